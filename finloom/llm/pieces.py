"""Cutting texts where byte-level BPE can never join symbols, so that each piece is tokenized once and remembered.

A byte-level pre-tokenizer ends a token before a blank or line end that stands between two characters other than
white space. Pieces cut there are tokenized alike alone and in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_DOUBLE = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def cut_pieces(text: str) -> list[str]:
    """A text cut before each blank or line end between two characters other than white space."""
    return _CUT.split(text)


#: Pieces that one Python worker remembers of either kind; about 200 bytes each.
REMEMBERED = 250_000


class _Memory(dict):
    """Values by piece. When half of the most are new, those not asked for since the last time are forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.old = most // 2, {}

    def lacking(self, wanted: set[str]) -> set[str]:
        """Those of wanted, of which none is new, that aren't old either; the others become new."""
        again = wanted.intersection(self.old) if self.old else set()
        self.update((p, self.old[p]) for p in again)
        return wanted - again

    def age(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


class PieceValues:
    """Values of the pieces of texts, found by find(list of pieces) -> list of values for pieces not remembered.

    Values can be added: a comma or full stop after a letter is a token of its own, so the value of such a piece is
    that of the piece without it plus that of the mark.
    """

    def __init__(self, find: Callable[[list[str]], Iterable], remembered: int = REMEMBERED):
        self.find = find
        self.spaced = _Memory(remembered)  # of a piece with a blank before it, unless it starts with a line end
        self.plain = _Memory(remembered)
        self.mark: dict[str, object] = {}

    def _cut(self, text: str) -> tuple[list[str], list[str]]:
        if _DOUBLE.search(text) is None:
            first, *rest = text.replace("\n", " \n").split(" ")
            return ([first] if first else []), rest
        return _CUT.split(text), []

    def _learn(self, known: _Memory, wanted: set[str], spaced: bool) -> None:
        new = known.lacking(wanted)
        marked = {p for p in new if len(p) > 1 and p[-1] in ",." and p[-2].isalpha()}
        stems = new - marked
        if marked:
            if not self.mark:
                self.mark = dict(zip(",.", self.find([",", "."]), strict=True))
            stems |= known.lacking({p[:-1] for p in marked}.difference(known, stems))
        if stems:
            ordered = [*stems]
            known.update(zip(ordered, self.find([p if not spaced or p[:1] == "\n" else " " + p for p in ordered]), strict=True))
        for p in marked:
            known[p] = known[p[:-1]] + self.mark[p[-1]]

    def _values(self, known: _Memory, lists: list[list[str]], spaced: bool) -> list[list]:
        known.age()
        get = known.get
        values = [[*map(get, pieces)] for pieces in lists]
        gaps = [[i for i, v in enumerate(row) if v is None] for row in values]
        self._learn(known, {pieces[i] for pieces, row in zip(lists, gaps, strict=True) for i in row}, spaced)
        for pieces, row, at in zip(lists, values, gaps, strict=True):
            for i in at:
                row[i] = known[pieces[i]]
        return values

    def of(self, texts: list[str]) -> list[list]:
        """The values of each text's pieces, in order."""
        cut = [self._cut(t) for t in texts]
        plain, spaced = self._values(self.plain, [a for a, _ in cut], False), self._values(self.spaced, [b for _, b in cut], True)
        return [a + b for a, b in zip(plain, spaced, strict=True)]
