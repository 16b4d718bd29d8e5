"""Tables in filings: cells from HTML or markdown, then layouts as joins of cells with their row's and column's heads.

Only the reading of a document into cells is Python, document by document; all that follows is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import amount
from ..functions.texts import first_match

#: A cell may span so many rows and columns at most, as browsers have it.
MOST_SPAN = 1000


class _Cells(HTMLParser):
    """Cells of a document's tables as (table, row, column, text), with spans filled."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[int, int, int, str]] = []
        self.tables, self.open, self.row, self.text, self.span = 0, [], None, None, (1, 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self._close_cell()
            self.open.append([self.tables, -1, {}])  # number, row, cells that reach down: (row, column) -> text
            self.tables += 1
        elif self.open and tag == "tr":
            self._close_cell()
            self.open[-1][1] += 1
        elif self.open and tag in ("td", "th", "te", "tu"):
            self._close_cell()
            a = dict(attrs)
            size = lambda k: min(MOST_SPAN, int(v)) if (v := (a.get(k) or "1")).isdigit() and int(v) else 1
            self.text, self.span = [], (size("rowspan"), size("colspan"))

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "te", "tu", "tr", "table"):
            self._close_cell()
        if tag == "table" and self.open:
            self.open.pop()

    def _close_cell(self) -> None:
        if self.text is None or not self.open:
            self.text = None
            return
        table, row, reach = self.open[-1]
        row = max(row, 0)
        column = 0
        while (row, column) in reach:
            column += 1
        text = " ".join("".join(self.text).split())
        for r in range(row, row + self.span[0]):
            for c in range(column, column + self.span[1]):
                reach[r, c] = text
                self.out.append((table, r, c, text))
        self.text = None


def _markdown(text: str) -> list[tuple[int, int, int, str]]:
    out, table, row, inside = [], -1, 0, False
    for line in text.split("\n"):
        line = line.strip()
        if not line.startswith("|"):
            inside = False
        elif not re.fullmatch(r"[|\s:\-]+", line):
            table, row = (table, row + 1) if inside else (table + 1, 0)
            inside = True
            out += [(table, row, c, " ".join(x.split())) for c, x in enumerate(line.strip("|").split("|"))]
    return out


def table_cells(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, table, row, col and text of each cell of a document's HTML or markdown tables. A cell over several rows or
    columns is there for each (spans over MOST_SPAN count as that). Null texts and texts without tables have none."""
    kind = docs.schema[key].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[text], strict=True):
                if "<table" in t.lower():
                    parser = _Cells()
                    parser.feed(t)
                    parser.close()
                    found = parser.out
                else:
                    found = _markdown(t)
                rows += [(k, *cell) for cell in found]
            yield pd.DataFrame(rows, columns=[key, "table", "row", "col", "text"])

    held = docs.where(F.col(text).rlike(r"(?i)<table|(?m)^\s*\|")).select(key, text)
    return held.mapInPandas(read, f"{key} {kind}, table int, row int, col int, text string")


def with_heads(cells: DataFrame, key: str, carry: bool = False) -> DataFrame:
    """The cells that aren't heads, with label (the row's first cell) and head (the column's first). carry: a blank label
    is the one above."""
    label = F.first("text").over(Window.partitionBy(key, "table", "row").orderBy("col"))
    head = F.first("text").over(Window.partitionBy(key, "table", "col").orderBy("row"))
    out = cells.withColumn("label", label).withColumn("head", head)
    if carry:
        above = Window.partitionBy(key, "table", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("label", F.last(F.nullif("label", F.lit("")), ignorenulls=True).over(above))
    return out.where("row > 0 AND col > 0")


#: What dealings are called, by whether the named firm buys or sells.
DEALS = (("매출|판매|수익", "customer"), ("매입|구매|비용", "supply"))


def dealings(cells: DataFrame, key: str, rules: Sequence[tuple[str, str]] = DEALS) -> DataFrame:
    """key, company, deal and amount of a document's dealings, by the first of these layouts that gives any: rows of
    deals under companies, rows of companies under deals, the same with blank companies carried down. A label that fits
    deals of two kinds is no deal."""

    def layout(rows: DataFrame, deal: str, company: str, place: int) -> DataFrame:
        kinds = F.array_compact(F.array(*(F.when(F.col(deal).rlike(p), v) for p, v in rules)))
        found = rows.withColumn("deal", F.when(F.size(F.array_distinct(kinds)) == 1, kinds[0])).withColumn("amount", amount("text"))
        kept = found.where(F.col("deal").isNotNull() & F.col("amount").isNotNull() & (F.length(F.trim(F.col(company))) > 0))
        return kept.select(key, F.col(company).alias("company"), "deal", "amount", F.lit(place).alias("_layout"))

    plain, carried = with_heads(cells, key), with_heads(cells, key, carry=True)
    all_ = layout(plain, "label", "head", 0).unionByName(layout(plain, "head", "label", 1)).unionByName(layout(carried, "head", "label", 2))
    best = all_.withColumn("_best", F.min("_layout").over(Window.partitionBy(key)))
    return best.where("_layout = _best").drop("_layout", "_best")


def best_table(cells: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """key and table of the table with the most of the required row labels, the first of equal ones, if it has all."""
    labels = cells.where("col = 0").select(key, "table", F.col("text").alias("label")).where(F.col("label").isin(list(required)))
    n = labels.groupBy(key, "table").agg(F.countDistinct("label").alias("n"))
    best = n.groupBy(key).agg(F.max_by(F.struct("table", "n"), F.struct("n", -F.col("table"))).alias("b"))
    return best.where(F.col("b.n") == len(required)).select(key, F.col("b.table").alias("table"))


#: Units of amounts in statements.
UNITS = (("십억\\s*원", 1e9), ("백만\\s*원", 1e6), ("천\\s*원", 1e3), ("원", 1.0))


def unit_scale(text: Column) -> Column:
    """The won of a note such as (단위: 백만원); 1 without one."""
    out = F.when(text.isNull(), F.lit(1.0))
    for pattern, scale in UNITS:
        out = out.when(text.rlike(rf"단위\s*[:：]?\s*\(?\s*{pattern}"), scale)
    return out.otherwise(1.0)


def statement_items(docs: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """key, table, account, name, column (0 for the latest) and amount in won of the rows whose name fits a rule."""
    scales = docs.select(key, unit_scale(F.col(text)).alias("_scale"))
    rows = with_heads(table_cells(docs, key, text), key).withColumn("account", first_match("label", rules)).where("account IS NOT NULL")
    items = rows.withColumn("amount", amount("text")).where("amount IS NOT NULL")
    return items.join(scales, key).select(key, "table", "account", F.col("label").alias("name"), (F.col("col") - 1).alias("column"), (F.col("amount") * F.col("_scale")).alias("amount"))


def sections(docs: DataFrame, key: str, text: str, heading: str) -> DataFrame:
    """key, place, title and body of a text's parts that start with a heading line; what stands before the first is
    place 0 with a null title, if there is any."""
    marked = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?m)^({heading})", "\u0001$1"), "\u0001")
    parts = docs.select(key, F.posexplode(marked).alias("place", "part"))
    title = F.when(F.col("place") > 0, F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)))
    body = F.when(F.col("place") > 0, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part"))
    return parts.select(key, "place", title.alias("title"), body.alias("body")).where("place > 0 OR length(trim(body)) > 0")


def capped_sections(parts: DataFrame, key: str, each: int = 4_500, total: int = 13_000) -> DataFrame:
    """key and text: a document's sections in order, each characters of each, until total are full: an excerpt."""
    cut = parts.withColumn("_t", F.substring("body", 1, each))
    before = F.sum(F.length("_t")).over(Window.partitionBy(key).orderBy("place")) - F.length("_t")
    kept = cut.withColumn("_t", F.substr(F.col("_t"), F.lit(1), F.greatest(F.lit(0), F.lit(total) - before))).where(F.length("_t") > 0)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "_t"))), lambda s: s["_t"]), "\n").alias("text"))


def missing_numbers(parts: DataFrame, key: str, number: str) -> DataFrame:
    """key, n, most and missing (numbers from 1 to the largest that aren't there)."""
    seen = parts.where(F.col(number) > 0).groupBy(key).agg(F.count("*").alias("n"), F.max(number).alias("most"), F.collect_set(number).alias("_s"))
    return seen.select(key, "n", "most", F.sort_array(F.array_except(F.sequence(F.lit(1), F.col("most").cast("int")), F.col("_s").cast("array<int>"))).alias("missing"))


def quotes_held(facts: DataFrame, sources: DataFrame, key: str, quote: str, text: str) -> DataFrame:
    """facts with held: whether the source of their key holds the quote, white space apart; false without a source."""
    flat = lambda c: F.regexp_replace(F.col(c), r"\s+", "")
    whole = sources.select(key, flat(text).alias("_text"))
    return facts.join(whole, key, "left").withColumn("held", F.coalesce(F.contains("_text", flat(quote)), F.lit(False))).drop("_text")


def shares_of_products(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, product and share (0 to 1) of rows with a share in percent, the largest of a product's."""
    rows = with_heads(table_cells(docs, key, text), key).where(F.col("text").rlike(r"^\s*\(?[0-9.,]+\s*%\)?\s*$"))
    value = F.regexp_replace("text", r"[%()\s,]", "").try_cast("double") / 100
    return rows.where("label NOT RLIKE '합계|총계|계$'").groupBy(key, F.col("label").alias("product")).agg(F.max(value).alias("share"))
