"""Notes of filings: heads found in a text, which of them count, the notes between them, and what is wrong with a split.

A text is cut at its heads into rows (key, nth, head, part); rules of order are windows over a document's heads, so that
texts are shuffled once and lie together by document. Row 0 is what stands before the first head.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may stand before a note's number and title; the ends of titles of consolidated and of separate notes;
#: where separate statements begin; heads inside the body of a section, and heads after a sentence's end.
_TITLE = r"<TITLE[^>]*>\s*(?:주\s*석\s*[-–—]?\s*)?\[?\s*(\d{1,2}(?:\s*[.\-]\s*(?:\d{1,2}|[A-Za-z])(?![A-Za-z]))?)\s*\]?\s*[.\-]?\s*((?:(?!</TITLE>).)+?)\s*"
CONSOLIDATED = r"(?s)" + _TITLE + r"\(\s*연결\s*\)\s*</TITLE>"
SEPARATE = r"(?s)" + _TITLE + r"\(\s*(?:별도|개별)\s*\)\s*</TITLE>"
BOUNDARY = r"<TITLE[^>]*>\s*(?:\d+(?:[.\-]\d+)?\.?\s*)?(?:별도|개별)?재무제표\s*(?:\(\s*별도\s*\))?\s*</TITLE>"
IN_BODY = r"(?i)<(?:SPAN|P|TITLE)\b[^>]*>\s*(\d{1,2})\s*\.\s*(?![\d\s.)])([^<]{1,200})"
MID_BODY = r"(?i)(?:</(?:SPAN|B|U|I|EM|STRONG)>|[다요]\.|니다|\)\.)\s{0,4}(\d{1,2})\s*\.\s*(?![\d\s.)])([^<]{1,200})"
#: Titles of the sections that hold notes, of sections that end one, and of those that only do with an anchor.
CONSOLIDATED_SECTION = r"^\s*(?:[\d.\-]+\s*)?연결\s*재무제표\s*(?:에\s*대한\s*)?주석\s*$"
SEPARATE_SECTION = r"^\s*(?:[\d.\-]+\s*)?(?:별도|개별)?\s*재무제표\s*(?:에\s*대한\s*)?주석\s*$"
SECTION_END = r"^\s*(?:[IVX]+\s*\.|【)|^\s*[\d.\-]+\s*(?:요약재무정보|연결재무제표|재무제표|배당에\s*관한\s*사항|증권의\s*발행|기타\s*재무에\s*관한\s*사항|대손충당금|재고자산)\s*(?:\(.*\))?\s*$"
ACCOUNT_TITLE = r"^\s*[\d.\-]+\s*(?:대손충당금|재고자산)\s*(?:\(.*\))?\s*$"
#: Where a head's line goes over into its text.
TITLE_CUT = r"\(\s*\d+\s*\)|\(\s*단위|보고기간|당기말|전기말|당기와|당기\s*중|당사의|회사의\s*|연결회사|연결기업|다음과\s*같"
#: Characters of a last note, and of a section, from which on it isn't searched; numbers a chain may skip.
MOST_LAST, LEAST_BLOCK, MOST_STEP = 300_000, 20_000, 4


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tidy_title(title: Column | str) -> Column:
    """A note's title without punctuation at its ends, a kind of statements after a dash, and numbers before it."""
    edge = lambda c: F.regexp_replace(c, r"^[ :·\-—.,]+|[ :·\-—.,]+$", "")
    held = F.regexp_replace(edge(F.trim(F.regexp_replace(title, r"\s+", " "))), r"\s*[-–—]\s*(?:연결|별도|개별)\s*$", "")
    return edge(F.regexp_replace(held, r"^(?:\s*\d{1,2}\s*[.,]\s*){1,4}", ""))


def clean_title(title: Column | str) -> Column:
    """The title of a head whose element goes on with text: up to where that begins, 60 characters at most."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(title, "<[^>]+>", ""), r"\s+", " "))
    cut = tidy_title(F.get(F.split(plain, TITLE_CUT, 2), F.lit(0)))
    return F.substring(bound(cut, lambda c: F.when(c != "", c).otherwise(tidy_title(plain))), 1, 60)


def note_number(number: Column | str) -> Column:
    """major and minor of a number like 3, 31-6, 11.1 or 6-B (6 and 2); minor is 0 without one."""
    flat = F.regexp_replace(number, r"\s+", "")
    minor = F.regexp_extract(flat, r"[.\-](.*)$", 1)
    letter = F.ascii(F.upper(F.substring(minor, 1, 1))) - 64
    value = F.when(minor.rlike(r"^\d+$"), minor.try_cast("int")).when(minor.rlike(r"^\p{L}"), letter).otherwise(0)
    return F.struct(F.regexp_extract(flat, r"^(\d+)", 1).try_cast("int").alias("major"), value.alias("minor"))


def parts(text: str, pattern: str) -> Column:
    """A text as an array of head and part; one struct for each part, so that no row carries all heads of its text. A text
    without heads is searched once."""

    def zipped(heads: Column) -> Column:
        cut = F.when(F.size(heads) == 0, F.array(text)).otherwise(F.split(text, pattern, -1))
        return F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), heads).alias("head"), cut.alias("part"))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), zipped)


def cut_at(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, nth, head and part: a text in rows, each a match of pattern (null in row 0) and what follows up to the next.
    Joined in order they are the text. Null texts have no row."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(parts(text, pattern)).alias("nth", "_p"))
    return rows.select(key, "nth", "_p.head", "_p.part")


def titled_notes(docs: DataFrame, key: str, text: str, pattern: str = CONSOLIDATED, boundary: str = BOUNDARY) -> DataFrame:
    """key, place, number, title and body of the notes whose heads are titles that fit pattern (number, title).

    The first note is the first with number 1, else the first. A number that falls to 1 or 2 after 5 or more begins other
    statements: there, or at the boundary, the notes end. Other numbers out of order stay; a head that repeats the number
    before it begins no note, its text goes on with that one's. The last note has MOST_LAST characters at most.
    """
    by = Window.partitionBy(key).orderBy("nth")
    whole = Window.partitionBy(key)
    rows = cut_at(docs, key, text, pattern).where("nth > 0").withColumn("number", F.regexp_extract("head", pattern, 1)).withColumn("_k", note_number("number"))
    rows = rows.withColumn("_first", F.coalesce(F.min(F.when(F.col("_k.major") == 1, F.col("nth"))).over(whole), F.lit(1))).where("nth >= _first")
    before = F.lag("_k").over(by)
    ends = F.nullif(F.regexp_instr("part", F.lit(boundary)), F.lit(0))
    rows = rows.withColumns({"_ends": ends, "_reset": (F.col("_k.major") <= 2) & (before["major"] >= 5), "_again": F.coalesce(F.col("_k") == before, F.lit(False))})
    rows = rows.withColumn("_stop", F.least(F.min(F.when(F.col("_reset"), F.col("nth"))).over(whole), F.min(F.when(F.col("_ends").isNotNull(), F.col("nth") + 1)).over(whole)))
    rows = rows.where("_stop IS NULL OR nth < _stop").withColumn("place", F.sum(F.when(F.col("_again"), 0).otherwise(1)).over(by))
    body = F.concat("head", F.when(F.col("_ends").isNotNull(), F.expr("substring(part, 1, _ends - 1)")).otherwise(F.col("part")))
    first = F.min_by(F.struct(F.regexp_replace("number", r"\s+", "").alias("number"), tidy_title(F.regexp_extract("head", pattern, 2)).alias("title")), "nth")
    notes = rows.withColumn("_piece", body).groupBy(key, "place").agg(first.alias("_f"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "_piece"))), lambda s: s["_piece"]), "").alias("body"))
    last = F.max("place").over(whole)
    return notes.select(key, "place", "_f.number", "_f.title", F.when(F.col("place") == last, F.substring("body", 1, MOST_LAST)).otherwise(F.col("body")).alias("body"))


def heads_of(docs: DataFrame, key: str, text: str, patterns: tuple[str, ...]) -> DataFrame:
    """key, kind, at (characters before), head and the groups number and title of each match of each pattern; kind is the
    pattern's place. Each text is cut once for each pattern where it lies, not in a union of cuts: of texts that are dealt out
    by key Spark 4.1 takes a union to be so too and shuffles it no more, but where its sides come to read one shuffle, it may
    lay them one after the other, and rows of a key no longer meet."""
    each = lambda f: F.coalesce(*(F.when(F.col("kind") == i, f(p)) for i, p in enumerate(patterns)))
    kinds = docs.where(F.col(text).isNotNull()).select(key, text, F.explode(F.array(*map(F.lit, range(len(patterns))))).alias("kind"))
    rows = kinds.select(key, "kind", F.posexplode(each(lambda p: parts(text, p))).alias("nth", "_p")).select(key, "kind", "nth", "_p.head", F.length("_p.part").alias("_n"))
    # what stands before head n: all parts before it, and the heads before it
    before = Window.partitionBy(key, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.sum(F.col("_n") + F.coalesce(F.length("head"), F.lit(0))).over(before) - F.col("_n") - F.coalesce(F.length("head"), F.lit(0)))
    group = lambda i: each(lambda p: F.regexp_extract("head", p, i))
    return rows.where("nth > 0").select(key, "kind", F.col("at").cast("int").alias("at"), "head", group(1).cast("int").alias("number"), group(2).alias("title"))


def longest_chain(numbers: Column, step: int = MOST_STEP) -> Column:
    """The places in an array of numbers from 1 to 99 of the longest rising chain whose neighbours differ by step at most;
    of equal ones, the one that ends first, and each link the first possible. The fold holds one chain for each number."""
    none = F.array_repeat(F.array().cast("array<int>"), 100)

    def add(state: Column, x: Column) -> Column:
        before = F.slice(state, F.greatest(x["number"] - step, F.lit(1)), F.least(F.lit(step), x["number"] - 1))
        rated = F.transform(before, lambda c: F.struct(F.size(c), -F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0)), c.alias("chain")))
        chain = F.concat(F.coalesce(F.array_max(rated)["chain"], F.array().cast("array<int>")), F.array(x["place"]))
        longer = lambda c: F.size(c) > F.size(F.get(state, x["number"] - 1))
        put = lambda c: F.concat(F.slice(state, F.lit(1), x["number"] - 1), F.array(c), F.slice(state, x["number"] + 1, F.lit(100)))
        return bound(chain, lambda c: F.when(longer(c), put(c)).otherwise(state))

    places = F.transform(numbers, lambda n, i: F.struct(n.alias("number"), i.alias("place")))
    rated = F.transform(F.aggregate(places, none, add), lambda c: F.struct(F.size(c), -F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0)), c.alias("chain")))
    return F.array_max(rated)["chain"]


def chained_notes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, number, title and body of the notes whose heads stand in the body of a section: of all that look like
    heads, the longest rising chain (longest_chain). A head that is a section's own title, or that the text begins with, is
    none; numbers from 1 to 99."""
    heads = heads_of(docs, key, text, (IN_BODY, MID_BODY)).where("number BETWEEN 1 AND 99")
    plain = F.trim(F.regexp_replace(F.regexp_replace("title", "<[^>]+>", ""), r"\s+", " "))
    heads = heads.where((F.col("kind") == 1) | ((F.col("at") > 0) & ~plain.rlike(CONSOLIDATED_SECTION) & ~plain.rlike(SEPARATE_SECTION)))
    lists = heads.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "kind", "number", clean_title("title").alias("title")))).alias("h"))
    chains = lists.select(key, F.transform(longest_chain(F.col("h.number")), lambda i: F.get("h", i)).alias("c"))
    met = docs.select(key, text).join(chains, key)
    end = lambda i: F.coalesce(F.get("c", i + 1)["at"], F.length(text))
    notes = F.transform("c", lambda x, i: F.struct((i + 1).alias("place"), x["number"].cast("string").alias("number"), x["title"].alias("title"), F.substr(F.col(text), x["at"] + 1, end(i) - x["at"]).alias("body")))
    return met.select(key, F.inline(notes))


def note_block(docs: DataFrame, key: str, text: str, consolidated: bool = True) -> DataFrame:
    """key and block: the longest part of a text from the title of a section of notes to the next title that ends one. A
    title that is an account's name ends one only with an anchor of the table of contents in its tag."""
    rows = cut_at(docs, key, text, r"(?s)<TITLE[^>]*>.{0,200}?</TITLE>").where("nth > 0")
    title = F.trim(F.regexp_replace(F.regexp_replace("head", "<[^>]+>", ""), r"\s+", " "))
    separate = title.rlike(SEPARATE_SECTION) & ~title.contains("연결")
    anchored = F.upper(F.regexp_extract("head", r"^<TITLE([^>]*)>", 1)).contains("AASSOCNOTE")
    ends = title.rlike(CONSOLIDATED_SECTION) | separate | (title.rlike(SECTION_END) & (~title.rlike(ACCOUNT_TITLE) | anchored))
    begins = title.rlike(CONSOLIDATED_SECTION) if consolidated else separate
    run = F.sum(F.when(ends, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("nth"))
    rows = rows.select(key, "nth", run.alias("run"), (begins & ends).alias("own"), F.concat("head", "part").alias("piece"))
    blocks = rows.groupBy(key, "run").agg(F.max_by("own", -F.col("nth")).alias("own"), F.min("nth").alias("nth"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "piece"))), lambda s: s["piece"]), "").alias("block"))
    return blocks.where("own").groupBy(key).agg(F.max_by("block", F.struct(F.length("block"), -F.col("nth"))).alias("block"))


def split_notes(docs: DataFrame, key: str, text: str, least_block: int = LEAST_BLOCK) -> DataFrame:
    """key, place, number, title and body of a filing's consolidated notes: those with titles of their own if they begin with
    number 1 or are 12 at least; else those in the body of its section of notes, if they are more."""
    held = lambda df, name: df.groupBy(key).agg(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "number", "title", "body")).alias(name))
    blocks = note_block(docs, key, text).where(F.length("block") > least_block)
    # a join, as a union of both may not keep a filing's notes together (see heads_of)
    both = held(titled_notes(docs, key, text), "_t").join(held(chained_notes(blocks, key, "block"), "_c"), key, "full").where(F.col(key).isNotNull())
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    opens = F.exists("_t", lambda x: (x["place"] == 1) & (note_number(x["number"])["major"] == 1))
    rule = F.coalesce(opens, F.lit(False)) | (n("_t") >= 12) | (n("_c") <= n("_t"))
    return both.select(key, F.inline(F.when(rule, F.col("_t")).otherwise(F.col("_c"))))


def section_issues(notes: DataFrame, key: str, n_chars: Column, fewest: int = 12, most_chars: int = 200_000, share: float = 0.3) -> DataFrame:
    """key, n, issues and gaps of each document's notes (key, number): few (fewer notes than fewest), large (one of more
    characters than most_chars), gaps (of the numbers up to the largest, more than share of it aren't there)."""
    rows = notes.select(key, note_number("number")["major"].alias("_m"), n_chars.alias("_n"))
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.max("_n").alias("_big"), F.max("_m").alias("_top"), F.collect_set("_m").alias("_s"))
    gaps = F.sort_array(F.array_except(F.sequence(F.lit(1), F.greatest("_top", F.lit(1))), F.col("_s")))
    kinds = F.array(F.when(F.col("n") < fewest, "few"), F.when(F.col("_big") > most_chars, "large"), F.when(F.size(gaps) > F.col("_top") * share, "gaps"))
    return found.select(key, "n", F.array_compact(kinds).alias("issues"), gaps.alias("gaps"))


def stale_tails(stored: DataFrame, split: DataFrame, key: str, ratio: float = 1.15, more: int = 2) -> DataFrame:
    """key, verdict and lost of the documents that were split again, by the notes (key, number) stored of them: tail_lost if
    the new notes have numbers above the largest stored one (lost lists them), stale if they are more than ratio times
    those stored and some, null if neither. A document that wasn't split again isn't judged."""
    of = lambda df, name: df.select(key, note_number("number")["major"].alias("_m")).groupBy(key).agg(F.count("*").alias(f"_n_{name}"), F.max("_m").alias(f"_top_{name}"), F.collect_set("_m").alias(f"_s_{name}"))
    both = of(split, "new").join(of(stored, "old").drop("_s_old"), key, "left")
    lost = F.sort_array(F.filter("_s_new", lambda m: m > F.coalesce("_top_old", F.lit(0))))
    verdict = F.when(F.size(lost) > 0, "tail_lost").when(F.col("_n_new") > F.coalesce("_n_old", F.lit(0)) * ratio + more, "stale")
    return both.select(key, verdict.alias("verdict"), lost.alias("lost"))
