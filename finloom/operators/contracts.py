"""Filings of supply contracts: forms of labels and values, read by labels wherever they stand, and the edges they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import latest_per_key
from .relations import resolved

#: Labels of a contract's amount, in order, its other side, its date and its end; titles of such filings, and of
#: corrections.
AMOUNTS, PARTY, SIGNED, ENDS = ("계약금액 총액", "확정 계약금액"), "계약상대방", "계약(수주)일자", "종료일"
TITLE, CORRECTION = "단일판매", "기재정정"
ROW, CELL = r"(?is)<TR\b[^>]*>(.*?)</TR>", r"(?is)<(?:TD|TH)\b[^>]*>(.*?)</(?:TD|TH)>"


def is_contract(title: Column) -> Column:
    """Whether a filing's title is that of a contract, and of no correction."""
    return F.coalesce(title.contains(TITLE) & ~title.contains(CORRECTION), F.lit(False))


def value_of(rows: Column, label: str) -> Column:
    """The last cell of the first row of several in which a cell before it contains the label; null without one."""
    fits = F.filter(rows, lambda r: (F.size(r) >= 2) & F.exists(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), lambda c: c.contains(label)))
    return F.trim(F.try_element_at(F.get(fits, F.lit(0)), F.lit(-1)))


def contract_forms(docs: DataFrame, key: str, text: str, received: Column) -> DataFrame:
    """key, counterparty, amount, year and valid_until of filings in HTML: the amount by the first of AMOUNTS that has one other
    than 0, the year of the contract's date, else that of received. Null texts and texts without rows have nulls."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), "&nbsp;|\\u00a0", " "), r"\s+", " "))
    rows = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(ROW), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)), plain))
    read = docs.select(key, received.alias("_received"), rows.alias("_rows"))
    number = lambda label: F.nullif(F.replace(value_of(F.col("_rows"), label), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))
    date = lambda label: F.nullif(F.regexp_extract(value_of(F.col("_rows"), label), r"\d{4}-\d{2}-\d{2}", 0), F.lit(""))
    year = F.coalesce(F.substring(date(SIGNED), 1, 4).cast("int"), F.year("_received"))
    return read.select(key, value_of(F.col("_rows"), PARTY).alias("counterparty"), F.coalesce(*map(number, AMOUNTS)).alias("amount"), year.alias("year"), date(ENDS).alias("valid_until"))


def contract_edges(forms: DataFrame, book: DataFrame, reporter: str, key: str) -> DataFrame:
    """forms with fate, source and target: kept edges go from the firm that files to its customer. A form without a
    counterparty has fate no_counterparty, one whose name isn't in the book (relations.name_book) link_failed, one with
    itself own. Repeated forms of one (source, target, year, key) are one."""
    met = resolved(forms, "counterparty", book)
    fate = F.when(F.coalesce("counterparty", F.lit("")) == "", "no_counterparty").when(F.col("code").isNull(), "link_failed").when(F.col("code") == F.col(reporter), "own").otherwise("kept")
    out = met.withColumn("fate", fate).withColumn("source", F.col(reporter)).withColumn("target", F.when(fate == "kept", F.col("code"))).drop("code", "queued")
    return latest_per_key(out, ["source", "target", "year", key], [F.col("amount").desc_nulls_last(), F.col("counterparty")])
