"""Queries of notes and names in texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import core as A
from ..operators import mentions as M
from ..operators import notes as N
from ..operators import tables as T
from .tables import PANEL_SQL, panel, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The sentences of documents, by number.
SENTENCES_SQL = r"SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS l FROM documents)"


def spread(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text of documents, by doc_id on all tasks: a file of one row group is read by one, which would search all
    of its texts; rows that are cut out of them lie together by document then, and aren't shuffled again."""
    return table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d).select("doc_id", F.split(F.coalesce("text", F.lit("")), r"\. ", -1).alias("l"))


def filings(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text: documents as filings whose sentences are notes with titles; numbers rise to 40 and begin again, some
    repeat, some have a letter; every third has separate statements after its 24th sentence."""

    def note(s, i):
        n = F.length(s)
        number = F.greatest(F.lit(0), i - (n % 5 == 0).cast("int")) % 40 + 1 + F.when(F.col("doc_id") % 4 == 0, 2).otherwise(0)
        ends = F.when((i == 23) & (F.col("doc_id") % 3 == 0), "<TITLE>재무제표</TITLE>").otherwise("")
        return F.concat(F.lit("<TITLE>"), number.cast("string"), F.when(n % 7 == 0, "-A").otherwise(""), F.lit(". 가"), n.cast("string"), F.lit(" (연결)</TITLE>"), s, ends)

    return _sentences(spark, d).select("doc_id", F.array_join(F.transform("l", note), "").alias("text"))


NOTES_SQL = f"""
SELECT doc_id, place, CAST(min_by(v, i) AS VARCHAR) || min_by(letter, i) AS number, min_by(v, i) AS major, '가' || CAST(min_by(n, i) AS VARCHAR) AS title, least(sum(size), CASE WHEN place = any_value(last) THEN 300000 END) AS n_chars
FROM (SELECT *, max(place) OVER (PARTITION BY doc_id) AS last FROM (SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS place FROM (
  SELECT *, min(CASE WHEN reset THEN i END) OVER (PARTITION BY doc_id) AS stop, min(CASE WHEN i = 24 AND doc_id % 3 = 0 THEN i + 1 END) OVER (PARTITION BY doc_id) AS bound FROM (
    SELECT *, coalesce(v <= 2 AND lag(v) OVER w >= 5, FALSE) AS reset, coalesce(v = lag(v) OVER w AND letter = lag(letter) OVER w, FALSE) AS again FROM (
      SELECT *, coalesce(min(CASE WHEN v = 1 THEN i END) OVER (PARTITION BY doc_id), 1) AS first FROM (
        SELECT doc_id, i, n, v, letter, n + 7 + len(CAST(v AS VARCHAR)) + len(letter) + 3 + len(CAST(n AS VARCHAR)) + 13 AS size FROM (
          SELECT doc_id, i, len(s) AS n, greatest(0, i - 1 - CASE WHEN len(s) % 5 = 0 THEN 1 ELSE 0 END) % 40 + 1 + CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END AS v, CASE WHEN len(s) % 7 = 0 THEN '-A' ELSE '' END AS letter FROM ({SENTENCES_SQL}))))
    WHERE i >= first WINDOW w AS (PARTITION BY doc_id ORDER BY i)))
  WHERE (stop IS NULL OR i < stop) AND (bound IS NULL OR i < bound))) GROUP BY 1, 2"""


@query(f"SELECT doc_id, place, number, title, n_chars FROM ({NOTES_SQL})")
def filing_notes(spark: SparkSession, d: str) -> DataFrame:
    return N.titled_notes(filings(spark, d), "doc_id", "text").select("doc_id", "place", "number", "title", F.length("body").alias("n_chars"))


@query(f"""
WITH n AS ({NOTES_SQL}), m AS (SELECT doc_id, count(*) AS n, max(n_chars) AS big, max(major) AS top, count(DISTINCT major) AS d, max(place) AS last, list(DISTINCT major) AS s FROM n GROUP BY 1),
o AS (SELECT doc_id, count(*) AS k, max(major) AS top FROM n JOIN (SELECT doc_id, last FROM m) USING (doc_id) WHERE place <= last - doc_id % 4 GROUP BY 1)
SELECT doc_id, n, array_to_string(list_filter([CASE WHEN n < 12 THEN 'few' END, CASE WHEN big > 300 THEN 'large' END, CASE WHEN m.top - d > m.top * 0.3 THEN 'gaps' END], lambda x: x IS NOT NULL), ',') AS issues, m.top - d AS n_gaps,
       CASE WHEN m.top > coalesce(o.top, 0) THEN 'tail_lost' WHEN n > coalesce(k, 0) * 1.15 + 2 THEN 'stale' END AS verdict, len(list_filter(s, lambda x: x > coalesce(o.top, 0))) AS n_lost
FROM m LEFT JOIN o USING (doc_id)""")
def section_health(spark: SparkSession, d: str) -> DataFrame:
    notes = N.titled_notes(filings(spark, d), "doc_id", "text").select("doc_id", "place", "number", F.length("body").alias("n_chars"))
    last = F.max("place").over(Window.partitionBy("doc_id"))
    stored = notes.withColumn("last", last).where("place <= last - doc_id % 4")
    issues = N.section_issues(notes, "doc_id", F.col("n_chars"), most_chars=300)
    found = issues.join(N.stale_tails(stored, notes, "doc_id"), "doc_id")
    return found.select("doc_id", "n", F.array_join("issues", ",").alias("issues"), F.size("gaps").alias("n_gaps"), "verdict", F.size("lost").alias("n_lost"))


def sections_of_notes(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text: documents as sections whose sentences have heads in the body, with numbers out of place among them."""

    def note(s, i):
        n = F.length(s)
        number = F.when(n % 6 == 0, n % 60 + 1).otherwise(F.floor((i % 120) / 2) + n % 3 + 1)
        return F.concat(F.lit("<P>"), number.cast("string"), F.lit(". 가"), n.cast("string"), F.lit("</P>"), s)

    return _sentences(spark, d).select("doc_id", F.concat(F.lit("-"), F.array_join(F.transform("l", note), "")).alias("text"))


@query(f"""
WITH RECURSIVE s AS (SELECT *, n + 3 + len(CAST(v AS VARCHAR)) + 3 + len(CAST(n AS VARCHAR)) + 4 AS size FROM (
  SELECT doc_id, i, len(s) AS n, CASE WHEN len(s) % 6 = 0 THEN len(s) % 60 + 1 ELSE (i - 1) % 120 // 2 + len(s) % 3 + 1 END AS v FROM ({SENTENCES_SQL}))),
l AS (SELECT doc_id, list(v ORDER BY i) AS v FROM s GROUP BY 1),
dp AS (SELECT doc_id, v, 1 AS i, [1] AS l, [0] AS b FROM l UNION ALL
  SELECT doc_id, v, i + 1, list_append(l, list_max(c) + 1), list_append(b, CASE WHEN list_max(c) = 0 THEN 0 ELSE list_position(c, list_max(c)) END) FROM (
    SELECT *, list_transform(range(1, i + 1), lambda j: CASE WHEN v[j] < v[i + 1] AND v[i + 1] <= v[j] + 4 THEN l[j] ELSE 0 END) AS c FROM dp WHERE i < len(v))),
e AS (SELECT doc_id, b, list_position(l, list_max(l)) AS i FROM dp WHERE i = len(v)),
chain AS (SELECT doc_id, b, i FROM e UNION ALL SELECT doc_id, b, b[i] FROM chain WHERE b[i] > 0),
t AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY i) - size AS start, sum(size) OVER (PARTITION BY doc_id) AS whole FROM s)
SELECT doc_id, row_number() OVER w AS place, CAST(v AS VARCHAR) AS number, '가' || CAST(n AS VARCHAR) AS title, coalesce(lead(start) OVER w, whole) - start AS n_chars
FROM chain JOIN t USING (doc_id, i) WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def body_notes(spark: SparkSession, d: str) -> DataFrame:
    return N.chained_notes(sections_of_notes(spark, d), "doc_id", "text").select("doc_id", "place", "number", "title", F.length("body").alias("n_chars"))


def corpus_names(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and name: for each supplier a few characters out of a document, as a name of that document's own."""
    made = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7 % 200).alias("doc_id"), (1 + F.col("s_suppkey") * 13 % 90).cast("int").alias("at"), (2 + F.col("s_suppkey") % 9).cast("int").alias("size"))
    return made.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.expr("substr(text, at, size)").alias("name"))


#: Names as DuckDB finds them: one pattern of all, the longest first.
NAMES_SQL = r"""
  SELECT doc_id, regexp_replace(substr(text, CAST(1 + s_suppkey * 13 % 90 AS BIGINT), CAST(2 + s_suppkey % 9 AS BIGINT)), '^\s+|\s+$', '', 'g') AS name
  FROM (SELECT s_suppkey, s_suppkey * 7 % 200 AS doc_id FROM supplier) JOIN documents USING (doc_id)"""
PATTERN_SQL = f"SELECT coalesce(string_agg(regexp_escape(name), '|' ORDER BY len(name) DESC, name), '$.') AS p FROM (SELECT DISTINCT name FROM ({NAMES_SQL}) WHERE len(name) >= 2)"


@query(f"""
SELECT doc_id, name, count(*) AS n, name IN (SELECT name FROM ({NAMES_SQL}) o WHERE o.doc_id = f.doc_id) AS own FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, p)) AS name FROM documents, ({PATTERN_SQL})) f GROUP BY doc_id, name""")
def name_mentions(spark: SparkSession, d: str) -> DataFrame:
    names = corpus_names(spark, d)
    found = M.names_in_texts(spread(spark, d), ["doc_id"], "text", names, "name").groupBy("doc_id", "name").agg(F.count("*").alias("n"))
    own = names.select("doc_id", F.regexp_replace("name", r"^\s+|\s+$", "").alias("name")).distinct().withColumn("own", F.lit(True))
    return found.join(own, ["doc_id", "name"], "left").withColumn("own", F.coalesce("own", F.lit(False)))


#: Words whose sentences are candidates, as documents have no words of relations.
GATE = ("the", "der", "que")


@query(f"""
WITH RECURSIVE c AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS nth FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])(\\s+)|(\\n{{2,}})', '\\1\x01\\2\\3\x02', 'g'), '\x01') AS l FROM documents)),
a AS (SELECT *, sum(len(replace(x, '\x02', ''))) OVER (PARTITION BY doc_id ORDER BY nth) AS e, CASE WHEN contains(x, '\x02') THEN split_part(x, '\x02', 2) ELSE x END AS s FROM c),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS i, e - len(s) AS b, e, s FROM a WHERE regexp_matches(s, '\\S')),
f AS (SELECT doc_id, i, b, e, regexp_matches(s, '{"|".join(GATE)}') OR len(list_filter(regexp_extract_all(s, p), lambda m: NOT coalesce(list_contains(own, m), FALSE))) > 0 AS f
      FROM n LEFT JOIN (SELECT doc_id, list(name) AS own FROM ({NAMES_SQL}) GROUP BY 1) USING (doc_id), ({PATTERN_SQL})),
g AS (SELECT *, bool_or(f) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM f),
h AS (SELECT doc_id, i, b, e, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g WHERE near),
r AS (SELECT doc_id, run, min(i) AS f, list(b ORDER BY i) AS b, list(e ORDER BY i) AS e FROM h GROUP BY 1, 2),
k AS (SELECT doc_id, b, e, 1 AS p, 1 AS q, e[1] - b[1] AS t FROM r UNION ALL
  SELECT doc_id, b, e, CASE WHEN t + e[q + 1] - b[q + 1] <= 300 THEN p ELSE q + 1 END, q + 1, CASE WHEN t + e[q + 1] - b[q + 1] <= 300 THEN t ELSE 0 END + e[q + 1] - b[q + 1] FROM k WHERE q < len(b)),
o AS (SELECT doc_id, b[p] AS start, least(max(e[q]), b[p] + 300) AS "end" FROM k GROUP BY doc_id, b[p])
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS seq, start, "end", md5(substr(text, CAST(start + 1 AS BIGINT), CAST("end" - start AS BIGINT))) AS text_md5 FROM o JOIN documents USING (doc_id)""")
def named_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs, names = spread(spark, d), corpus_names(spark, d)
    rows = M.candidates(docs, "doc_id", "text", names, "name", names, GATE)
    return M.chunks_of(docs, "doc_id", "text", rows, most=300).select("doc_id", "seq", "start", "end", F.md5("text").alias("text_md5"))


def statements(spark: SparkSession, d: str) -> DataFrame:
    """corp, year and text: each firm's latest three years as a filing of two statements with units of their own: sales by one
    of three names, of which the third says nothing, income with a minus as brackets or a mark, and equity without heads."""
    whole = lambda c: F.floor(F.col(c)).cast("long")
    years = panel(spark, d).groupBy("corp").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("year")).alias("y"), whole("revenue").alias("r"), whole("operating_income").alias("o"), whole("total_equity").alias("e")))), 1, 3).alias("s"))
    shown = lambda v: F.when(v >= 0, F.format_number(v, 0)).when(F.col("corp") % 2 == 0, F.concat(F.lit("("), F.format_number(-v, 0), F.lit(")"))).otherwise(F.concat(F.lit("△"), F.format_number(-v, 0)))
    cells = lambda field: F.array_join(F.transform("s", lambda x: F.concat(F.lit("<TD>"), F.coalesce(shown(x[field]), F.lit("-")), F.lit("</TD>"))), "")
    row = lambda head, body: F.concat(F.lit("<TR>"), head, body, F.lit("</TR>"))
    name = F.get(F.array(F.lit("<TD>Ⅰ. 매출액(주6)</TD>"), F.lit("<TD>영업수익</TD>"), F.lit('<TD ACODE="ifrs-full_Revenue">합계</TD>')), (F.col("corp") % 3).cast("int"))
    heads = F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("<TD>제 "), (F.lit(9) - i).cast("string"), F.lit(" 기</TD>"))), "")
    note = F.concat(F.lit("<TD>"), (F.col("corp") % 40).cast("string"), F.lit("</TD>"))
    income = F.concat(F.lit("<TITLE>4-2. 연결 손익계산서</TITLE>(단위: 천원)<TABLE>"), row(F.lit("<TD>과목</TD><TD>주석</TD>"), heads), row(F.concat(name, note), cells("r")), row(F.concat(F.lit("<TD>영업이익</TD>"), note), cells("o")), F.lit("</TABLE>"))
    balance = F.concat(F.lit("<TITLE>재무상태표</TITLE>"), F.when(F.col("corp") % 2 == 0, "(단위: 백만원)").otherwise("(단위 : 원)"), row(F.lit("<TD>자본총계</TD>"), cells("e")), F.lit("<TITLE>주석</TITLE>"), row(F.lit("<TD>부채총계</TD>"), cells("e")))
    return years.select("corp", (-F.get("s", F.lit(0))["y"]).alias("year"), F.concat(income, balance).alias("text"))


@query(f"""
WITH p AS (SELECT corp, year, CAST(floor(revenue) AS DOUBLE) AS r, CAST(floor(operating_income) AS DOUBLE) AS o, CAST(floor(total_equity) AS DOUBLE) AS e, row_number() OVER (PARTITION BY corp ORDER BY year DESC) - 1 AS place, max(year) OVER (PARTITION BY corp) AS last, count(*) OVER (PARTITION BY corp) AS n FROM ({PANEL_SQL})),
u AS (SELECT corp, last, n, place, unnest(['revenue', 'operating_income', 'total_equity']) AS account, unnest([CASE WHEN corp % 3 < 2 THEN r * 1000 END, o * 1000, e * CASE WHEN corp % 2 = 0 THEN 1e6 ELSE 1 END]) AS amount FROM p WHERE place < 3)
SELECT corp, CASE account WHEN 'total_equity' THEN 'OFS' ELSE 'CFS' END AS kind, place, account, CASE account WHEN 'total_equity' THEN 2 ELSE 3 END AS rank, amount, last - place AS fiscal_year FROM u WHERE amount IS NOT NULL AND (account <> 'revenue' OR amount <> 0) AND (account = 'total_equity' OR n > 1)""")
def core_accounts(spark: SparkSession, d: str) -> DataFrame:
    filed = statements(spark, d)
    rows = A.statement_rows(A.statement_blocks(filed, "corp", "text"), "corp").join(filed.select("corp", "year"), "corp")
    return A.core_accounts(rows, "corp", "year").select("corp", "kind", "place", "account", "rank", "amount", "fiscal_year")


#: Quantities that each supplier's lines have by status and flag: two companies with two dealings.
DEALT_SQL = """SELECT l_suppkey AS s, l_linestatus AS company, CASE l_returnflag WHEN 'R' THEN 'customer' ELSE 'supply' END AS deal, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY 1, 2, 3"""


def dealing_notes(spark: SparkSession, d: str) -> DataFrame:
    """s and text: notes of suppliers with a table in one of four layouts: dealings by companies, companies by dealings, the
    same as markdown, and companies by dealings with a cell over two rows; before it a table of other things."""
    lines = table(spark, d, "lineitem").where("l_returnflag IN ('R', 'N')")
    total = lambda status, flag: F.sum(F.when((F.col("l_linestatus") == status) & (F.col("l_returnflag") == flag), F.col("l_quantity").cast("long")))
    sums = lines.groupBy(F.col("l_suppkey").alias("s")).agg(*(total(status, flag).alias(f"{status}{flag}") for status in "OF" for flag in "RN"))
    shown = lambda c: F.coalesce(F.format_number(c, 0), F.lit("-"))
    html = lambda *cells: F.concat(F.lit("<tr>"), *(x for c in cells for x in (F.lit("<td>"), F.lit(c) if isinstance(c, str) else c, F.lit("</td>"))), F.lit("</tr>"))
    mark = lambda *cells: F.concat(F.lit("|"), *(x for c in cells for x in (F.lit(" "), F.lit(c) if isinstance(c, str) else c, F.lit(" |"))), F.lit("\n"))
    by_company = lambda row: (row("회사", "상품 매출", "원재료 매입", "비고"), row("O", shown("OR"), shown("ON"), "-"), row("F", shown("FR"), shown("FN"), "-"))
    layouts = (
        F.concat(F.lit("<table>"), html("구분", "O", "F"), html("매출액", shown("OR"), shown("FR")), html("매입액", shown("ON"), shown("FN")), html("보증", "1", "2"), F.lit("</table>")),
        F.concat(F.lit("<table>"), *by_company(html), F.lit("</table>")), F.concat(mark("주석", "쪽"), F.lit("\n"), *by_company(mark)),
        F.concat(F.lit("<table>"), html("회사", "매출", "매입"), F.lit('<tr><td rowspan="2">O</td><td>'), shown("OR"), F.lit("</td><td>"), shown("ON"), F.lit("</td></tr><tr><td>-</td><td>-</td></tr>"), html("F", shown("FR"), shown("FN")), F.lit("</table>")),
    )
    return sums.select("s", F.concat(F.when(F.col("s") % 4 == 2, "").otherwise("<table><tr><td>주석</td><td>쪽</td></tr><tr><td>1</td><td>2</td></tr></table>"), F.get(F.array(*layouts), (F.col("s") % 4).cast("int"))).alias("text"))


@query(f"SELECT s, company, deal, CAST(q AS DOUBLE) AS amount FROM ({DEALT_SQL})")
def note_dealings(spark: SparkSession, d: str) -> DataFrame:
    cells = T.table_cells(dealing_notes(spark, d), "s", "text")
    return T.dealings(cells, "s").select("s", "company", "deal", "amount")


@query("""SELECT DISTINCT l_suppkey AS s, 1 AS "table" FROM lineitem WHERE l_returnflag IN ('R', 'N') AND l_suppkey % 4 > 0""")
def company_tables(spark: SparkSession, d: str) -> DataFrame:
    """The table of a note that has a row for each of the two companies."""
    return T.best_table(T.table_cells(dealing_notes(spark, d), "s", "text"), "s", ["O", "F"])
