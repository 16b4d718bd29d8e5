"""Core accounts of filed statements: blocks by title, rows and columns of their tables, one unit for each block, and for
each account, kind of statements and column the best of all rows that fit. All by column functions; nothing is added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .notes import cut_at

#: Rules of accounts (rank, by code or by name, values), the statements they are taken from, in order, parts of
#: names that forbid them, names that say nothing, and accounts that are filed as a deduction.
ACCOUNT_RULES = {
    "revenue": ((1, "code", ("ifrs-full_Revenue",)), (2, "code", ("dart_Revenue", "ifrs_Revenue")), (3, "name", (
        "매출액", "수익(매출액)", "영업수익", "매출", "영업수익(매출액)", "매출액(영업수익)", "매출(영업수익)", "매출및지분법손익", "매출수익", "영업수익합계", "매출액합계", "수익", "매출(수익)", "영업수익(수익)",
    ))),
    "cogs": ((1, "code", ("ifrs-full_CostOfSales",)), (2, "name", ("매출원가", "매출원가(영업비용)", "매출원가합계"))),
    "operating_income": ((1, "code", ("dart_OperatingIncomeLoss",)), (2, "code", ("ifrs-full_ProfitLossFromOperatingActivities",)), (3, "name", (
        "영업이익", "영업이익(손실)", "영업손익", "영업손실", "영업이익(영업손실)", "영업손실(영업이익)",
    ))),
    "net_income": ((1, "code", ("ifrs-full_ProfitLoss",)), (2, "name", ("당기순이익", "당기순이익(손실)", "당기순손익", "당기순손실", "연결당기순이익", "당기순이익(당기순손실)"))),
    "total_assets": ((1, "code", ("ifrs-full_Assets",)), (2, "name", ("자산총계", "자산합계", "자산계", "자산"))),
    "total_liabilities": ((1, "code", ("ifrs-full_Liabilities",)), (2, "name", ("부채총계", "부채합계", "부채계", "부채"))),
    "total_equity": ((1, "code", ("ifrs-full_Equity",)), (2, "name", ("자본총계", "자본합계", "자본계", "자본"))),
    "current_assets": ((1, "code", ("ifrs-full_CurrentAssets",)), (2, "name", ("유동자산", "유동자산합계", "유동자산계"))),
    "current_liabilities": ((1, "code", ("ifrs-full_CurrentLiabilities",)), (2, "name", ("유동부채", "유동부채합계", "유동부채계"))),
    "long_term_debt": ((1, "code", ("ifrs-full_NoncurrentLiabilities",)), (2, "name", ("비유동부채", "비유동부채합계", "비유동부채계"))),
    "operating_cashflow": ((1, "code", ("ifrs-full_CashFlowsFromUsedInOperatingActivities",)), (2, "name", (
        "영업활동현금흐름", "영업활동으로인한현금흐름", "영업활동으로인한순현금흐름", "영업활동순현금흐름", "영업활동으로부터의현금흐름", "영업활동으로인한현금흐름액", "영업활동으로인한자금수지", "영업활동으로인한순현금흐름액",
    ))),
    "investing_cashflow": ((1, "code", ("ifrs-full_CashFlowsFromUsedInInvestingActivities",)), (2, "name", (
        "투자활동현금흐름", "투자활동으로인한현금흐름", "투자활동으로인한순현금흐름", "투자활동순현금흐름", "투자활동으로부터의현금흐름", "투자활동으로인한현금흐름액", "투자활동으로인한자금수지", "투자활동으로인한순현금흐름액",
    ))),
    "financing_cashflow": ((1, "code", ("ifrs-full_CashFlowsFromUsedInFinancingActivities",)), (2, "name", (
        "재무활동현금흐름", "재무활동으로인한현금흐름", "재무활동으로인한순현금흐름", "재무활동순현금흐름", "재무활동으로부터의현금흐름", "재무활동으로인한현금흐름액", "재무활동으로인한자금수지", "재무활동으로인한순현금흐름액",
    ))),
}
STATEMENTS_OF = {"revenue": ("IS", "CIS"), "cogs": ("IS", "CIS"), "operating_income": ("IS", "CIS"), "net_income": ("IS", "CIS")} | dict.fromkeys(("operating_cashflow", "investing_cashflow", "financing_cashflow"), ("CF",))
FORBIDDEN = dict.fromkeys(("operating_cashflow", "investing_cashflow", "financing_cashflow"), ("유입", "유출")) | {"revenue": ("이자수익", "수수료수익", "보험수익", "금융수익", "기타수익")}
NO_NAMES, DEDUCTED = ("합계", "계", "소계", "총계", "구분", "과목", "합 계"), ("cogs",)
#: Names of statements, longer ones first where one holds the other, and units of won.
STATEMENTS = (("재무상태표", "BS"), ("대차대조표", "BS"), ("포괄손익계산서", "CIS"), ("손익계산서", "IS"), ("현금흐름표", "CF"), ("자본변동표", "SCE"))
UNITS = {"원": 1.0, "천원": 1e3, "백만원": 1e6, "십억원": 1e9, "억원": 1e8, "조원": 1e12}
TITLE = r"(?is)^<TITLE[^>]*>\s*(?:\d+\s*[-.]\s*\d+\s*\.?\s*)?((?:연결\s*)?(?:재무상태표|대차대조표|포괄손익계산서|손익계산서|현금흐름표|자본변동표))\s*(?:\([^<)]{0,20}\))?\s*</TITLE>"
GROUP = r'(?i)<TABLE-GROUP[^>]*ACLASS="\{XBRL\}[A-Za-z0-9_]+"[^>]*>'
PERIOD, UNIT = r"^제\d+(?:\((?:당|전|전전)\))?기", r"단위\s*[:：]\s*([가-힣]*원)"
ROW, CELL = r"(?is)<TR\b[^>]*>(.*?)</TR>", r"(?is)<(TE|TD|TH)\b([^>]*)>(.*?)</\1>"


def plain(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"&nbsp;|　| ", " ")


def account_label(text: Column | str) -> Column:
    """An account's name without tags, blanks, references to notes, and numbers or bullets before it; brackets stay."""
    out = F.regexp_replace(F.regexp_replace(plain(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"\s+", ""), r"[(（<\[]주석?[\d,.\-~\s]*[)）>\]]", "")
    out = F.regexp_replace(out, r"^(?:[(\[]?[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩIVXivx0-9가나다라마바사아자차카타파하①②③④⑤⑥⑦⑧⑨⑩]{1,4}[)\].,·]\s*|[\-−–ㆍ·‧∙•*]+)+", "")
    return F.regexp_replace(out, r"^[ .·]+|[ .·]+$", "")


def filed_amount(text: Column) -> Column:
    """The number of a cell; brackets and marks before it are a minus. Blank cells, dashes and words are null, never 0."""
    t = F.trim(plain(text))
    closed = t.startswith("(") & t.endswith(")")
    t = F.trim(F.regexp_replace(t, r"^\((.*)\)$", "$1"))
    marked = t.rlike("^[△▲−▵-]")
    digits = F.regexp_replace(F.trim(F.regexp_replace(t, "^[△▲−▵-]", "")), "[, ]", "")
    value = F.when(digits.rlike(r"^\d+(\.\d+)?$"), digits.try_cast("double"))
    return F.when(closed | marked, -value).otherwise(value)


def statement_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, block, kind (CFS of consolidated statements, else OFS), statement and body: what stands between the title of a
    statement and the next title; in filings without such titles, groups of tables named by their first cell."""
    name = lambda c: F.regexp_replace(c, r"\s+", "")
    of = lambda c: F.coalesce(*(F.when(c.contains(w), F.lit(v)) for w, v in STATEMENTS))

    def blocks(rows: DataFrame, title: Column, body: Column, way: str) -> DataFrame:
        found = rows.select(key, F.col("nth").alias("block"), name(title).alias("_name"), body.alias("body"))
        found = found.select("*", of(F.col("_name")).alias("statement"), F.when(F.col("_name").contains("연결"), "CFS").otherwise("OFS").alias("kind")).where("statement IS NOT NULL")
        return found.groupBy(key).agg(F.collect_list(F.struct("block", "kind", "statement", "body")).alias(way))

    titled = cut_at(docs, key, text, r"(?i)<TITLE[^>]*>").where("nth > 0").withColumn("_all", F.concat("head", "part"))
    titled = blocks(titled.where(F.col("_all").rlike(TITLE)), F.regexp_extract("_all", TITLE, 1), F.regexp_replace("_all", TITLE, ""), "_titled")
    grouped = cut_at(docs, key, text, GROUP).where("nth > 0").withColumn("_body", F.get(F.split("part", r"(?i)</TABLE-GROUP>|<TABLE-GROUP\b", 2), F.lit(0)))
    grouped = blocks(grouped, F.regexp_extract("_body", CELL, 3), F.col("_body"), "_grouped")
    # a join, as a union of both may not keep a filing's blocks together (see notes.heads_of)
    both = titled.join(grouped, key, "full").where(F.col(key).isNotNull())
    return both.select(key, F.inline(F.coalesce("_titled", "_grouped")))


def statement_rows(blocks: DataFrame, key: str) -> DataFrame:
    """key, kind, statement, code, name, amount in won, place (0 for the latest of three columns), unit and order of the cells
    of blocks. Columns of amounts are those with periods as heads, if a row has two at least; else the three after the name.
    A row with fewer cells than its heads ask for has none. The unit is the block's own, from its first 6,000 characters."""
    unit = F.regexp_extract(F.regexp_replace(F.substring("body", 1, 6000), "<[^>]+>", " "), UNIT, 1)
    scale = F.coalesce(*(F.when(unit == w, F.lit(v)) for w, v in UNITS.items()), F.lit(1.0))
    lists = blocks.select(key, "block", "kind", "statement", scale.alias("unit"), F.regexp_extract_all("body", F.lit(ROW), F.lit(1)).alias("_rows"))
    cells = lambda row: F.arrays_zip(F.regexp_extract_all(row, F.lit(CELL), F.lit(2)).alias("a"), F.regexp_extract_all(row, F.lit(CELL), F.lit(3)).alias("t"))
    lists = lists.withColumn("_cells", F.transform("_rows", cells))
    heads = F.transform("_cells", lambda row: F.filter(F.transform(row, lambda c, i: F.when(account_label(c["t"]).rlike(PERIOD), i)), lambda i: i.isNotNull()))
    lists = lists.withColumn("_at", F.slice(F.get(F.filter(heads, lambda h: F.size(h) >= 2), F.lit(0)), 1, 3))
    rows = lists.select(key, "block", "kind", "statement", "unit", "_at", F.posexplode("_cells").alias("_r", "_row")).where("size(_row) >= 2")
    rows = rows.where("_at IS NULL OR array_max(_at) < size(_row)").withColumn("name", account_label(F.get("_row", F.lit(0))["t"])).where("name <> ''")
    picked = F.when(F.col("_at").isNull(), F.slice("_row", 2, 3)).otherwise(F.transform("_at", lambda i: F.get("_row", i)))
    out = rows.select(key, "kind", "statement", "name", "unit", "block", "_r", F.posexplode(picked).alias("place", "_c"))
    code = F.regexp_extract("_c.a", r'(?i)\bACODE\s*=\s*"([^"]*)"', 1)
    return out.select(key, "kind", "statement", code.alias("code"), "name", (filed_amount(F.col("_c.t")) * F.col("unit")).alias("amount"), "place", "unit", F.struct("block", "_r", "place").alias("order")).where("amount IS NOT NULL")


def core_accounts(rows: DataFrame, key: str, year: str | None = None) -> DataFrame:
    """key, kind, place, account, rank, statement, code, name, amount and unit of the best row of statement_rows for each
    account, kind and column: by the rank of its rule, an amount other than 0, the order of statements, and place in the
    filing. What isn't found is absent; revenue of 0 is as good as not found. year: a column of rows with the filing's year
    adds fiscal_year, a year less for each column."""

    def candidate(account: str) -> Column:
        rank = F.lit(None).cast("int")
        for number, by, values in reversed(ACCOUNT_RULES[account]):
            rank = F.when(F.col("code" if by == "code" else "name").isin(*values), number).otherwise(rank)
        place = F.coalesce(*(F.when(F.col("statement") == s, i) for i, s in enumerate(STATEMENTS_OF.get(account, ("BS",)))), F.lit(None).cast("int"))
        allowed = ~F.col("name").isin(*NO_NAMES)
        for word in FORBIDDEN.get(account, ()):
            allowed = allowed & ~F.col("name").contains(word)
        return F.when(rank.isNotNull() & place.isNotNull() & allowed, F.struct(F.lit(account).alias("account"), rank.alias("rank"), place.alias("_p")))

    held = [c for c in (year,) if c]
    found = rows.select("*", F.inline(F.array_compact(F.array(*map(candidate, ACCOUNT_RULES)))))
    best = F.min_by(F.struct("rank", "statement", "code", "name", "amount", "unit", *held), F.struct("rank", F.col("amount") == 0, "_p", "order"))
    out = found.groupBy(key, "kind", "place", "account").agg(best.alias("_b")).select(key, "kind", "place", "account", "_b.*").where("account <> 'revenue' OR amount <> 0")
    out = out.withColumn("amount", F.when(F.col("account").isin(*DEDUCTED), F.abs("amount")).otherwise(F.col("amount")))
    return out.withColumn("fiscal_year", F.col(year) - F.col("place")) if year else out
