"""Notes of filings: markups of heads, numbers that fall back or repeat, chains in a body, and splits gone stale."""

import pytest
from pyspark.sql import functions as F

from finloom.operators import notes as N

TITLE = "<TITLE>{}</TITLE>{}"


def frame(spark, texts):
    return spark.createDataFrame([*enumerate(texts)], "k long, t string").repartition(2)


def by_key(df, *columns):
    out = {}
    for r in df.orderBy("k", "place").collect():
        out.setdefault(r["k"], []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


def test_numbers_and_titles(spark):
    numbers = {"6-A": (6, 1), "6-b": (6, 2), "31-6": (31, 6), "3": (3, 0), "11.1": (11, 1), "26. 27": (26, 27), "": (None, 0), None: (None, 0)}
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n string").select("i", N.note_number("n").alias("k")).orderBy("i").collect()
    assert [tuple(r["k"]) for r in rows] == [*numbers.values()]
    titles = {"특수관계자 - 연결": "특수관계자", ", 11. 매출채권": "매출채권", "-A 대여유가증권": "A 대여유가증권", " 1. 2. 가나 :": "가나", None: None}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").select("i", N.tidy_title("t").alias("v")).orderBy("i").collect()
    assert [r["v"] for r in rows] == [*titles.values()]
    heads = {"특수관계자 거래(1) 보고기간종료일 현재 당사의 지배기업은 다음과 같습니다.": "특수관계자 거래", "당사의 재고": "당사의 재고", "a" * 80: "a" * 60}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(heads)], "i int, t string").select("i", N.clean_title("t").alias("v")).orderBy("i").collect()
    assert [r["v"] for r in rows] == [*heads.values()]


def test_titled_notes(spark):
    note = lambda n, body, end="(연결)": TITLE.format(f"{n} 제목{n} {end}", body)
    texts = [
        "x" + note("1.", "a") + note("30.", "b") + note("1.", "other"),  # falls back: other statements
        note("1.", "a") + note("16.", "b") + note("16.", "c") + note("17.", "d"),  # a repeated number
        note("19-A.", "a") + note("20-A.", "b") + note("19-B.", "c") + note("21.", "d"),  # out of order in the filing itself
        note("주석33 -", "a") + note("주석 - 38.", "b") + note("[40]", "c") + note("2.", "gone"),
        note("7.", "toc") + note("1.", "a") + note("2.", "b") + TITLE.format("5. 재무제표", "s") + note("3.", "gone"),
        note("1.", "a", "(별도)"), "no heads", "", None, note("1.", "y" * 400_000),
    ]
    found = by_key(N.titled_notes(frame(spark, texts), "k", "t"), "number", "title", "body")
    assert [n for n, _, _ in found[0]] == ["1", "30"] and "other" not in found[0][-1][2] and found[0][0][2].endswith("a")
    assert [(n, b.count("</TITLE>"), b[-1]) for n, _, b in found[1]] == [("1", 1, "a"), ("16", 2, "c"), ("17", 1, "d")]
    assert [n for n, _, _ in found[2]] == ["19-A", "20-A", "19-B", "21"]
    assert [n for n, _, _ in found[3]] == ["33", "38", "40"]
    assert [(n, b[-1]) for n, _, b in found[4]] == [("1", "a"), ("2", "b")]
    assert sorted(found) == [0, 1, 2, 3, 4, 9] and len(found[9][0][2]) == N.MOST_LAST
    assert by_key(N.titled_notes(frame(spark, texts), "k", "t", N.SEPARATE), "number") == {5: ["1"]}


def plain_chain(numbers, step=4):
    length, back = [1] * len(numbers), [-1] * len(numbers)
    for i, x in enumerate(numbers):
        for j in range(i):
            if numbers[j] < x <= numbers[j] + step and length[j] + 1 > length[i]:
                length[i], back[i] = length[j] + 1, j
    out, i = [], max(range(len(numbers)), key=lambda i: length[i]) if numbers else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def test_longest_chain(spark):
    import random

    rng = random.Random(4)
    lists = [[], [5], [1, 2, 3], [3, 1, 2, 3, 9], [99, 98, 99], [1, 6, 2, 10, 3]] + [[rng.randrange(1, rng.choice([6, 30, 100])) for _ in range(rng.randrange(60))] for _ in range(60)]
    rows = spark.createDataFrame([*enumerate(lists)], "i int, n array<int>").select("i", N.longest_chain(F.col("n")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in rows} == {i: plain_chain(x) for i, x in enumerate(lists)}


def test_chained_notes_and_the_fallback(spark):
    head = "<TITLE>3. 연결재무제표 주석</TITLE>"
    body = lambda n: f"<P>{n}. 제목{n}</P>" + "문장입니다. " * 200
    chain = head + "".join(map(body, range(1, 11))) + "<P>1. 표의 줄</P>" + "끝입니다.11. 특수관계자 거래(1) 당사의 ..." + "z" * 3000
    texts = [
        chain + "<TITLE>4. 재무제표</TITLE>" + body(12), head + "해당사항 없음", chain.replace("<P>7. ", '<TITLE ENG="x">7. ').replace("제목7</P>", "재고자산</TITLE>"),
        chain.replace("<P>7. ", '<TITLE AASSOCNOTE="D">7. ').replace("제목7</P>", "재고자산</TITLE>"), "<TITLE>5-1) 잔액(연결)</TITLE>x" + chain, "".join(TITLE.format(f"{n}. 가 (연결)", "b") for n in range(1, 4)) + chain, None,
    ]
    df = frame(spark, texts)
    found = by_key(N.split_notes(df, "k", "t", 1000), "number", "title")
    whole = [(str(n), f"제목{n}") for n in range(1, 11)] + [("11", "특수관계자 거래")]
    assert found[0] == whole and 1 not in found and found[4] == whole
    assert found[2] == [(n, "재고자산" if n == "7" else t) for n, t in whole]  # an account's name without an anchor ends nothing
    assert found[3] == whole[:6] and found[5] == [(str(n), "가") for n in range(1, 4)]
    texts = {r["k"]: r["block"] for r in N.note_block(df, "k", "t").collect()}
    assert texts[0] == chain and texts[1] == head + "해당사항 없음"
    joined = {k: "".join(v) for k, v in by_key(N.chained_notes(N.note_block(df, "k", "t").where("k = 0"), "k", "block"), "body").items()}
    assert joined[0] == chain[len(head):]


@pytest.mark.parametrize("most", ["-1", "10m"])
def test_chained_notes_of_texts_dealt_out_before(spark, tmp_path, most):
    """Heads of both kinds meet by text, though the texts are dealt out by key already and all read one shuffle."""
    text = "x<P>1. 가</P>a끝입니다.2. 나<P>3. 다</P>b끝입니다.4. 라"
    spark.createDataFrame([(k, text) for k in range(40)] + [(None, text), (40, None)], "k long, t string").write.parquet(f"{tmp_path}/texts")
    df = spark.read.parquet(f"{tmp_path}/texts").repartition("k").select("k", F.coalesce("t", F.lit("")).alias("t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        found = by_key(N.chained_notes(df, "k", "t"), "place", "number", "title", "body")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    notes = [(1, "1", "가", "<P>1. 가</P>a끝입니"), (2, "2", "나", "다.2. 나"), (3, "3", "다", "<P>3. 다</P>b끝입니"), (4, "4", "라", "다.4. 라")]
    assert found == {k: notes for k in range(40)}


def test_split_of_texts_dealt_out_before(spark, tmp_path):
    """The two ways of a filing are weighed against each other, though its text is dealt out by key already."""
    title = "<TITLE>3. 연결재무제표 주석</TITLE>"
    body = title + "".join(f"<P>{n}. 가</P>" + "z" * 200 for n in range(1, 7))
    few = "".join(TITLE.format(f"{n}. 나 (연결)", "b") for n in range(2, 5))
    texts = [few + body, "".join(TITLE.format(f"{n}. 나 (연결)", "b") for n in range(1, 4)) + body, few + title, body] * 10
    rows = [*enumerate(texts), (None, texts[0]), (99, None)]
    spark.createDataFrame(rows, "k long, t string").write.parquet(f"{tmp_path}/texts")
    df = spark.read.parquet(f"{tmp_path}/texts").repartition("k")
    found = by_key(N.split_notes(df, "k", "t", 1000), "place", "number")
    chained, titled = [(n, str(n)) for n in range(1, 7)], [(1, "1"), (2, "2"), (3, "3")]
    assert found == {k: [chained, titled, [(1, "2"), (2, "3"), (3, "4")], chained][k % 4] for k in range(40)}


def test_health(spark):
    rows = lambda k, numbers, n=10: [(k, str(x), n) for x in numbers]
    schema = "k long, number string, n int"
    notes = spark.createDataFrame(rows(1, range(1, 31)) + rows(2, range(1, 6)) + rows(3, [1, *range(20, 32)]) + rows(4, range(1, 14), 200_001) + rows(5, ["1", "2-1", "2-2"] * 4), schema)
    got = {r["k"]: (r["n"], r["issues"], r["gaps"][:2]) for r in N.section_issues(notes, "k", F.col("n")).collect()}
    assert got == {1: (30, [], []), 2: (5, ["few"], []), 3: (13, ["gaps"], [2, 3]), 4: (13, ["large"], []), 5: (12, [], [])}
    split = spark.createDataFrame(rows(1, range(1, 40)) + rows(2, range(1, 6)) + rows(3, [*range(1, 6)] * 3) + rows(6, [1, 2]), schema)
    stored = spark.createDataFrame(rows(1, range(1, 30)) + rows(2, range(1, 6)) + rows(3, range(1, 6)) + rows(9, [1]), schema)
    got = {r["k"]: (r["verdict"], r["lost"]) for r in N.stale_tails(stored, split, "k").collect()}
    assert got == {1: ("tail_lost", [*range(30, 40)]), 2: (None, []), 3: ("stale", []), 6: ("tail_lost", [1, 2])}
