"""Column builders for what readers see: names, particles, edge details, statements in words, and small verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import classes, col, ratio
from .texts import NOTES, mapped, sign_pattern

#: What the Latin letters are called.
LETTERS = {
    "A": "에이", "B": "비", "C": "씨", "D": "디", "E": "이", "F": "에프", "G": "지", "H": "에이치", "I": "아이", "J": "제이", "K": "케이", "L": "엘", "M": "엠",
    "N": "엔", "O": "오", "P": "피", "Q": "큐", "R": "알", "S": "에스", "T": "티", "U": "유", "V": "브이", "W": "더블유", "X": "엑스", "Y": "와이", "Z": "제트",
}


def spoken_name(name: Column | str) -> Column:
    """A name with its runs of up to four Latin letters spelled as they are called, wherever these letters stand in it;
    null if it has none. Other longer runs are words and stay."""
    called = F.create_map(*(F.lit(x) for pair in LETTERS.items() for x in pair))
    spelled = lambda run: F.array_join(F.transform(F.split(F.upper(run), ""), lambda c: called[c]), "")
    runs = F.filter(F.regexp_extract_all(col(name), F.lit("[A-Za-z]+"), 0), lambda run: F.length(run) <= 4)
    out = F.aggregate(runs, col(name), lambda held, run: F.replace(held, run, spelled(run)))
    return F.when(out != col(name), out)


#: A form that belongs to the name before.
STRAY_FORM = r"^(?i:LTD|LLC|INC|CORP|GMBH|PTE|CO)\s*[.,]\s*(?=[A-Za-z가-힣])"


def shown_name(name: Column | str) -> Column:
    """A name for readers: single blanks, no notes and no form of another name before it; null gives ''."""
    out = F.trim(F.regexp_replace(F.coalesce(col(name), F.lit("")), r"\s+", " "))
    out = F.regexp_replace(F.regexp_replace(out, STRAY_FORM, ""), "|".join(NOTES[:-1]), "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"^[ ,·]+|[ ,·]+$", ""), r"\s*\*+\s*$", ""), r"\s+", " "))


#: Particles after a consonant and after a vowel.
PARTICLES = {"은는": ("은", "는"), "이가": ("이", "가"), "을를": ("을", "를"), "과와": ("과", "와"), "으로": ("으로", "로")}


def with_particle(word: Column | str, kind: str, boxed: bool = False) -> Column:
    """A word with the particle that its last sound asks for; closing marks don't count, and other scripts end in a vowel.
    boxed: the word in square brackets, the particle behind them."""
    last = F.substring(F.regexp_replace(F.trim(col(word)), r"[\])}·.,%]+$", ""), -1, 1)
    code = F.ascii(last) - 0xAC00
    syllable = code.between(0, 0xD7A3 - 0xAC00)
    consonant = last.isin(*"013678") | (syllable & (code % 28 != 0))
    liquid = last.isin(*"178") | (syllable & (code % 28 == 8))
    closed, open_ = PARTICLES[kind]
    ending = F.when(consonant & ~liquid if kind == "으로" else consonant, closed).otherwise(open_)
    return F.concat(F.lit("[") if boxed else F.lit(""), col(word), F.lit("]") if boxed else F.lit(""), ending)


#: Classes of related parties, by words that a note's class has all of, and marks that stay with it.
PARTY_CLASSES = (
    (("최상위", "지배기업"), "최상위 지배기업"), (("지배기업",), "지배기업"), (("종속기업",), "종속기업"), (("관계기업",), "관계기업"), (("공동기업",), "관계기업"),
    (("영향력",), "유의적 영향력"), (("대규모기업집단",), "대규모기업집단"), (("계열회사",), "대규모기업집단"), (("기타",), "기타"), (("그밖",), "기타"),
)
GROUP_MARK, SEPARATE_MARK = "그룹 합산", "별도"


def party_class(text: Column | str) -> Column:
    """The class of a related party as filings name it, without source and notes, by the first rule of PARTY_CLASSES;
    else the cleaned text. Null gives ''."""
    out = F.regexp_replace(F.coalesce(col(text), F.lit("")), "^[^:]*:", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\((?:주|\*)[^)]*\)", " "), r"\s+", " "))
    out = F.trim(F.replace(F.regexp_replace(out, "^,+|,+$", ""), F.lit(":"), F.lit(" ")))
    dense, found = F.replace(out, F.lit(" "), F.lit("")), F.when(F.lit(False), F.lit(""))
    for words, name in PARTY_CLASSES:
        every = F.lit(True)
        for w in words:
            every = every & dense.contains(w)
        found = found.when(every, name)
    return found.otherwise(out)


def edge_detail(share: Column | str, group: Column | str, detail: Column | str, from_notes: Column) -> Column:
    """What a relation is shown by: its share in percent, else its group, else its class (of notes without one: related
    party), with the marks of whole groups and separate statements. Free of colons."""
    named = F.when((party_class(detail) == "") & from_notes, "특수관계자").otherwise(party_class(detail))
    for mark, held in ((GROUP_MARK, GROUP_MARK), (SEPARATE_MARK, f"({SEPARATE_MARK})")):
        named = F.when(F.coalesce(col(detail).contains(held), F.lit(False)), F.trim(F.concat(named, F.lit(f" ({mark})")))).otherwise(named)
    grouped = F.when(F.coalesce(col(group), F.lit("")) != "", F.replace(col(group), F.lit(":"), F.lit(" ")))
    return F.coalesce(F.concat(col(share).cast("double").cast("string"), F.lit("%")), grouped, named)


def dated_detail(detail: Column | str, year: Column | str) -> Column:
    """A detail with its year behind a middle dot; the year alone if there is no detail."""
    known = F.coalesce(col(year), F.lit(0)) != 0
    return F.when(known & (F.coalesce(col(detail), F.lit("")) != ""), F.concat(col(detail), F.lit(" · "), col(year).cast("string"))).when(known, col(year).cast("string")).otherwise(col(detail))


#: Labels of money that goes out to a party and comes in from it, and words of balances and results.
CAPITAL_OUT = ("자금대여거래", "자금대여", "대여거래", "대여", "현금출자", "출자", "유상증자", "출자금납입")
CAPITAL_IN = ("자금차입거래", "자금차입", "차입거래", "차입")
NO_CAPITAL = ("금", "보증", "담보", "기초", "기말", "잔액", "이자", "배당", "회수", "상환")


def capital_direction(label: Column | str) -> Column:
    """capital_out or capital_in of a label in parts with commas: null if none or both fit, or if another part has a word
    of NO_CAPITAL."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(col(label), r"\s+", " "), ","), lambda p: F.trim(p)), lambda p: p != "")
    out, in_ = F.arrays_overlap(parts, F.array(*map(F.lit, CAPITAL_OUT))), F.arrays_overlap(parts, F.array(*map(F.lit, CAPITAL_IN)))
    spoilt = F.exists(parts, lambda p: ~p.isin(*CAPITAL_OUT, *CAPITAL_IN) & p.rlike("|".join(NO_CAPITAL)))
    return F.when((out != in_) & ~spoilt, F.when(out, "capital_out").otherwise("capital_in"))


#: What the signs of operating, investing and financing flows stand for.
FLOWS = {
    "+--": "pays for investments and for debt out of its own earnings",
    "+-+": "earns, and borrows to invest more than that",
    "++-": "sells assets and pays debt back while it still earns",
    "+++": "gathers cash from all three sides",
    "--+": "lives on outside money: earnings are negative and investing goes on",
    "-++": "covers a loss with sold assets and new debt",
    "-+-": "sells assets to pay debt without earning",
    "---": "loses cash on all three sides",
}
OTHER_FLOW = "shows no plain pattern"


def _whole(value: Column) -> Column:
    return F.format_string("%.0f", F.bround(value, 0))


def income_words(revenue: Column | str, operating: Column | str, net: Column | str) -> Column:
    """Margins in words, as what is left of 100 won of sales; the net margin only where there is one."""
    margin, last = ratio(operating, revenue, 100.0), ratio(net, revenue, 100.0)
    more = F.when(last.isNotNull(), F.concat(F.lit(", "), _whole(last), F.lit(" after all else"))).otherwise("")
    return F.when(margin.isNull(), "no margin: sales or operating income missing").otherwise(F.concat(F.lit("of 100 won sold, operations keep "), _whole(margin), more))


def balance_words(assets: Column | str, liabilities: Column | str, equity: Column | str) -> Column:
    """Debt and equity in words, as shares of assets."""
    debt, own = ratio(liabilities, assets, 100.0), ratio(equity, assets, 100.0)
    text = F.concat(F.lit("debt "), _whole(debt), F.lit(" %"), F.when(own.isNotNull(), F.concat(F.lit(" and equity "), _whole(own), F.lit(" %"))).otherwise(""), F.lit(" of assets"))
    return F.when(F.coalesce(col(assets), F.lit(0)) == 0, "no shares: assets missing").when(debt.isNull(), "no shares: debt missing").otherwise(text)


def flow_words(operating: Column | str, investing: Column | str, financing: Column | str) -> Column:
    """The kind of firm that the signs of its three flows show."""
    signs = sign_pattern(operating, investing, financing)
    return F.when(signs.isNull(), "no pattern: a flow is missing").otherwise(F.concat(F.lit("the firm "), mapped(signs, FLOWS, OTHER_FLOW)))


def guessed_market(code: Column | str) -> Column:
    """KOSPI for codes that start with 0, else KOSDAQ."""
    return F.when(col(code).startswith("0"), "KOSPI").when(col(code).isNotNull(), "KOSDAQ")


def score_bucket(score: Column | str) -> Column:
    """good from 70, mid from 40 or without a score, else bad."""
    return F.when(col(score).isNull() | F.isnan(col(score).cast("double")), "mid").otherwise(classes(score, [(70, "good"), (40, "mid")], "bad"))


def revenue_verdict(held: Column | str, parsed: Column | str, tolerance: float = 0.005) -> Column:
    """held_missing, parsed_missing, held_zero, same (within tolerance of what is held, of 1 at least) or other."""
    h, p = col(held), col(parsed)
    near = F.abs(p - h) / F.greatest(F.abs(h), F.lit(1.0)) <= tolerance
    return F.when(h.isNull(), "held_missing").when(p.isNull(), "parsed_missing").when(h == 0, "held_zero").when(near, "same").otherwise("other")


#: Relations of persons, and marks of companies.
PERSONAL = ("본인", "친인척", "친족", "인척", "계열회사 임원", "최대주주의 특수관계인", "최대주주 본인")
COMPANY_MARKS = ("주식회사", "(주)", "㈜", "(유)", "Ltd", "Inc", "Corp")


def is_person(name: Column | str, relation: Column | str) -> Column:
    """Whether a holder is a person: by a resident number, or by a name of 2 to 5 Hangul without a company's mark, where
    the relation is a person's or unknown."""
    marked = F.lit(False)
    for m in COMPANY_MARKS:
        marked = marked | col(name).contains(m)
    short = F.replace(col(name), F.lit(" "), F.lit("")).rlike("^[가-힣]{2,5}$") & ~marked
    near = F.coalesce(col(relation), F.lit("")) == ""
    for word in PERSONAL:
        near = near | F.coalesce(col(relation).contains(word), F.lit(False))
    return F.coalesce(col(name).rlike(r"\d{6}-\d{7}") | (short & near), F.lit(False))


def overlaps_category(title: Column | str, held: Column) -> Column:
    """Whether the words of a title, between middle dots, are all in those of one of the titles of an array, or the reverse."""
    words = lambda t: F.filter(F.transform(F.split(t, "·"), lambda w: F.trim(w)), lambda w: w != "")
    one = words(col(title))
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    return F.coalesce(F.exists(held, lambda t: (F.size(one) > 0) & (F.size(words(t)) > 0) & (within(one, words(t)) | within(words(t), one))), F.lit(False))


def sample_stratum(has_name: Column, text: Column | str, words: Sequence[str]) -> Column:
    """named_kw, named_only or kw_only of a chunk, by whether it names another firm and has one of the words."""
    keyed = F.lit(False)
    for w in words:
        keyed = keyed | F.coalesce(col(text).contains(w), F.lit(False))
    return F.when(has_name & keyed, "named_kw").when(has_name, "named_only").otherwise("kw_only")
