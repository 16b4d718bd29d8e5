"""What kind of party a name in a filing stands for, or why it stands for none. Null names count as empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

#: Texts that are no names, parts of names, and words of classes, dealings and groups of holders.
EMPTY = ("", "-", "−", "―", "계", "합계", "소계", "총계", "n/a", "na")
FRAGMENTS = (
    "llc", "ltd", "ltd.", "inc", "inc.", "l.p.", "lp", "co.", "co", "corp", "corp.", "gmbh", "s.a.", "sa", "pte", "pte.", "b.v.", "bv", "n.v.", "nv",
    "s.r.o.", "sarl", "sas", "plc", "ag", "kk", "주식회사", "㈜", "(주)",
)
CLASS_WORDS = ("특수관계자", "관계기업", "공동기업", "종속기업", "지배기업", "기업집단", "계열회사", "경영진", "영향력", "공동지배", "합계", "소계")
DEALING_WORDS = (
    "거래", "매출", "매입", "수익", "비용", "자산", "부채", "채권", "채무", "구매", "판매", "대여", "차입", "상환", "출자금", "배당", "급여", "보상", "잔액", "대손", "미수", "미지급", "선급", "선수",
)
HOLDER_GROUPS = (
    "자기주식", "자사주", "기타개인", "우리사주조합", "소액주주", "기타주주", "국민연금", "기타법인", "주요주주", "임원등", "임직원등", "임원", "임직원", "주주", "특수관계인등", "우리사주", "기타주식",
)
COMPANY = (
    r"(?iU)㈜|\(주\)|주식회사|유한회사|합자회사|합명회사|유한책임회사|\bLtd\b|\bInc\b|\bLLC\b|\bLLP\b|\bGmbH\b|\bS\.A\b|\bN\.V\b|\bB\.V\b|\bPte\b|\bCorp\b|\bCo\b|\bCompany\b|\bLimited\b|\bPLC\b|\bAG\b|s\.r\.o|SARL|SAS"
    r"|은행|증권|보험|캐피탈|홀딩스|파트너스|산업|전자|화학|건설|자산운용|자산신탁|투자신탁|자산개발|인베스트먼트|거래소|리츠|에셋|금융|카드|저축|리스|벤처스|테크놀로지|시스템|네트웍스|솔루션"
)
SHAPES = (
    (r"^[\d,.\s%()\-–—~]+$", "numeric_only"), (r"^\d+\s*\)$", "orphan_marker"), (r"^\(?\s*단위\s*[:：]", "unit_header"), (r"^(?:주|\*|note)\s*\d*\s*\)", "footnote_prefix"),
)
GROUP_TOTAL = r"등\s*(?:기타\s*)?\d+\s*개\s*사"
SENTENCE = r"습니다|합니다|하였음|되었음|입니다|하였고|되었고|바랍니다|연결회사는|연결실체는|공정거래위원회|의\s*경우|주석\s*\d+\s*참조|흡수합병|사명변경|상호를?\s*변경|지분을\s*취득"


def _holds(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join("\\Q" + w + "\\E" for w in words))


def _clean(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), r"^\s+|\s+$", "")


def no_party(name: Column | str) -> Column:
    """Why a name stands for no party, by the first rule that fits; null if it may stand for one. Names with a company's
    mark are never classes or dealings."""
    s = _clean(name)
    low, dense, company = F.lower(s), F.regexp_replace(s, r"\s+", ""), s.rlike(COMPANY)
    out = F.when(low.isin(*EMPTY), "empty_or_total").when(low.isin(*FRAGMENTS) | F.trim(low, F.lit(".")).isin(*FRAGMENTS), "suffix_fragment").when(F.length(s) < 2, "too_short")
    for pattern, why in SHAPES:
        out = out.when(s.rlike(pattern), why)
    out = out.when(dense.isin(*HOLDER_GROUPS), "aggregate_token").when(s.rlike(GROUP_TOTAL), "group_total").when(s.rlike(SENTENCE), "sentence_form")
    return out.when(_holds(s, CLASS_WORDS) & ~company, "category_label").when(_holds(s, DEALING_WORDS) & ~company, "txn_item")


#: Chinese letters of kinship; last words of a relation that name a person or a company; words of companies
#: anywhere, one-letter relations of persons (whole), and words of persons anywhere.
KINSHIP = "[子女夫妻父母兄弟姉妹姊孫叔伯姪甥媤壻]"
PERSON_ENDS = (
    "임원", "이사", "감사", "본인", "친인척", "친족", "인척", "배우자", "자녀", "특수관계인", "며느리", "사위", "조카", "친척", "형제", "자매", "부인", "최대주주",
    "대표", "회장", "사장", "전무", "상무", "제수", "형수", "숙부", "숙모", "직계비속", "직계존속", "임직원",
)
COMPANY_ENDS = ("회사", "법인", "계열", "조합", "펀드", "재단", "단체")
COMPANY_RELATIONS = ("법인", "회사", "계열", "자회사", "모회사", "관계사", "제휴", "거래처", "매출처", "매입처", "출자", "투자")
SHORT_RELATIONS = ("자", "부", "모", "제", "매", "형", "손", "처", "녀", "남")
PERSON_RELATIONS = (
    "본인", "최대주주", "친인척", "친족", "인척", "배우자", "자녀", "특수관계인", "대표이사", "사내이사", "사외이사", "감사", "임원", "며느리", "사위", "조카", "친척", "형제", "자매", "부인",
)


def relation_signal(relation: Column | str) -> Column:
    """person, corp or neutral, as a relation says: its last word counts most. Blanks and closing brackets don't count."""
    r = F.regexp_replace(F.regexp_replace(F.coalesce(col(relation), F.lit("")), r"\s+", ""), r"[)\]）]+$", "")
    ends = lambda words: r.rlike("(?:" + "|".join(words) + ")$")
    out = F.when(r.rlike(KINSHIP), "person").when(r == "", "neutral").when(ends(PERSON_ENDS), "person").when(ends(COMPANY_ENDS), "corp")
    return out.when(_holds(r, COMPANY_RELATIONS), "corp").when(r.isin(*SHORT_RELATIONS), "person").when(_holds(r, PERSON_RELATIONS), "person").otherwise("neutral")


#: Words of funds and public bodies, and family names.
FUND_WORDS = ("조합", "펀드", "신탁", "공제", "투자회사", "사모", "벤처투자", "인베스트먼트", "리츠", "유동화전문", "제이차", "기금", "fund", "trust", "partners l.p.")
PUBLIC_WORDS = ("공단", "공사", "진흥원", "연구원", "재단", "협회", "학교", "대학교", "정부", "조달청", "국민연금", "예금보험", "산업은행", "수출입은행", "중소벤처기업")
FAMILY_NAMES = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민"


def party_kind(name: Column | str, relation: Column | str, may_be_person: bool = True, by_family_name: bool = False) -> Column:
    """person, coop_fund, public_org or private_corp. may_be_person: False where only companies stand, such as what a firm
    invests in. by_family_name: lists of holders, where three syllables with a family name are a person's unless the
    relation says otherwise. no_party() comes first."""
    s = _clean(name)
    dense, company, signal = F.regexp_replace(s, r"\s+", ""), s.rlike(COMPANY), relation_signal(relation)
    may = F.lit(may_be_person) & ~company
    numbered = may & ~s.contains("등록번호") & s.rlike(r"\d{6}\s*-\s*\d{7}")
    family = may & F.lit(by_family_name) & (signal == "neutral") & dense.rlike(f"^[{FAMILY_NAMES}][가-힣]{{2}}$")
    out = F.when(numbered | (may & (signal == "person") & dense.rlike("^[가-힣]{2,4}$")), "person")
    return out.when(_holds(s, FUND_WORDS) | F.lower(s).rlike("fund|trust"), "coop_fund").when(_holds(s, PUBLIC_WORDS), "public_org").when(family, "person").otherwise("private_corp")


#: Marks between names of a list, brackets, where names run into each other, and legal forms that stand alone.
SEPARATORS, OPEN, CLOSE = ",、·", "([{（［｛", ")]}）］｝"
GLUED = ((r"((?:Inc|Ltd|Ltda|Corp|LLC|GmbH)\.)(?=[A-Z가-힣])", "$1,"), (r"\)(?=㈜|\(주\))", "),"))
FORM_TAILS = (
    "ltd", "inc", "llc", "llp", "co", "corp", "gmbh", "sa", "sas", "sarl", "bv", "nv", "pte", "plc", "ag", "kk", "lp", "sro", "srl", "pty", "spa",
    "limited", "company", "corporation", "sdnbhd", "bhd", "ltda", "cv", "kg",
)


def _is_form(piece: Column) -> Column:
    """Whether a piece is a legal form alone: eight Latin letters at most, with a full stop or among FORM_TAILS."""
    letters = F.lower(F.regexp_replace(piece, "[^A-Za-z]", ""))
    return letters.rlike("^.{1,8}$") & ~piece.rlike("[가-힣]") & (piece.contains(".") | letters.isin(*FORM_TAILS))


def listed_names(text: Column | str) -> Column:
    """The names of a list, between separators outside brackets, legal forms with the name before them; an empty array for
    a null or a single name. Whatever has eight Latin letters at most and a full stop counts as a form, so Beta Inc. does."""
    for pattern, to in GLUED:
        text = F.regexp_replace(col(text), pattern, to)
    empty = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))

    def marked(state: Column, c: Column) -> Column:
        depth = F.when(c.isin(*OPEN), state["depth"] + 1).when(c.isin(*CLOSE), F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        return F.struct(depth.alias("depth"), F.concat(state["text"], F.when(c.isin(*SEPARATORS) & (depth == 0), "\n").otherwise(F.replace(c, F.lit("\n"), F.lit(" ")))).alias("text"))

    pieces = F.filter(F.transform(F.split(F.aggregate(F.split(text, ""), empty, marked)["text"], "\n"), lambda p: F.trim(p)), lambda p: p != "")
    none = F.array().cast("array<string>")
    whole = F.aggregate(
        pieces, none,
        lambda held, p: F.when((F.size(held) > 0) & _is_form(p), F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(F.concat_ws(", ", F.get(held, F.size(held) - 1), p)))).otherwise(F.concat(held, F.array(p))),
    )
    return F.when(F.size(whole) > 1, whole).otherwise(none)


#: Kinds of sectors by words, the first that fits.
SECTOR_KINDS = (("금융|은행|증권|보험", "finance"), ("식품|음식료|농수산|가공식품|음료", "food"), ("반도체|전자부품|정밀기기", "semiconductor"), ("소매|유통|마트|백화점", "retail"), ("경비|경호|보안", "security"))


def first_item(items: Column, field: str, word: str) -> Column:
    """The first struct of an array whose field contains a word; null without one."""
    return F.get(F.filter(items, lambda x: F.coalesce(x[field].contains(word), F.lit(False))), 0)
