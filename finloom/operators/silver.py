"""From raw relations to edges: one pass of ordered rules in which each row gets its fate, nodes of parties without a code,
and the numbers of fates.

raw: id (arrival), source_type, source_name, target_name, relate, ratio, stock_kind, year, raw_response.
registry: name, code. blocked: source, target. overrides: code, group_name. Nothing is updated: edges and nodes are
functions of these tables, whatever the order of rows, and a second run gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.labels import shown_name
from ..functions.parties import no_party, party_kind, relation_signal
from ..functions.texts import normal_name, plain_uid, short_latin_name, unlisted_uid
from .relations import reduced

#: Kinds of sources (holders of a firm, what a firm invests in, groups, filings), those this pass manages, and
#: words of stock that stand in a name's column by mistake.
HOLDERS, INVESTED, GROUPS, FILINGS = "hyslrSttus", "otrCprInvstmntSttus", "ftc", "dart_filing"
MANAGED = (HOLDERS, INVESTED, GROUPS)
STOCK_WORDS = ("보통주", "우선주", "종류주", "전환우선주", "상환우선주", "기타주")
MOST_SHARE = 100

#: The counters of a run.
FATES = {
    "kept_ownership": "kept_ownership", "kept_ftc": "kept_ftc", "kept_filing": "kept_filing", "unmatched": "dropped_unmatched", "blocklist": "dropped_blocklist",
    "ratio_invalid": "dropped_ratio_invalid", "self_loop": "dropped_self_loop", "stock_kind_row": "dropped_stock_kind_row",
}
KEY = ["source", "target", "source_type", "year"]


def _settled(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with columns, as generated ones: filters on them stay above, so that long rules stand once in a plan."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def named_ends(keys: DataFrame, registry: DataFrame, blocked: DataFrame, overrides: DataFrame) -> DataFrame:
    """_key (n: and a name, or c: and a code) of keys, once, with code, shown and plain (a name as it is shown, and that as it
    is looked up, null if it stands for no party), own (the group that overrides says) and against (what is blocked behind
    it). A name is read once, however many rows have it, and rows meet all of this in one join for each end."""
    listed = registry.where("code IS NOT NULL")
    book = listed.select(F.concat(F.lit("n:"), normal_name("name")).alias("_k"), "code").union(listed.select(F.concat(F.lit("c:"), "code"), "code"))
    book = book.where("_k IS NOT NULL AND _k <> 'n:'").groupBy("_k").agg(F.max("code").alias("code"))
    own = overrides.groupBy("code").agg(F.max("group_name").alias("own"))
    against = blocked.groupBy(F.col("source").alias("code")).agg(F.collect_set("target").alias("against"))
    book = book.join(own, "code", "left").join(against, "code", "left")
    once, name, is_name = keys.where("_key IS NOT NULL").distinct(), F.substring("_key", 3, 2**31 - 1), F.col("_key").startswith("n:")
    once = _settled(once, {"_k": F.when(is_name, F.concat(F.lit("n:"), normal_name(name))).otherwise(F.col("_key")), "shown": F.when(is_name, shown_name(name))})
    once = _settled(once, {"plain": F.when(is_name & no_party("shown").isNull(), normal_name("shown"))})
    return once.join(book, "_k", "left").drop("_k")


def judged(raw: DataFrame, registry: DataFrame, blocked: DataFrame, overrides: DataFrame) -> DataFrame:
    """raw with fate, source and target (codes, or ids of nodes without one), anchor and party (the firm that names such a
    node, and its name as shown), queued (a name too short to link by), kind of stock, and group_name.

    Holders' rows: stock words as a name, a firm that isn't listed, a name that stands for no party, and a firm that holds
    itself go. Investments: an unlisted firm, a share above MOST_SHARE, no party and blocked pairs go; of a firm in itself
    without being counted. Groups and filings name codes, both of which must be known. What is left is kept.
    """
    holder, invested = F.col("source_type") == HOLDERS, F.col("source_type") == INVESTED
    named = holder | invested
    key = lambda c: F.concat(F.when(named, "n:").otherwise("c:"), F.col(c))
    # what rows say alone comes first, so that the joins carry short columns
    stock = F.when(~holder, "unknown").when(F.col("stock_kind").contains("보통"), "common").when(F.col("stock_kind").rlike("우선|종류"), "preferred").otherwise("unknown")
    words = F.coalesce(holder & F.trim("source_name").isin(*STOCK_WORDS), F.lit(False))
    rows = raw.select("*", key("source_name").alias("_ks"), key("target_name").alias("_kt"), stock.alias("stock"), words.alias("_words"), (invested & short_latin_name("target_name")).alias("_short"),
                      F.when(F.col("source_type") == GROUPS, F.get_json_object("raw_response", "$.group_name")).alias("_group"))
    book = named_ends(rows.select(F.explode(F.array("_ks", "_kt")).alias("_key")), registry, blocked, overrides)
    by = lambda c, *columns: book.select(F.col("_key").alias(c), *(F.col(a).alias(b) for a, b in columns))
    rows = rows.join(by("_ks", ("code", "_s"), ("shown", "_p1"), ("plain", "_q1"), ("against", "_not")), "_ks", "left")
    rows = rows.withColumns({"_p1": F.when(holder, F.col("_p1")), "_q1": F.when(holder, F.col("_q1")), "_not": F.when(invested, F.col("_not"))})
    rows = rows.join(by("_kt", ("code", "_t"), ("shown", "_p2"), ("plain", "_q2"), ("own", "_own")), "_kt", "left")
    party = F.when(named, F.coalesce(F.when(holder, F.col("_p1")).otherwise(F.col("_p2")), F.lit("")))
    rows = _settled(rows, {"party": party, "_plain": F.when(holder, F.col("_q1")).otherwise(F.col("_q2")), "anchor": F.when(holder, F.col("_t")).when(invested, F.col("_s"))})
    uid = F.when(F.col("_plain").isNotNull(), plain_uid("anchor", "_plain"))
    found = F.when(holder, F.coalesce("_s", uid)).when(invested, F.coalesce("_t", uid))
    rows = _settled(rows, {"source": F.when(holder, found).otherwise(F.col("_s")), "target": F.when(invested, found).otherwise(F.col("_t"))})
    blocks = F.array_contains("_not", F.col("target"))
    both, same = F.col("source").isNotNull() & F.col("target").isNotNull(), F.col("source") == F.col("target")
    holders = F.when(F.col("_words"), "stock_kind_row").when(~both, "unmatched").when(same, "self_loop").otherwise("kept_ownership")
    investments = F.when(F.col("_s").isNull(), "unmatched").when(F.col("ratio") > MOST_SHARE, "ratio_invalid").when(~both, "unmatched").when(blocks, "blocklist").when(same, "own").otherwise("kept_ownership")
    fate = F.when(holder, holders).when(invested, investments).when(F.col("source_type") == GROUPS, F.when(both, "kept_ftc").otherwise("unmatched"))
    fate = fate.when((F.col("source_type") == FILINGS) & both, "kept_filing").otherwise("ignored")
    asked = invested & F.col("_s").isNotNull() & ~F.coalesce(F.col("ratio") > MOST_SHARE, F.lit(False))
    made = (holder & ~F.col("_words") & F.col("_t").isNotNull() & F.col("_s").isNull()) | (asked & F.col("_t").isNull())
    group = F.when(F.col("source_type") == GROUPS, F.coalesce("_own", "_group"))
    rows = _settled(rows, {"fate": fate, "queued": F.coalesce(asked & F.col("_t").isNull() & F.col("_short"), F.lit(False)), "group_name": group})
    rows = rows.withColumn("node", F.when(F.coalesce(made, F.lit(False)), F.when(holder, F.col("source")).otherwise(F.col("target"))))
    return rows.drop("_ks", "_kt", "_s", "_t", "_p1", "_p2", "_q1", "_q2", "_not", "_own", "_words", "_short", "_group", "_plain")


def silver_edges(rows: DataFrame) -> DataFrame:
    """The edges of judged rows, one for each of KEY: common stock before unknown before preferred, then the higher share,
    then the later row."""
    kept = reduced(rows.where("fate LIKE 'kept%'"), KEY, "stock", "ratio", "id")
    kind = F.when(F.col("fate") == "kept_ftc", "ftc_group").when(F.col("fate") == "kept_filing", "dart_filing").otherwise("ownership")
    return kept.select(*KEY, kind.alias("relation"), F.when(kind == "ownership", F.col("ratio")).alias("ratio"), "group_name")


def kind_of(name: str, relate: str, first_seen: str) -> Column:
    """party_kind of a node by what is stored of it: what is invested in is no person, holders may be told by family names."""
    by = lambda **more: party_kind(name, relate, **more)
    return F.when(F.col(first_seen).startswith("otrCpr"), by(may_be_person=False)).when(F.col(first_seen).startswith(HOLDERS), by(by_family_name=True)).otherwise(by())


def silver_nodes(rows: DataFrame) -> DataFrame:
    """uid, anchor, name, relate, first_seen and kind of the parties without a code: the shortest name, the first relation
    that names a person, else the last; the kind follows from these, whatever the order of rows."""
    own = rows.where("node IS NOT NULL").withColumn("_seen", F.concat_ws(":", "source_type", "year"))
    own = own.withColumn("_relate", F.when(F.col("source_type") == HOLDERS, F.col("relate")))
    person = relation_signal("_relate") == "person"
    found = own.groupBy(F.col("node").alias("uid")).agg(
        F.min("anchor").alias("anchor"), F.min_by("party", F.struct(F.length("party"), "id")).alias("name"),
        F.coalesce(F.min_by(F.when(person, F.col("_relate")), F.when(person, F.col("id"))), F.max_by("_relate", "id")).alias("relate"), F.min_by("_seen", "id").alias("first_seen"),
    )
    return found.withColumn("kind", kind_of("name", "relate", "first_seen"))


def reconciled(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored nodes with names and kinds by the rules of now, moves): nodes of one anchor whose shown names have become the
    same are one, that with the id of this name, else the least; moves (old, new) says which went where, to null if the
    name stands for no party."""
    clean = _settled(nodes, {"_name": shown_name("name")})
    clean = _settled(clean, {"_none": (F.col("_name") == "") | no_party("_name").isNotNull()})
    rest = [c for c in nodes.columns if c not in ("uid", "anchor", "name", "kind")]
    own = F.struct((F.col("uid") != unlisted_uid("anchor", "_name")).alias("other"), "uid", *rest)
    groups = clean.where("NOT _none").groupBy("anchor", "_name").agg(F.min(own).alias("_o"))
    kept = groups.select("_o.uid", "anchor", F.col("_name").alias("name"), *(f"_o.{c}" for c in rest)).withColumn("kind", kind_of("name", "relate", "first_seen"))
    to = groups.select("anchor", "_name", F.col("_o.uid").alias("new"))
    moves = clean.where("NOT _none").join(to, ["anchor", "_name"]).where("uid <> new").select(F.col("uid").alias("old"), "new")
    return kept.select(*nodes.columns), moves.union(clean.where("_none").select("uid", F.lit(None).cast("string")))


def referenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that an edge names."""
    ends = edges.select(F.col("source").alias("uid")).union(edges.select("target")).distinct()
    return nodes.join(ends, "uid", "left_semi")


def _counts() -> list[Column]:
    of = lambda condition, name: F.coalesce(F.sum(F.when(condition, 1)), F.lit(0)).cast("long").alias(name)
    out = [of(F.col("fate") == fate, name) for fate, name in FATES.items()]
    return [*out, of(F.col("queued"), "queued_ambiguous"), of(F.col("node").isNotNull(), "unlisted_nodes"), F.lit(0).cast("long").alias("dropped_personal"), F.lit(0).cast("long").alias("dropped_foundation")]


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """rows, and the counters of their fates, filled by the first job that reads rows: none of its own."""
    out = Observation("fates")
    constant = ("dropped_personal", "dropped_foundation")  # persons and foundations are nodes now
    return rows.observe(out, *(c for c in _counts() if not any(n in str(c) for n in constant))), out


def counters(rows: DataFrame, old_edges: DataFrame, old_nodes: DataFrame) -> DataFrame:
    """All counters of a run in one row: fates; pruned_stale, old edges of managed sources that no row makes any more;
    pruned_orphan_nodes, old and new nodes that no edge names, and old edges elsewhere that name a node which isn't there;
    kind_reconciled, old nodes whose name, kind or id changes. rows are read several times: written() first, they are judged
    once."""
    edges, nodes = rows.where("fate LIKE 'kept%'").select(*KEY).distinct(), rows.where("node IS NOT NULL").select(F.col("node").alias("uid"))
    managed = F.col("source_type").isin(*MANAGED)
    stale = old_edges.where(managed).join(edges, KEY, "left_anti").agg(F.count("*").alias("pruned_stale"))
    elsewhere = old_edges.where(~managed).select("source", "target")
    kept, moves = reconciled(old_nodes)
    changed = kept.alias("n").join(old_nodes.alias("o"), "uid").where("n.name <> o.name OR NOT n.kind <=> o.kind").select("uid").union(moves.select("old"))
    every = kept.select("uid").union(nodes.select("uid")).distinct()
    orphans = every.join(referenced(every, edges.select("source", "target").union(elsewhere)), "uid", "left_anti").select("uid")
    ends = elsewhere.select(F.monotonically_increasing_id().alias("e"), F.explode(F.array("source", "target")).alias("uid")).where("uid LIKE 'x\\_%'")
    dangling = ends.join(every, "uid", "left_anti").select(F.col("e").cast("string")).distinct()
    return rows.agg(*_counts()).crossJoin(stale).crossJoin(orphans.union(dangling).agg(F.count("*").alias("pruned_orphan_nodes"))).crossJoin(changed.agg(F.count("*").alias("kind_reconciled")))
