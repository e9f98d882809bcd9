"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles (as 64-bit hashes). Documents with equal sets form a
*class*; the join runs over one node per class. Two sets with Jaccard >= 0.8 share at
least o = ceil(0.8 n) of either one's n shingles. In any order of all shingles the
first n - o + l of both then hold at least l common ones, for every l: a longer
prefix is a stronger condition.

What makes candidates expensive are shingles that many nodes have (*hot*: more than
``HOT`` nodes). A node's prefix is therefore as long as its cost demands:

1. *First prefix.* In hash order, n - o + L shingles, L about a 32nd of n. A node
   whose prefix holds h hot shingles needs no candidates from them: a partner shares
   L' prefix shingles (L' is the L of the smallest partner possible), so at least
   L' - h of its cheap ones. Only pairs with that many matches are verified.
2. *Whole set.* Where h >= L', the prefix is lengthened to the whole set and ordered by
   frequency among these nodes. With c shingles that are not hot there, a partner shares at
   least c - (n - o) of them, if that is positive.
3. *Core.* What is left are nodes of which over 80 % of the shingles are hot: large groups of
   near copies. Two of them that share a cheap shingle are found by it. Two that share
   none have all they share among their hot ones, which must then be 4/9 of both sizes
   together for either of them. Each hot shingle names the core node with the least share of
   cheap ones as its centre; every core node is verified against its centres, which joins
   nearly all that can be similar. After that, only core nodes in different
   components that pass this bound are candidates for each other.

Every step emits at most ``HOT`` candidates per posting but for the last, which meets only
nodes that the centres did not join. All candidates are verified on their whole
sets, and no candidate is dropped by a cap.

Defined results: a null or empty text, or one without words, is the empty set, linked
with nothing; a text with fewer than five words is one shingle of all its words; a row
without ``doc_id`` gets no component and links nothing; repeated rows get the
same result; if rows of one id differ in text, links of either count for the id; an
empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import Store, map_slices, texts_of, type_of
from sensorloom.llm.components import connected_components
from sensorloom.sources.scratch import ScratchTables, materialize

WORDS = 5
# Nodes that share a shingle above which it makes no candidates.
HOT = 16
# A node that shares fewer cheap shingles with all others together than it needs from one
# partner has no partner; shingles that meet by chance mostly end here.
MAY_PAIR = "need <= 0 or cheap >= need"
# The broadcast filter of ids never has more rows than this.
FILTER_SLOTS = 1 << 21

_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (two rounds of multiply and shift)."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def shingle_set(text: str) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit integers."""
    # bytes.lower() and bytes.split() know ASCII letters and white space only.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    width = min(WORDS, n)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total += hashes[i : n - width + 1 + i] * _FACTORS[i]
    return np.unique(_mixed(total).view(np.int64))


def required(n: int) -> int:
    """Shingles that a partner must share at least."""
    return -(-4 * n // 5)


def extra(n: int) -> int:
    """Shingles beyond n - o in the first prefix (L)."""
    return min(required(n), 1 + max(2, n // 32))


def _sql_required(n: str) -> str:
    return f"((4 * {n} + 4) div 5)"


def _sql_prefix(n: str) -> str:
    """Length of the first prefix."""
    o = _sql_required(n)
    return f"({n} - {o} + least({o}, 1 + greatest(2, {n} div 32)))"


def _sql_least_extra(n: str) -> str:
    """L of the smallest set that can be similar to one of n."""
    m = _sql_required(n)
    return f"least({_sql_required(m)}, 1 + greatest(2, {m} div 32))"


def signatures(docs: DataFrame, sets: bool = False) -> DataFrame:
    """``doc_id, n, d1, d2, tokens``: size and digest of the set, and the first
    prefix or (``sets``) the whole set, ascending."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, d1, d2, tokens = [], [], [], []
        for text in batch.column("text").to_pylist():
            found = shingle_set(text)
            n = len(found)
            digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
            sizes.append(n)
            d1.append(int.from_bytes(digest[:8], "little", signed=True))
            d2.append(int.from_bytes(digest[8:], "little", signed=True))
            tokens.append(found if sets else found[: n - required(n) + extra(n)])
        ends = np.zeros(len(tokens) + 1, dtype=np.int32)
        np.cumsum([len(t) for t in tokens], out=ends[1:])
        values = np.concatenate(tokens) if tokens else np.empty(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(d1, pa.int64()),
                pa.array(d2, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
            ],
            names=["doc_id", "n", "d1", "d2", "tokens"],
        )

    schema = f"doc_id {type_of(docs, 'doc_id')}, n bigint, d1 bigint, d2 bigint, tokens array<bigint>"
    return map_slices(texts_of(docs), "text", run, schema)


def _sets_of(docs: DataFrame, nodes: DataFrame, repeated: bool) -> DataFrame:
    """``node, n, tokens, costly`` with the whole sets of some nodes (``node, d1, d2, costly``).

    ``repeated``: whether ``docs`` may hold a row twice.
    """
    slot = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(FILTER_SLOTS))
    slots = nodes.select(F.pmod(F.xxhash64("node"), F.lit(FILTER_SLOTS)).alias("slot")).distinct()
    # At most FILTER_SLOTS numbers, so it may be broadcast; it keeps most texts
    # from being shuffled. The join by id below is the exact one.
    near = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    near = near.join(F.broadcast(slots), slot == slots["slot"], "left_semi")
    wanted = nodes.select("node", F.struct("d1", "d2", "costly").alias("digest"))
    exact = near.join(wanted, near["doc_id"] == F.col("node"))
    # The digest rides along: of rows with one id, only those count whose set is the class's.
    keyed = exact.select(F.struct("node", "digest").alias("doc_id"), "text")
    sets = signatures(keyed, sets=True).where("doc_id.digest.d1 = d1 and doc_id.digest.d2 = d2")
    found = sets.select("doc_id.node", "n", "tokens", "doc_id.digest.costly", "d1", "d2")
    if repeated:
        found = found.dropDuplicates(["node", "d1", "d2"])
    return found.drop("d1", "d2")


def _close(a: str, b: str) -> Column:
    """Whether two sizes allow Jaccard >= 0.8."""
    return F.expr(f"5 * least({a}, {b}) >= 4 * greatest({a}, {b})")


def _candidates(shared: DataFrame) -> DataFrame:
    """Pairs ``a, b`` from postings ``token, node, n, c, need, hot`` of first prefixes.

    A node with ``need`` > 0 makes candidates: of all that share at least ``need``
    of its cheap tokens. Two such nodes are looked at from one side only. Besides the
    k cheap tokens, a pair can share the hot ones of the poorer prefix and what lies
    behind the prefixes; together that must be 4/9 of both sizes.
    """
    cheap = shared.where(F.col("c") <= HOT).withColumn("behind", F.expr(f"n - {_sql_prefix('n')}"))
    sides = [
        cheap.select(
            "token",
            *[F.col(c).alias(f"{c}_{s}") for c in ("n", "need", "hot", "behind")],
            F.col("node").alias(s),
        )
        for s in "ab"
    ]
    met = (
        sides[0]
        .where("need_a > 0")
        .join(sides[1], "token")
        .where("a <> b and (need_b <= 0 or a < b)")
        .where(_close("n_a", "n_b"))
    )
    overlap = F.ceil((F.col("n_a") + F.col("n_b")) * 4 / 9 - 1e-6)
    elsewhere = F.least("hot_a", "hot_b") + F.greatest("behind_a", "behind_b")
    least = F.greatest("need_a", "need_b", overlap - elsewhere).alias("least_k")
    counted = met.groupBy("a", "b", least).agg(F.count("*").alias("k"))
    return counted.where("k >= least_k").select("a", "b")


def _whole_candidates(flagged: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes with whole sets that share a cheap token.

    Of k shared cheap tokens: k is at least what either node needs, and with the hot
    tokens of the poorer node it makes up 4/9 of both sizes, as a Jaccard of 0.8 asks.
    """
    cheap = flagged.where(F.col("c") <= HOT).where(MAY_PAIR)
    sides = [
        cheap.select(
            "token",
            *[F.col(c).alias(f"{c}_{s}") for c in ("n", "need", "hot")],
            F.col("node").alias(s),
        )
        for s in "ab"
    ]
    met = sides[0].join(sides[1], "token").where("a < b").where(_close("n_a", "n_b"))
    bounds = [
        F.greatest("need_a", "need_b").alias("need"),
        F.ceil((F.col("n_a") + F.col("n_b")) * 4 / 9 - 1e-6).alias("overlap"),
        F.least("hot_a", "hot_b").alias("hot"),
    ]
    counted = met.groupBy("a", "b", *bounds).agg(F.count("*").alias("k"))
    return counted.where("k >= need and k + hot >= overlap").select("a", "b")


def _frequent(postings: DataFrame, store: Store) -> DataFrame:
    """Postings of tokens that two nodes or more have, with their number ``c``."""
    counts = postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    # Written, so that the join below reads two plain tables and a hot token can be split.
    stored = store(counts, "token_counts")
    return postings.join(stored.hint("shuffle_hash"), "token")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that do have Jaccard >= 0.8."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    sized = both.select("a", "b", shared.alias("shared"), (F.size("ta") + F.size("tb")).alias("total"))
    return sized.where("100 * shared >= 80 * (total - shared)").select("a", "b")


def _flag_core(xshared: DataFrame) -> DataFrame:
    """Postings of the whole sets with ``need`` and the share of tokens that are not hot."""
    stats = xshared.groupBy("node", "n").agg(
        F.count_if(F.col("c") > HOT).alias("hot"), F.count_if(F.col("c") <= HOT).alias("cheap")
    )
    need = F.expr(f"{_sql_required('n')} - hot")
    stats = stats.select(
        "node", "hot", "cheap", need.alias("need"), (1 - F.col("hot") / F.col("n")).alias("other")
    )
    return xshared.join(stats, "node")


def _centre_pairs(flagged: DataFrame, store: Store) -> DataFrame:
    """Each core node with the centres of its hot tokens."""
    hot = flagged.where((F.col("need") <= 0) & (F.col("c") > HOT))
    centres = hot.groupBy("token").agg(
        F.min(F.struct("other", F.col("node").alias("b"), F.col("n").alias("nb"))).alias("centre")
    )
    met = hot.join(store(centres, "centres"), "token").select(
        F.col("node").alias("a"), F.col("centre.b").alias("b"), "n", F.col("centre.nb").alias("nb")
    )
    return met.where("a <> b").where(_close("n", "nb")).select("a", "b").distinct()


def _rest_pairs(flagged: DataFrame, components: DataFrame, store: Store) -> DataFrame:
    """Core nodes in different components that share hot tokens only.

    All they share lies in either one's h hot tokens and is at least 4/9 of both sizes
    together, say m; so they meet in the h - m + 1 rarest of these. A node is listed
    with what its smallest partner may need; a pair is met where its own m allows.
    """
    hot = flagged.where((F.col("need") <= 0) & (F.col("c") > HOT))
    placed = hot.join(components, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    # A token that only one component has joins nothing new.
    spread = placed.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    )
    live = store(spread.where("low <> high").select("token"), "live_tokens")
    # At most the tokens of one set.
    order = F.array_sort(F.collect_list(F.struct("c", "token")))
    ordered = placed.groupBy("node", "n", "hot", "component").agg(order.alias("ordered"))
    width = F.expr(f"hot - {_sql_required('n')} + 1").cast("int")
    prefix = ordered.select(
        "node", "n", "component", "hot", F.posexplode(F.slice("ordered", F.lit(1), width)).alias("i", "t")
    ).select("node", "n", "component", (F.col("hot") - F.col("i")).alias("left"), "t.token")
    open_ = store(prefix.join(live, "token", "left_semi"), "core_prefixes")
    sides = [
        open_.select(
            "token",
            *[F.col(c).alias(f"{c}_{s}") for c in ("n", "left", "component")],
            F.col("node").alias(s),
        )
        for s in "ab"
    ]
    met = sides[0].join(
        sides[1],
        (sides[0]["token"] == sides[1]["token"])
        & F.expr("a < b and component_a <> component_b")
        & _close("n_a", "n_b")
        & F.expr("9 * least(left_a, left_b) >= 4 * (n_a + n_b)"),
    )
    return met.select("a", "b").distinct()


def _same_id(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of the ids that stand in more than one class with the nodes of these."""
    held = rows.where("n > 0 and doc_id is not null").select("doc_id", "d1", "d2", "n").distinct()
    several = held.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    classes = held.join(several.hint("shuffle_hash"), "doc_id").join(
        nodes.select("d1", "d2", "n", "node"), ["d1", "d2", "n"]
    )
    return classes.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")


def similar_classes(
    docs: DataFrame, store: Store = materialize
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures per row, classes ``d1, d2, n, node`` and links ``a, b`` between nodes.

    The links suffice for the components. They are not all links there are: within large
    groups, core nodes are linked with centres, by cheap shingles or across components only.
    """
    rows = store(signatures(docs), "signatures")
    classes = (
        rows.where("n > 0 and doc_id is not null")
        .groupBy("d1", "d2", "n")
        .agg(F.min("doc_id").alias("node"), F.first("tokens").alias("tokens"))
    )
    nodes = store(classes, "nodes")
    postings = nodes.select("node", "n", F.explode("tokens").alias("token"))
    shared = store(_frequent(postings, store), "shared_tokens")
    counted = shared.groupBy("node", "n").agg(
        F.count_if(F.col("c") > HOT).alias("hot"), F.count_if(F.col("c") <= HOT).alias("cheap")
    )
    needs = store(
        counted.select("node", F.expr(f"{_sql_least_extra('n')} - hot").alias("need"), "cheap", "hot"),
        "needs",
    )
    first = store(_candidates(shared.join(needs.where(MAY_PAIR), "node")), "candidates")
    # The flag travels with a set, so that no set is shuffled to find it.
    met = [first.select(F.col(side).alias("node"), F.lit(False).alias("costly")) for side in "ab"]
    costly = needs.where("need <= 0").select("node", F.lit(True).alias("costly"))
    involved = (
        met[0].unionByName(met[1]).unionByName(costly).groupBy("node").agg(F.max("costly").alias("costly"))
    )
    keyed = store(nodes.select("node", "d1", "d2").join(involved, "node"), "involved")
    twice = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    repeated = not twice.isEmpty()
    sets = store(_sets_of(docs, keyed, repeated=repeated), "sets")
    whole = sets.where("costly").select("node", "n", F.explode("tokens").alias("token"))
    flagged = store(_flag_core(_frequent(whole, store)), "whole_postings")
    pairs = first.unionByName(_whole_candidates(flagged)).unionByName(_centre_pairs(flagged, store))
    links = store(_verified(pairs.distinct(), sets), "first_links")
    joined = connected_components(links, "a", "b", store)
    # Core nodes are costly ones.
    core = sets.where("costly")
    rest = store(_verified(_rest_pairs(flagged, joined, store), core), "rest_links")
    links = links.unionByName(rest)
    if repeated:
        links = links.unionByName(_same_id(rows, nodes))
    return rows, nodes.drop("tokens"), links


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``."""
    with ScratchTables(docs.sparkSession) as scratch:
        store = scratch.materialize
        rows, nodes, links = similar_classes(docs, store)
        components = connected_components(links, "a", "b", store)
        known = nodes.join(components, "node", "left").select(
            "d1", "d2", "n", F.coalesce("component", "node").alias("component")
        )
        # All that the result reads; the rest goes now.
        known = materialize(known, "classes")
        rows = materialize(rows.select("doc_id", "n", "d1", "d2"), "signatures")
    joined = rows.join(known, ["d1", "d2", "n"], "left")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
