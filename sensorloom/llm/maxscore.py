"""Exact top-k by inner product with MaxScore over shards of postings.

Vector components become integers (``floor(scale * x)``). A *term* is a dimension
with a sign. The posting list of a term in a shard holds the components of that sign;
a query uses, for each of its non-zero components, the term with the same sign,
so every used posting adds to the score, and the largest impact of the list
bounds what it can add. Components of the other sign only lower a score, so leaving
them out keeps a bound.

Per query and shard the terms are split by these bounds: the *non-essential* ones
are those whose bounds together stay below the k-th best score known, so a vector
that no essential term reaches is out. The essential postings are traversed for all vectors of the shard; what is
still competitive with the bounds of the rest is probed term after term until it
is out or fully scored. Shards are independent; their best k per query are merged.

Defined results: vectors that are null, or hold null, NaN or infinite components,
take no part, nor do rows without an id; shorter vectors count as padded with zeros; a
query never meets rows with its own id; of repeated rows of one query id the least
vector is the query; repeated rows of other ids are candidates as often as they
occur; fewer than k candidates give fewer rows; an empty table gives an empty one.
Scores must fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
K = 5
# Vectors of one shard, queries that visit a shard together.
SHARD_ROWS = 8192
QUERY_ROWS = 1024
# Essential terms are added up this many at a time.
TERM_BLOCK = 8


def usable(column: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    values = F.col(column)
    bad = F.exists(
        values,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")),
    )
    return values.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id`` and ``v`` (array of long) of the vectors that take part."""
    numbers = F.transform(
        F.col(vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")
    )
    used = vectors.where(F.col(id_col).isNotNull() & usable(vector_col))
    return used.select(F.col(id_col).cast("bigint").alias("vec_id"), numbers.alias("v"))


def _matrix(rows: Iterable[np.ndarray], width: int) -> np.ndarray:
    rows = list(rows)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class Shard:
    """The postings of some vectors and the bounds of their lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        # One row per dimension: a posting list is a contiguous run.
        self.lists = np.ascontiguousarray(vectors[order].T)
        if len(ids):
            self.most = np.maximum(self.lists.max(axis=1), 0)
            self.least = np.minimum(self.lists.min(axis=1), 0)
        self.impacts: dict[int, np.ndarray] = {}

    def impact(self, term: int, positive: bool) -> np.ndarray:
        """A posting list: components of one sign, zero elsewhere."""
        key = 2 * term + positive
        if key not in self.impacts:
            values = self.lists[term]
            self.impacts[key] = np.maximum(values, 0) if positive else np.minimum(values, 0)
        return self.impacts[key]

    def top(self, query_id: int, query: np.ndarray, k: int, known: int | None):
        """Positions and scores of the shard's best k for one query.

        ``known``: a score that k candidates elsewhere already reach.
        """
        terms = np.flatnonzero(query)
        weights = query[terms]
        bounds = np.where(weights > 0, weights * self.most[terms], weights * self.least[terms])
        # From the largest bound down: the essential ones come first.
        order = np.argsort(-bounds, kind="stable")
        terms, weights, bounds = terms[order], weights[order], bounds[order]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        others = np.flatnonzero(self.ids != query_id)
        threshold = known
        if len(others) > k:
            # Exact scores of the vectors that lead after the first terms: the k-th
            # of them is reached by k candidates, so nothing below it matters.
            head = terms[:TERM_BLOCK]
            first = weights[:TERM_BLOCK] @ self.lists[head]
            lead = others[np.argpartition(-first[others], k - 1)[: 8 * k]]
            exact = weights @ self.lists[np.ix_(terms, lead)]
            reached = int(np.sort(exact)[-k])
            threshold = reached if known is None else max(known, reached)
        if threshold is None:
            n_essential = len(terms)
        else:
            n_essential = int(np.count_nonzero(rest[:-1] >= threshold))
        # Traverse the essential postings.
        gained = np.zeros(len(self.ids), dtype=np.int64)
        alive = others
        for start in range(0, n_essential, TERM_BLOCK):
            stop = min(start + TERM_BLOCK, n_essential)
            if len(alive) == len(others):
                for t, w in zip(terms[start:stop], weights[start:stop]):
                    gained += w * self.impact(t, w > 0)
            else:
                for t, w in zip(terms[start:stop], weights[start:stop]):
                    gained[alive] += w * self.impact(t, w > 0)[alive]
            if threshold is not None:
                alive = alive[gained[alive] + rest[stop] >= threshold]
        # Probe the non-essential ones for what is still competitive.
        for at in range(n_essential, len(terms)):
            if not len(alive):
                break
            t, w = terms[at], weights[at]
            gained[alive] += w * self.impact(t, w > 0)[alive]
            alive = alive[gained[alive] + rest[at + 1] >= threshold]
        scores = weights @ self.lists[np.ix_(terms, alive)] if len(terms) else np.zeros(len(alive))
        scores = np.asarray(scores, dtype=np.int64)
        best = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive][best], scores[best]


def _search(k: int):
    """The function of one shard: its vectors against every query block that visits it."""

    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(vectors) and len(queries):
            width = max(map(len, [*vectors["v"], *queries["q"]]))
            shard = Shard(vectors["vec_id"].to_numpy(), _matrix(vectors["v"], width))
            for query_id, values in zip(queries["query_id"], queries["q"]):
                query = np.zeros(width, dtype=np.int64)
                query[: len(values)] = values
                ids, scores = shard.top(int(query_id), query, k, None)
                found += [(int(query_id), int(i), int(s)) for i, s in zip(ids, scores)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    n_shards: int,
    n_blocks: int,
    k: int = K,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of quantized ``queries`` against ``vectors``.

    Both have ``vec_id`` and ``v``. Vectors are dealt to shards and queries to
    blocks; every block visits every shard, which is what an exact search
    costs, but each (shard, block) is a group of its own, so neither side
    ever has to fit in one task as a whole.
    """
    one_each = queries.groupBy("vec_id").agg(F.min("v").alias("q"))
    # Rows and not ids are dealt: many rows of one id are no large group.
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_shards)).cast("int")
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")
    asked = one_each.select(F.col("vec_id").alias("query_id"), "q").select(
        "*", block.alias("block"), F.explode(F.expr(f"sequence(0, {n_shards - 1})")).alias("shard")
    )
    dealt = vectors.select(
        "*", shard.alias("shard"), F.explode(F.expr(f"sequence(0, {n_blocks - 1})")).alias("block")
    )
    found = (
        dealt.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInPandas(_search(k), "query_id bigint, vec_id bigint, score bigint")
    )
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_search(
    table: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    scale: int = SCALE,
) -> DataFrame:
    """Top-k of the rows that ``is_query`` selects against all rows of ``table``."""
    rows = quantized(table, id_col, vector_col, scale)
    asking = quantized(table.where(is_query), id_col, vector_col, scale)
    sizes = table.agg(
        F.count("*").alias("rows"), F.coalesce(F.count_if(is_query), F.lit(0)).alias("queries")
    ).first()
    n_shards = max(1, -(-sizes["rows"] // SHARD_ROWS))
    n_blocks = max(1, -(-sizes["queries"] // QUERY_ROWS))
    return top_k(asking, rows, n_shards, n_blocks, k)
