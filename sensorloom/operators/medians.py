"""Exact medians of large groups.

A quantile summary is exact for groups of some thousand values; beyond that it returns an element
near the middle, and which one depends on how the group was spread over tasks. For larger groups
the middle element is found by narrowing: count the values between two bounds in equal ranges, keep the
range that holds the middle rank, go on between the least and the greatest value in it. Counts are partial
sums before any exchange, so a group of any size and any spread costs one pass per round, and
two or three rounds do. What is left in the last range is ranked by value.

The result is the element of rank ceil(n / 2) of the n values that are not NULL; NaN is the greatest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.columns import SUMMARISED
from sensorloom.sources.scratch import materialize

# Up to so many events the summary of accuracy 10,000 holds every value of a group.
EXACT_ROWS = 5_000
# Ranges that a round counts in, and distinct values that are ranked in the end.
RANGES = 1024
RANKED_VALUES = 4096
# Up to so many groups their bounds are broadcast (a kilobyte each).
BROADCAST_GROUPS = 50_000
# Each round cuts at least the greatest value off, and nearly always all but a thousandth.
MOST_ROUNDS = 200


def large_groups(
    sizes: DataFrame, keys: list[str], above: int | None = None
) -> tuple[DataFrame, int] | None:
    """The groups of a table ``(*keys, n_rows)`` that a summary does not hold, and how many they
    are (an action); None if there are none. Rows of one group are added up."""
    above = EXACT_ROWS if above is None else above
    large = sizes.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"))
    stored = materialize(large.where(F.col("n_rows") > above).select(*keys), "large_groups")
    count = stored.count()
    return (stored, count) if count else None


def _same(keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"g_{key}"))
    return condition


def _values(events: DataFrame, keys: list[str], bounds: DataFrame, count: int) -> DataFrame:
    """``*keys, metric, value, low, high``: the values of open metrics within their bounds.

    ``bounds`` has one row per group: its keys as ``g_<key>``, and ``bounds``, a map from metric to (low, high).
    """
    small = F.broadcast(bounds) if count <= BROADCAST_GROUPS else bounds
    cells = F.array(
        *[
            F.struct(F.lit(p).alias("metric"), F.col(c).cast("double").alias("value"))
            for p, c in SUMMARISED.items()
        ]
    )
    joined = events.join(small, _same(keys)).select(*keys, "bounds", F.inline(cells))
    held = joined.withColumn("b", F.col("bounds")[F.col("metric")]).where(
        F.col("value").isNotNull() & F.col("b").isNotNull()
    )
    inside = F.col("value").between(F.col("b.low"), F.col("b.high"))
    return held.where(inside).select(*keys, "metric", "value", "b.low", "b.high")


def _per_group(open_: DataFrame, keys: list[str]) -> DataFrame:
    entry = F.struct("metric", F.struct("low", "high").alias("b"))
    maps = open_.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("bounds"))
    return maps.select(*[F.col(k).alias(f"g_{k}") for k in keys], "bounds")


def exact_medians(
    events: DataFrame, keys: list[str], groups: tuple[DataFrame, int], ranked: int | None = None
) -> DataFrame:
    """``*keys`` and ``<metric>_p50`` for every summarised metric of the given groups.

    ``events`` has the keys and the summarised columns. Runs one job per round, until no
    more than ``ranked`` values are left.
    """
    chosen, count = groups
    ranked = RANKED_VALUES if ranked is None else ranked
    wide_open = (F.col("low") != F.col("high")) & (F.col("left") > ranked)
    wide = [F.col(k).alias(f"g_{k}") for k in keys]
    members = chosen.select(*wide)
    members = F.broadcast(members) if count <= BROADCAST_GROUPS else members
    # The first bounds: the least and the greatest value.
    ends = [
        F.struct(
            F.lit(p).alias("metric"),
            F.count(c).alias("n"),
            F.min(F.col(c).cast("double")).alias("low"),
            F.max(F.col(c).cast("double")).alias("high"),
        ).alias(p)
        for p, c in SUMMARISED.items()
    ]
    extremes = events.join(members, _same(keys)).groupBy(*keys).agg(*ends)
    first = extremes.select(*keys, F.inline(F.array(*SUMMARISED))).where("n > 0")
    # The rank that is looked for among the values between the bounds, from 1; and how many those are.
    state = first.select(
        *keys, "metric", "low", "high", F.expr("(n + 1) div 2").alias("rank"), F.col("n").alias("left")
    )
    state = materialize(state, "median_bounds")
    for _ in range(MOST_ROUNDS):
        open_ = state.where(wide_open)
        if open_.isEmpty():
            break
        narrowed = _narrowed(events, keys, open_, count)
        state = materialize(state.where(~wide_open).unionByName(narrowed), "median_bounds")
    # One value is left, or few enough to be ranked.
    done = state.where(F.col("low") == F.col("high")).select(*keys, "metric", F.col("low").alias("p50"))
    few = state.where(F.col("low") != F.col("high"))
    counted = (
        _values(events, keys, _per_group(few, keys), count)
        .groupBy(*keys, "metric", "value")
        .agg(F.count("*").alias("times"))
    )
    # At most ``ranked`` rows per group and metric.
    upto = Window.partitionBy(*keys, "metric").orderBy("value")
    in_order = counted.withColumn("upto", F.sum("times").over(upto))
    wanted = few.select(*wide, F.col("metric").alias("g_metric"), "rank")
    found = (
        in_order.join(wanted, _same([*keys, "metric"]))
        .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("times") < F.col("rank")))
        .select(*keys, "metric", F.col("value").alias("p50"))
    )
    medians = done.unionByName(found)
    sides = [
        F.max(F.when(F.col("metric") == p, F.col("p50"))).alias(f"{p}_p50") for p in SUMMARISED
    ]
    return materialize(medians.groupBy(*keys).agg(*sides), "exact_medians")


def _narrowed(events: DataFrame, keys: list[str], open_: DataFrame, count: int) -> DataFrame:
    """The bounds of the range that holds the wanted rank, and the rank within it."""
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    place = (value - low) / ((high - low) / RANGES)
    # Ends have ranges of their own side, so that infinite and NaN ends go with the first round.
    index = (
        F.when(value == low, 0)
        .when(value == high, RANGES - 1)
        .when(F.isnan(place), 1)
        .otherwise(F.least(F.floor(F.least(place, F.lit(float(RANGES)))), F.lit(RANGES - 1)))
    )
    ranges = (
        _values(events, keys, _per_group(open_, keys), count)
        .groupBy(*keys, "metric", index.cast("int").alias("range"))
        .agg(F.count("*").alias("n"), F.min("value").alias("new_low"), F.max("value").alias("new_high"))
    )
    # At most ``RANGES`` rows per group and metric.
    upto = Window.partitionBy(*keys, "metric").orderBy("range")
    counted = ranges.withColumn("upto", F.sum("n").over(upto))
    wanted = open_.select(
        *[F.col(k).alias(f"g_{k}") for k in keys], F.col("metric").alias("g_metric"), "rank"
    )
    return (
        counted.join(wanted, _same([*keys, "metric"]))
        .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        .select(
            *keys,
            "metric",
            F.col("new_low").alias("low"),
            F.col("new_high").alias("high"),
            (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"),
            F.col("n").alias("left"),
        )
    )
