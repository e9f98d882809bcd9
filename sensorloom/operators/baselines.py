"""Dummy classifiers as joins (M4, M5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.columns import digest_fraction, seeded_digest
from sensorloom.operators.ranking import binned_running_total, sized
from sensorloom.sources.scratch import materialize

PREDICTION_COLUMNS = ["model", "seed", "session_id", "user_id", "prediction"]


def _train_class_sizes(splits: DataFrame) -> DataFrame:
    return (
        splits.where(~F.col("is_valid"))
        .groupBy("seed", "user_id")
        .agg(F.count("*").alias("n_train"))
    )


def most_frequent_predictions(splits: DataFrame) -> DataFrame:
    """Everyone gets the commonest training class, ties by class order (M4)."""
    winners = (
        _train_class_sizes(splits)
        .groupBy("seed")
        .agg(F.min(F.struct(-F.col("n_train"), F.col("user_id"))).alias("top"))
        .select("seed", F.col("top.user_id").alias("prediction"))
    )
    # One row per seed, so the broadcast is bounded by the number of seeds.
    return (
        splits.where("is_valid")
        .join(F.broadcast(winners), "seed")
        .withColumn("model", F.lit("Dummy_most_frequent"))
        .select(*PREDICTION_COLUMNS)
    )


def _dyadic_blocks(first: Column, last: Column, most: int) -> Column:
    """The positions first..last as aligned blocks: array of (level, block).

    A block of level k is 2^k positions long and starts at a multiple of it; an
    interval is at most two blocks per level.
    """
    levels = F.sequence(F.lit(0), F.lit(max(0, most.bit_length() - 1)))

    def on_level(k: Column) -> Column:
        width = F.pow(F.lit(2.0), k)
        low = F.ceil(first / width).cast("bigint")
        high = F.floor((last + 1) / width).cast("bigint")
        after = low + low % 2
        left = F.when((low < high) & (low % 2 == 1), F.struct(k.alias("level"), low.alias("block")))
        right = F.when(
            (after < high) & (high % 2 == 1), F.struct(k.alias("level"), (high - 1).alias("block"))
        )
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(levels, on_level)))


def stratified_predictions(splits: DataFrame) -> DataFrame:
    """Random classes with the training frequencies, repeatable (M5).

    Training sessions are laid out class by class on positions 0..n-1, so a
    class owns an interval as long as it is frequent. Each validation session
    draws a position. Intervals are cut into aligned blocks, at most two per
    power of two, and a position lies in one block of each size: the owner is found
    by an equi-join on (size, block) that meets exactly once.
    """
    sizes = _train_class_sizes(splits).withColumn("bin", F.substring(F.md5("user_id"), 1, 3))
    intervals = materialize(
        binned_running_total(sizes, ["seed"], "bin", ["user_id"], F.col("n_train")), "intervals"
    )
    first, last = F.col("before"), F.col("before") + F.col("n_train") - 1
    longest, n_intervals = intervals.agg(
        F.coalesce(F.max("n_train"), F.lit(1)), F.count("*")
    ).first()
    owners = intervals.select(
        "seed",
        F.col("user_id").alias("prediction"),
        F.inline(_dyadic_blocks(first, last, longest)),
    )
    totals = intervals.groupBy("seed").agg(F.sum("n_train").alias("n"))
    # The split already used the digest of (seed, session); a draw from the same
    # digest would only reach the front of the line, hence the extra word.
    chance = digest_fraction(seeded_digest(F.lit("draw"), "seed", "session_id"))
    draws = (
        splits.where("is_valid")
        # One row per seed.
        .join(F.broadcast(totals), "seed")
        .withColumn("at", F.floor(chance * F.col("n")))
        # One row per block size that occurs.
        .withColumn("level", F.explode(F.lit(list(range(longest.bit_length())))))
        .withColumn("block", F.floor(F.col("at") / F.pow(F.lit(2.0), "level")))
    )
    return (
        draws.join(
            sized(owners, 2 * longest.bit_length() * n_intervals), ["seed", "level", "block"]
        )
        .withColumn("model", F.lit("Dummy_stratified"))
        .select(*PREDICTION_COLUMNS)
    )
