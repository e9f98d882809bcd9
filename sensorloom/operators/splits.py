"""Label index, feature vectors and repeated stratified holdout (M1-M3)."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.columns import digest_fraction, seeded_digest
from sensorloom.operators.ranking import binned_rank, sized
from sensorloom.sources.scratch import materialize

# Sessions of one class that are sorted together; larger classes are cut up.
ROWS_PER_BIN = 50_000


def assemble(table: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """The feature columns as one ``features`` vector, in the given order (M1)."""
    vector = VectorAssembler(inputCols=features, outputCol="features")
    return vector.transform(table).select(*keep, "features")


def class_table(table: DataFrame, bin_rows: int = ROWS_PER_BIN) -> tuple[DataFrame, int]:
    """``(user_id, label)`` with classes in sorted order -> 0, 1, ..., and their number (M2).

    The names stay in the table: they are ranked in range partitions of bounded size
    and only their count comes to the driver.
    """
    users = materialize(table.select("user_id").distinct(), "users")
    counts = users.agg(
        F.count("*").alias("n"), F.count_if(F.col("user_id").isNull()).alias("unknown")
    ).first()
    if counts["unknown"]:
        raise ValueError("sessions without a user_id have no class")
    n_bins = max(1, -(-counts["n"] // bin_rows))
    ranges = users.repartitionByRange(n_bins, "user_id").withColumn("bin", F.spark_partition_id())
    # Written once, so that a row's range is the same whenever it is read.
    placed = materialize(ranges, "user_ranges")
    ranked = binned_rank(placed, [], "bin", ["user_id"], one_bin=n_bins == 1)
    label = (F.col("position") - 1).cast("double").alias("label")
    return materialize(ranked.select("user_id", label), "classes"), counts["n"]


def with_label(table: DataFrame, classes: DataFrame, n_classes: int) -> DataFrame:
    """``table`` plus ``label``, which knows the number of classes but not their names."""
    attributes = {"ml_attr": {"type": "nominal", "name": "label", "num_vals": n_classes}}
    return table.join(sized(classes, n_classes), "user_id").withMetadata("label", attributes)


def class_counts(table: DataFrame) -> DataFrame:
    """Sessions per class."""
    return table.groupBy("user_id").agg(F.count("*").alias("n_class"))


def class_weights(table: DataFrame) -> DataFrame:
    """``table`` plus ``weight`` = N / (K * sessions of the row's class).

    The class table is joined without a hint: small ones are broadcast by their
    run-time size, and a class with many sessions is split by the skew join.
    """
    classes = class_counts(table)
    balanced = classes.agg(F.sum("n_class") / F.count("*")).scalar()
    weights = classes.select("user_id", (balanced / F.col("n_class")).alias("weight"))
    return table.join(weights, "user_id")


@dataclass(frozen=True)
class SplitSizes:
    """What a split of a table comes to; ``counts`` has the sessions of each user."""

    counts: DataFrame
    sessions: int
    users: int
    largest_user: int
    n_valid: int

    @property
    def n_train(self) -> int:
        return self.sessions - self.n_valid


def split_sizes(sessions: DataFrame, test_size: float) -> SplitSizes:
    """Sizes of a stratified split (an action); ``ValueError`` where there is none."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    # Written once: everything about class sizes is derived from this table.
    counts = materialize(class_counts(sessions), "class_counts")
    totals = counts.agg(
        F.coalesce(F.sum("n_class"), F.lit(0)).alias("n"),
        F.count("*").alias("k"),
        F.min("n_class").alias("smallest"),
        F.max("n_class").alias("largest"),
        F.count_if(F.col("user_id").isNull()).alias("unlabelled"),
    ).first()
    n_valid = math.ceil(test_size * totals["n"])
    if totals["unlabelled"]:
        raise ValueError("sessions without a user_id cannot be stratified")
    if not totals["n"] or totals["smallest"] < 2:
        raise ValueError("every user needs at least two sessions to be split")
    if n_valid < totals["k"] or totals["n"] - n_valid < totals["k"]:
        raise ValueError("a split side would hold fewer sessions than there are users")
    return SplitSizes(counts, totals["n"], totals["k"], totals["largest"], n_valid)


def _quotas(seeds: list[int], sizes: SplitSizes, bin_rows: int) -> DataFrame:
    """Per user: its sessions and, per seed, how many of them are held out."""
    share = F.col("n_class") * sizes.n_valid
    remainder = share % sizes.sessions
    shares = sizes.counts.select(
        "user_id",
        "n_class",
        ((share - remainder) / sizes.sessions).cast("bigint").alias("base"),
        remainder.alias("remainder"),
    )
    # How many places rounding down leaves open; the same for every seed.
    open_places = sizes.n_valid - shares.agg(F.sum("base")).first()[0]
    drawn = (
        shares.withColumn("seed", F.explode(F.lit(seeds)))
        .withColumn("draw", seeded_digest("seed", "user_id"))
        # Distinct remainders are few (at most one per class size); the digest
        # prefix cuts each of them into 4096 pieces.
        .withColumn("rung", F.struct((-F.col("remainder")).alias("r"), F.substring("draw", 1, 3)))
    )
    queue = binned_rank(
        drawn, ["seed"], "rung", ["draw", "user_id"], one_bin=sizes.users <= bin_rows
    )
    quota = F.col("base") + (F.col("position") <= open_places).cast("bigint")
    return queue.groupBy("user_id", "n_class").agg(
        F.collect_list(F.struct("seed", quota.alias("quota"))).alias("quotas")
    )


def stratified_splits(
    sessions: DataFrame,
    seeds: Iterable[int],
    test_size: float = 0.2,
    bin_rows: int = ROWS_PER_BIN,
    sizes: SplitSizes | None = None,
) -> DataFrame:
    """``(seed, session_id, user_id, is_valid)``, one exact split per seed (M3).

    ``sessions`` has one row per session. Of N sessions ceil(test_size * N) are
    held out. Users get their proportional share rounded down; left-over places
    go to the largest remainders, ties by a digest of seed and user. Within a
    user the sessions with the smallest digest of seed and session are taken.

    No task sorts more than about ``bin_rows`` sessions of one user. ``sizes``
    saves a job if :func:`split_sizes` has been asked already.
    """
    seeds = list(dict.fromkeys(seeds))
    sizes = sizes or split_sizes(sessions, test_size)
    user_bins = F.ceil(F.col("n_class") / bin_rows)
    candidates = (
        sessions.select("session_id", "user_id")
        # Joined before the seeds are unfolded: N rows, not N x seeds.
        .join(sized(_quotas(seeds, sizes, bin_rows), sizes.users * len(seeds)), "user_id")
        .select("session_id", "user_id", "n_class", F.inline("quotas"))
        .withColumn("draw", seeded_digest("seed", "session_id"))
        .withColumn("bin", F.floor(digest_fraction(F.col("draw")) * user_bins))
    )
    ranked = binned_rank(
        candidates,
        ["seed", "user_id"],
        "bin",
        ["draw", "session_id"],
        one_bin=sizes.largest_user <= bin_rows,
    )
    return ranked.select(
        "seed", "session_id", "user_id", (F.col("position") <= F.col("quota")).alias("is_valid")
    )


def held_out_seeds(splits: DataFrame) -> DataFrame:
    """One row per session with the seeds that hold it out (at most one entry per seed)."""
    return splits.groupBy("session_id").agg(
        F.collect_list(F.when(F.col("is_valid"), F.col("seed"))).alias("held_out")
    )
