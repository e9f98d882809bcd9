import math
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from sensorloom.operators.baselines import most_frequent_predictions, stratified_predictions
from sensorloom.operators.ranking import binned_rank, binned_running_total
from sensorloom.operators.splits import (
    assemble,
    class_table,
    class_weights,
    held_out_seeds,
    split_sizes,
    stratified_splits,
    with_label,
)


def table(spark, sizes):
    rows = [(f"{u}-{i}", u) for u, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "session_id string, user_id string")


def text(*parts):
    return md5(":".join(map(str, parts)).encode()).hexdigest()


def expected_split(sizes, seed, test_size):
    """Largest remainder by brute force."""
    n = sum(sizes.values())
    n_valid = math.ceil(test_size * n)
    base = {u: n_valid * c // n for u, c in sizes.items()}
    order = sorted(sizes, key=lambda u: (-(n_valid * sizes[u] % n), text(seed, u), u))
    for u in order[: n_valid - sum(base.values())]:
        base[u] += 1
    held = set()
    for u, c in sizes.items():
        names = sorted((text(seed, f"{u}-{i}"), f"{u}-{i}") for i in range(c))
        held |= {name for _, name in names[: base[u]]}
    return held


SIZES = {"a": 15, "b": 15, "c": 31, "d": 2, "e": 150, "f": 7}


@pytest.mark.parametrize("bin_rows", [50_000, 4])
@pytest.mark.parametrize("test_size", [0.2, 0.37])
def test_split_matches_brute_force(spark, bin_rows, test_size):
    sessions = table(spark, SIZES)
    splits = stratified_splits(sessions, [0, 1, 7, 7], test_size, bin_rows=bin_rows)
    held, counts = defaultdict(set), Counter()
    for row in splits.collect():
        counts[row["seed"]] += 1
        if row["is_valid"]:
            held[row["seed"]].add(row["session_id"])
    assert dict(counts) == {seed: sum(SIZES.values()) for seed in (0, 1, 7)}
    for seed in (0, 1, 7):
        assert held[seed] == expected_split(SIZES, seed, test_size)


def test_balanced_users_split_twelve_to_three(spark):
    sessions = table(spark, {f"u{i}": 15 for i in range(20)})
    per_user = (
        stratified_splits(sessions, [0, 1])
        .groupBy("seed", "user_id")
        .agg(F.count_if("is_valid").alias("n"))
    )
    assert {r["n"] for r in per_user.collect()} == {3}


def test_split_does_not_depend_on_row_order(spark):
    sessions = table(spark, SIZES)
    one = stratified_splits(sessions.repartition(7), [3]).collect()
    other = stratified_splits(sessions.orderBy(F.desc("session_id")).coalesce(1), [3]).collect()
    assert sorted(one) == sorted(other)


@pytest.mark.parametrize(
    "sizes, test_size",
    [
        ({"a": 10, "b": 1}, 0.2),
        ({"a": 2, "b": 2}, 0.2),
        ({"a": 2, "b": 2}, 0.8),
        ({}, 0.2),
        (SIZES, 1.0),
    ],
)
def test_impossible_splits(spark, sizes, test_size):
    with pytest.raises(ValueError):
        stratified_splits(table(spark, sizes), [0], test_size)


def test_unlabelled_sessions_cannot_be_split(spark):
    rows = table(spark, SIZES).union(table(spark, {"x": 3}).withColumn("user_id", F.lit(None)))
    with pytest.raises(ValueError, match="user_id"):
        split_sizes(rows, 0.2)


def test_held_out_seeds(spark):
    splits = stratified_splits(table(spark, SIZES), [0, 1, 2])
    flags = {r["session_id"]: set(r["held_out"]) for r in held_out_seeds(splits).collect()}
    assert len(flags) == sum(SIZES.values())
    for seed in (0, 1, 2):
        held = {s for s, seeds in flags.items() if seed in seeds}
        assert held == expected_split(SIZES, seed, 0.2)


def test_binned_ranks_equal_plain_ranks(spark):
    df = spark.range(2000).selectExpr(
        "id % 3 AS g", "hash(id) AS x", "floor(hash(id) / 100000000) AS bin", "id % 5 AS w"
    )
    ranked = binned_rank(df, ["g"], "bin", ["x"]).collect()
    plain = binned_rank(df, ["g"], "bin", ["x"], one_bin=True).collect()
    key = lambda r: (r["g"], r["x"], r["position"])
    assert sorted(map(key, ranked)) == sorted(map(key, plain))
    totals = binned_running_total(df, ["g"], "bin", ["x"], F.col("w")).collect()
    for g in range(3):
        before = 0
        for row in sorted((r for r in totals if r["g"] == g), key=lambda r: r["x"]):
            assert row["before"] == before
            before += row["w"]


@pytest.mark.parametrize("bin_rows", [3, 1000])
def test_label_index_is_alphabetic(spark, bin_rows):
    names = ["b", "a", "c", "B", "ä", "10", "9", ""] + [f"u{i:03}" for i in range(20)]
    sessions = table(spark, {name: 1 + i % 3 for i, name in enumerate(names)})
    classes, n_classes = class_table(sessions, bin_rows)
    assert n_classes == len(names)
    found = {r["user_id"]: r["label"] for r in classes.collect()}
    assert found == {name: i for i, name in enumerate(sorted(names))}
    labelled = with_label(sessions, classes, n_classes)
    assert labelled.count() == sessions.count()
    assert labelled.schema["label"].metadata["ml_attr"]["num_vals"] == n_classes


def test_vectors_keep_column_order(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0)], "session_id string, x double, y double")
    row = assemble(df, ["y", "x"], ["session_id"]).first()
    assert list(row["features"]) == [2.0, 1.0]


def test_class_weights(spark):
    weights = class_weights(table(spark, {"a": 6, "b": 2}))
    assert {(r["user_id"], round(r["weight"], 9)) for r in weights.collect()} == {
        ("a", round(8 / (2 * 6), 9)),
        ("b", 2.0),
    }
    balanced = class_weights(table(spark, {"a": 4, "b": 4}))
    assert {r["weight"] for r in balanced.collect()} == {1.0}


def test_most_frequent_class_and_tie(spark):
    splits = stratified_splits(table(spark, {"b": 10, "a": 10, "c": 30}), [0])
    assert {r["prediction"] for r in most_frequent_predictions(splits).collect()} == {"c"}
    tied = stratified_splits(table(spark, {"b": 10, "a": 10}), [0, 1])
    assert {r["prediction"] for r in most_frequent_predictions(tied).collect()} == {"a"}


def test_stratified_draws_follow_the_frequencies(spark):
    sizes = {"a": 3000, "b": 1000, **{f"z{i}": 5 for i in range(100)}}
    splits = stratified_splits(table(spark, sizes), [0, 1])
    drawn = stratified_predictions(splits).collect()
    # Exactly one draw per validation session.
    assert len({(r["seed"], r["session_id"]) for r in drawn}) == len(drawn) == 2 * 900
    shares = Counter(r["prediction"] for r in drawn)
    assert shares["a"] / len(drawn) == pytest.approx(3000 / 4500, abs=0.05)
    assert shares["b"] / len(drawn) == pytest.approx(1000 / 4500, abs=0.05)
    assert len(shares) > 40
    # Draws are independent of which sessions were held out.
    hits = sum(r["prediction"] == "a" for r in drawn if r["user_id"] == "a")
    assert hits / sum(r["user_id"] == "a" for r in drawn) == pytest.approx(2 / 3, abs=0.06)


def test_no_nested_loops(spark, plan_text):
    """Neither dummy compares sessions with all classes."""
    splits = stratified_splits(table(spark, SIZES), [0, 1], bin_rows=4)
    for df in (splits, most_frequent_predictions(splits), stratified_predictions(splits)):
        plan = plan_text(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_large_sides_of_joins_stay_off_the_driver(spark, tmp_path, plan_text):
    """Small on disk, but many rows: such tables are not broadcast."""
    n_users, seeds = 6000, list(range(20))
    named = F.concat(F.lit("u"), F.col("id") % n_users)
    rows = spark.range(2 * n_users).select(
        F.concat(named, F.lit("-"), F.floor(F.col("id") / n_users)).alias("session_id"),
        named.alias("user_id"),
    )
    rows.write.parquet(f"{tmp_path}/sessions")
    sessions = spark.read.parquet(f"{tmp_path}/sessions")
    splits = stratified_splits(sessions, seeds, test_size=0.5)
    plan = plan_text(splits)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    splits.write.parquet(f"{tmp_path}/splits")
    drawn = stratified_predictions(spark.read.parquet(f"{tmp_path}/splits"))
    # The number of training rows per seed goes to all machines, nothing else.
    assert plan_text(drawn).count("BroadcastHashJoin") == 1
    assert drawn.count() == n_users * len(seeds)
