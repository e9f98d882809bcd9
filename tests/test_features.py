import math
import re

import pytest
from pyspark.sql import functions as F

from sensorloom.functions.columns import METRICS, sensor_label
from sensorloom.operators.alignment import align_train_test_features, feature_union
from sensorloom.operators.features import (
    build_session_features,
    session_sensor_features,
    with_magnitude,
)
from sensorloom.operators.layout import MAX_PARTITIONS, SessionLayout, plan_layout
from sensorloom.operators.quality import event_profile
from sensorloom.operators.splits import assemble
from sensorloom.plans.reports import feature_job


def by_session(df):
    return {r["session_id"]: r.asDict() for r in df.collect()}


def rounded_rows(df):
    """Rows as text, doubles to nine digits: sums depend on the partitioning."""
    cells = [f"round(`{c}`, 9)" if t == "double" else f"`{c}`" for c, t in df.dtypes]
    return sorted(map(str, df.selectExpr(*cells).toDF(*df.columns).collect()))


def test_metric_count():
    assert len(METRICS) == len(set(METRICS)) == 57
    assert len(METRICS) * 6 == 342


def test_session_features(walk_events):
    features = build_session_features(walk_events, has_label=True)
    assert features.columns[0] == "session_id" and features.columns[-1] == "user_id"
    assert len(features.columns) == 2 + 2 * 57
    rows = by_session(features)
    assert set(rows) == {"walk-a", "walk-b", "walk-c"}
    first = rows["walk-a"]
    assert first["user_id"] == "ada" and rows["walk-c"]["user_id"] == "bo"
    assert first["sensor_4_n_events"] == 3 and first["sensor_4_duration_ms"] == 480
    assert first["sensor_4_event_rate"] == pytest.approx(3 / 481)
    assert (first["sensor_4_mag_min"], first["sensor_4_mag_max"]) == (5.0, 9.0)
    assert first["sensor_4_mag_p50"] == 7.0 and first["sensor_4_field_1_p50"] == 3.0
    assert first["sensor_4_field_0_std"] == pytest.approx(math.sqrt(13))
    assert first["sensor_11_event_rate"] == 1.0 and first["sensor_11_mag_mean"] == 2.5
    # Of two values the lower one is the median.
    assert rows["walk-b"]["sensor_4_field_0_p50"] == 8.0
    assert rows["walk-b"]["sensor_11_field_0_mean"] is None


def test_plain_co_located_and_hot_paths_agree(spark):
    events = spark.range(6000).selectExpr(
        "cast(id AS string) AS uid",
        "id * 3 AS timestamp",
        "cast(id % 3 AS string) AS sensor_type",
        *[
            f"if(id % {i + 5} = 0, null, cast(id * {i + 7} % 101 AS double)) AS field_{i}"
            for i in range(8)
        ],
        # One session has a third of all rows, another one no name.
        "case when id % 3 = 0 then 'hot' when id % 11 = 0 then null "
        "else concat('s', id % 40) end AS session_id",
        "'u' AS user_id",
    )
    expected = rounded_rows(session_sensor_features(events))
    profile = event_profile(events)
    for threshold in (10**9, 1000, 100, 0):
        layout = plan_layout(profile, threshold)
        assert (layout.hot_sessions is None) == (threshold == 10**9)
        if threshold == 100:
            salts = {r["session_id"]: r["salts"] for r in layout.hot_sessions.collect()}
            assert salts["hot"] == 20
        rows = session_sensor_features(events, layout=layout)
        assert rounded_rows(rows) == expected, threshold
    fixed = session_sensor_features(events, layout=SessionLayout(None, 5))
    assert rounded_rows(fixed) == expected


def test_layout_grows_with_the_table(spark):
    profile = spark.createDataFrame([("s1", 10**12), ("s2", 5)], "session_id string, n_rows bigint")
    layout = plan_layout(profile)
    # More than a session's setting, but never more than a driver can look after.
    assert layout.partitions == MAX_PARTITIONS == 50_000
    assert [tuple(r) for r in layout.hot_sessions.collect()] == [("s1", 50_000)]
    assert plan_layout(profile.withColumn("n_rows", F.lit(10**9))).partitions == 100
    assert plan_layout(profile.where("n_rows < 10")).partitions is None


def test_medians_of_large_groups_are_exact_on_every_path(spark):
    """300,000 values per group: plain, placed and salted find the same element."""
    n = 300_000
    events = spark.range(2 * n).selectExpr(
        "cast(id AS string) AS uid",
        "id AS timestamp",
        "cast(id % 2 AS string) AS sensor_type",
        # A permutation of 0 .. n-1 for each sensor: a value is its own rank.
        f"cast((id div 2) * 7919 % {n} AS double) AS field_0",
        # Half of the values are one; most of the rest lie close together.
        f"if(id % 4 < 2, 1.5, exp(cast((id div 2) * 7919 % {n} AS double) / {n} * 40)) AS field_1",
        "if(id % 3 = 0, null, -cast(id AS double)) AS field_2",
        *[f"cast(null AS double) AS field_{i}" for i in range(3, 8)],
        "'s' AS session_id",
        "'u' AS user_id",
    )
    profile = event_profile(events, with_nulls=False)
    layouts = [None, SessionLayout(None, 6), plan_layout(profile, 50_000)]
    assert layouts[2].hot_sessions is not None and layouts[2].large_groups[1] == 2
    exact = events.groupBy("sensor_type").agg(
        *[
            F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").alias(c)
            for c in ("field_0", "field_1", "field_2")
        ]
    )
    expected = sorted(map(tuple, exact.collect()))
    assert expected[0][1] == n / 2 - 1
    found = ["sensor_type", "field_0_p50", "field_1_p50", "field_2_p50"]
    for layout in layouts:
        rows = session_sensor_features(events, layout=layout).select(found).collect()
        assert sorted(map(tuple, rows)) == expected


def test_exact_medians_of_odd_values(spark, monkeypatch):
    """Ties, infinite values, NaN, NULL keys and values over many magnitudes, ranked by narrowing."""
    from sensorloom.operators import medians

    for name, value in (("EXACT_ROWS", 0), ("RANKED_VALUES", 3), ("RANGES", 4)):
        monkeypatch.setattr(medians, name, value)
    inf, nan = math.inf, math.nan
    columns = {
        ("a", "1"): [3.0] * 7 + [1.0, 9.0],
        ("b", "1"): [-inf, 2.0, inf, 5.0, 7.0, inf, -inf, 1.0],
        ("b", None): [nan, nan, 4.0, 1.0, nan],
        (None, "2"): [2.0**i for i in range(-30, 31)] + [-(3.0**i) for i in range(20)],
        ("c", "2"): [None, None],
        ("d", "2"): [None, 0.5, None, 0.25],
        ("e", "2"): [1e308, -1e308, 1.7e308, 5.0, -1.7e308],
    }
    rows = [
        (f"{i}", i, sensor, value, session)
        for (session, sensor), values in columns.items()
        for i, value in enumerate(values)
    ]
    events = spark.createDataFrame(
        rows, "uid string, timestamp bigint, sensor_type string, field_0 double, session_id string"
    ).withColumns({f"field_{i}": F.lit(None).cast("double") for i in range(1, 8)})
    found = {
        (r["session_id"], r["sensor_type"]): r["field_0_p50"]
        for r in session_sensor_features(events).collect()
    }
    for key, values in columns.items():
        known = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
        expected = known[(len(known) + 1) // 2 - 1] if known else None
        assert repr(found[key]) == repr(expected), key


def test_median_accuracy_is_passed_on(spark, make_events):
    events = make_events([(i, "1", float(i), 0.0, 0.0, "s", "u") for i in range(2000)])
    exact = session_sensor_features(events).first()["field_0_p50"]
    rough = session_sensor_features(events, accuracy=2).first()["field_0_p50"]
    assert exact == 999.0
    assert rough != exact


def test_single_event_and_missing_values(make_events):
    events = make_events([(5, "1", None, 2.0, 2.0, "s", "u")])
    row = session_sensor_features(events).first()
    assert (row["n_events"], row["duration_ms"], row["event_rate"]) == (1, 0, 1.0)
    assert row["field_0_mean"] is None and row["field_0_nn"] == 0
    assert row["field_1_std"] is None and row["field_1_p50"] == 2.0
    assert row["mag_nn"] == 0 and row["mag_mean"] is None


def test_nan_is_the_largest_value(make_events):
    events = make_events(
        [(1, "1", math.nan, 0.0, 0.0, "s", "u"), (2, "1", 7.0, 0.0, 0.0, "s", "u")]
    )
    row = session_sensor_features(events).first()
    assert math.isnan(row["field_0_max"]) and row["field_0_min"] == 7.0
    assert row["field_0_nn"] == 2


def test_magnitude(make_events):
    rows = with_magnitude(
        make_events([(1, "1", 2.0, 3.0, 6.0, "s", "u"), (2, "1", 2.0, None, 6.0, "s", "u")])
    )
    assert [r["mag_012"] for r in rows.orderBy("uid").collect()] == [7.0, None]


ODD_SENSORS = [None, "null", "A", "a", "a.b", "a_2eb", "it's `b`", "", "7", "é 中"]


def test_sensor_labels_are_apart_and_plain():
    labels = [sensor_label(s) for s in ODD_SENSORS]
    assert len({label.lower() for label in labels}) == len(ODD_SENSORS)
    assert all(re.fullmatch("[a-z0-9_]+", label) for label in labels)
    assert sensor_label("19") == "19" and sensor_label(None) == "null"
    assert sensor_label("null") == "xnull"


def test_odd_sensor_names_go_all_the_way(make_events):
    events = make_events(
        [(i, s, float(i), 1.0, 2.0, f"w{k}", "u") for i, s in enumerate(ODD_SENSORS) for k in (1, 2)]
    )
    tables = feature_job(events, events.where("session_id = 'w1'").drop("user_id"))
    assert len(tables.features) == 57 * len(ODD_SENSORS)
    row = tables.train.where("session_id = 'w2'").first()
    for i, sensor in enumerate(ODD_SENSORS):
        assert row[f"sensor_{sensor_label(sensor)}_field_0_mean"] == i
    vector = assemble(tables.test, tables.features, ["session_id"]).first()["features"]
    assert len(vector) == len(tables.features)


def test_single_metric_column_order_and_listed_sensors(walk_events):
    features = build_session_features(walk_events, has_label=False, sensors=["7", "4"])
    assert features.columns[1] == "sensor_7_n_events"
    assert features.columns[58] == "sensor_4_n_events"
    rows = by_session(features)
    assert rows["walk-a"]["sensor_7_n_events"] is None
    # A session that only has unlisted sensors is kept.
    only_7 = build_session_features(walk_events.where("session_id = 'walk-a'"), False, ["7"])
    assert only_7.count() == 1


def test_label_join_keeps_every_label(make_events):
    events = make_events(
        [
            (1, "1", 1.0, 1.0, 1.0, "s1", "u1"),
            (2, "1", 1.0, 1.0, 1.0, "s1", "u2"),
            (3, "1", 1.0, 1.0, 1.0, "s2", "u1"),
            (4, "1", 1.0, 1.0, 1.0, "s2", None),
            (5, "1", 1.0, 1.0, 1.0, None, "u3"),
        ]
    )
    rows = build_session_features(events, True).select("session_id", "user_id").collect()
    assert {tuple(r) for r in rows} == {
        ("s1", "u1"),
        ("s1", "u2"),
        ("s2", "u1"),
        ("s2", None),
        (None, None),
    }
    carried = build_session_features(events, True, single_user=True)
    users = {r["session_id"]: r["user_id"] for r in carried.collect()}
    assert users["s2"] == "u1" and users[None] is None


def test_joined_and_carried_labels_agree(walk_events):
    joined = build_session_features(walk_events, True)
    carried = build_session_features(walk_events, True, single_user=True)
    assert by_session(joined) == by_session(carried)


@pytest.mark.parametrize("unseen", ["4", "11"])
def test_alignment_fills_what_one_side_never_saw(walk_events, unseen):
    """Each sensor in turn is missing on the test side."""
    train = build_session_features(walk_events, True)
    other = walk_events.where(F.col("sensor_type") != unseen).drop("user_id")
    left, right, features = align_train_test_features(train, build_session_features(other, False))
    assert left.columns == ["session_id", *features, "user_id"]
    assert right.columns == ["session_id", *features] and features == sorted(features)
    assert {t for c, t in left.dtypes if c in features} == {"double"}
    assert dict(right.dtypes).items() <= dict(left.dtypes).items()
    for row in right.collect():
        assert all(row[f] == 0.0 for f in features if f.startswith(f"sensor_{unseen}_"))
    whole = by_session(left)
    for row in right.collect():
        kept = [f for f in features if not f.startswith(f"sensor_{unseen}_")]
        assert [row[f] for f in kept] == [whole[row["session_id"]][f] for f in kept]


def test_alignment_sorts_as_text_and_never_takes_the_label(spark):
    train = spark.createDataFrame(
        [("s", 1, None, "u")],
        "session_id string, sensor_2_x bigint, sensor_19_x double, user_id string",
    )
    test = spark.createDataFrame(
        [("t", math.nan, "leak")], "session_id string, sensor_1_x double, user_id string"
    )
    assert feature_union(train, test) == ["sensor_19_x", "sensor_1_x", "sensor_2_x"]
    left, right, _ = align_train_test_features(train, test)
    assert tuple(left.first()) == ("s", 0.0, 0.0, 1.0, "u")
    assert tuple(right.first()) == ("t", 0.0, 0.0, 0.0)


def test_feature_job(walk_events):
    test = walk_events.where("session_id <> 'walk-a'").drop("user_id")
    tables = feature_job(walk_events, test)
    assert len(tables.features) == 114
    assert (tables.train.count(), tables.test.count()) == (3, 2)
    plain = align_train_test_features(
        build_session_features(walk_events, True), build_session_features(test, False)
    )
    assert rounded_rows(tables.train) == rounded_rows(plain[0])
    assert rounded_rows(tables.test) == rounded_rows(plain[1])


def test_shuffles(spark, walk_events, tmp_path, plan_text):
    path = str(tmp_path / "events")
    walk_events.write.parquet(path)
    events = spark.read.parquet(path)
    sensors = ["4", "11"]
    plain = plan_text(build_session_features(events, True, sensors, single_user=True))
    assert plain.count("Exchange hashpartitioning") == 2
    assert "partial_avg" in plain
    placed = plan_text(
        build_session_features(
            events, True, sensors, layout=SessionLayout(None, 6), single_user=True
        )
    )
    # Events are placed by session once; aggregate and pivot need nothing more.
    assert placed.count("Exchange hashpartitioning") == 1
    assert "uid" not in placed


def test_hot_sessions_take_one_scan(spark, walk_events, tmp_path, plan_text):
    path = str(tmp_path / "events")
    walk_events.write.parquet(path)
    events = spark.read.parquet(path)
    layout = plan_layout(event_profile(events, with_nulls=False), 2)
    rows = session_sensor_features(events, layout=layout)
    plan = plan_text(rows)
    # The other scan is the table of hot sessions, which is broadcast.
    assert plan.count("FileScan parquet") == 2 and plan.count("field_7") and "BroadcastHashJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 2 and "partial_avg" in plan
    assert rounded_rows(rows) == rounded_rows(session_sensor_features(events))
