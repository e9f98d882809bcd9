"""Sparse vectors against the wide table, and sensor types that no pivot takes."""

import pytest
from catalog import views
from pyspark.sql import functions as F

from sensorloom.functions.columns import METRICS
from sensorloom.operators.features import build_session_features, feature_name, sensor_values
from sensorloom.operators.sparse import sensor_numbers, sparse_session_features


def dense_of(features):
    """Vectors by session as dicts from (sensor, metric)."""
    names = {r["index"]: (r["sensor_type"], r["metric"]) for r in features.names().collect()}
    assert sorted(names) == list(range(features.size))
    return {
        r["session_id"]: {names[i]: v for i, v in zip(r["indices"], r["values"])}
        for r in features.vectors.collect()
    }


def test_sparse_is_the_wide_table(spark, sf_dir):
    events = views.oddly_named(views.sensor_events(spark, sf_dir))
    sensors = [None, "A", "a", "a.b `c'", "null"]
    wide = build_session_features(events, True, sensors, single_user=True).na.fill(0.0)
    features = sparse_session_features(events, True)
    assert features.size == 5 * len(METRICS)
    assert [r["sensor_type"] for r in features.sensors.orderBy("sensor_no").collect()] == sensors
    found = dense_of(features)
    rows = wide.collect()
    assert {r["session_id"] for r in rows} == found.keys()
    for row in rows:
        for sensor in sensors:
            for metric in METRICS:
                value = found[row["session_id"]].get((sensor, metric), 0.0)
                assert value == pytest.approx(row[feature_name(sensor, metric)], abs=1e-9)
    users = {r["session_id"]: r["user_id"] for r in features.vectors.collect()}
    assert users == {r["session_id"]: r["user_id"] for r in rows}


def test_test_side_uses_the_numbers_of_the_training_side(spark, make_events):
    train = make_events([(1, "b", 1.0, 1.0, 1.0, "s1", "u"), (1, "d", 1.0, 1.0, 1.0, "s1", "u")])
    test = make_events([(1, "d", 2.0, 0.0, 0.0, "t1", "u"), (2, "z", 1.0, 1.0, 1.0, "t2", "u")])
    numbers = sensor_numbers(train)
    found = dense_of(sparse_session_features(test.drop("user_id"), False, numbers))
    assert found["t1"][("d", "field_0_mean")] == 2.0 and ("d", "field_1_mean") not in found["t1"]
    assert found["t2"] == {}


def test_twenty_thousand_sensor_types(spark):
    events = spark.range(40_000).selectExpr(
        "cast(id AS string) AS uid",
        "id AS timestamp",
        "concat('type ', cast(id % 20000 AS string)) AS sensor_type",
        *[f"cast(id % {i + 3} + 1 AS double) AS field_{i}" for i in range(8)],
        "concat('s', cast(id % 7 AS string)) AS session_id",
        "'u' AS user_id",
    )
    with pytest.raises(ValueError, match="sensor types to pivot"):
        sensor_values(events)
    features = sparse_session_features(events, True)
    assert features.size == 20_000 * len(METRICS)
    rows = features.vectors.select("session_id", F.size("indices").alias("n"), F.array_max("indices").alias("top"))
    assert rows.count() == 7
    assert rows.agg(F.max("top")).first()[0] < features.size
    # Every event is a group of its own session and type: no deviation, no duration, but the rest.
    n_events = features.vectors.select(F.explode(F.arrays_zip("indices", "values")).alias("e")).where(
        F.col("e.indices") % len(METRICS) == 0
    )
    assert n_events.agg(F.sum("e.values")).first()[0] == 40_000


def test_no_events(make_events):
    features = sparse_session_features(make_events([]), True)
    assert features.size == 0 and features.vectors.isEmpty()
