import pytest

from sensorloom.operators.quality import (
    find_mixed_user_sessions,
    get_imbalance_ratio,
    get_null_counts,
    get_sensor_types,
    get_session_size_stats,
    get_user_session_counts,
    require_single_user_sessions,
)
from sensorloom.plans.reports import validation_report


def pairs(spark, rows):
    return spark.createDataFrame(rows, "session_id string, user_id string")


def test_null_counts(spark):
    """A third, a fifth and none of thirty rows are missing."""
    df = spark.range(30).selectExpr(
        "if(id % 3 = 0, null, id) AS third", "if(id % 5 = 0, null, 'x') AS fifth", "id AS full"
    )
    assert get_null_counts(df).first().asDict() == {"third": 10, "fifth": 6, "full": 0}


def test_null_counts_of_nothing_and_of_nan(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert tuple(get_null_counts(empty).first()) == (0, 0)
    nan = spark.createDataFrame([(float("nan"),), (None,)], "a double")
    assert get_null_counts(nan).first()["a"] == 1


def test_mixed_user_sessions(spark):
    """Session k is used by k different people, each of them twice."""
    df = pairs(spark, [(f"ride {k}", f"p{i}") for k in range(1, 5) for i in range(k)] * 2)
    found = {tuple(r) for r in find_mixed_user_sessions(df).collect()}
    assert found == {("ride 2", 2), ("ride 3", 3), ("ride 4", 4)}


def test_a_column_called_n_rows_means_nothing(spark):
    df = spark.createDataFrame(
        [("s", "u", 7), ("s", "u", 7), ("t", "u", 1), ("t", None, 9)],
        "session_id string, user_id string, n_rows int",
    )
    assert get_session_size_stats(df).first()["max_count"] == 2
    assert get_session_size_stats(df, weight="n_rows").first()["max_count"] == 14
    (row,) = find_mixed_user_sessions(df, with_nulls=True).collect()
    assert tuple(row) == ("t", 1, 1)
    (row,) = find_mixed_user_sessions(df, with_nulls=True, weight="n_rows").collect()
    assert tuple(row) == ("t", 1, 9)


def test_a_missing_user_is_no_second_user(spark):
    df = pairs(spark, [("s1", "u1"), ("s1", None), ("s1", None), ("s2", "u1"), ("s3", None)])
    assert find_mixed_user_sessions(df).isEmpty()
    (row,) = find_mixed_user_sessions(df, with_nulls=True).collect()
    assert tuple(row) == ("s1", 1, 2)


def test_mixed_users_of_a_hot_session(spark):
    """One session holds most rows; partial aggregation leaves one row per user."""
    df = spark.range(20_000).selectExpr(
        "if(id % 10 < 7, 'hot', concat('s', id % 50)) AS session_id",
        "cast(id % 3 AS string) AS user_id",
    )
    counts = {r["session_id"]: r["n_users"] for r in find_mixed_user_sessions(df).collect()}
    assert counts["hot"] == 3


def test_session_sizes(spark):
    rows = [(f"s{i}", "u") for i in range(1, 101) for _ in range(i)]
    stats = get_session_size_stats(pairs(spark, rows)).first()
    assert tuple(stats) == (50, 90, 99, 100)


def test_sensor_types_sort_as_text(spark):
    df = spark.createDataFrame([("2",), ("19",), (None,), ("1",), ("19",)], "sensor_type string")
    assert [r[0] for r in get_sensor_types(df).collect()] == [None, "1", "19", "2"]


def test_user_session_counts(spark):
    df = pairs(
        spark,
        [
            ("s1", "u1"),
            ("s1", "u1"),
            ("s2", "u2"),
            ("s3", "u2"),
            ("s4", None),
            (None, "u3"),
            ("s5", "u0"),
        ],
    )
    expected = [("u2", 2), (None, 1), ("u0", 1), ("u1", 1), ("u3", 0)]
    assert [tuple(r) for r in get_user_session_counts(df).collect()] == expected


def test_imbalance_ratio(spark):
    """Users 1 to 4 have 3, 6, 9 and 12 sessions."""
    df = pairs(spark, [(f"{u}/{i}", f"u{u}") for u in range(1, 5) for i in range(3 * u)])
    assert get_imbalance_ratio(df) == pytest.approx(4.0)
    assert get_imbalance_ratio(df.limit(0)) is None
    assert get_imbalance_ratio(pairs(spark, [("s1", "u1"), (None, "u2")])) is None


def test_gate(spark):
    mixed = pairs(spark, [("s1", "u1"), ("s1", "u2"), ("s2", "u1")])
    with pytest.raises(ValueError, match="several users"):
        require_single_user_sessions(mixed)
    assert require_single_user_sessions(mixed, on_mixed="report").count() == 1
    assert require_single_user_sessions(mixed.where("session_id = 's2'")).isEmpty()
    with pytest.raises(ValueError):
        require_single_user_sessions(mixed, on_mixed="ignore")


def test_report_from_one_pass_equals_the_single_checks(walk_events):
    report = validation_report(walk_events)
    checks = {
        "null_counts": get_null_counts,
        "session_size_stats": get_session_size_stats,
        "sensor_types": get_sensor_types,
        "mixed_user_sessions": find_mixed_user_sessions,
        "user_session_counts": get_user_session_counts,
    }
    for name, check in checks.items():
        assert report[name].collect() == check(walk_events).collect(), name
    assert report["imbalance_ratio"].first()[0] == 2.0
    assert set(validation_report(walk_events.drop("user_id"))) == {
        "null_counts",
        "session_size_stats",
        "sensor_types",
    }
