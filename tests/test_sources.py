import math
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from catalog.views import epoch_millis
from sensorloom.operators.quality import event_profile, get_null_counts
from sensorloom.plans.reports import audit_of, profile_events, validation_report
from sensorloom.sources import predictions
from sensorloom.sources.events import (
    TEST_SCHEMA,
    TRAIN_SCHEMA,
    bad_field_table,
    dataset_audit,
    load_test_data,
    load_train_data,
    preview,
    read_events,
    write_events,
)
from sensorloom.sources.predictions import read_manifest, read_predictions, write_predictions
from sensorloom.sources.scratch import (
    ScratchTables,
    delete_folder,
    fresh_path,
    materialize,
    scratch_root,
)

HEADER = "uid,timestamp,sensor_type," + ",".join(f"field_{i}" for i in range(8))


def test_schemas():
    assert len(TRAIN_SCHEMA) == 13
    assert TRAIN_SCHEMA.names[-2:] == ["session_id", "user_id"]
    assert TEST_SCHEMA.names == [n for n in TRAIN_SCHEMA.names if n != "user_id"]
    assert all(field.nullable for field in TRAIN_SCHEMA)


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text(
        HEADER
        + ",session_id,user_id\n"
        + "a,1000,1,1.5,,NaN,oops,0,0,0,0,s1,u1\n"
        + "b,x,1,1,1,1,1,1,1,1,1,s1,u1\n"
    )
    rows = {r["uid"]: r for r in load_train_data(spark, str(path)).collect()}
    assert rows["a"]["field_0"] == 1.5
    assert rows["a"]["field_1"] is None
    assert math.isnan(rows["a"]["field_2"])
    assert rows["a"]["field_3"] is None
    assert rows["b"]["timestamp"] is None and rows["b"]["field_0"] == 1.0


def test_reordered_header_is_refused(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text(HEADER + ",user_id,session_id\na,1,1,1,1,1,1,1,1,1,1,u1,s1\n")
    with pytest.raises(Exception, match="header does not conform"):
        load_train_data(spark, str(path)).collect()


def test_parquet_twin_finds_columns_by_name(spark, walk_events, tmp_path):
    path = str(tmp_path / "events")
    shuffled = walk_events.select(*reversed(walk_events.columns)).withColumn(
        "timestamp", F.col("timestamp").cast("int")
    )
    write_events(shuffled, path, fmt="parquet")
    back = load_train_data(spark, path, fmt="parquet")
    assert back.schema == TRAIN_SCHEMA
    assert sorted(back.collect()) == sorted(walk_events.collect())
    assert load_test_data(spark, path, fmt="parquet").columns == TEST_SCHEMA.names


def test_parquet_scan_reads_only_what_is_used(spark, walk_events, tmp_path, plan_text):
    path = str(tmp_path / "events")
    write_events(walk_events, path, fmt="parquet")
    plan = plan_text(load_train_data(spark, path, fmt="parquet").groupBy("session_id").count())
    assert "ReadSchema: struct<session_id:string>" in plan


def test_profile_reads_three_columns(spark, walk_events, tmp_path, plan_text):
    path = str(tmp_path / "events")
    write_events(walk_events, path, fmt="parquet")
    events = load_train_data(spark, path, fmt="parquet")
    plan = plan_text(event_profile(events, with_nulls=False))
    assert "ReadSchema: struct<sensor_type:string,session_id:string,user_id:string>" in plan
    assert "partial_count" in plan


def test_unknown_format(spark, walk_events, tmp_path):
    with pytest.raises(ValueError):
        read_events(spark, "x", labelled=True, fmt="orc")
    with pytest.raises(ValueError):
        write_events(walk_events, str(tmp_path / "x"), fmt="orc")


def test_audit_from_events_and_from_profiles(walk_events):
    tables = {"train": walk_events, "test": walk_events.drop("user_id")}
    expected = [("train", 7, 3, 2, 13), ("test", 7, 3, None, 12)]
    assert [tuple(r) for r in dataset_audit(tables).collect()] == expected
    profiles = {name: profile_events(df) for name, df in tables.items()}
    assert [tuple(r) for r in audit_of(profiles).collect()] == expected


def test_preview_is_a_top_n(walk_events, plan_text):
    top = preview(walk_events, 2, ["uid"])
    assert [r["uid"] for r in top.collect()] == ["e0", "e1"]
    assert "TakeOrderedAndProject" in plan_text(top)
    assert preview(walk_events).count() == 5


def test_predictions_are_sorted_csv_with_header(spark, tmp_path):
    path = tmp_path / "out" / "submission"
    rows = spark.createDataFrame(
        [("s3", "u1", 1), ("s1", "u2", 2), ("s2", "u1", 3)],
        "session_id string, user_id string, x int",
    )
    write_predictions(rows, str(path))
    write_predictions(rows, str(path))
    parts = [part.read_text() for part in sorted(path.glob("*.csv"))]
    assert all(part.startswith("session_id,user_id\n") for part in parts)
    # Part after part, the sessions are in order.
    lines = [line for part in parts for line in part.splitlines()[1:]]
    assert lines == ["s1,u2", "s2,u1", "s3,u1"]


def test_manifest_tells_what_was_written(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(f"s{i}", None if i % 7 == 0 else "" if i % 5 == 0 else f"u{i % 3}") for i in range(500)]
    table = spark.createDataFrame(rows, "session_id string, user_id string").repartition(4)
    write_predictions(table, path)
    manifest = read_manifest(spark, path)
    assert manifest["rows"] == 500 and manifest["columns"] == ["session_id", "user_id"]
    assert read_predictions(spark, path).count() == 500
    next(Path(path).glob("*.csv")).unlink()
    with pytest.raises(ValueError, match="manifest"):
        read_predictions(spark, path)
    write_predictions(table.limit(0), path)
    assert read_predictions(spark, path).isEmpty()
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_killed_write_leaves_the_former_output_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    good = spark.createDataFrame([("s1", "u1"), ("s2", "u2")], "session_id string, user_id string")
    write_predictions(good, path)
    # Dies while writing: one row cannot be computed.
    broken = spark.range(100).select(
        F.col("id").cast("string").alias("session_id"),
        F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise("u").alias("user_id"),
    )
    with pytest.raises(Exception, match="lost"):
        write_predictions(broken, path)
    assert sorted(map(tuple, read_predictions(spark, path).collect())) == [("s1", "u1"), ("s2", "u2")]

    # Dies between staging and the rename.
    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(predictions, "_swap", killed)
        with pytest.raises(KeyboardInterrupt):
            write_predictions(good.limit(1), path)
    assert read_predictions(spark, path).count() == 2
    write_predictions(good.limit(1), path)
    assert read_predictions(spark, path).count() == 1


def test_malformed_fields_are_counted_by_the_first_pass(spark, tmp_path):
    header = ",".join(f.name for f in TRAIN_SCHEMA)
    lines = [
        "e1,10,4,1.0,2.0,3.0,,,,,,s1,u1",
        "e2,ten,4,1.0,2.0,3.0,,,,,,s1,u1",
        "e3,30,4,NaN,x,3.0,,,,,,s1,u1",
        "e4,4x,4,1.0,y y,,,,,,,s2,u1",
        "e5,50,4,1.0",
        "e6,60,4,1.0,2.0,3.0,,,,,,s2,u1,more",
    ]
    (tmp_path / "events.csv").write_text("\n".join([header, *lines]) + "\n")
    counted = Observation("events")
    events = load_train_data(spark, str(tmp_path), bad_fields=counted)
    assert events.columns == TRAIN_SCHEMA.names
    plain = load_train_data(spark, str(tmp_path))
    profile = event_profile(events).collect()
    assert sorted(map(str, profile)) == sorted(map(str, event_profile(plain).collect()))
    found = {r["column_name"]: r["n_bad"] for r in bad_field_table(spark, "train", counted).collect()}
    expected = dict.fromkeys(TRAIN_SCHEMA.names, 0) | {"timestamp": 2, "field_1": 2, "bad_lines": 5}
    assert found == expected
    again = load_train_data(spark, str(tmp_path), bad_fields=Observation("again"))
    assert sorted(map(str, again.collect())) == sorted(map(str, plain.collect()))


def test_scratch_uses_the_named_folder(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "t") != fresh_path(spark, "t")


def test_profile_keeps_null_counts(spark, walk_events):
    holes = walk_events.withColumn("field_1", F.when(F.col("uid") != "e0", F.col("field_1")))
    holes = holes.withColumn("user_id", F.when(F.col("uid") != "e5", F.col("user_id")))
    report = validation_report(holes)
    assert report["null_counts"].first() == get_null_counts(holes).first()
    assert event_profile(holes).agg(F.sum("n_rows")).first()[0] == 7


def test_scratch_tables_go_as_a_whole(spark):
    kept = materialize(spark.range(3), "kept")
    with ScratchTables(spark) as scratch:
        own = scratch.materialize(spark.range(5), "own")
        assert own.count() == 5 and Path(scratch.folder.removeprefix("file:")).exists()
    assert not Path(scratch.folder.removeprefix("file:")).exists()
    assert kept.count() == 3
    with pytest.raises(ValueError):
        delete_folder(spark, "/tmp/somewhere-else")


@pytest.mark.parametrize("zone", ["UTC", "America/St_Johns"])
def test_event_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        table = spark.sql(
            "SELECT timestamp_ntz'2024-03-10 02:30:01.987654' AS ts "
            "UNION ALL SELECT timestamp_ntz'1970-01-02 00:00:00.001' UNION ALL SELECT null"
        )
        found = {r[0] for r in table.select(epoch_millis("ts")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == {1710037801987, 86400001, None}
