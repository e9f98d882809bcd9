"""Sensor-event views over the supplied ``events`` table.

A session is one user's six-day slot of the month, event types become sensor
types, ``field_2`` is missing now and then, ``field_3`` and ``field_4`` exist for
some sensors only and ``field_5`` to ``field_7`` never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.alignment import align_train_test_features
from sensorloom.operators.features import build_session_features
from sensorloom.sources.events import TRAIN_SCHEMA, conform

SENSORS = ["1", "19", "2", "4", "5"]
# The test side never saw this one.
TRAIN_ONLY_SENSOR = "19"
SENSOR_OF_TYPE = {"click": "1", "error": "2", "purchase": "4", "signup": "5"}
# The last slot of the month is the unseen period.
TEST_SLOT = "%-4"
N_CLASSES = 4


def epoch_millis(ts: str) -> Column:
    """Milliseconds of a zone-less timestamp, read as UTC whatever the session's zone is."""
    days = F.date_diff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.floor(F.expr(f"extract(SECOND FROM {ts})") * 1000)
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000 + seconds


def sensor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in the labelled event layout (B1)."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    event_type, value, event_id = F.col("event_type"), F.col("value"), F.col("event_id")
    sensor = F.lit(TRAIN_ONLY_SENSOR)
    for name, code in SENSOR_OF_TYPE.items():
        sensor = F.when(event_type == name, code).otherwise(sensor)
    user = F.col("user_id").cast("string")
    slot = F.floor((F.dayofmonth("ts") - 1) / 6).cast("int").cast("string")
    columns = {
        "uid": event_id,
        "timestamp": epoch_millis("ts"),
        "sensor_type": sensor,
        "field_0": value,
        "field_1": F.get_json_object("props", "$.k"),
        "field_2": F.when(event_id % 10 != 0, event_id % 7),
        "field_3": F.when(event_type.isin("purchase", "view"), value * 0.5),
        "field_4": F.when(event_type == "view", event_id % 13),
        "field_5": F.lit(None),
        "field_6": F.lit(None),
        "field_7": F.lit(None),
        "session_id": F.concat(user, F.lit("-"), slot),
        "user_id": user,
    }
    return raw.select(
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in TRAIN_SCHEMA.fields]
    )


def train_part(events: DataFrame) -> DataFrame:
    """Everything before the unseen period (B2)."""
    return events.where(~F.col("session_id").like(TEST_SLOT))


def test_part(events: DataFrame) -> DataFrame:
    """The unseen period, without users and without the train-only sensor (B2)."""
    unseen = F.col("session_id").like(TEST_SLOT) & (F.col("sensor_type") != TRAIN_ONLY_SENSOR)
    return conform(events.where(unseen), labelled=False)


def mixed_events(events: DataFrame) -> DataFrame:
    """All events, those with the largest ``field_1`` filed under the next user."""
    next_user = (F.col("user_id").cast("int") + 1).cast("string")
    return events.withColumn(
        "user_id", F.when(F.col("field_1") >= 98, next_user).otherwise(F.col("user_id"))
    )


def learnable_events(events: DataFrame) -> DataFrame:
    """All events with four classes of users and a signature in two fields.

    The signature is strong enough for every learner to be right on every session,
    so that SQL can tell what the fits have to predict.

    The supplied users behave at random; this is what the models can learn.
    """
    group = F.col("user_id").cast("int") % N_CLASSES
    return events.withColumns(
        {
            "user_id": group.cast("string"),
            "field_0": F.col("field_0") / 100 + 6 * group,
            "field_1": F.col("field_1") / 50 + 6 * (group % 2),
        }
    )


def dense_events(events: DataFrame) -> DataFrame:
    """All events with the slot alone as session: thousands of events per session."""
    slot = F.substring_index("session_id", "-", -1)
    return events.withColumns({"session_id": slot, "user_id": F.lit("all")})


# Sensor types that differ in case, hold dots, quotes or blanks, or look like NULL.
ODD_SENSORS = {"1": None, "19": "null", "2": "A", "4": "a", "5": "a.b `c'"}
ODD_LABELS = {"1": "null", "19": "xnull", "2": "x_41", "4": "xa", "5": "xa_2eb_20_60c_27"}


def oddly_named(events: DataFrame) -> DataFrame:
    """All events under the sensor types of :data:`ODD_SENSORS`."""
    sensor = F.lit(None).cast("string")
    for plain, odd in ODD_SENSORS.items():
        sensor = F.when(F.col("sensor_type") == plain, F.lit(odd)).otherwise(sensor)
    return events.withColumn("sensor_type", sensor)


def aligned_sides(events: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Aligned train and test features of an event table."""
    train = build_session_features(train_part(events), True, sensors=SENSORS, single_user=True)
    seen = [s for s in SENSORS if s != TRAIN_ONLY_SENSOR]
    test = build_session_features(test_part(events), False, sensors=seen)
    return align_train_test_features(train, test)


# Stand-ins for models: every sensor is scored once per day of the month.
MODEL_OF_SENSOR = {"1": "LR", "19": "Dummy_stratified", "2": "SVM", "4": "RF", "5": "GBT"}
# Day number of 2024-01-01, the first day of the events.
FIRST_DAY = 19723
# A prime, so that rounding never meets an exact half.
SCORE_UNIT = 211


def score_table(events: DataFrame, digits: int) -> DataFrame:
    """``(model, seed, macro_f1)`` from the data: mean ``field_0`` per sensor and day."""
    model = F.lit(None)
    for sensor, name in MODEL_OF_SENSOR.items():
        model = F.when(F.col("sensor_type") == sensor, name).otherwise(model)
    day = (F.floor(F.col("timestamp") / 86_400_000) - FIRST_DAY).cast("int")
    return events.groupBy(model.alias("model"), day.alias("seed")).agg(
        F.round(F.avg("field_0") / SCORE_UNIT, digits).alias("macro_f1")
    )
