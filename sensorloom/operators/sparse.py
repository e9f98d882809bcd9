"""Session features as sparse vectors, for more sensor types than a table has columns.

The pivot makes 57 columns per sensor type, and a plan of some thousand columns is slow to analyse, so
it refuses beyond ``spark.sql.pivotMaxValues``. Here the columns are rows of a table: sensor types are
numbered in sorted order (in range partitions, names never come to the driver), feature number =
57 * sensor number + metric number, and a session is the sorted list of its features that are
neither missing nor zero. The plan has one aggregate and one join, whatever the number of types.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.columns import METRICS
from sensorloom.operators.features import session_sensor_features
from sensorloom.operators.layout import SessionLayout
from sensorloom.operators.splits import class_table
from sensorloom.sources.scratch import materialize

# Stands for the missing sensor type; sorts first, as NULL does.
_NO_SENSOR = "\x00"


@dataclass(frozen=True)
class SparseFeatures:
    """``vectors``: ``session_id``, ``indices`` and ``values`` (and ``user_id``) per session;
    ``sensors``: ``sensor_type, sensor_no``; ``size``: length of the vectors."""

    vectors: DataFrame
    sensors: DataFrame
    size: int

    def names(self) -> DataFrame:
        """``index, sensor_type, metric`` of every feature."""
        numbered = F.posexplode(F.array(*map(F.lit, METRICS))).alias("metric_no", "metric")
        return self.sensors.select("sensor_type", "sensor_no", numbered).select(
            (F.col("sensor_no") * len(METRICS) + F.col("metric_no")).alias("index"),
            "sensor_type",
            "metric",
        )


def sensor_numbers(events: DataFrame) -> tuple[DataFrame, int]:
    """``(sensor_type, sensor_no)`` in sorted order from 0, NULL first, and how many there are."""
    types = events.select(F.coalesce("sensor_type", F.lit(_NO_SENSOR)).alias("user_id"))
    numbered, count = class_table(types)
    sensor = F.when(F.col("user_id") != _NO_SENSOR, F.col("user_id"))
    return numbered.select(
        sensor.alias("sensor_type"), F.col("label").cast("bigint").alias("sensor_no")
    ), count


def _entries(first: Column) -> Column:
    """(index, value) of the metrics of one (session, sensor) row that are there and not zero.

    As in the aligned tables NaN counts as missing.
    """
    values = F.array(*[F.col(m).cast("double") for m in METRICS])
    all_ = F.transform(
        values, lambda v, i: F.struct((first + i).alias("index"), F.nanvl(v, F.lit(0.0)).alias("value"))
    )
    return F.filter(all_, lambda e: e["value"].isNotNull() & (e["value"] != 0))


def sparse_session_features(
    events: DataFrame,
    has_label: bool,
    sensors: tuple[DataFrame, int] | None = None,
    layout: SessionLayout | None = None,
) -> SparseFeatures:
    """One sparse vector per session; a session of known sensors only.

    ``sensors`` (of the training side, by :func:`sensor_numbers`) makes the vectors of two
    tables agree: a sensor type that it lacks has no features. A session all of whose features
    are missing has empty lists. With ``has_label`` sessions must have one user, which is carried along.
    """
    numbers, count = sensors if sensors is not None else sensor_numbers(events)
    rows = session_sensor_features(events, layout=layout, carry_user=has_label)
    known = numbers.select(F.col("sensor_type").alias("n_sensor"), "sensor_no")
    same = F.col("sensor_type").eqNullSafe(F.col("n_sensor"))
    numbered = rows.join(known, same, "left")
    first = F.col("sensor_no") * len(METRICS)
    entries = F.when(first.isNotNull(), _entries(first)).otherwise(
        F.expr("cast(array() as array<struct<index: bigint, value: double>>)")
    )
    label = [F.max("user_id").alias("user_id")] if has_label else []
    # Bounded by the sensors of one session.
    packed = numbered.select("session_id", entries.alias("entries"), *(["user_id"] if has_label else []))
    vectors = packed.groupBy("session_id").agg(
        F.array_sort(F.flatten(F.collect_list("entries"))).alias("entries"), *label
    )
    chosen = vectors.select(
        "session_id",
        F.col("entries.index").alias("indices"),
        F.col("entries.value").alias("values"),
        *(["user_id"] if has_label else []),
    )
    return SparseFeatures(materialize(chosen, "sparse_features"), numbers, count * len(METRICS))
