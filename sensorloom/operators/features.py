"""Session features: events -> one wide row per session.

Plan shape: one aggregate over the events by (session, sensor), all 57 metrics at
once and all of them partial aggregates. The pivot then groups those rows by
session; a session has at most one row per sensor there.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.columns import (
    MEASUREMENTS,
    METRICS,
    SUMMARISED,
    event_rate,
    magnitude,
    metric_aggregates,
    sensor_label,
)
from sensorloom.operators.layout import SessionLayout, aggregate_by_layout
from sensorloom.operators.medians import BROADCAST_GROUPS, exact_medians, large_groups
from sensorloom.operators.quality import get_sensor_types

GRAIN = ["session_id", "sensor_type"]


def with_magnitude(events: DataFrame) -> DataFrame:
    """Events plus ``mag_012`` (F1)."""
    return events.withColumn("mag_012", magnitude())


def session_sensor_features(
    events: DataFrame,
    accuracy: int | None = None,
    layout: SessionLayout | None = None,
    carry_user: bool = False,
) -> DataFrame:
    """One row per (session, sensor) with the 57 metrics.

    ``layout`` (from an event profile) decides how the events are spread; see
    :mod:`.layout`. ``carry_user`` adds the session's ``user_id``, valid once no
    session has two users.

    Medians are exact, so they depend on no layout: small groups come out of the one
    aggregate, for large ones see :mod:`.medians`. Without a layout the group sizes are counted
    first. An ``accuracy`` asks for approximate medians instead, in one pass whatever the sizes.
    """
    label = ["user_id"] if carry_user else []
    aggregates = metric_aggregates(accuracy) + [F.max(c).alias(c) for c in label]

    def aggregate(rows: DataFrame) -> DataFrame:
        return with_magnitude(rows).groupBy(*GRAIN).agg(*aggregates)

    used = events.select(*GRAIN, "timestamp", *MEASUREMENTS, *label)
    rows = aggregate(used) if layout is None else aggregate_by_layout(used, layout, aggregate)
    if accuracy is None:
        known = layout is not None and layout.sizes_known
        large = layout.large_groups if known else _large(events)
        if large is not None:
            rows = _with_exact_medians(rows, used, large)
    return rows.withColumn("event_rate", event_rate()).select(*GRAIN, *METRICS, *label)


def _large(events: DataFrame) -> tuple[DataFrame, int] | None:
    sizes = events.groupBy(*GRAIN).agg(F.count("*").alias("n_rows"))
    return large_groups(sizes, GRAIN)


def _with_exact_medians(
    rows: DataFrame, events: DataFrame, large: tuple[DataFrame, int]
) -> DataFrame:
    """``rows`` with the medians of large groups replaced by the exact ones."""
    names = [f"{prefix}_p50" for prefix in SUMMARISED]
    exact = exact_medians(with_magnitude(events), GRAIN, large)
    exact = exact.toDF(*[f"g_{k}" for k in GRAIN], *[f"exact_{n}" for n in names])
    same = F.lit(True)
    for key in GRAIN:
        same = same & F.col(key).eqNullSafe(F.col(f"g_{key}"))
    joined = rows.join(F.broadcast(exact) if large[1] <= BROADCAST_GROUPS else exact, same, "left")
    chosen = [
        F.coalesce(f"exact_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns
    ]
    return joined.select(*chosen)


def feature_name(sensor: str | None, metric: str) -> str:
    """``sensor_<type>_<metric>`` with the type as :func:`sensor_label` writes it."""
    return f"sensor_{sensor_label(sensor)}_{metric}"


def sensor_values(events: DataFrame) -> list[str | None]:
    """The sensor types of a table as pivot values (an action).

    Meant to be a handful; more than ``spark.sql.pivotMaxValues`` is an error, so
    a column full of garbage never reaches the driver.
    """
    limit = int(events.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    found = [row["sensor_type"] for row in get_sensor_types(events).take(limit + 1)]
    if len(found) > limit:
        raise ValueError(f"more than {limit} sensor types to pivot")
    return found


def pivot_sensors(
    rows: DataFrame, sensors: Iterable[str | None], carry_user: bool = False
) -> DataFrame:
    """(session, sensor) rows -> one row per session, sensors side by side.

    Each sensor's metrics travel as one struct, picked by one aggregate per
    sensor; a sensor the session lacks is NULL. Sessions without any of the
    listed sensors are kept with all features NULL.
    """
    sensors = list(sensors)
    packed = F.struct(*METRICS)
    picks = [
        F.first(F.when(F.col("sensor_type").eqNullSafe(F.lit(sensor)), packed), True).alias(
            f"pick_{i}"
        )
        for i, sensor in enumerate(sensors)
    ]
    if carry_user:
        picks.append(F.max("user_id").alias("user_id"))
    if not picks:
        return rows.select("session_id").distinct()
    label = ["user_id"] if carry_user else []
    names = [feature_name(sensor, metric) for sensor in sensors for metric in METRICS]
    # Unpacking whole structs and naming by position is two calls; building
    # hundreds of column objects one by one takes longer than the query.
    unpacked = [f"pick_{i}.*" for i in range(len(sensors))]
    wide = rows.groupBy("session_id").agg(*picks).select("session_id", *unpacked, *label)
    return wide.toDF("session_id", *names, *label)


def session_labels(events: DataFrame) -> DataFrame:
    """Distinct (session, user) pairs (F16)."""
    return events.select("session_id", "user_id").distinct()


def build_session_features(
    events: DataFrame,
    has_label: bool,
    sensors: Iterable[str | None] | None = None,
    accuracy: int | None = None,
    layout: SessionLayout | None = None,
    single_user: bool = False,
) -> DataFrame:
    """The wide session table: ``session_id``, features, ``user_id`` if labelled.

    Without ``sensors`` the types are looked up first, one extra pass over one
    column. Labels are left-joined on the session, so a session of two users
    gives two rows and a NULL session stays unlabelled (F17). When the caller
    has already ruled that out (``single_user``), the label rides through the
    aggregates instead: no second pass over the events and no join. The feature
    job does so; the join is the definition it is tested against.
    """
    if sensors is None:
        sensors = sensor_values(events)
    carry = has_label and single_user
    rows = session_sensor_features(events, accuracy, layout, carry)
    wide = pivot_sensors(rows, sensors, carry)
    if carry:
        known = F.col("session_id").isNotNull()
        return wide.withColumn("user_id", F.when(known, F.col("user_id")))
    if has_label:
        return wide.join(session_labels(events), "session_id", "left")
    return wide
