"""How the events are spread over tasks before they are aggregated.

Without knowledge of the data the feature aggregate relies on map-side partial
aggregation, which is safe for any distribution. Its price is that a median
summary of a group below some thousand values is no smaller than the values, so
for ordinary sessions the shuffle carries as much as the events would, and the
pivot shuffles once more.

With an event profile at hand the sizes are known. Events are then
hash-partitioned by session once, and everything after that (the aggregate, the
pivot, the label join) finds its rows in place: one shuffle altogether. If some
session is too large for one task, every event also gets a *salt*: 0 for ordinary
sessions, one of ceil(size / limit) numbers for a hot one. The events still are
read and moved once; what moves again is one aggregation buffer per (session,
sensor, salt), which is where the pieces of a hot session meet.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.columns import MEASUREMENTS
from sensorloom.operators.medians import large_groups
from sensorloom.sources.scratch import materialize

# Events of one session above which it is not put into one task.
HOT_SESSION_ROWS = 20_000_000
# Events per partition aimed at (some 2 GB of rows, sorted and spilled), and the most
# partitions: each costs the driver and every map task an entry.
ROWS_PER_PARTITION = 20_000_000
MAX_PARTITIONS = 50_000
# Up to this many hot sessions their table is broadcast (some 10 MB).
BROADCAST_SESSIONS = 100_000


@dataclass(frozen=True)
class SessionLayout:
    """Hot sessions with their number of ``salts`` (None if there are none), how many
    they are, partitions (None: the session's setting), and the (session, sensor) groups that
    are too large for a median summary (None if there are none, or unless ``sizes_known``)."""

    hot_sessions: DataFrame | None
    partitions: int | None
    n_hot: int = 0
    large_groups: tuple[DataFrame, int] | None = None
    sizes_known: bool = False


def plan_layout(
    profile: DataFrame, hot_session_rows: int = HOT_SESSION_ROWS
) -> SessionLayout:
    """Sizes the layout from an event profile (small actions on a small table).

    Fewer than (events / ``hot_session_rows``) sessions are hot by construction.
    """
    limit = max(1, hot_session_rows)
    sizes = profile.groupBy("session_id").agg(F.sum("n_rows").alias("size"))
    hot = materialize(
        sizes.where(F.col("size") > hot_session_rows).select(
            "session_id", F.ceil(F.col("size") / limit).cast("int").alias("salts")
        ),
        "hot_sessions",
    )
    n_hot = hot.count()
    total = profile.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()["n"]
    wanted = min(MAX_PARTITIONS, -(-total // ROWS_PER_PARTITION))
    default = int(profile.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_sensor = "sensor_type" in profile.columns
    # Below the session's own setting, adaptive execution picks the number.
    return SessionLayout(
        hot if n_hot else None,
        wanted if wanted > default else None,
        n_hot,
        large_groups(profile, ["session_id", "sensor_type"]) if by_sensor else None,
        by_sensor,
    )


def aggregate_by_layout(
    events: DataFrame, layout: SessionLayout, aggregate: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``aggregate(events)``, where the aggregate groups by session (and more)."""
    keys = [F.col("session_id")]
    if layout.hot_sessions is not None:
        hot = layout.hot_sessions.select(F.col("session_id").alias("hot_session_id"), "salts")
        if layout.n_hot <= BROADCAST_SESSIONS:
            hot = F.broadcast(hot)
        # A NULL session is a session too, and may well be the largest.
        same = events["session_id"].eqNullSafe(F.col("hot_session_id"))
        salt = F.pmod(F.xxhash64("timestamp", *MEASUREMENTS), F.col("salts"))
        events = events.join(hot, same, "left").withColumn("salt", F.coalesce(salt, F.lit(0)))
        keys.append(F.col("salt"))
    if layout.partitions is None:
        placed = events.repartition(*keys)
    else:
        placed = events.repartition(layout.partitions, *keys)
    return aggregate(placed)
