"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEASUREMENTS = tuple(f"field_{i}" for i in range(8))

# Metric prefix -> the event column it summarises.
SUMMARISED = {**{m: m for m in MEASUREMENTS}, "mag": "mag_012"}

STATISTICS = ("mean", "p50", "std", "min", "max", "nn")

# Every metric of one (session, sensor) row: 2 + 9 * 6 + 1 = 57.
METRICS = (
    ["n_events", "duration_ms"]
    + [f"{prefix}_{stat}" for prefix in SUMMARISED for stat in STATISTICS]
    + ["event_rate"]
)


def sensor_label(sensor: str | None) -> str:
    """A sensor type as part of a column name (F15): injective, lower case, no dots.

    Plain digits stay. Anything else gets an ``x`` in front and keeps its lower-case
    ASCII letters and digits; other bytes become ``_`` and two hexadecimal digits. NULL is
    ``null``, which no string turns into.
    """
    if sensor is None:
        return "null"
    if sensor.isascii() and sensor.isdigit():
        return sensor
    kept = "abcdefghijklmnopqrstuvwxyz0123456789"
    return "x" + "".join(
        chr(b) if chr(b) in kept else f"_{b:02x}" for b in sensor.encode("utf-8")
    )


def magnitude() -> Column:
    """Length of the vector (field_0, field_1, field_2); NULL if any part is (F1)."""
    squares = [F.col(axis) * F.col(axis) for axis in MEASUREMENTS[:3]]
    return F.sqrt(squares[0] + squares[1] + squares[2])


def event_rate() -> Column:
    """Events per millisecond; the +1 keeps a single-event stream finite."""
    return F.col("n_events") / (F.col("duration_ms") + 1.0)


def metric_aggregates(accuracy: int | None = None) -> list[Column]:
    """Aggregates: every metric but the event rate.

    Mean, sample standard deviation, extremes and non-null counts are plain
    partial aggregates. The median is a mergeable quantile summary: an actual
    element of the data whose rank is off by at most n / accuracy (10,000 by
    default) of n values. Which element within that bound depends on how the
    group was spread over tasks; groups of some thousand values are exact, and the
    feature operators replace the medians of larger ones.

    Written as SQL fragments: one call each instead of several per column object.
    """
    closeness = "" if accuracy is None else f", {accuracy}"
    of_column = {
        "mean": "avg({c})",
        "p50": "percentile_approx({c}, 0.5" + closeness + ")",
        "std": "stddev_samp({c})",
        "min": "min({c})",
        "max": "max({c})",
        "nn": "count({c})",
    }
    fragments = ["count(*) AS n_events", "max(timestamp) - min(timestamp) AS duration_ms"]
    for prefix, column in SUMMARISED.items():
        for statistic in STATISTICS:
            fragments.append(of_column[statistic].format(c=column) + f" AS {prefix}_{statistic}")
    return [F.expr(fragment) for fragment in fragments]


def seeded_digest(*parts: Column | str) -> Column:
    """md5 text of the parts joined by ``:``, the repeatable source of randomness.

    Keyed on values, so it does not depend on row order or partitioning.
    """
    return F.md5(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts]))


def digest_fraction(digest: Column) -> Column:
    """The first 32 bits of a digest as a number in [0, 1); grows with the text."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)
