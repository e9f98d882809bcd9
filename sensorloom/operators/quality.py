"""Data-quality checks on event tables (V1-V7).

The checks that group by session or user need only who, where and how often, so
all of them also work on the *event profile*: one row per (session, user, sensor)
with a row count and null counts. What counts rows says so by ``weight=PROFILE_ROWS``;
a table's own column of that name has no such meaning. It takes one pass over the events with
map-side aggregation and is smaller by the number of events per group; a
report that needs every check builds it once (see ``plans.reports``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROFILE_KEYS = ["session_id", "user_id", "sensor_type"]
# Name of the row count of a profile.
PROFILE_ROWS = "n_rows"
_NULLS = "nulls__"


def get_null_counts(df: DataFrame) -> DataFrame:
    """NULLs per column, one row (V1). NaN is a value; an empty table counts 0."""
    return df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def event_profile(df: DataFrame, with_nulls: bool = True) -> DataFrame:
    """One row per (session, user, sensor): rows and NULLs of the other columns.

    Without the NULL counts a columnar scan reads the three key columns only.
    """
    keys = [k for k in PROFILE_KEYS if k in df.columns]
    others = [c for c in df.columns if c not in keys] if with_nulls else []
    return df.groupBy(*keys).agg(
        F.count("*").alias(PROFILE_ROWS),
        *[F.count_if(F.col(c).isNull()).alias(_NULLS + c) for c in others],
    )


def null_counts_of_profile(profile: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`get_null_counts` of the profiled table, from a profile with NULL counts."""

    def nulls(column: str) -> Column:
        if _NULLS + column in profile.columns:
            total = F.sum(_NULLS + column)
        else:
            total = F.sum(F.when(F.col(column).isNull(), F.col(PROFILE_ROWS)))
        return F.coalesce(total, F.lit(0)).alias(column)

    return profile.select(*[nulls(c) for c in columns])


def find_mixed_user_sessions(
    df: DataFrame, with_nulls: bool = False, weight: str | None = None
) -> DataFrame:
    """Sessions with more than one distinct user (V2).

    A NULL user is no user and is not counted. ``with_nulls`` adds
    ``n_null_users`` (unlabelled rows) and also returns sessions that have both
    a user and unlabelled rows: those would still get two label rows. ``weight``
    names a column that says how many rows a row stands for.
    """
    stands_for = F.lit(1) if weight is None else F.col(weight)
    # One row per (session, user) first: map-side partial, no expanded distinct.
    pairs = df.groupBy("session_id", "user_id").agg(F.sum(stands_for).alias("rows"))
    checked = pairs.groupBy("session_id").agg(
        F.count("user_id").alias("n_users"),
        F.coalesce(F.sum(F.when(F.col("user_id").isNull(), F.col("rows"))), F.lit(0)).alias(
            "n_null_users"
        ),
    )
    if not with_nulls:
        return checked.where("n_users > 1").drop("n_null_users")
    return checked.where("n_users > 1 OR (n_users > 0 AND n_null_users > 0)")


def get_session_size_stats(df: DataFrame, weight: str | None = None) -> DataFrame:
    """50th, 90th and 99th percentile and maximum of events per session (V3)."""
    rows = F.count("*") if weight is None else F.sum(weight)
    sizes = df.groupBy("session_id").agg(rows.alias("size"))
    quantiles = {f"p{q}": F.percentile_approx("size", q / 100) for q in (50, 90, 99)}
    return sizes.agg(
        *[quantile.alias(name) for name, quantile in quantiles.items()],
        F.max("size").alias("max_count"),
    )


def get_sensor_types(df: DataFrame) -> DataFrame:
    """Distinct sensor types in string order, NULL first if present (V4)."""
    return df.select("sensor_type").distinct().orderBy(F.asc_nulls_first("sensor_type"))


def _sessions_per_user(df: DataFrame) -> DataFrame:
    pairs = df.select("user_id", "session_id").distinct()
    return pairs.groupBy("user_id").agg(F.count("session_id").alias("n_sessions"))


def get_user_session_counts(df: DataFrame) -> DataFrame:
    """Distinct sessions of each user, most first, ties by user (V5)."""
    return _sessions_per_user(df).orderBy(F.desc("n_sessions"), F.asc_nulls_first("user_id"))


def imbalance(df: DataFrame) -> DataFrame:
    """One row: most over fewest sessions of a user; NULL if undefined (V6)."""
    extremes = _sessions_per_user(df).agg(
        F.max("n_sessions").alias("most"), F.min("n_sessions").alias("fewest")
    )
    return extremes.select(
        (F.col("most") / F.nullif(F.col("fewest"), F.lit(0))).alias("imbalance_ratio")
    )


def get_imbalance_ratio(df: DataFrame) -> float | None:
    """:func:`imbalance` as a number (an action)."""
    return imbalance(df).first()["imbalance_ratio"]


def require_single_user_sessions(df: DataFrame, on_mixed: str = "raise") -> DataFrame:
    """Gate before feature building (V7).

    ``raise`` stops with ``ValueError`` at the first session of more than one
    user; ``report`` only returns those sessions.
    """
    if on_mixed not in ("raise", "report"):
        raise ValueError(f"on_mixed must be 'raise' or 'report', not {on_mixed!r}")
    mixed = find_mixed_user_sessions(df)
    if on_mixed == "raise" and not mixed.isEmpty():
        raise ValueError("mixed sessions: some session_id comes with several users")
    return mixed
