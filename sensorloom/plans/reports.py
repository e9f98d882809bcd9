"""Validation report and feature job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.alignment import align_train_test_features
from sensorloom.operators.features import build_session_features, sensor_values
from sensorloom.operators.layout import HOT_SESSION_ROWS, plan_layout
from sensorloom.operators.quality import (
    PROFILE_ROWS,
    event_profile,
    find_mixed_user_sessions,
    get_sensor_types,
    get_session_size_stats,
    get_user_session_counts,
    imbalance,
    null_counts_of_profile,
)
from sensorloom.sources.scratch import in_parallel, materialize


@dataclass(frozen=True)
class Profiled:
    """An event table and its materialized profile."""

    events: DataFrame
    profile: DataFrame

    @property
    def labelled(self) -> bool:
        return "user_id" in self.events.columns


def profile_events(events: DataFrame, with_nulls: bool = False) -> Profiled:
    """One pass over the events; every check afterwards reads the small profile."""
    return Profiled(events, materialize(event_profile(events, with_nulls), "profile"))


def validation_report(events: DataFrame) -> dict[str, DataFrame]:
    """All checks of one event table from a single pass over it.

    Unlabelled tables have no user checks. Nothing here is fatal.
    """
    profiled = profile_events(events, with_nulls=True)
    profile = profiled.profile
    report = {
        "null_counts": null_counts_of_profile(profile, events.columns),
        "session_size_stats": get_session_size_stats(profile, weight=PROFILE_ROWS),
        "sensor_types": get_sensor_types(profile),
    }
    if profiled.labelled:
        report["mixed_user_sessions"] = find_mixed_user_sessions(profile, weight=PROFILE_ROWS)
        report["user_session_counts"] = get_user_session_counts(profile)
        report["imbalance_ratio"] = imbalance(profile)
    return report


def audit_of(tables: dict[str, Profiled]) -> DataFrame:
    """:func:`sources.events.dataset_audit` from profiles."""
    audits = []
    for name, table in tables.items():
        users = F.count_distinct("user_id") if table.labelled else F.lit(None).cast("bigint")
        audits.append(
            table.profile.agg(
                F.coalesce(F.sum(PROFILE_ROWS), F.lit(0)).alias("n_rows"),
                F.count_distinct("session_id").alias("n_sessions"),
                users.alias("n_users"),
            ).select(
                F.lit(name).alias("table_name"),
                "*",
                F.lit(len(table.events.columns)).cast("bigint").alias("n_columns"),
            )
        )
    result = audits[0]
    for audit in audits[1:]:
        result = result.unionByName(audit)
    return result


@dataclass(frozen=True)
class FeatureTables:
    """Aligned features of both sides, as scratch tables."""

    train: DataFrame
    test: DataFrame
    features: list[str]


def feature_job_of(
    train: Profiled,
    test: Profiled,
    hot_session_rows: int = HOT_SESSION_ROWS,
    single_user: bool = False,
) -> FeatureTables:
    """:func:`feature_job` on profiled tables.

    The profile supplies the pivot values of both sides and the session sizes
    the layout is planned from, so neither costs a pass over the events.
    """
    types = train.profile.select("sensor_type").union(test.profile.select("sensor_type"))
    sensors = sensor_values(types)

    def wide(side: Profiled, labelled: bool) -> DataFrame:
        return build_session_features(
            side.events,
            has_label=labelled,
            sensors=sensors,
            layout=plan_layout(side.profile, hot_session_rows),
            single_user=single_user,
        )

    both = [partial(wide, train, True), partial(wide, test, False)]
    aligned = align_train_test_features(*in_parallel(types.sparkSession, both, 2))
    names = ("train_features", "test_features")
    stored = [partial(materialize, df, name) for df, name in zip(aligned, names)]
    return FeatureTables(*in_parallel(types.sparkSession, stored, 2), aligned[2])


def profile_both(train: DataFrame, test: DataFrame) -> tuple[Profiled, Profiled]:
    """Profiles of both sides, computed side by side."""
    tasks = [partial(profile_events, train), partial(profile_events, test)]
    return tuple(in_parallel(train.sparkSession, tasks, 2))


def feature_job(train: DataFrame, test: DataFrame, **options) -> FeatureTables:
    """Session features of both tables with the same columns."""
    return feature_job_of(*profile_both(train, test), **options)
