"""The whole experiment: events in, predictions out."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.estimators import (
    FitSettings,
    compare_predictions,
    predict_users,
    prepare_holdout,
    train_final_random_forest,
    tune_on,
)
from sensorloom.operators.layout import HOT_SESSION_ROWS
from sensorloom.operators.ledger import Ledger
from sensorloom.operators.quality import (
    find_mixed_user_sessions,
    imbalance,
    require_single_user_sessions,
)
from sensorloom.operators.scoring import (
    comparison_chart,
    macro_f1,
    paired_wilcoxon_test,
    summarize_model_scores,
)
from sensorloom.plans.reports import audit_of, feature_job_of, profile_both
from sensorloom.session import build_session
from sensorloom.sources.events import bad_field_table, load_test_data, load_train_data
from sensorloom.sources.predictions import write_predictions
from sensorloom.sources.scratch import materialize


def run_experiment(
    config: dict[str, Any],
    spark: SparkSession | None = None,
    settings: FitSettings = FitSettings(),
    hot_session_rows: int = HOT_SESSION_ROWS,
) -> dict[str, Any]:
    """Load, validate, build features, compare, test, tune, fit, predict, write.

    ``config`` is a plain nested dict: ``data.train_path``, ``data.test_path``,
    optional ``data.format`` (``csv`` or ``parquet``), ``evaluation.n_seeds``
    (default 20), ``model.random_state`` (default 42), ``output.submission_path``,
    optional ``output.model_comparison_path``, which gets the chart data, and optional
    ``output.ledger_path``: a run that names the ledger of an earlier one reads the fits that
    are finished there.

    The events are read twice per side: once for the profile (validation,
    pivot values, session sizes) and once for the features. A session of two users
    or a session without a user stops the run before features are built.
    """
    spark = spark or build_session()
    data, output = config["data"], config["output"]
    fmt = data.get("format", "csv")
    seeds = list(range(int(config.get("evaluation", {}).get("n_seeds", 20))))
    random_state = int(config.get("model", {}).get("random_state", 42))

    # The profile's pass counts the fields that could not be parsed; the next pass need not.
    bad = {"train": Observation("train"), "test": Observation("test")} if fmt == "csv" else {}
    noted = profile_both(
        load_train_data(spark, data["train_path"], fmt, bad.get("train")),
        load_test_data(spark, data["test_path"], fmt, bad.get("test")),
    )
    train = replace(noted[0], events=load_train_data(spark, data["train_path"], fmt))
    test = replace(noted[1], events=load_test_data(spark, data["test_path"], fmt))
    require_single_user_sessions(train.profile)
    unlabelled = train.profile.where(F.col("user_id").isNull() | F.col("session_id").isNull())
    if not unlabelled.isEmpty():
        raise ValueError("unlabelled events: some training rows lack session_id or user_id")

    tables = feature_job_of(train, test, hot_session_rows, single_user=True)
    holdout = prepare_holdout(tables.train, tables.features, seeds)
    ledger = Ledger(spark, output.get("ledger_path"))
    predictions = compare_predictions(holdout, settings, ledger=ledger)
    scores = materialize(macro_f1(predictions), "scores")
    summary = summarize_model_scores(scores)
    comparison = paired_wilcoxon_test(scores, "RF", "GBT")
    chart = comparison_chart(summary)
    if output.get("model_comparison_path"):
        chart.orderBy("position").coalesce(1).write.mode("overwrite").csv(
            output["model_comparison_path"], header=True
        )

    best, tuning = tune_on(holdout, settings, ledger)
    holdout.release()
    final = train_final_random_forest(
        tables.train, tables.features, best, random_state, settings
    )
    submission = materialize(predict_users(final, tables.test, tables.features), "submission")
    write_predictions(submission, output["submission_path"])

    bad_fields = [bad_field_table(spark, name, counted) for name, counted in bad.items()]
    return {
        "bad_fields": reduce(DataFrame.unionByName, bad_fields) if bad_fields else None,
        "audit": audit_of({"train": train, "test": test}),
        "mixed_user_sessions": find_mixed_user_sessions(train.profile),
        "imbalance_ratio": imbalance(train.profile),
        "model_summary": summary,
        "rf_xgb_comparison": comparison,
        "best_parameters": best,
        "tuning_results": tuning,
        "submission": submission,
        "figure": chart,
        "n_features": len(tables.features),
        "train_sessions": tables.train.count(),
        "test_sessions": tables.test.count(),
    }
