"""The registered queries: every operator over the whole supplied event table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from catalog import views
from sensorloom.operators import estimators as est
from sensorloom.operators.baselines import most_frequent_predictions, stratified_predictions
from sensorloom.operators.features import (
    build_session_features,
    session_labels,
    session_sensor_features,
    with_magnitude,
)
from sensorloom.operators.layout import plan_layout
from sensorloom.operators.medians import exact_medians, large_groups
from sensorloom.operators.quality import (
    event_profile,
    find_mixed_user_sessions,
    get_null_counts,
    get_sensor_types,
    get_session_size_stats,
    get_user_session_counts,
    imbalance,
    require_single_user_sessions,
)
from sensorloom.operators.scoring import (
    comparison_chart,
    macro_f1,
    paired_differences,
    signed_rank_test,
    summarize_model_scores,
)
from sensorloom.operators.sparse import sparse_session_features
from sensorloom.operators.splits import (
    assemble,
    class_table,
    class_weights,
    stratified_splits,
    with_label,
)
from sensorloom.plans.experiment import run_experiment
from sensorloom.plans.reports import FeatureTables, feature_job, validation_report
from sensorloom.sources.events import (
    bad_field_table,
    dataset_audit,
    load_test_data,
    load_train_data,
    preview,
    write_events,
)
from sensorloom.sources.predictions import write_predictions
from sensorloom.sources.scratch import fresh_path, materialize

Query = Callable[[SparkSession, str], DataFrame]

# The protocol's seeds. Linear fits and one comparison take all of them; tuning, the whole job, the
# other comparison and the single queries of trees one: the rest of their protocol is full.
SEEDS = list(range(20))
MODEL_SEEDS = SEEDS[:1]
PAIRS = [("RF", "GBT"), ("LR", "SVM"), ("RF", "Dummy_stratified")]
# Sessions above this count as hot in some queries, so that both paths run.
HOT_ROWS = 13

_QUERIES: dict[str, Query] = {}


def _on_events(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a query that is a function of the sensor-event view."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(views.sensor_events(spark, sf_dir))

    _QUERIES[build.__name__] = query
    return build


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums may differ in the last bits across partitionings."""
    return df.selectExpr(
        *[f"round(`{c}`, {digits}) AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes]
    )


# --- sources and sinks ------------------------------------------------------


@_on_events
def csv_roundtrip_train(events: DataFrame) -> DataFrame:
    spark = events.sparkSession
    path = fresh_path(spark, "train_csv")
    write_events(views.train_part(events), path)
    return load_train_data(spark, path)


@_on_events
def csv_roundtrip_test(events: DataFrame) -> DataFrame:
    spark = events.sparkSession
    path = fresh_path(spark, "test_csv")
    write_events(views.test_part(events), path)
    return load_test_data(spark, path)


@_on_events
def bad_field_counts(events: DataFrame) -> DataFrame:
    """Training events with words for numbers, as CSV; what the profile's pass could not parse."""
    spark = events.sparkSession
    path = fresh_path(spark, "malformed_csv")
    train = views.train_part(events)
    late = F.col("timestamp") % 7 == 0
    garbled = train.withColumns(
        {
            "timestamp": F.when(late, F.lit("late")).otherwise(F.col("timestamp").cast("string")),
            "field_1": F.when(F.col("field_1") >= 90, F.lit("much")).otherwise(
                F.col("field_1").cast("string")
            ),
        }
    )
    garbled.write.option("header", True).csv(path)
    counted = Observation("train")
    materialize(event_profile(load_train_data(spark, path, bad_fields=counted)), "profile")
    return bad_field_table(spark, "train", counted)


@_on_events
def parquet_roundtrip_train(events: DataFrame) -> DataFrame:
    spark = events.sparkSession
    path = fresh_path(spark, "train_parquet")
    write_events(views.train_part(events), path, fmt="parquet")
    return load_train_data(spark, path, fmt="parquet")


@_on_events
def predictions_sink(events: DataFrame) -> DataFrame:
    """Writes the last split's draws of the stratified dummy and reads them back."""
    spark = events.sparkSession
    splits = _splits(events).where(F.col("seed") == SEEDS[-1])
    drawn = stratified_predictions(splits)
    path = fresh_path(spark, "predictions_csv")
    write_predictions(drawn.select("session_id", F.col("prediction").alias("user_id")), path)
    return spark.read.schema("session_id string, user_id string").csv(path, header=True)


@_on_events
def dataset_audit_tables(events: DataFrame) -> DataFrame:
    return dataset_audit({"train": views.train_part(events), "test": views.test_part(events)})


@_on_events
def preview_events(events: DataFrame) -> DataFrame:
    return preview(events, 5, ["session_id", "timestamp", "uid"])


# --- validation -------------------------------------------------------------


@_on_events
def null_counts(events: DataFrame) -> DataFrame:
    return get_null_counts(events)


@_on_events
def mixed_user_sessions(events: DataFrame) -> DataFrame:
    return find_mixed_user_sessions(views.mixed_events(events))


@_on_events
def mixed_user_sessions_with_nulls(events: DataFrame) -> DataFrame:
    hidden = F.when(F.col("field_1") < 98, F.col("user_id"))
    return find_mixed_user_sessions(events.withColumn("user_id", hidden), with_nulls=True)


@_on_events
def validation_gate(events: DataFrame) -> DataFrame:
    """The gate passes on the untouched events and reports the tampered ones."""
    require_single_user_sessions(events, on_mixed="raise")
    return require_single_user_sessions(views.mixed_events(events), on_mixed="report").agg(
        F.count("*").alias("n_mixed_sessions")
    )


@_on_events
def session_size_stats(events: DataFrame) -> DataFrame:
    return get_session_size_stats(events)


@_on_events
def sensor_types(events: DataFrame) -> DataFrame:
    return get_sensor_types(events)


@_on_events
def user_session_counts(events: DataFrame) -> DataFrame:
    return get_user_session_counts(events)


@_on_events
def imbalance_ratio(events: DataFrame) -> DataFrame:
    """On the tampered copy, where users do differ."""
    return rounded(imbalance(views.mixed_events(events)))


@_on_events
def validation_summary(events: DataFrame) -> DataFrame:
    """The one-pass report of the tampered copy, as (check, item, value) rows."""
    report = validation_report(views.mixed_events(events))

    def rows(check: str, item, value) -> DataFrame:
        return report[check].select(
            F.lit(check).alias("check"), item.alias("item"), value.cast("double").alias("value")
        )

    def unpivoted(check: str) -> DataFrame:
        wide = report[check].select(*[F.col(c).cast("double") for c in report[check].columns])
        return wide.unpivot([], wide.columns, "item", "value").select(
            F.lit(check).alias("check"), "item", "value"
        )

    parts = [
        unpivoted("null_counts"),
        unpivoted("session_size_stats"),
        rows("sensor_types", F.col("sensor_type"), F.lit(None)),
        rows("mixed_user_sessions", F.col("session_id"), F.col("n_users")),
        rows("user_session_counts", F.col("user_id"), F.col("n_sessions")),
        rows("imbalance_ratio", F.lit("ratio"), F.round("imbalance_ratio", 6)),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- features ---------------------------------------------------------------


@_on_events
def event_magnitude(events: DataFrame) -> DataFrame:
    return rounded(with_magnitude(events).select("uid", "mag_012"))


@_on_events
def session_sensor_features_all(events: DataFrame) -> DataFrame:
    return rounded(session_sensor_features(events), 6)


@_on_events
def session_sensor_features_by_layout(events: DataFrame) -> DataFrame:
    """The same table, co-located by session, with its larger sessions kept apart."""
    layout = plan_layout(materialize(event_profile(events, with_nulls=False), "profile"), HOT_ROWS)
    return rounded(session_sensor_features(events, layout=layout), 6)


def _dense(events: DataFrame, hot_rows: int | None) -> DataFrame:
    dense = views.dense_events(events)
    layout = None
    if hot_rows is not None:
        layout = plan_layout(materialize(event_profile(dense, with_nulls=False), "profile"), hot_rows)
    return rounded(session_sensor_features(dense, layout=layout), 6)


@_on_events
def dense_sessions_plain(events: DataFrame) -> DataFrame:
    """Thousands of events per session, by partial aggregation."""
    return _dense(events, None)


@_on_events
def dense_sessions_placed(events: DataFrame) -> DataFrame:
    """The same, placed by session."""
    return _dense(events, 10**12)


@_on_events
def dense_session_medians(events: DataFrame) -> DataFrame:
    """Medians of all groups of dense sessions by narrowing, down to twenty values."""
    dense = with_magnitude(views.dense_events(events))
    sizes = dense.groupBy("session_id", "sensor_type").agg(F.count("*").alias("n_rows"))
    groups = large_groups(sizes, ["session_id", "sensor_type"], above=0)
    return rounded(exact_medians(dense, ["session_id", "sensor_type"], groups, ranked=20))


@_on_events
def dense_sessions_salted(events: DataFrame) -> DataFrame:
    """The same, every session hot and spread over salts."""
    return _dense(events, 100)


@_on_events
def odd_sensor_names(events: DataFrame) -> DataFrame:
    """Sensor types with dots, quotes and clashing cases, aligned and assembled."""
    odd = views.oddly_named(events)
    tables = feature_job(views.train_part(odd), views.test_part(odd), single_user=True)
    vectors = assemble(tables.train, tables.features, ["session_id"])
    width = F.size(vector_to_array("features")).cast("bigint").alias("n_features")
    return rounded(tables.train.join(vectors.select("session_id", width), "session_id"))


@_on_events
def session_features_train(events: DataFrame) -> DataFrame:
    return rounded(build_session_features(views.train_part(events), True))


@_on_events
def session_features_mixed(events: DataFrame) -> DataFrame:
    """Labels of sessions with two users: one row per (session, user)."""
    mixed = views.mixed_events(events)
    return rounded(build_session_features(mixed, True, sensors=views.SENSORS))


@_on_events
def session_features_test(events: DataFrame) -> DataFrame:
    return rounded(build_session_features(views.test_part(events), False))


@_on_events
def sparse_features(events: DataFrame) -> DataFrame:
    """The features of all sessions as (session, index, value), without a wide table."""
    features = sparse_session_features(events, True)
    entry = F.inline(F.arrays_zip("indices", "values"))
    return rounded(features.vectors.select("session_id", "user_id", entry).toDF(
        "session_id", "user_id", "index", "value"
    ))


@_on_events
def aligned_train(events: DataFrame) -> DataFrame:
    return rounded(views.aligned_sides(events)[0])


@_on_events
def aligned_test(events: DataFrame) -> DataFrame:
    return rounded(views.aligned_sides(events)[1])


def _feature_job(events: DataFrame) -> FeatureTables:
    return feature_job(
        views.train_part(events), views.test_part(events), hot_session_rows=HOT_ROWS
    )


@_on_events
def feature_job_train(events: DataFrame) -> DataFrame:
    return rounded(_feature_job(events).train)


@_on_events
def feature_job_test(events: DataFrame) -> DataFrame:
    return rounded(_feature_job(events).test)


@_on_events
def feature_job_sizes(events: DataFrame) -> DataFrame:
    """Sessions and feature columns of both sides after the feature job."""
    tables = _feature_job(events)
    sides = [
        side.agg(F.count("*").alias("n_sessions")).select(
            F.lit(name).alias("side"),
            "n_sessions",
            F.lit(len(tables.features)).cast("bigint").alias("n_features"),
        )
        for name, side in (("train", tables.train), ("test", tables.test))
    ]
    return sides[0].unionByName(sides[1])


# --- splits, dummies, metric ------------------------------------------------


def _sessions(events: DataFrame) -> DataFrame:
    """(session, user) pairs as a table: a split looks at them several times."""
    return materialize(session_labels(events), "sessions")


@_on_events
def label_index(events: DataFrame) -> DataFrame:
    """Ranked in ranges of about 32 users."""
    pairs = _sessions(events)
    classes, n_classes = class_table(pairs, bin_rows=32)
    indexed = with_label(pairs, classes, n_classes)
    return indexed.select("session_id", "user_id", F.col("label").cast("bigint").alias("label"))


@_on_events
def stratified_split(events: DataFrame) -> DataFrame:
    return stratified_splits(_sessions(events), SEEDS)


@_on_events
def stratified_split_uneven(events: DataFrame) -> DataFrame:
    """Shares that do not divide, so left-over places are drawn."""
    return stratified_splits(_sessions(events), SEEDS, test_size=0.3)


@_on_events
def stratified_split_large_classes(events: DataFrame) -> DataFrame:
    """Four large classes, ranked in bins of about 16 sessions."""
    pairs = _sessions(views.learnable_events(events))
    return stratified_splits(pairs, SEEDS, bin_rows=16)


def _splits(events: DataFrame) -> DataFrame:
    return materialize(stratified_splits(_sessions(events), SEEDS), "splits")


@_on_events
def dummy_most_frequent_scores(events: DataFrame) -> DataFrame:
    return rounded(macro_f1(most_frequent_predictions(_splits(events))))


@_on_events
def dummy_stratified_predictions(events: DataFrame) -> DataFrame:
    return stratified_predictions(_splits(events))


@_on_events
def dummy_stratified_scores(events: DataFrame) -> DataFrame:
    return rounded(macro_f1(stratified_predictions(_splits(events))))


@_on_events
def macro_f1_scores(events: DataFrame) -> DataFrame:
    """Both dummies over four classes, scored in one pass."""
    splits = _splits(views.learnable_events(events))
    both = most_frequent_predictions(splits).unionByName(stratified_predictions(splits))
    return rounded(macro_f1(both))


@_on_events
def class_weights_all(events: DataFrame) -> DataFrame:
    return rounded(class_weights(_sessions(views.learnable_events(events))))


@_on_events
def scaler_stats(events: DataFrame) -> DataFrame:
    train, _, features = views.aligned_sides(events)
    stats = est.scaler_statistics(assemble(train, features, ["session_id"]), features)
    # Eight significant digits: the features differ by many orders of magnitude.
    return stats.select(
        "feature",
        F.format_string("%.7e", "mean").alias("mean"),
        F.format_string("%.7e", "std").alias("std"),
    )


# --- evaluation -------------------------------------------------------------


@_on_events
def score_summary(events: DataFrame) -> DataFrame:
    return rounded(summarize_model_scores(views.score_table(events, 9)))


@_on_events
def paired_score_differences(events: DataFrame) -> DataFrame:
    return rounded(paired_differences(views.score_table(events, 9), PAIRS), 9)


@_on_events
def wilcoxon_pair(events: DataFrame) -> DataFrame:
    """No ties: exact p-values."""
    return rounded(signed_rank_test(paired_differences(views.score_table(events, 9), PAIRS)))


@_on_events
def wilcoxon_pair_ties(events: DataFrame) -> DataFrame:
    """Coarse scores with ties and zeros: normal approximation."""
    return rounded(signed_rank_test(paired_differences(views.score_table(events, 2), PAIRS)))


@_on_events
def wilcoxon_pair_exact_ties(events: DataFrame) -> DataFrame:
    """The same scores with ties and zeros, exact p over all signs."""
    differences = paired_differences(views.score_table(events, 2), PAIRS)
    return rounded(signed_rank_test(differences, "exact"))


@_on_events
def comparison_chart_data(events: DataFrame) -> DataFrame:
    return rounded(comparison_chart(summarize_model_scores(views.score_table(events, 9))))


@_on_events
def tuning_rank(events: DataFrame) -> DataFrame:
    """Grid points stood in for by sensors; scores stay in seed order."""
    points = {m: i for i, m in enumerate(sorted(views.MODEL_OF_SENSOR.values()))}
    grid_id = F.lit(None)
    for model, i in points.items():
        grid_id = F.when(F.col("model") == model, i).otherwise(grid_id)
    scores = views.score_table(events, 9).select(grid_id.alias("grid_id"), "seed", "macro_f1")
    ranked = est.rank_grid(scores)
    unfolded = ranked.select("grid_id", "mean", "std", "rank", F.posexplode("scores"))
    return rounded(unfolded.toDF("grid_id", "mean", "std", "rank", "seed", "score"))


# --- models, with the full hyper-parameters ----------------------------------

FULL = est.FitSettings()


def _learnable(events: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    return views.aligned_sides(views.learnable_events(events))


def _learnable_train(events: DataFrame) -> tuple[DataFrame, list[str]]:
    train, _, features = _learnable(events)
    return materialize(train, "train"), features


def _learner(model: str, seeds: list[int]) -> Callable[[DataFrame], DataFrame]:
    def predictions(events: DataFrame) -> DataFrame:
        train, features = _learnable_train(events)
        data = est.prepare_holdout(train, features, seeds)
        return est.compare_predictions(data, FULL, [model])

    return predictions


for _name, _model, _seeds in (
    ("logistic_regression", "LR", SEEDS),
    ("linear_svm", "SVM", SEEDS),
    ("random_forest", "RF", MODEL_SEEDS),
    ("boosted_trees", "GBT", MODEL_SEEDS),
):
    _build = _learner(_model, _seeds)
    _build.__name__ = _name
    _on_events(_build)


@_on_events
def model_comparison(events: DataFrame) -> DataFrame:
    train, features = _learnable_train(events)
    scores = est.compare_models_repeated(train, features, MODEL_SEEDS, settings=FULL)
    return rounded(summarize_model_scores(scores))


@_on_events
def model_comparison_all_seeds(events: DataFrame) -> DataFrame:
    """All six models on all twenty splits; means to two digits, as not every fit is right on
    every single session."""
    train, features = _learnable_train(events)
    scores = est.compare_models_repeated(train, features, SEEDS, settings=FULL)
    return scores.groupBy("model").agg(
        F.count("*").alias("n_seeds"), F.round(F.avg("macro_f1"), 2).alias("mean_macro_f1")
    )


@_on_events
def forest_tuning(events: DataFrame) -> DataFrame:
    """All six grid points, their parameters unfolded."""
    train, features = _learnable_train(events)
    ranked = est.tune_random_forest(train, features, MODEL_SEEDS, FULL)[1]
    return rounded(ranked.select("rank", "grid_id", "params.*", "mean", "std"))


@_on_events
def final_predictions(events: DataFrame) -> DataFrame:
    train, test, features = _learnable(events)
    train = materialize(train, "train")
    model = est.train_final_random_forest(train, features, FULL.forest, settings=FULL)
    return est.predict_users(model, test, features)


@_on_events
def experiment(events: DataFrame) -> DataFrame:
    """The whole job from CSV files to predictions, one seed."""
    spark = events.sparkSession
    folder = fresh_path(spark, "experiment")
    learnable = views.learnable_events(events)
    write_events(views.train_part(learnable), f"{folder}/train")
    write_events(views.test_part(learnable), f"{folder}/test")
    config = {
        "data": {"train_path": f"{folder}/train", "test_path": f"{folder}/test"},
        "evaluation": {"n_seeds": len(MODEL_SEEDS)},
        "output": {"submission_path": f"{folder}/submission"},
    }
    return run_experiment(config, spark, FULL)["submission"]


def queries() -> dict[str, Query]:
    return dict(_QUERIES)

