"""Session features and closed-set user identification on PySpark."""

from sensorloom.operators.alignment import align_train_test_features
from sensorloom.operators.estimators import (
    FOREST_GRID,
    LIGHT,
    FitSettings,
    ForestParams,
    compare_models_repeated,
    predict_users,
    train_final_random_forest,
    tune_random_forest,
)
from sensorloom.operators.features import build_session_features, session_sensor_features
from sensorloom.operators.quality import (
    find_mixed_user_sessions,
    get_imbalance_ratio,
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
    paired_wilcoxon_test,
    signed_rank_test,
    summarize_model_scores,
)
from sensorloom.operators.splits import assemble, class_table, class_weights, stratified_splits
from sensorloom.plans.experiment import run_experiment
from sensorloom.plans.reports import feature_job, validation_report
from sensorloom.session import build_session
from sensorloom.sources.events import (
    TEST_SCHEMA,
    TRAIN_SCHEMA,
    dataset_audit,
    load_test_data,
    load_train_data,
    preview,
)
from sensorloom.sources.predictions import write_predictions

__all__ = [
    "FOREST_GRID",
    "FitSettings",
    "ForestParams",
    "LIGHT",
    "TEST_SCHEMA",
    "TRAIN_SCHEMA",
    "align_train_test_features",
    "assemble",
    "build_session",
    "build_session_features",
    "class_weights",
    "compare_models_repeated",
    "comparison_chart",
    "dataset_audit",
    "feature_job",
    "find_mixed_user_sessions",
    "class_table",
    "get_imbalance_ratio",
    "get_null_counts",
    "get_sensor_types",
    "get_session_size_stats",
    "get_user_session_counts",
    "imbalance",
    "load_test_data",
    "load_train_data",
    "macro_f1",
    "paired_wilcoxon_test",
    "predict_users",
    "preview",
    "require_single_user_sessions",
    "run_experiment",
    "session_sensor_features",
    "signed_rank_test",
    "stratified_splits",
    "summarize_model_scores",
    "train_final_random_forest",
    "tune_random_forest",
    "validation_report",
    "write_predictions",
]
