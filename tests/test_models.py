import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sensorloom.operators import estimators as est
from sensorloom.operators.scoring import macro_f1, summarize_model_scores
from sensorloom.operators.splits import assemble

FEATURES = ["feature_1", "feature_2", "feature_3"]


@pytest.fixture(scope="module")
def rings(spark):
    """Three walkers told apart by the length of a vector whose direction is random."""
    rng = np.random.default_rng(20)
    rows = []
    for i in range(36):
        direction = rng.normal(size=3)
        length = 1.0 + 2 * (i % 3) + rng.uniform(-0.4, 0.4)
        rows.append((f"r{i}", f"walker {i % 3}", *map(float, length * np.abs(direction) / np.linalg.norm(direction))))
    columns = ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, f"session_id string, user_id string, {columns}")


def test_final_forest_knows_its_training_sessions(rings):
    model = est.train_final_random_forest(
        rings, FEATURES, est.ForestParams(n_estimators=60), random_state=9
    )
    predicted = est.predict_users(model, rings, FEATURES)
    assert predicted.columns == ["session_id", "user_id"]
    truth = {r["session_id"]: r["user_id"] for r in rings.collect()}
    found = {r["session_id"]: r["user_id"] for r in predicted.collect()}
    assert found.keys() == truth.keys() and set(found.values()) <= set(truth.values())
    assert sum(found[s] == truth[s] for s in truth) >= 34


def test_defaults_are_the_full_protocol():
    settings = est.FitSettings()
    assert len(settings.grid) == 6
    assert settings.grid[2] == est.ForestParams(500, 20, "sqrt", 1)
    assert settings.forest == est.ForestParams(500, None, "sqrt", 1)
    boost = (settings.boost_rounds, settings.boost_depth, settings.boost_rate)
    shares = (settings.boost_row_share, settings.boost_column_share, settings.boost_penalty)
    assert boost + shares == (400, 6, 0.05, 0.9, 0.9, 1.0)
    linear = (settings.linear_penalty, settings.logistic_iterations, settings.svm_iterations)
    assert linear == (1.0, 3000, 1000)
    assert est.MODELS == ["Dummy_most_frequent", "Dummy_stratified", "LR", "SVM", "RF", "GBT"]


def test_scaler_centres_and_flattens_constants(spark):
    rows = [("a", 1.0, 7.0), ("b", 2.0, 7.0), ("c", 6.0, 7.0)]
    table = spark.createDataFrame(rows, "session_id string, x double, y double")
    df = assemble(table, ["x", "y"], [])
    scaled = est.standard_scaler().fit(df).transform(df)
    values = [r["v"] for r in scaled.select(vector_to_array("scaled").alias("v")).collect()]
    assert [v[1] for v in values] == [0.0, 0.0, 0.0]
    std = math.sqrt(((1 - 3) ** 2 + (2 - 3) ** 2 + (6 - 3) ** 2) / 2)
    assert [v[0] for v in values] == pytest.approx([-2 / std, -1 / std, 3 / std])
    stats = {r["feature"]: r for r in est.scaler_statistics(df, ["x", "y"]).collect()}
    assert stats["x"]["mean"] == pytest.approx(3.0) and stats["x"]["std"] == pytest.approx(std)


@pytest.fixture(scope="module")
def four_groups(spark):
    """Forty sessions of four users, two informative features and one noise column."""
    rng = np.random.default_rng(7)
    rows = [
        (
            f"s{i}",
            f"u{i % 4}",
            float(rng.normal(3 * (i % 4), 0.3)),
            float(rng.normal(2 * (i % 2), 0.3)),
            float(rng.normal()),
        )
        for i in range(40)
    ]
    columns = ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, f"session_id string, user_id string, {columns}")


@pytest.fixture(scope="module")
def holdout(four_groups):
    return est.prepare_holdout(four_groups, FEATURES, [0, 1])


def test_holdout_tables(holdout):
    assert holdout.n_train == 32 and holdout.n_classes == 4
    for seed in (0, 1):
        assert holdout.train(seed).count() == 32
        assert holdout.valid(seed).count() == 8
        both = holdout.train(seed).join(holdout.valid(seed), "session_id")
        assert both.isEmpty()


def test_nothing_to_fit_is_an_error(holdout):
    with pytest.raises(ValueError, match="no model"):
        est.compare_predictions(holdout, est.LIGHT, models=[])


def test_comparison(holdout):
    predictions = est.compare_predictions(holdout, est.LIGHT)
    counts = predictions.groupBy("model", "seed").count().collect()
    assert len(counts) == 12 and {r["count"] for r in counts} == {8}
    means = {
        r["model"]: r["mean_macro_f1"]
        for r in summarize_model_scores(macro_f1(predictions)).collect()
    }
    assert means["Dummy_most_frequent"] == pytest.approx(0.1)
    best_dummy = max(means["Dummy_most_frequent"], means["Dummy_stratified"])
    for model in ("LR", "SVM", "RF", "GBT"):
        assert means[model] >= 0.8 > best_dummy, model


def test_comparison_of_some_models(four_groups):
    scores = est.compare_models_repeated(
        four_groups, FEATURES, [5], settings=est.LIGHT, models=["RF", "Dummy_stratified"]
    )
    found = {(r["model"], r["seed"]) for r in scores.collect()}
    assert found == {("RF", 5), ("Dummy_stratified", 5)}


def test_tuning(holdout):
    best, results = est.tune_on(holdout, est.LIGHT)
    rows = results.collect()
    assert [r["rank"] for r in rows] == [1, 2, 3]
    assert best == est.LIGHT.grid[rows[0]["grid_id"]]
    assert rows[0]["params"]["n_estimators"] == best.n_estimators
    assert all(len(r["scores"]) == 2 for r in rows)
    assert rows[0]["mean"] == max(r["mean"] for r in rows) >= 0.8
