import pytest
from catalog import views
from pyspark.sql import functions as F

from sensorloom.operators.estimators import LIGHT
from sensorloom.plans.experiment import run_experiment
from sensorloom.sources.events import write_events


@pytest.fixture(scope="module")
def config(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("experiment")
    events = views.learnable_events(views.sensor_events(spark, sf_dir))
    write_events(views.train_part(events), str(root / "train"))
    write_events(views.test_part(events), str(root / "test"))
    return {
        "project": {"name": "test"},
        "data": {"train_path": str(root / "train"), "test_path": str(root / "test")},
        "evaluation": {"n_seeds": 2},
        "model": {"random_state": 42},
        "output": {
            "submission_path": str(root / "out" / "submission"),
            "model_comparison_path": str(root / "out" / "chart"),
        },
    }


def test_run_experiment(spark, config):
    result = run_experiment(config, spark, LIGHT)
    assert result["n_features"] == 5 * 57
    assert (result["train_sessions"], result["test_sessions"]) == (60, 15)
    assert result["imbalance_ratio"].first()[0] == pytest.approx(16 / 12)
    assert result["mixed_user_sessions"].isEmpty()

    summary = result["model_summary"].collect()
    assert len(summary) == 6 and summary[0]["mean_macro_f1"] > 0.9
    comparison = result["rf_xgb_comparison"].first()
    assert (comparison["model_a"], comparison["model_b"]) == ("RF", "GBT")
    assert result["best_parameters"] in LIGHT.grid
    assert result["tuning_results"].count() == 3
    assert result["figure"].count() == 6

    written = spark.read.csv(config["output"]["submission_path"], header=True)
    assert written.columns == ["session_id", "user_id"]
    assert sorted(written.collect()) == sorted(result["submission"].collect())
    # The session id still tells the original user, hence the right class.
    right = written.where(F.split("session_id", "-")[0].cast("int") % 4 == F.col("user_id"))
    # The test side lacks a sensor the forest was trained with.
    assert right.count() >= 12
    chart = spark.read.csv(config["output"]["model_comparison_path"], header=True)
    assert chart.count() == 6


def test_gate_stops_the_run(spark, sf_dir, config, tmp_path):
    events = views.mixed_events(views.train_part(views.sensor_events(spark, sf_dir)))
    write_events(events, str(tmp_path / "mixed"))
    data = {**config["data"], "train_path": str(tmp_path / "mixed")}
    with pytest.raises(ValueError, match="several users"):
        run_experiment({**config, "data": data}, spark, LIGHT)


def test_unlabelled_training_events_stop_the_run(spark, sf_dir, config, tmp_path):
    events = views.train_part(views.sensor_events(spark, sf_dir))
    nobody = F.when(F.col("session_id") != "3-1", F.col("user_id"))
    write_events(events.withColumn("user_id", nobody), str(tmp_path / "nobody"))
    data = {**config["data"], "train_path": str(tmp_path / "nobody")}
    with pytest.raises(ValueError, match="unlabelled events"):
        run_experiment({**config, "data": data}, spark, LIGHT)
