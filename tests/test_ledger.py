"""Finished fits are read, failed ones fitted again."""

import numpy as np
import pytest

from sensorloom.operators import estimators as est
from sensorloom.operators import ledger as ledgers

FEATURES = ["feature_1", "feature_2"]


@pytest.fixture(scope="module")
def sessions(spark):
    rng = np.random.default_rng(2)
    rows = [
        (f"s{i}", f"u{i % 3}", float(rng.normal(3 * (i % 3), 0.3)), float(rng.normal()))
        for i in range(30)
    ]
    return spark.createDataFrame(
        rows, "session_id string, user_id string, feature_1 double, feature_2 double"
    )


@pytest.fixture(scope="module")
def holdout(sessions):
    return est.prepare_holdout(sessions, FEATURES, [0, 1, 2])


def counting(monkeypatch, fail=()):
    """Records which splits each model is asked to fit; some (model, seed) fail."""
    asked = []

    def wrap(model, fit):
        def fits(data, seeds, settings):
            asked.extend((model, seed) for seed in seeds)
            if any((model, seed) in fail for seed in seeds):
                raise RuntimeError(f"lost while fitting {model}")
            return fit(data, seeds, settings)

        return fits

    learners = {model: wrap(model, fit) for model, fit in est.LEARNERS.items()}
    monkeypatch.setattr(est, "LEARNERS", learners)
    return asked


def test_one_failure_loses_one_fit(spark, holdout, tmp_path, monkeypatch):
    folder = str(tmp_path / "fits")
    models = ["Dummy_most_frequent", "LR", "RF"]
    with monkeypatch.context() as patch:
        asked = counting(patch, fail={("RF", 1)})
        with pytest.raises(ledgers.FitsFailed, match="RF, seed 1") as failed:
            est.compare_predictions(holdout, est.LIGHT, models, ledgers.Ledger(spark, folder))
        assert len(failed.value.failures) == 1
        assert sorted(asked) == [("LR", 0), ("LR", 1), ("LR", 2), ("RF", 0), ("RF", 1), ("RF", 2)]
    with monkeypatch.context() as patch:
        asked = counting(patch)
        again = est.compare_predictions(holdout, est.LIGHT, models, ledgers.Ledger(spark, folder))
        assert asked == [("RF", 1)]
    fresh = est.compare_predictions(holdout, est.LIGHT, models)
    assert sorted(again.collect()) == sorted(fresh.collect())
    assert again.groupBy("model", "seed").count().count() == 9


def test_more_seeds_fit_the_new_ones_only(spark, sessions, holdout, tmp_path, monkeypatch):
    folder = str(tmp_path / "fits")
    est.compare_predictions(holdout, est.LIGHT, ["SVM"], ledgers.Ledger(spark, folder))
    # The holdout flags are part of the data, so other seeds are other data.
    asked = counting(monkeypatch)
    est.compare_predictions(holdout, est.LIGHT, ["SVM", "GBT"], ledgers.Ledger(spark, folder))
    assert {m for m, _ in asked} == {"GBT"}


def test_what_a_fit_depends_on(spark, holdout, sessions):
    rows = ledgers.fingerprint(sessions)
    assert rows == ledgers.fingerprint(sessions.repartition(5))
    assert rows != ledgers.fingerprint(sessions.where("session_id <> 's3'"))
    assert rows != ledgers.fingerprint(sessions.withColumnRenamed("feature_1", "other"))
    assert ledgers.fingerprint(sessions.limit(0)) != rows
    assert est.settings_of("LR", est.FitSettings()) == {
        "linear_penalty": 1.0, "logistic_iterations": 3000,
    }
    assert "boost_rounds" in est.settings_of("GBT", est.FitSettings())
    assert "parallel_fits" not in est.settings_of("RF", est.FitSettings())
    full, light = (est.settings_of("RF", s) for s in (est.FitSettings(), est.LIGHT))
    assert ledgers.digest("RF", full) != ledgers.digest("RF", light)


def test_an_uncommitted_table_does_not_count(spark, tmp_path):
    ledger = ledgers.Ledger(spark, str(tmp_path))
    fit = ledgers.Fit("one", "key")
    made = []

    def job(missing):
        made.append(missing)
        return {fit: spark.range(3)}

    ledger.run([([fit], job)], 1, "id bigint")
    (tmp_path / "key" / "_SUCCESS").unlink()
    found = ledger.run([([fit], job)], 1, "id bigint")
    assert len(made) == 2 and found.count() == 3
    assert ledger.run([([fit], job)], 1, "id bigint").count() == 3 and len(made) == 2


def test_grid_points_resume(spark, holdout, tmp_path, monkeypatch):
    ledger = ledgers.Ledger(spark, str(tmp_path / "grid"))
    first = sorted(est.grid_scores(holdout, est.LIGHT, ledger).collect())

    def broken(*args):
        raise AssertionError("fitted again")

    monkeypatch.setattr(est, "forest", broken)
    assert sorted(est.grid_scores(holdout, est.LIGHT, ledger).collect()) == first


def test_grid_points_that_differ_in_limits_share_their_trees(holdout, monkeypatch):
    fit, sizes = est.fit_forest, []
    monkeypatch.setattr(est, "fit_forest", lambda *a: sizes.append(a[2:4]) or fit(*a))
    points = [est.ForestParams(3, 2), est.ForestParams(6, None), est.ForestParams(5, 4, "sqrt", 3)]
    shared = est.grid_forests(holdout, points, holdout.seeds[0], est.LIGHT)
    assert sizes == [(6, None), (5, 4)]
    x = np.concatenate([b.x for b in holdout.blocks(holdout.seeds).rdd.collect()])
    for params, forest in zip(points, shared):
        alone = est.forest(holdout, params, holdout.seeds[0], est.LIGHT, True)
        assert (alone.margins(x) == forest.margins(x)).all()
