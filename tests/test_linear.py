"""The linear fits against plain numpy: objective, gradient and all splits at once."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sensorloom.operators import blocks as blocks_of
from sensorloom.operators import linear

N, WIDTH, CLASSES = 240, 7, 3


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    y = rng.integers(0, CLASSES, N)
    x = rng.normal(size=(N, WIDTH)) * [1, 1, 10, 0.1, 1, 100, 0] + [0, 5, -40, 1, 0, 1e6, 3]
    x[:, 0] += 1.5 * y
    x[:, 2] -= 8.0 * (y == 1)
    held = rng.random((2, N)) < 0.2
    return x, y, held


@pytest.fixture(scope="module")
def packed(spark, sample):
    x, y, held = sample
    rows = [
        (f"s{i}", float(y[i]), x[i].tolist(), [s for s in (0, 1) if held[s, i]]) for i in range(N)
    ]
    schema = "session_id string, label double, x array<double>, held_out array<int>"
    table = spark.createDataFrame(rows, schema).withColumn("features", array_to_vector("x"))
    return blocks_of.pack(table.drop("x"), N, WIDTH, CLASSES, [0, 1])


def scaled(x):
    std = x.std(0)
    return (x - x.mean(0)) / np.where(std > 0, std, 1.0)


def scaled_weights(model, x):
    """Weights and intercepts for scaled inputs."""
    return model.weights * x.std(0)[:, None], model.offsets + x.mean(0) @ model.weights


def test_blocks_hold_every_row_once(packed, sample):
    x, y, held = sample
    found = packed.rdd.collect()
    assert sum(len(b.labels) for b in found) == N
    got = sorted((tuple(r), int(k), tuple(h)) for b in found for r, k, h in zip(b.x, b.labels, b.held.T))
    assert got == sorted((tuple(r), int(k), tuple(h)) for r, k, h in zip(x, y, held.T))


def test_sums_over_many_partitions(spark):
    numbers = spark.sparkContext.parallelize(range(1000), 200).map(lambda i: np.array([i, 1]))
    assert blocks_of.summed(numbers, lambda v: v * 2).tolist() == [999_000, 2000]
    assert blocks_of.summed(numbers.filter(lambda v: False), lambda v: v) is None


def test_logistic_regression_solves_the_penalised_objective(packed, sample):
    x, y, held = sample
    for s, model in enumerate(linear.fit_logistic(packed, penalty=0.7)):
        train = ~held[s]
        xt, yt = x[train], y[train]
        w, b = scaled_weights(model, xt)
        z = scaled(xt) @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        r = p - np.eye(CLASSES)[yt]
        assert np.abs(0.7 * scaled(xt).T @ r + w).max() < 1e-3
        assert np.abs(r.sum(0)).max() < 1e-3
        # The constant column has no say.
        assert (model.weights[6] == 0).all()


@pytest.mark.parametrize("newton", [True, False])
def test_svm_solves_the_squared_hinge_objective(packed, sample, newton, monkeypatch):
    if not newton:
        monkeypatch.setattr(linear, "NEWTON_FEATURES", 0)
    x, y, held = sample
    for s, model in enumerate(linear.fit_svm(packed, penalty=0.5)):
        train = ~held[s]
        xt = scaled(x[train])
        w, b = scaled_weights(model, x[train])
        sign = np.where(y[train][:, None] == np.arange(CLASSES), 1.0, -1.0)
        short = np.maximum(0, 1 - sign * (xt @ w + b))
        gradient = -2 * 0.5 * xt.T @ (sign * short) + w
        assert np.abs(gradient).max() < 1e-3
        assert np.abs(-2 * 0.5 * (sign * short).sum(0) + b).max() < 1e-3


def test_both_solvers_find_the_same_minimum(packed, monkeypatch):
    newton = linear.fit_svm(packed, tolerance=1e-8)
    monkeypatch.setattr(linear, "NEWTON_FEATURES", 0)
    for a, b in zip(newton, linear.fit_svm(packed, tolerance=1e-8)):
        assert a.weights == pytest.approx(b.weights, abs=1e-4)


def test_splits_do_not_touch_each_other(spark, packed, sample):
    """Each split's model is the one it gets alone."""
    together = linear.fit_logistic(packed)
    x, y, held = sample
    alone = packed.rdd.map(lambda b: b._replace(held=b.held[1:])).persist()
    one = linear.fit_logistic(blocks_of.Blocks(alone, N, WIDTH, CLASSES, [1]))
    assert one[0].weights == pytest.approx(together[1].weights, abs=1e-4)


def test_predictions_keep_the_other_columns(spark, packed, sample):
    x, y, _ = sample
    model = linear.fit_svm(packed)[0]
    rows = [(i, x[i].tolist(), "p") for i in range(50)]
    table = spark.createDataFrame(rows, "i int, x array<double>, c0 string")
    table = table.withColumn("features", array_to_vector("x")).drop("x")
    found = model.transform(table)
    assert found.columns == ["i", "c0", "prediction"]
    got = {r["i"]: r["prediction"] for r in found.collect()}
    assert got == {i: float(k) for i, k in enumerate(model.margins(x[:50]).argmax(1))}
    assert found.where(F.col("c0") != "p").isEmpty()
    assert model.transform(table.limit(0)).isEmpty()
