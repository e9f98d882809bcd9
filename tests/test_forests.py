"""Forests: the same trees however they are grown, bags, class weights, no depth limit."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from sensorloom.operators import blocks as blocks_of
from sensorloom.operators import forests
from sensorloom.operators.boosting import bin_edges

N, WIDTH, CLASSES = 400, 9, 3


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    y = rng.choice(CLASSES, N, p=[0.6, 0.3, 0.1])
    x = rng.normal(size=(N, WIDTH))
    x[:, 2] = 0.0
    x[:, 5] = np.round(x[:, 5])
    x[:, 1] += y
    return x, y


@pytest.fixture(scope="module")
def table(spark, sample):
    x, y = sample
    rows = [(f"s{i}", float(y[i]), x[i].tolist(), [0] if i % 5 == 0 else []) for i in range(N)]
    schema = "session_id string, label double, x array<double>, held_out array<int>"
    made = spark.createDataFrame(rows, schema).withColumn("features", array_to_vector("x"))
    return made.drop("x")


@pytest.fixture(scope="module")
def packed(table):
    return blocks_of.pack(table, N, WIDTH, CLASSES, [0])


@pytest.fixture(scope="module")
def edges(table):
    return bin_edges(table, WIDTH, 32)


def shape(forest, tree, at=0):
    """A tree as nested tuples, free of the numbers of its nodes."""
    if forest.feature[tree][at] < 0:
        return tuple(np.round(forest.shares[tree][at], 5).tolist())
    return (
        int(forest.feature[tree][at]),
        float(forest.edge[tree][at]),
        shape(forest, tree, forest.left[tree][at]),
        shape(forest, tree, forest.right[tree][at]),
    )


@pytest.mark.parametrize(
    "settings",
    [
        dict(n_trees=6, seed=1),
        dict(n_trees=5, seed=2, balanced=True, split=0),
        dict(n_trees=4, seed=3, depth=4, least_rows=5, balanced=True),
    ],
)
def test_the_same_trees_however_grown(spark, packed, edges, settings, monkeypatch):
    monkeypatch.setattr(forests, "NODES_PER_PASS", 7)
    sent = forests.fit_forest(packed, edges, **settings)
    parts = packed.rdd.collect()
    x, y, keys, held = (
        np.concatenate([p.x for p in parts]), np.concatenate([p.labels for p in parts]),
        np.concatenate([p.keys for p in parts]), np.concatenate([p.held for p in parts], axis=1),
    )
    spread = spark.sparkContext.parallelize(
        [
            blocks_of.Block(str(i), keys[p], y[p], x[p], held[:, p])
            for i, p in enumerate(slice(i, i + 61) for i in range(0, N, 61))
        ],
        3,
    )
    scattered = blocks_of.Blocks(spread, N, WIDTH, CLASSES, [0])
    for local_rows in (0, 40):
        grown = forests.fit_forest(
            scattered, edges, **settings, broadcast_bytes=0, local_rows=local_rows
        )
        for tree in range(settings["n_trees"]):
            assert shape(grown, tree) == shape(sent, tree)
        assert (grown.margins(x) == sent.margins(x)).all()


def test_leaves_are_pure_without_limits(packed, edges, sample):
    forest = forests.fit_forest(packed, edges, 20, seed=4, max_features="all")
    x, y = sample
    for tree in range(20):
        leaves = forest.feature[tree] < 0
        # Rows that share all bins may differ in class; here none do.
        assert (forest.shares[tree][leaves].max(1) > 0.999).all()
    assert (forest.margins(x).argmax(1) == y).mean() > 0.97


def test_limits_hold(packed, edges):
    deep = forests.fit_forest(packed, edges, 5, seed=5)
    flat = forests.fit_forest(packed, edges, 5, seed=5, depth=3)
    assert max(flat.depths()) == 3 < max(deep.depths())
    coarse = forests.fit_forest(packed, edges, 5, seed=5, least_rows=60)
    assert all((f >= 0).sum() <= N / 60 for f in coarse.feature)


def test_a_tree_deeper_than_thirty(spark):
    """Classes alternate along one feature, so that good cuts are near the ends."""
    n = 1000
    rows = [(f"s{i}", float(i % 2), [float(i)], []) for i in range(n)]
    schema = "session_id string, label double, x array<double>, held_out array<int>"
    made = spark.createDataFrame(rows, schema).withColumn("features", array_to_vector("x"))
    edges = [np.arange(n - 1, dtype=float)]
    packed = blocks_of.pack(made.drop("x"), n, 1, 2, [])
    # Of equal cuts the lowest wins, so a comb grows.
    forest = forests.fit_forest(packed, edges, 3, seed=1)
    assert max(forest.depths()) > 30
    limited = forests.fit_forest(packed, edges, 3, seed=1, depth=30)
    assert max(limited.depths()) == 30


def test_bags_are_poisson_and_keyed():
    keys = np.random.default_rng(8).integers(0, 2**63, 50_000).astype(np.uint64)
    times = forests.bag(keys, forests.mixed(1, 7))
    shares = np.bincount(times, minlength=5)[:5] / len(keys)
    assert shares == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613, 0.0153], abs=0.01)
    assert (forests.bag(keys[::-1], forests.mixed(1, 7)) == times[::-1]).all()
    other = forests.bag(keys, forests.mixed(1, 8))
    assert abs(np.corrcoef(times, other)[0, 1]) < 0.02


def test_class_weights_of_each_bag(packed, edges):
    """The root's shares under balanced weights are even, whatever the bag drew."""
    balanced = forests.fit_forest(packed, edges, 8, seed=6, balanced=True)
    plain = forests.fit_forest(packed, edges, 8, seed=6)
    for tree in range(8):
        assert balanced.shares[tree][0] == pytest.approx([1 / 3] * 3, abs=1e-6)
    drawn = np.array([plain.shares[tree][0] for tree in range(8)])
    assert drawn.std(0).min() > 0 and drawn.mean(0) == pytest.approx([0.6, 0.3, 0.1], abs=0.08)
    params = forests.GrowParams(None, 1, 1, 2, 3, True, np.array([0]))
    assert params.weights(np.array([6.0, 0.0, 3.0])) == pytest.approx([0.5, 0.0, 1.0])


def test_nothing_varies(spark):
    rows = [(f"s{i}", float(i % 3 == 0), [1.0, 2.0], []) for i in range(30)]
    schema = "session_id string, label double, x array<double>, held_out array<int>"
    made = spark.createDataFrame(rows, schema).withColumn("features", array_to_vector("x"))
    packed = blocks_of.pack(made.drop("x"), 30, 2, 2, [])
    forest = forests.fit_forest(packed, bin_edges(made, 2, 8), 5)
    assert {r["prediction"] for r in forest.transform(made.drop("x")).collect()} == {0.0}
    spread = forests.fit_forest(packed, bin_edges(made, 2, 8), 5, broadcast_bytes=0)
    assert spread.depths() == [0] * 5


def test_rows_that_soon_are_pure_are_not_sent(spark, monkeypatch):
    """A table whose classes part at the root: counts alone grow the trees, whatever a task may hold."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 4)) + 10.0 * (np.arange(6000) % 2)[:, None]
    edges = [np.quantile(x[:, f], np.arange(1, 32) / 32) for f in range(4)]
    parts = [
        blocks_of.Block(
            str(i), np.arange(i, 6000, 6).astype(np.uint64) << np.uint64(20),
            (np.arange(i, 6000, 6) % 2).astype("<i4"), x[i::6], np.zeros((0, 1000), bool),
        )
        for i in range(6)
    ]
    packed = blocks_of.Blocks(spark.sparkContext.parallelize(parts, 2), 6000, 4, 2, [])
    here = forests.fit_forest(packed, edges, 5, seed=1)
    sent = []
    finish = forests._Top._finish
    monkeypatch.setattr(
        forests._Top, "_finish", lambda top, nodes: (sent.extend(nodes), finish(top, nodes))
    )
    spread = forests.fit_forest(packed, edges, 5, seed=1, broadcast_bytes=0)
    assert sum(node.n_rows for node in sent) < 6000
    for tree in range(5):
        assert shape(spread, tree) == shape(here, tree)


def test_counts_travel_in_few_bytes():
    assert forests.narrow(np.array([3, 200])).dtype == np.uint8
    assert forests.added(np.array([200], np.uint8), np.array([100], np.uint8)).tolist() == [300]


def test_nodes_look_at_columns_and_copy_no_rows():
    rng = np.random.default_rng(8)
    n, width = 500, 12
    bins = rng.integers(0, 6, (n, width)).astype(np.uint8)
    labels, times = rng.integers(0, 3, n), rng.poisson(1.0, n)
    p = forests.GrowParams(None, 1, 4, 6, 3, False, np.arange(width))
    rows, some = np.flatnonzero(times)[::2], np.array([7, 0, 3])
    plain = forests.counts_of(bins[rows[:, None], some], labels[rows], times[rows], p)
    assert (forests.counts_at(bins, rows, some, labels, times, p) == plain).all()
    # Rows that are not in the bag change nothing, whatever the order of memory.
    kept = np.flatnonzero(times)
    whole = forests.grow_locally(np.asfortranarray(bins), labels, times, 9, 0, np.ones(3), p)
    part = forests.grow_locally(bins[kept], labels[kept], times[kept], 9, 0, np.ones(3), p)
    assert (whole.feature, whole.bin, whole.left) == (part.feature, part.bin, part.left)


def test_limits_leave_a_part_of_the_same_trees(packed, edges):
    deep = forests.fit_forest(packed, edges, 6, seed=5, balanced=True)
    for n_trees, depth in ((6, 3), (4, None), (2, 1)):
        grown = forests.fit_forest(packed, edges, n_trees, depth, seed=5, balanced=True)
        left = forests.limited(deep, n_trees, depth)
        assert left.depths() == grown.depths()
        assert [shape(left, t) for t in range(n_trees)] == [shape(grown, t) for t in range(n_trees)]


def test_features_that_do_not_vary_take_no_bytes(packed, edges, monkeypatch):
    """The size that decides the plan is that of the features that trees can cut."""
    monkeypatch.setattr(forests, "_Top", None)
    padded = blocks_of.Blocks(
        packed.rdd.map(
            lambda b: b._replace(x=np.hstack([b.x, np.ones((len(b.x), 90))]))
        ),
        N, WIDTH + 90, CLASSES, [0],
    )
    more = edges + [np.zeros(0)] * 90
    forest = forests.fit_forest(padded, more, 3, seed=1, broadcast_bytes=N * WIDTH)
    assert max(f.max() for f in forest.feature) < WIDTH
