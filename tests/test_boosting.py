"""Boosted trees against a plain booster, and the same model from every layout of the rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from sensorloom.operators import blocks as blocks_of
from sensorloom.operators import boosting

N, WIDTH, CLASSES = 180, 6, 3


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    y = rng.integers(0, CLASSES, N)
    x = rng.normal(size=(N, WIDTH))
    x[:, 1] = np.round(x[:, 1])
    x[:, 4] = 2.5
    x[:, 0] += y * 0.8
    x[:, 3] = np.where(y == 2, np.abs(x[:, 3]), x[:, 3])
    held = rng.random((2, N)) < 0.2
    return x, y, held


@pytest.fixture(scope="module")
def table(spark, sample):
    x, y, held = sample
    rows = [
        (f"s{i}", float(y[i]), x[i].tolist(), [s for s in (3, 8) if held[(3, 8).index(s), i]])
        for i in range(N)
    ]
    schema = "session_id string, label double, x array<double>, held_out array<int>"
    made = spark.createDataFrame(rows, schema).withColumn("features", array_to_vector("x"))
    return made.drop("x")


@pytest.fixture(scope="module")
def packed(table):
    return blocks_of.pack(table, N, WIDTH, CLASSES, [3, 8])


def row_order(packed):
    """Features, labels, keys and held-out flags of all rows, in one order."""
    parts = packed.rdd.collect()
    return (
        np.concatenate([p.x for p in parts]),
        np.concatenate([p.labels for p in parts]),
        np.concatenate([p.keys for p in parts]),
        np.concatenate([p.held for p in parts], axis=1),
    )


def plain_booster(x, y, keys, train, seed, edges, params):
    """Margins after all rounds, by a recursive booster that looks at each cut in turn."""
    margins = np.zeros((len(x), CLASSES))
    bins = boosting.to_bins(x, edges)
    for round_ in range(params.rounds):
        p = np.exp(margins - margins.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = p - np.eye(CLASSES)[y]
        h = 2 * p * (1 - p)
        used = train & boosting.chosen(keys, seed, round_, params.row_share)
        for k in range(CLASSES):
            rng = np.random.default_rng([seed, round_, k])
            n_columns = max(1, int(params.column_share * x.shape[1]))
            columns = sorted(rng.permutation(x.shape[1])[:n_columns])

            def leaf(rows):
                return -params.rate * g[rows, k].sum() / (h[rows, k].sum() + params.penalty)

            def score(rows):
                return g[rows, k].sum() ** 2 / (h[rows, k].sum() + params.penalty)

            def grow(inside, depth):
                rows = inside & used
                best = (boosting.LEAST_GAIN, None)
                if depth < params.depth:
                    for f in columns:
                        for cut in range(len(edges[f])):
                            left, right = rows & (bins[:, f] <= cut), rows & (bins[:, f] > cut)
                            if min(h[left, k].sum(), h[right, k].sum()) < params.least_hessian:
                                continue
                            gain = score(left) + score(right) - score(rows)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, cut))
                if best[1] is None:
                    margins[inside, k] += leaf(rows)
                    return
                f, cut = best[1]
                grow(inside & (bins[:, f] <= cut), depth + 1)
                grow(inside & (bins[:, f] > cut), depth + 1)

            grow(np.ones(len(x), bool), 0)
    return margins


PARAMS = boosting.BoostParams(rounds=6, depth=4, rate=0.3)


def test_bins_are_quantiles(table, sample):
    edges = boosting.bin_edges(table, WIDTH, 16)
    x = sample[0]
    assert len(edges[4]) == 0 and 10 <= len(edges[0]) <= 15
    assert set(edges[1]) <= set(x[:, 1])
    counts = np.bincount(boosting.to_bins(x, edges)[:, 0], minlength=16)
    assert counts.max() <= N / 16 + 2 and counts.min() >= N / 16 - 2


def test_equal_to_a_plain_booster(table, packed):
    edges = boosting.bin_edges(table, WIDTH, 16)
    x, y, keys, held = row_order(packed)
    models = boosting.fit_boosted_trees(packed, edges, PARAMS)
    assert [m.seed for m in models] == [3, 8]
    for s, model in enumerate(models):
        assert model.n_rounds == PARAMS.rounds
        expected = plain_booster(x, y, keys, ~held[s], model.seed, edges, PARAMS)
        assert model.margins(x) == pytest.approx(expected, abs=1e-6)


def test_the_same_model_from_every_layout(spark, table, packed, monkeypatch):
    edges = boosting.bin_edges(table, WIDTH, 16)
    monkeypatch.setattr(boosting, "REBASE_ROUNDS", 2)
    monkeypatch.setattr(boosting, "STEPS_PER_BROADCAST", 3)
    here = boosting.fit_boosted_trees(packed, edges, PARAMS)
    x, y, keys, held = row_order(packed)
    pieces = [slice(i, i + 23) for i in range(0, N, 23)]
    spread = spark.sparkContext.parallelize(
        [
            blocks_of.Block(str(i), keys[p], y[p], x[p], held[:, p])
            for i, p in enumerate(reversed(pieces))
        ],
        4,
    )
    scattered = blocks_of.Blocks(spread, N, WIDTH, CLASSES, [3, 8])
    everywhere = boosting.fit_boosted_trees(scattered, edges, PARAMS, local_bytes=0)
    for a, b in zip(here, everywhere):
        assert (a.feature == b.feature).all() and (a.edge == b.edge).all()
        assert (a.values == b.values).all()


def test_lost_states_are_replayed(table, packed, sample):
    """A worker that has nothing kept comes to the same sums."""
    edges = boosting.bin_edges(table, WIDTH, 16)
    block = boosting.binned(packed, edges).first()
    n_bins = max(map(len, edges)) + 1
    steps = [
        boosting.Split(np.array([0, 1]), np.array([0, 0]), np.array([0, 1]), np.array([5, 1])),
        boosting.Values(np.arange(42.0).reshape(6, 7) / 100),
        boosting.Split(np.array([2]), np.array([0]), np.array([3]), np.array([4])),
    ]
    states = [boosting.state_of(block, "t", steps[:n], n_bins, [3, 8], 0.9) for n in (0, 1, 2, 3)]
    assert all(state is states[0] for state in states)
    fresh = boosting.state_of(block, "other", steps, n_bins, [3, 8], 0.9)
    assert fresh is not states[0]
    wanted = (np.array([0, 2, 2]), np.array([0, 1, 2]))
    assert (fresh.histograms(*wanted) == states[0].histograms(*wanted)).all()
    # A task that runs again asks for an earlier state.
    earlier = boosting.state_of(block, "t", steps[:1], n_bins, [3, 8], 0.9)
    assert earlier.done == 1 and earlier.round == 0


def test_nothing_varies(spark):
    rows = [(f"s{i}", float(i % 3 == 0), [1.0, 2.0], []) for i in range(30)]
    schema = "session_id string, label double, x array<double>, held_out array<int>"
    made = spark.createDataFrame(rows, schema).withColumn("features", array_to_vector("x"))
    packed = blocks_of.pack(made.drop("x"), 30, 2, 2, [0])
    edges = boosting.bin_edges(made, 2, 8)
    [model] = boosting.fit_boosted_trees(packed, edges, boosting.BoostParams(rounds=3))
    assert {r["prediction"] for r in model.transform(made.drop("x")).collect()} == {0.0}


def test_draws_are_shares_and_independent_of_layout():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    first, second = (boosting.chosen(keys, 4, r, 0.9) for r in (0, 1))
    assert abs(first.mean() - 0.9) < 0.01 and abs((first & second).mean() - 0.81) < 0.01
    assert (boosting.chosen(keys[::-1], 4, 0, 0.9) == first[::-1]).all()


@pytest.mark.parametrize("n_bins, width", [(7, 5), (7, 4), (100, 3)])
def test_one_pass_over_the_rows_counts_two_features(monkeypatch, n_bins, width):
    rng = np.random.default_rng(5)
    n = 300
    bins = rng.integers(0, n_bins, (n, width)).astype(np.uint8)
    block = boosting.BinnedBlock(
        "b", rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2, n), bins,
        rng.random((1, n)) < 0.2, rng.normal(size=(1, n, 2)), 0,
    )
    state = boosting.State(block, n_bins, [4], 0.8)
    state.node[0, 1] = rng.integers(1, 4, n)
    passes = []
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a: passes.append(1) or count(*a))
    sums = state.histograms(np.array([0, 1, 1]), np.array([0, 3, 1]))
    monkeypatch.undo()
    for at, (k, node) in enumerate([(0, 0), (1, 3), (1, 1)]):
        rows = state.members[0][state.node[0, k][state.members[0]] == node]
        for i, values in enumerate((state.gradients, state.hessians)):
            for f in range(width):
                plain = np.bincount(bins[rows, f], values[0, k][rows], n_bins)
                assert (sums[at, i, f] == plain).all()
    # Gradients and Hessians of two trees.
    assert len(passes) == 4 * (-(-width // 2) if n_bins == 7 else width)


def test_small_blocks_are_gathered_without_the_rows_held_out(spark, table, packed):
    """A pass costs a block some milliseconds whatever its rows, so a partition has one."""
    edges = boosting.bin_edges(table, WIDTH, 16)
    x, y, keys, held = row_order(packed)
    pieces = [
        blocks_of.Block(str(i), keys[i::30], y[i::30], x[i::30], held[:1, i::30]) for i in range(30)
    ]
    many = blocks_of.Blocks(spark.sparkContext.parallelize(pieces, 15), N, WIDTH, CLASSES, [3])
    found = boosting.gathered(many, edges, 16).glom().map(len).collect()
    assert sum(found) <= spark.sparkContext.defaultParallelism and max(found) == 1
    rows = boosting.gathered(many, edges, 16).map(lambda b: len(b.labels)).sum()
    assert rows == N - held[0].sum()


@pytest.mark.parametrize("n_bins", [7, 100])
def test_cells_tell_bins(n_bins):
    bins = np.random.default_rng(6).integers(0, n_bins, (400, 5)).astype(np.uint8)
    cells, rows = boosting.paired(bins, n_bins), np.arange(0, 400, 3)
    for f in range(5):
        for limit in (0, 3, n_bins - 2):
            assert (cells.above(f, limit, rows) == (bins[rows, f] > limit)).all()


def test_features_with_few_bins_share_a_pass(table, packed, monkeypatch):
    """Groups by the bins that features have: fewer columns than pairs, and the same model."""
    edges = boosting.bin_edges(table, WIDTH, 16)
    plain = boosting.fit_boosted_trees(packed, edges, PARAMS)
    monkeypatch.setattr(boosting, "GROUP_ROWS", 1)
    bins = np.random.default_rng(2).integers(0, 5, (50, 6)).astype(np.uint8)
    cells = boosting.grouped(bins, [np.arange(4.0)] * 6, 17)
    assert len(cells.columns) == 2 < len(boosting.paired(bins, 17).columns)
    for f in range(6):
        for limit in range(4):
            assert (cells.above(f, limit, np.arange(50)) == (bins[:, f] > limit)).all()
    # In this process, as tasks have a module of their own.
    n_features, n_classes = packed.n_features, packed.n_classes
    for s, model in enumerate(plain):
        whole = boosting.binned(packed, edges).collect()
        one = boosting.joined(whole)
        one = boosting.without_held(one._replace(held=one.held[s : s + 1], margins=one.margins[:1]))
        grower = boosting.Here(one, model.seed, n_features, n_classes, edges, PARAMS)
        assert max(map(len, grower.state.cells.groups)) > 2
        for _ in range(PARAMS.rounds):
            grower.grow()
        values = np.array([[tree.values for tree in trees] for trees in grower.rounds])
        assert (values == model.values).all()
