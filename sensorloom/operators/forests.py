"""Random forests with bootstrap bags, class weights per bag and no depth limit.

A tree sees a bag: each row as often as a Poisson draw, keyed by row and tree, says. Weights
are 1, or balanced within that very bag: rows of the bag / (classes * rows of the class in the bag).
At every node features are drawn without replacement, keyed by the node's path, as many as ``sqrt``
says and as many again as long as none of them varies there; the cut with the lowest Gini
impurity wins, the first of equals. A node is a leaf when it is pure, at the depth limit (if
there is one) or when no cut leaves both sides enough rows.

Cuts depend on counts of rows by (feature, bin, class), whole numbers, and on keyed draws. So the
trees are the same however they are grown, and that is decided by size alone:

* Tables whose bins fit into ``BROADCAST_BYTES`` are sent to all machines, and tasks grow trees.
* Larger ones stay where they are. Nodes with many rows are cut level by level: partitions count,
  an exchange by node adds the counts and finds the cut, the driver sees cuts only. The rows of a
  small node meet in one task, which grows the whole subtree. A node is small when
  sending its rows costs little more than counting it (and at ``LOCAL_ROWS`` the latest), so rows
  that soon come into pure leaves are never sent, and counts add up to no more than rows would.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from sensorloom.operators.blocks import Block, Blocks, predicted
from sensorloom.operators.boosting import to_bins

# Bytes of bins that are sent to every machine.
BROADCAST_BYTES = 64 << 20
# Rows of a bag that one task may hold.
LOCAL_ROWS = 1 << 16
# Trees that one task grows, and nodes that are counted in one pass.
TREES_PER_TASK = 8
NODES_PER_PASS = 2048
# Bytes of counts that one task holds in a pass, and bytes of one count on its way.
PASS_BYTES = 64 << 20
COUNT_BYTES = 2
# Fixed value: a sum of doubles counts 2^26 rows exactly above this bit, and their times below it.
ROW_SHIFT = 27
# Chances that a Poisson variable of mean 1 is at most 0, 1, 2, ...
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 12.0)])))

_MASK = (1 << 64) - 1


def mixed(a: int, b: int) -> int:
    """A well-spread 64-bit hash of two numbers."""
    z = (a * 0x9E3779B97F4A7C15 + b + 1) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return z ^ (z >> 31)


def bag(keys: np.ndarray, tree_key: int) -> np.ndarray:
    """How often each row stands in a tree's bag."""
    z = (keys ^ np.uint64(tree_key)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return np.searchsorted(POISSON, (z >> np.uint64(11)).astype(float) * 2.0**-53, "right")


@dataclass(frozen=True)
class GrowParams:
    """What a tree needs to know besides its rows."""

    depth: int | None
    least_rows: int
    n_drawn: int
    n_bins: int
    n_classes: int
    balanced: bool
    # Features that take more than one value at all.
    features: np.ndarray = field(repr=False)

    def drawn(self, node_key: int) -> np.ndarray:
        """The order in which a node looks at features."""
        return np.random.default_rng(node_key).permutation(self.features)

    def weights(self, bag_counts: np.ndarray) -> np.ndarray:
        """Class weights of a tree from the rows of its bag by class."""
        if not self.balanced:
            return np.ones(self.n_classes)
        with np.errstate(divide="ignore"):
            weights = bag_counts.sum() / (self.n_classes * bag_counts)
        return np.where(bag_counts > 0, weights, 0.0)


class Cut(NamedTuple):
    feature: int
    bin: int


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of counts of any two types."""
    return np.add(a, b, dtype=np.int64)


def counts_of(bins: np.ndarray, labels: np.ndarray, times: np.ndarray, p: GrowParams) -> np.ndarray:
    """Counts by (feature, bin, class), and last, by (feature, bin), of rows however often they stand
    in the bag."""
    n, width = bins.shape
    cell = (bins + np.arange(width) * p.n_bins) * p.n_classes + labels[:, None]
    size = width * p.n_bins * p.n_classes
    by_class = np.bincount(cell.ravel(), np.repeat(times, width), size)
    rows = np.bincount(cell.ravel(), minlength=size).reshape(width, p.n_bins, -1).sum(2)
    out = np.empty((width, p.n_bins, p.n_classes + 1), np.int64)
    out[..., :-1] = by_class.reshape(width, p.n_bins, p.n_classes)
    out[..., -1] = rows
    return out


def counts_at(
    bins: np.ndarray, rows: np.ndarray, some: np.ndarray, labels: np.ndarray, times: np.ndarray, p: GrowParams
) -> np.ndarray:
    """:func:`counts_of` some features of some rows, a column at a time and without copying the rows.

    One sum holds both counts: each row adds its times in the bag and ``1 << ROW_SHIFT``.
    """
    width, size = len(some), p.n_bins * p.n_classes
    label = labels[rows].astype(np.intp)
    weight = times[rows] + float(1 << ROW_SHIFT)
    out = np.empty((width, p.n_bins, p.n_classes + 1), np.int64)
    for j, f in enumerate(some):
        cell = bins[:, f].take(rows).astype(np.intp)
        cell *= p.n_classes
        cell += label
        both = np.bincount(cell, weight, size).astype(np.int64).reshape(p.n_bins, p.n_classes)
        out[j, :, :-1] = both & ((1 << ROW_SHIFT) - 1)
        out[j, :, -1] = (both >> ROW_SHIFT).sum(1)
    return out


def best_cut(counts: np.ndarray, weights: np.ndarray, features: np.ndarray, p: GrowParams) -> Cut | None:
    """The cut with the lowest impurity, or None if no feature can be cut."""
    below = np.cumsum(counts, axis=1)[:, :-1]
    rest = counts.sum(1)[:, None] - below
    possible = (below[..., -1] >= p.least_rows) & (rest[..., -1] >= p.least_rows)
    if not possible.any():
        return None
    score = np.zeros(possible.shape)
    for side in (below, rest):
        mass = side[..., :-1] * weights
        total = mass.sum(2)
        score += (mass**2).sum(2) / np.where(total > 0, total, 1.0)
    # Rounded, so that equal cuts are equal whatever the order of sums.
    score = np.where(possible, np.round(score, 9), -np.inf)
    place = int(score.argmax())
    feature, cut = divmod(place, score.shape[1])
    return Cut(int(features[feature]), cut)


class Grown:
    """A tree in the making: nodes in the order they were made, children behind parents."""

    def __init__(self) -> None:
        self.feature: list[int] = []
        self.bin: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.shares: list[np.ndarray] = []

    def node(self, counts: np.ndarray, weights: np.ndarray) -> int:
        mass = counts * weights
        self.feature.append(-1)
        self.bin.append(0)
        self.left.append(-1)
        self.right.append(-1)
        self.shares.append((mass / max(mass.sum(), 1e-300)).astype(np.float32))
        return len(self.feature) - 1

    def graft(self, at: int, other: Grown) -> None:
        """Puts a grown subtree in the place of a leaf."""
        offset = len(self.feature) - 1

        def moved(child: int) -> int:
            return child + offset if child > 0 else child

        self.feature[at], self.bin[at] = other.feature[0], other.bin[0]
        self.left[at], self.right[at] = moved(other.left[0]), moved(other.right[0])
        self.shares[at] = other.shares[0]
        self.feature += other.feature[1:]
        self.bin += other.bin[1:]
        self.left += map(moved, other.left[1:])
        self.right += map(moved, other.right[1:])
        self.shares += other.shares[1:]


def closed(counts: np.ndarray, n_rows: int, depth: int, p: GrowParams) -> bool:
    """Whether a node is a leaf already by what it holds."""
    full = p.depth is not None and depth >= p.depth
    return full or n_rows < 2 * max(1, p.least_rows) or np.count_nonzero(counts) < 2


def grow_locally(
    bins: np.ndarray, labels: np.ndarray, times: np.ndarray,
    node_key: int, depth: int, weights: np.ndarray, p: GrowParams,
) -> Grown:
    """The whole (sub)tree of the rows of a bag; rows that are not in it have no times."""
    grown = Grown()

    def counted(rows: np.ndarray) -> np.ndarray:
        return np.bincount(labels[rows], times[rows], p.n_classes).astype(np.int64)

    everything = np.flatnonzero(times)
    counts = counted(everything)
    todo = [(grown.node(counts, weights), everything, counts, node_key, depth)]
    while todo:
        at, rows, counts, key, depth = todo.pop()
        if closed(counts, len(rows), depth, p):
            continue
        order, cut = p.drawn(key), None
        for start in range(0, len(order), p.n_drawn):
            some = order[start : start + p.n_drawn]
            cells = counts_at(bins, rows, some, labels, times, p)
            cut = best_cut(cells, weights, some, p)
            if cut is not None:
                break
        if cut is None:
            continue
        below = bins[:, cut.feature].take(rows) <= cut.bin
        grown.feature[at], grown.bin[at] = cut
        sides = []
        for side, part in enumerate((rows[below], rows[~below])):
            side_counts = counted(part)
            child = grown.node(side_counts, weights)
            sides.append(child)
            todo.append((child, part, side_counts, mixed(key, side), depth + 1))
        grown.left[at], grown.right[at] = sides
    return grown


# --- trees of tables that are small enough to be sent ---


def _grow_here(table: tuple, trees: list[int], seed: int, p: GrowParams) -> list[Grown]:
    keys, bins, labels = table
    grown = []
    for tree in trees:
        tree_key = mixed(seed, tree)
        times = bag(keys, tree_key)
        weights = p.weights(np.bincount(labels, times, p.n_classes))
        grown.append(grow_locally(bins, labels, times, mixed(tree_key, 0), 0, weights, p))
    return grown


# --- trees of larger tables ---


class Open(NamedTuple):
    """A node that may be cut: how many features it has tried in vain, and its rows by class."""

    tree: int
    at: int
    key: int
    depth: int
    tried: int
    counts: np.ndarray
    n_rows: int


class _Top:
    """Cuts large nodes level by level and ships the rows of small ones."""

    def __init__(self, rdd: RDD, n_trees: int, seed: int, p: GrowParams, local_rows: int):
        self.rdd, self.seed, self.p, self.local_rows = rdd, seed, p, local_rows
        self.n_trees = n_trees
        self.context = rdd.context
        self.trees = [Grown() for _ in range(n_trees)]
        cells = min(p.n_drawn, len(p.features)) * p.n_bins * (p.n_classes + 1)
        self.per_pass = max(1, min(NODES_PER_PASS, PASS_BYTES // max(1, 8 * cells)))
        # From a node of this size on, all counts of a subtree come to at most what its rows take.
        counted = 2 * COUNT_BYTES * cells * rdd.getNumPartitions()
        self.small_rows = min(local_rows, counted // max(1, len(p.features)))

    def grow(self) -> list[Grown]:
        seed, p, n_trees = self.seed, self.p, self.n_trees

        def bags(blocks: Iterable[tuple]) -> Iterator[tuple]:
            for _, keys, _, labels in blocks:
                for tree in range(n_trees):
                    times = bag(keys, mixed(seed, tree))
                    counts = np.bincount(labels, times, p.n_classes).astype(np.int64)
                    yield tree, np.append(counts, np.count_nonzero(times))

        totals = self.rdd.mapPartitions(bags).reduceByKey(np.add).collect()
        self.weights = np.zeros((n_trees, p.n_classes))
        nodes = []
        for tree, counts in sorted(totals, key=lambda item: item[0]):
            self.weights[tree] = p.weights(counts[:-1].astype(float))
            at = self.trees[tree].node(counts[:-1], self.weights[tree])
            key = mixed(mixed(seed, tree), 0)
            nodes.append(Open(tree, at, key, 0, 0, counts[:-1], int(counts[-1])))
        if not len(p.features):
            return self.trees
        small: list[Open] = []
        while nodes:
            large = []
            for node in nodes:
                if closed(node.counts, node.n_rows, node.depth, p):
                    continue
                (small if node.n_rows <= self.small_rows else large).append(node)
            nodes = []
            for start in range(0, len(large), self.per_pass):
                nodes += self._cut(large[start : start + self.per_pass])
        for start in range(0, len(small), NODES_PER_PASS):
            self._finish(small[start : start + NODES_PER_PASS])
        return self.trees

    def _paths(self) -> list[tuple]:
        """The trees so far, as arrays that place rows."""
        return [
            (np.array(t.feature), np.array(t.bin), np.array(t.left), np.array(t.right))
            for t in self.trees
        ]

    def _cut(self, nodes: list[Open]) -> list[Open]:
        """Cuts nodes; what may be cut next."""
        p, seed = self.p, self.seed
        paths = self.context.broadcast(self._paths())
        wanted = self.context.broadcast([(n.tree, n.at, n.key, n.tried) for n in nodes])
        weights = self.context.broadcast(self.weights)

        def counted(blocks: Iterable[tuple]) -> Iterator[tuple]:
            for _, keys, bins, labels in blocks:
                for i, rows, times in _rows_of(wanted.value, paths.value, keys, bins, seed):
                    _, _, key, tried = wanted.value[i]
                    some = p.drawn(key)[tried : tried + p.n_drawn]
                    yield i, narrow(counts_at(bins, rows, some, labels, times, p))

        def cut(item: tuple) -> tuple:
            i, cells = item[0], item[1].astype(np.int64)
            tree, _, key, tried = wanted.value[i]
            some = p.drawn(key)[tried : tried + p.n_drawn]
            found = best_cut(cells, weights.value[tree], some, p)
            if found is None:
                return i, None, None
            # Left and right counts, from any one feature's cells.
            f = int(np.flatnonzero(some == found.feature)[0])
            left = cells[f, : found.bin + 1].sum(0)
            return i, found, (left, cells[f].sum(0) - left)

        # One value per node and partition at most.
        cuts = self.rdd.mapPartitions(counted).reduceByKey(added).map(cut).collect()
        for sent in (paths, wanted, weights):
            sent.unpersist()
        following = []
        for i, found, sides in sorted(cuts, key=lambda item: item[0]):
            node = nodes[i]
            if found is None:
                if node.tried + p.n_drawn < len(p.features):
                    following.append(node._replace(tried=node.tried + p.n_drawn))
                continue
            tree = self.trees[node.tree]
            tree.feature[node.at], tree.bin[node.at] = found
            children = []
            for side, counts in enumerate(sides):
                at = tree.node(counts[:-1], self.weights[node.tree])
                children.append(at)
                key = mixed(node.key, side)
                following.append(
                    Open(node.tree, at, key, node.depth + 1, 0, counts[:-1], int(counts[-1]))
                )
            tree.left[node.at], tree.right[node.at] = children
        return following

    def _finish(self, nodes: list[Open]) -> None:
        """Brings the rows of small nodes together and grows their subtrees."""
        p, seed = self.p, self.seed
        paths = self.context.broadcast(self._paths())
        wanted = self.context.broadcast([(n.tree, n.at, n.key, n.depth) for n in nodes])
        weights = self.context.broadcast(self.weights)

        def shipped(blocks: Iterable[tuple]) -> Iterator[tuple]:
            for _, keys, bins, labels in blocks:
                for i, rows, times in _rows_of(wanted.value, paths.value, keys, bins, seed):
                    yield i, (bins[rows], narrow(labels[rows]), narrow(times[rows]))

        def subtree(item: tuple) -> tuple:
            i, parts = item
            tree, _, key, depth = wanted.value[i]
            bins, labels, times = map(np.concatenate, zip(*parts))
            bins = np.asfortranarray(bins)
            return i, grow_locally(bins, labels, times, key, depth, weights.value[tree], p)

        # A group holds ``local_rows`` rows at most.
        n_tasks = max(1, min(len(nodes), 4 * self.rdd.getNumPartitions()))
        grown = self.rdd.mapPartitions(shipped).groupByKey(n_tasks).map(subtree).collect()
        for i, other in sorted(grown, key=lambda item: item[0]):
            self.trees[nodes[i].tree].graft(nodes[i].at, other)
        for sent in (paths, wanted, weights):
            sent.unpersist()


def _rows_of(
    wanted: list[tuple], paths: list[tuple], keys: np.ndarray, bins: np.ndarray, seed: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per wanted node that a block has rows of: its number, the rows, how often each row of the
    block stands in the bag. Rows go down to wanted nodes only, a column at a time."""
    by_tree: dict[int, list[int]] = {}
    for i, node in enumerate(wanted):
        by_tree.setdefault(node[0], []).append(i)
    for tree, numbers in by_tree.items():
        times = bag(keys, mixed(seed, tree))
        feature, cut, left, right = paths[tree]
        number_of = {wanted[i][1]: i for i in numbers}
        inner = np.flatnonzero(feature >= 0)
        parent = np.full(len(feature), -1)
        parent[left[inner]] = parent[right[inner]] = inner
        leads = np.zeros(len(feature), bool)
        above = np.array(list(number_of))
        while len(above):
            leads[above] = True
            above = np.unique(parent[above])
            above = above[above >= 0]
        todo = [(0, np.flatnonzero(times))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if feature[at] < 0:
                yield number_of[at], rows, times
                continue
            below = bins[:, feature[at]].take(rows) <= cut[at]
            if leads[left[at]]:
                todo.append((left[at], rows[below]))
            if leads[right[at]]:
                todo.append((right[at], rows[~below]))


# --- models ---


@dataclass(frozen=True)
class Forest:
    """Fitted trees; a row's class is the one with the greatest mean share over its leaves."""

    feature: list[np.ndarray]
    edge: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    shares: list[np.ndarray]
    seed: int

    def depths(self) -> list[int]:
        """Depth of every tree."""
        found = []
        for left, right in zip(self.left, self.right):
            depth = np.zeros(len(left), np.int64)
            # Children stand behind their parents.
            for at in np.flatnonzero(left > 0):
                depth[left[at]] = depth[right[at]] = depth[at] + 1
            found.append(int(depth.max()))
        return found

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sums of class shares by row."""
        out = np.zeros((len(x), self.shares[0].shape[1]))
        for feature, edge, left, right, shares in zip(
            self.feature, self.edge, self.left, self.right, self.shares
        ):
            node = np.zeros(len(x), np.int64)
            inner = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
            while len(inner):
                here = node[inner]
                below = x[inner, feature[here]] <= edge[here]
                node[inner] = np.where(below, left[here], right[here])
                inner = inner[feature[node[inner]] >= 0]
            out += shares[node]
        # Equal up to the order of sums is equal.
        return np.round(out, 6)

    def transform(self, table: DataFrame) -> DataFrame:
        """Adds ``prediction``, the label with the greatest share (the first of equals)."""
        return predicted(table, self)


def limited(forest: Forest, n_trees: int, depth: int | None) -> Forest:
    """The first trees of a forest, down to a depth: what a fit with these limits would grow.

    Bags and draws are keyed by tree and path, so a limit changes nothing above it.
    """
    trees = []
    for tree in range(n_trees):
        feature, edge, left, right, shares = (
            part[tree] for part in (forest.feature, forest.edge, forest.left, forest.right, forest.shares)
        )
        if depth is not None:
            level = np.zeros(len(feature), np.int64)
            at, down = np.zeros(1, np.int64), 0
            while len(at):
                level[at] = down
                inner = at[feature[at] >= 0]
                at, down = np.concatenate([left[inner], right[inner]]), down + 1
            kept = level <= depth
            inner = (feature >= 0) & (level < depth)
            # A node's number among those that stay.
            number = np.cumsum(kept) - 1
            feature = np.where(inner, feature, -1)[kept]
            left, right = (np.where(inner, number[side], -1)[kept] for side in (left, right))
            edge, shares = edge[kept], shares[kept]
        trees.append((feature, edge, left, right, shares))
    return Forest(*map(list, zip(*trees)), forest.seed)


def fit_forest(
    blocks: Blocks,
    edges: list[np.ndarray],
    n_trees: int = 500,
    depth: int | None = None,
    max_features: str = "sqrt",
    least_rows: int = 1,
    seed: int = 0,
    split: int | None = None,
    balanced: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    local_rows: int = LOCAL_ROWS,
) -> Forest:
    """A forest on all rows of ``blocks``, or on the training rows of its ``split``-th seed."""
    varying = np.flatnonzero([len(e) > 0 for e in edges])
    drawn = {"sqrt": int(np.sqrt(blocks.n_features)), "all": blocks.n_features}[max_features]
    n_bins = max(map(len, edges), default=0) + 1
    # Features that do not vary are never cut: trees grow over the places of those that do.
    places = np.arange(len(varying))
    p = GrowParams(
        depth, least_rows, max(1, drawn), n_bins, blocks.n_classes, balanced, places
    )
    context = blocks.spark.sparkContext
    sent = context.broadcast([edges[f] for f in varying])

    def binned(block: Block) -> tuple:
        x, labels, keys = block.x[:, varying], block.labels, block.keys
        if split is not None:
            train = np.flatnonzero(~block.held[split])
            x, labels, keys = x[train], labels[train], keys[train]
        return block.id, keys, to_bins(x, sent.value), labels

    def as_one(parts: Iterable[Block]) -> Iterator[tuple]:
        # A partition has some megabytes of bins. Nodes look at a few columns each.
        found = [binned(block) for block in parts]
        if found:
            keys, bins, labels = (np.concatenate([part[i] for part in found]) for i in (1, 2, 3))
            yield found[0][0], keys, np.asfortranarray(bins), labels

    rdd = blocks.rdd.mapPartitions(as_one)
    if blocks.n_rows * len(varying) * (1 if n_bins <= 256 else 2) <= broadcast_bytes:
        # Bounded by ``broadcast_bytes``.
        parts = sorted(rdd.collect(), key=lambda part: part[0])
        keys, bins, labels = (np.concatenate([part[i] for part in parts]) for i in (1, 2, 3))
        table = keys, np.asfortranarray(bins), labels
        everywhere = context.broadcast(table)
        chunks = [
            list(range(start, min(start + TREES_PER_TASK, n_trees)))
            for start in range(0, n_trees, TREES_PER_TASK)
        ]
        grown = (
            context.parallelize(chunks, len(chunks))
            .flatMap(lambda trees: _grow_here(everywhere.value, trees, seed, p))
            .collect()
        )
        everywhere.unpersist()
    else:
        kept = rdd.persist(StorageLevel.MEMORY_AND_DISK)
        grown = _Top(kept, n_trees, seed, p, local_rows).grow()
        kept.unpersist()
    sent.unpersist()
    padded = np.full((max(1, len(varying)), n_bins), np.inf)
    for i, f in enumerate(varying):
        padded[i, : len(edges[f])] = edges[f]
    # Place -1, a leaf's, stays -1.
    features_of = np.append(varying, -1)
    features = [np.array(t.feature) for t in grown]
    return Forest(
        [features_of[f] for f in features],
        [padded[np.maximum(f, 0), np.array(t.bin)] for f, t in zip(features, grown)],
        [np.array(t.left) for t in grown],
        [np.array(t.right) for t in grown],
        [np.array(t.shares) for t in grown],
        seed,
    )
