"""Softmax gradient boosting over K classes.

Every round grows one tree per class on the gradients and Hessians of the softmax loss:
second-order gains with an L2 penalty on leaf values, rows drawn per round, columns drawn
per tree, depth-wise growth over quantile bins. All trees of a round grow together, those of all
splits of a repeated holdout too: one pass over the rows per level, whatever the number of
classes and splits.

What a pass returns are histograms of gradients, whose size depends on trees, features and bins
alone. Gradients are rounded to a fixed point, so sums are whole numbers: the model is the
same, bit for bit, however the rows are spread over blocks and tasks. Of two siblings only the
lighter one is counted, the other is its parent less the first.

Where the rows are is decided by size alone. A table whose bins fit into ``LOCAL_BYTES`` is sent to
all machines, and one task per split grows its trees: a pass of a few milliseconds is not worth a
job. Beyond that rows stay where they are, and what follows holds.

A row's margins and its place in the growing trees follow from the block and the steps taken so
far. Workers keep them between passes; a worker without them replays the steps, so lost
executors cost time only. Every ``REBASE_ROUNDS`` rounds the margins are stored with the blocks and
the lineage is cut by a checkpoint.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.blocks import Block, Blocks, WorkerCache, predicted, summed
from sensorloom.sources.scratch import scratch_root

# Fixed value: fractions of a gradient unit that are counted. A block of 2^20 rows sums exactly.
SCALE = float(1 << 30)
# Fixed value: gains up to this are none.
LEAST_GAIN = 1e-6
# Rounds after which margins are stored, and steps that travel in one broadcast.
REBASE_ROUNDS = 50
STEPS_PER_BROADCAST = 48
# Bytes of margins, bins and places that a worker keeps.
KEPT_BYTES = 512 << 20
# Bytes of bins that one task may hold.
LOCAL_BYTES = 64 << 20
# Cells up to which two features are counted together, by pairs of bins.
PAIR_CELLS = 1 << 12
# Cells of a group of features, and rows from which groups are worth their cells.
GROUP_CELLS = 1 << 13
GROUP_ROWS = 1 << 17
# Rows that are counted in one go.
CHUNK_ROWS = 1 << 13
# Fixed value: rows of a block that sum exactly.
BLOCK_ROWS = 1 << 20


@dataclass(frozen=True)
class BoostParams:
    """Fixed values of the protocol as defaults."""

    rounds: int = 400
    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.9
    column_share: float = 0.9
    penalty: float = 1.0
    least_hessian: float = 1.0


class Split(NamedTuple):
    """A step: these nodes of these trees send rows with a bin above ``bin`` to the right."""

    tree: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    bin: np.ndarray


class Values(NamedTuple):
    """A step: the round is over, ``values`` has what each node adds, by tree and node."""

    values: np.ndarray


class BinnedBlock(NamedTuple):
    """A block with bins for features; ``margins`` (split, row, class) after ``round`` rounds."""

    id: str
    keys: np.ndarray
    labels: np.ndarray
    bins: np.ndarray | Cells
    held: np.ndarray
    margins: np.ndarray
    round: int


# --- bins ---


def bin_edges(table: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """Per feature the values that separate its quantile bins, ascending; at most ``bins - 1``."""
    shares = [i / bins for i in range(1, bins)]
    cells = table.select(F.posexplode(vector_to_array("features")).alias("feature", "value"))
    edges = cells.groupBy("feature").agg(
        F.percentile_approx("value", shares, 10_000).alias("edges"), F.max("value").alias("top")
    )
    found = [np.zeros(0)] * n_features
    # One row per feature.
    for row in edges.collect():
        values = np.unique(np.array(row["edges"], float))
        # Above the largest value lies nothing.
        found[row["feature"]] = values[values < row["top"]]
    return found


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many edges lie below it."""
    out = np.empty(x.shape, np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16)
    for f, edge in enumerate(edges):
        out[:, f] = np.searchsorted(edge, x[:, f], "left")
    return out


# --- what a worker does ---


def chosen(keys: np.ndarray, seed: int, round_: int, share: float) -> np.ndarray:
    """Which rows a round draws: by a hash of row, seed and round, wherever the row lies."""
    salt = np.array([(seed * 1_000_003 + round_ + 1) % 2**64], np.uint64)
    z = keys ^ (salt * np.uint64(0x9E3779B97F4A7C15))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share


class State:
    """Margins and places of the rows of one block, as far as the steps go."""

    def __init__(self, block: BinnedBlock, n_bins: int, seeds: list[int], share: float):
        self.n_bins, self.seeds, self.share = n_bins, seeds, share
        self.use(block)
        self.margins = block.margins.copy()
        self.done, self.round, self.begun_at = 0, block.round, block.round
        self._begin()

    def use(self, block: BinnedBlock) -> None:
        """Takes the cells of a block; those that came with the task are not kept beyond it."""
        self.block = block
        self.cells = block.bins if isinstance(block.bins, Cells) else paired(block.bins, self.n_bins)

    def let_go(self) -> None:
        """Forgets what comes with the block each time."""
        self.block = self.cells = None

    def size(self) -> int:
        return 5 * self.margins.nbytes

    def _begin(self) -> None:
        """Everyone at the root of the coming round, whose gradients wait until they are asked for."""
        n_splits, n, n_classes = self.margins.shape
        self.node = np.zeros((n_splits, n_classes, n), np.int16)
        self.counted = False

    def _draw(self) -> None:
        """Fixed-point gradients and Hessians of the round, by class, as trees read them."""
        if self.counted:
            return
        n_splits, n, n_classes = self.margins.shape
        self.gradients = np.empty((n_splits, n_classes, n))
        self.hessians = np.empty((n_splits, n_classes, n))
        for s in range(n_splits):
            for start in range(0, n, CHUNK_ROWS):
                some = slice(start, start + CHUNK_ROWS)
                p = np.ascontiguousarray(self.margins[s, some].T)
                p -= p.max(0)
                np.exp(p, out=p)
                p /= p.sum(0)
                self.hessians[s, :, some] = np.rint(np.maximum(2.0 * p * (1.0 - p), 1e-16) * SCALE)
                labels = self.block.labels[some]
                p[labels, np.arange(len(labels))] -= 1.0
                self.gradients[s, :, some] = np.rint(p * SCALE)
        self.members = [
            np.flatnonzero(~held & chosen(self.block.keys, seed, self.round, self.share))
            for held, seed in zip(self.block.held, self.seeds)
        ]
        self.counted = True

    def take(self, steps: list[Split | Values]) -> None:
        for step in steps:
            if isinstance(step, Split):
                self._split(step)
            else:
                self._finish(step)
            self.done += 1

    def _split(self, step: Split) -> None:
        n_classes = self.margins.shape[2]
        for tree, at, feature, limit in zip(*(part.tolist() for part in step)):
            node = self.node[tree // n_classes, tree % n_classes]
            rows = np.flatnonzero(node == at)
            node[rows] = self.cells.above(feature, limit, rows) + np.int16(2 * at + 1)

    def _finish(self, step: Values) -> None:
        n_classes = self.margins.shape[2]
        for tree, values in enumerate(step.values):
            s, k = divmod(tree, n_classes)
            self.margins[s, :, k] += values.take(self.node[s, k])
        self.round += 1
        self._begin()

    def histograms(self, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Sums of gradients and Hessians by (wanted node, feature, bin)."""
        self._draw()
        n_classes, n_bins = self.margins.shape[2], self.n_bins
        out = np.zeros((len(tree), 2, self.cells.width, n_bins), np.int64)
        wide = self.cells.wide
        # At the root the trees of a split have the same rows.
        groups: list[tuple[np.ndarray, list]] = []
        for t in np.unique(tree):
            wanted = np.flatnonzero(tree == t)
            s, k = divmod(int(t), n_classes)
            rows, first = self.members[s], None
            places = self.node[s, k].take(rows)
            slot = np.full(int(node[wanted].max()) + 1, -1, np.intp)
            slot[node[wanted]] = np.arange(len(wanted))
            if len(wanted) > 1:
                slots = np.where(places < len(slot), slot.take(places, mode="clip"), -1)
                kept = slots >= 0
            else:
                kept = places == node[wanted[0]]
            if not kept.all():
                rows = rows[kept]
            if len(wanted) > 1:
                first = slots[kept] * wide
            weights = [values[s, k].take(rows) for values in (self.gradients, self.hessians)]
            if groups and groups[-1][0] is rows:
                groups[-1][1].append((wanted, first, weights))
            else:
                groups.append((rows, [(wanted, first, weights)]))
        # Pieces that stay in a core's cache, and have more rows than there are sums.
        most = max(len(wanted) for _, parts in groups for wanted, _, _ in parts)
        piece = max(CHUNK_ROWS, 4 * most * wide)
        own, cell = np.empty(piece, np.intp), np.empty(piece, np.intp)
        for c, column in enumerate(self.cells.columns):
            narrow = np.empty(piece, column.dtype)
            features, size = self.cells.groups[c], self.cells.sizes[c]
            used = math.prod(size)
            for rows, parts in groups:
                sums = [[0.0, 0.0] for _ in parts]
                for start in range(0, len(rows), piece):
                    some = slice(start, min(start + piece, len(rows)))
                    n = some.stop - start
                    np.take(column, rows[some], out=narrow[:n], mode="clip")
                    np.copyto(own[:n], narrow[:n])
                    for (wanted, first, weights), total in zip(parts, sums):
                        at = own[:n]
                        if first is not None:
                            at = np.add(own[:n], first[some], out=cell[:n])
                        for i in (0, 1):
                            total[i] += np.bincount(at, weights[i][some], len(wanted) * wide)
                for (wanted, _, _), total in zip(parts, sums):
                    for i in (0, 1):
                        if not len(rows):
                            continue
                        both = total[i].reshape(-1, wide)[:, :used].reshape(-1, *size)
                        for j, f in enumerate(features):
                            others = tuple(a for a in range(1, both.ndim) if a != j + 1)
                            out[wanted, i, f, : size[j]] = both.sum(others) if others else both
        return out


def pairs_up(n_bins: int) -> bool:
    """Whether features are counted two at a time."""
    return n_bins**2 <= PAIR_CELLS


class Cells(NamedTuple):
    """Bins of a group of features in one number each, the last feature's counting least.

    One pass over the rows then answers for all features of a group.
    """

    columns: list[np.ndarray]
    groups: list[list[int]]
    # Bins by group and feature.
    sizes: list[list[int]]
    # Per feature its column, what its bin is multiplied by there, and its bins.
    places: list[tuple[int, int, int]]

    @property
    def width(self) -> int:
        return len(self.places)

    @property
    def wide(self) -> int:
        """Cells of the widest column."""
        return max(math.prod(size) for size in self.sizes)

    def above(self, feature: int, limit: int, rows: np.ndarray) -> np.ndarray:
        """Which rows have a bin above ``limit``."""
        column, factor, size = self.places[feature]
        cell = self.columns[column].take(rows)
        if self.groups[column][0] == feature:
            return cell >= (limit + 1) * factor
        if factor > 1:
            cell = cell // cell.dtype.type(factor)
        return cell % cell.dtype.type(size) > limit


def celled(bins: np.ndarray, groups: list[list[int]], sizes: list[int]) -> Cells:
    """The cells of rows, by groups of features; ``sizes`` has the bins of each feature."""
    columns, places = [], [(0, 1, 1)] * bins.shape[1]
    for c, group in enumerate(groups):
        factor = 1
        for f in reversed(group):
            places[f] = c, factor, sizes[f]
            factor *= sizes[f]
        if len(group) == 1:
            columns.append(np.ascontiguousarray(bins[:, group[0]]))
            continue
        cell = bins[:, group[0]].astype(np.int16)
        for f in group[1:]:
            cell *= np.int16(sizes[f])
            cell += bins[:, f].astype(np.int16)
        columns.append(cell)
    return Cells(columns, groups, [[sizes[f] for f in group] for group in groups], places)


def paired(bins: np.ndarray, n_bins: int) -> Cells:
    """Features two at a time where they have few bins, else one by one."""
    width, step = bins.shape[1], 2 if pairs_up(n_bins) else 1
    groups = [list(range(f, min(f + step, width))) for f in range(0, width, step)]
    return celled(bins, groups, [n_bins] * width)


def grouped(bins: np.ndarray, edges: list[np.ndarray], n_bins: int) -> Cells:
    """Features in few groups, by the bins that each one has; for tables with more rows than cells."""
    if len(bins) < GROUP_ROWS or not pairs_up(n_bins):
        return paired(bins, n_bins)
    sizes = [len(edge) + 1 for edge in edges]
    groups: list[list[int]] = []
    cells: list[int] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        room = [g for g, n in enumerate(cells) if n * sizes[f] <= GROUP_CELLS]
        if room:
            best = max(room, key=lambda g: cells[g])
            groups[best].append(f)
            cells[best] *= sizes[f]
        else:
            groups.append([f])
            cells.append(sizes[f])
    return celled(bins, groups, sizes)


_STATES = WorkerCache(KEPT_BYTES)


def state_of(
    block: BinnedBlock, token: str, steps: list, n_bins: int, seeds: list[int], share: float
) -> State:
    """The state of a block after ``steps``, which are those since its margins were stored."""
    key = (token, block.id)
    state = _STATES.get(key)
    if state is None or state.begun_at != block.round or state.done > len(steps):
        state = State(block, n_bins, seeds, share)
    elif state.block is None:
        state.use(block)
    state.take(steps[state.done :])
    _STATES.put(key, state, state.size())
    return state


# --- the driver ---


class Node(NamedTuple):
    """A node that may be split: its place and the sums of its rows."""

    tree: int
    node: int
    gradient: int
    hessian: int


class Tree:
    """Nodes by heap number: node i has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature = np.full(size, -1, np.int32)
        self.bin = np.zeros(size, np.int32)
        self.values = np.zeros(size)


def best_splits(
    sums: np.ndarray, nodes: list[Node], allowed: np.ndarray, params: BoostParams
) -> list[tuple[int, int, int, int] | None]:
    """Per node the split of the greatest gain, as (feature, bin, gradient, Hessian of the left).

    ``sums`` has (node, 2, feature, bin); ``allowed`` which features a node's tree may use. Of
    equal gains the first feature and the lowest bin win.
    """
    left = np.cumsum(sums, axis=3)[..., :-1]
    g_left, h_left = left[:, 0] / SCALE, left[:, 1] / SCALE
    g = np.array([n.gradient for n in nodes])[:, None, None] / SCALE
    h = np.array([n.hessian for n in nodes])[:, None, None] / SCALE
    g_right, h_right = g - g_left, h - h_left
    penalty = params.penalty
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (
            g_left**2 / (h_left + penalty)
            + g_right**2 / (h_right + penalty)
            - g**2 / (h + penalty)
        )
    fits = (h_left >= params.least_hessian) & (h_right >= params.least_hessian)
    gain = np.where(fits & allowed[:, :, None], gain, -np.inf).reshape(len(nodes), -1)
    if not gain.shape[1]:
        return [None] * len(nodes)
    places = gain.argmax(1)
    n_cuts = left.shape[3]
    found: list[tuple[int, int, int, int] | None] = []
    for i, place in enumerate(places.tolist()):
        feature, cut = divmod(place, n_cuts)
        if gain[i, place] <= LEAST_GAIN:
            found.append(None)
        else:
            found.append((feature, cut, int(left[i, 0, feature, cut]), int(left[i, 1, feature, cut])))
    return found


class Grower:
    """Grows all trees of some splits; where the rows are is up to the two kinds below."""

    def __init__(self, seeds: list[int], n_features: int, n_classes: int, edges: list[np.ndarray], params: BoostParams):
        self.params, self.seeds = params, seeds
        self.n_features, self.n_classes = n_features, n_classes
        self.n_trees = len(seeds) * n_classes
        self.varying = varying_features(edges)
        self.n_bins = max(map(len, edges), default=0) + 1
        self.rounds: list[list[Tree]] = []

    def _histograms(self, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Sums by (node, 2, varying feature, bin) over the rows of the wanted nodes."""
        raise NotImplementedError

    def _add(self, step: Split | Values) -> None:
        """Takes a step."""
        raise NotImplementedError

    def _rebase(self) -> None:
        """Stores what the steps have led to."""

    def _lighter(self, left: Node, right: Node) -> Node:
        """The sibling that is counted; either one gives the same sums."""
        return min(left, right, key=lambda n: n.hessian)

    def _columns(self, round_: int) -> np.ndarray:
        """Which columns each tree of a round may use."""
        n = max(1, int(self.params.column_share * self.n_features))
        out = np.zeros((self.n_trees, self.n_features), bool)
        for tree in range(self.n_trees):
            s, k = divmod(tree, self.n_classes)
            rng = np.random.default_rng([self.seeds[s] % 2**32, round_, k])
            out[tree, rng.permutation(self.n_features)[:n]] = True
        return out[:, self.varying]

    def grow(self) -> None:
        """One round: a tree per class and split."""
        params, columns = self.params, self._columns(len(self.rounds))
        trees = [Tree(params.depth) for _ in range(self.n_trees)]
        roots = np.arange(self.n_trees)
        sums = self._histograms(roots, np.zeros(self.n_trees, np.int64))
        # Any feature's bins hold all rows of a node.
        totals = sums[:, :, 0].sum(2)
        nodes = [Node(t, 0, int(totals[t, 0]), int(totals[t, 1])) for t in range(self.n_trees)]
        for node in nodes:
            self._leaf(trees, node)
        for level in range(params.depth):
            splits = best_splits(sums, nodes, columns[[n.tree for n in nodes]], params)
            taken = [(i, n, s) for i, (n, s) in enumerate(zip(nodes, splits)) if s is not None]
            if not taken:
                break
            for _, node, (feature, cut, _, _) in taken:
                trees[node.tree].feature[node.node] = feature
                trees[node.tree].bin[node.node] = cut
            self._add(
                Split(
                    np.array([n.tree for _, n, _ in taken]),
                    np.array([n.node for _, n, _ in taken]),
                    np.array([s[0] for _, _, s in taken]),
                    np.array([s[1] for _, _, s in taken]),
                )
            )
            pairs = []
            for i, node, (_, _, g, h) in taken:
                left = Node(node.tree, 2 * node.node + 1, g, h)
                right = Node(node.tree, 2 * node.node + 2, node.gradient - g, node.hessian - h)
                self._leaf(trees, left)
                self._leaf(trees, right)
                # Neither side can be split again if it cannot give both children enough.
                least = 2 * params.least_hessian * SCALE
                if max(left.hessian, right.hessian) >= least:
                    pairs.append((i, left, right))
            if level + 1 == params.depth or not pairs:
                break
            lighter = [self._lighter(left, right) for _, left, right in pairs]
            counted = self._histograms(
                np.array([n.tree for n in lighter]), np.array([n.node for n in lighter])
            )
            nodes, parts = [], []
            for (i, left, right), light, own in zip(pairs, lighter, counted):
                heavy = right if light is left else left
                nodes += [light, heavy]
                parts += [own, sums[i] - own]
            sums = np.stack(parts)
        self.rounds.append(trees)
        self._add(Values(np.stack([tree.values for tree in trees])))
        if len(self.rounds) % REBASE_ROUNDS == 0 and len(self.rounds) < params.rounds:
            self._rebase()

    def _leaf(self, trees: list[Tree], node: Node) -> None:
        gradient, hessian = node.gradient / SCALE, node.hessian / SCALE
        value = -gradient / (hessian + self.params.penalty) if hessian + self.params.penalty else 0.0
        trees[node.tree].values[node.node] = self.params.rate * value


class Here(Grower):
    """All rows in this process; one split."""

    def __init__(self, block: BinnedBlock, seed: int, n_features: int, n_classes: int, edges: list[np.ndarray], params: BoostParams):
        super().__init__([seed], n_features, n_classes, edges, params)
        cells = grouped(block.bins, [edges[f] for f in self.varying], self.n_bins)
        self.state = State(block._replace(bins=cells), self.n_bins, [seed], params.row_share)

    def _histograms(self, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        return self.state.histograms(tree, node)

    def _lighter(self, left: Node, right: Node) -> Node:
        """Hessians shrink where a class is known well, however many rows there are: rows decide."""
        places = self.state.node[0, left.tree]
        fewer = np.count_nonzero(places == left.node) <= np.count_nonzero(places == right.node)
        return left if fewer else right

    def _add(self, step: Split | Values) -> None:
        self.state.take([step])


class Everywhere(Grower):
    """Rows in blocks all over the cluster; all splits together."""

    def __init__(self, blocks: Blocks, edges: list[np.ndarray], params: BoostParams):
        super().__init__(blocks.seeds, blocks.n_features, blocks.n_classes, edges, params)
        self.context = blocks.spark.sparkContext
        if self.context.getCheckpointDir() is None:
            self.context.setCheckpointDir(scratch_root(blocks.spark))
        self.token = uuid.uuid4().hex
        self.rdd = gathered(blocks, edges, self.n_bins).persist(StorageLevel.MEMORY_AND_DISK)
        # Steps since the margins were stored: whole broadcasts, then single ones.
        self.sent: list[Any] = []
        self.steps: list[Split | Values] = []

    def _add(self, step: Split | Values) -> None:
        self.steps.append(step)
        if len(self.steps) >= STEPS_PER_BROADCAST:
            self.sent.append(self.context.broadcast(self.steps))
            self.steps = []

    def _histograms(self, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        token, seeds, share = self.token, self.seeds, self.params.row_share
        n_bins, sent, steps = self.n_bins, list(self.sent), list(self.steps)

        def of_block(block: BinnedBlock) -> np.ndarray:
            known = [step for part in sent for step in part.value] + steps
            state = state_of(block, token, known, n_bins, seeds, share)
            sums = state.histograms(tree, node)
            state.let_go()
            return sums

        return summed(self.rdd, of_block)

    def _rebase(self) -> None:
        """Stores the margins with the blocks and forgets the steps that led to them."""
        token, seeds, share = self.token, self.seeds, self.params.row_share
        n_bins, sent, steps = self.n_bins, list(self.sent), list(self.steps)

        def advanced(block: BinnedBlock) -> BinnedBlock:
            known = [step for part in sent for step in part.value] + steps
            state = state_of(block, token, known, n_bins, seeds, share)
            state.let_go()
            return block._replace(margins=state.margins.copy(), round=state.round)

        before, self.rdd = self.rdd, self.rdd.map(advanced).persist(StorageLevel.MEMORY_AND_DISK)
        self.rdd.checkpoint()
        self.rdd.count()
        before.unpersist()
        for part in self.sent:
            part.unpersist()
        self.sent, self.steps = [], []

    def release(self) -> None:
        self.rdd.unpersist()
        for part in self.sent:
            part.unpersist()


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model: per round and class a tree, by heap number of its nodes."""

    feature: np.ndarray
    edge: np.ndarray
    values: np.ndarray
    seed: int

    @property
    def n_rounds(self) -> int:
        return len(self.feature)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaf values by row and class."""
        n_rounds, n_classes, size = self.feature.shape
        out = np.zeros((len(x), n_classes))
        rows = np.arange(len(x))
        for r in range(n_rounds):
            for k in range(n_classes):
                feature, edge = self.feature[r, k], self.edge[r, k]
                node = np.zeros(len(x), np.int64)
                inner = rows if feature[0] >= 0 else rows[:0]
                while len(inner):
                    here = node[inner]
                    right = x[inner, feature[here]] > edge[here]
                    node[inner] = 2 * here + 1 + right
                    inner = inner[feature[node[inner]] >= 0]
                out[:, k] += self.values[r, k][node]
        return out

    def transform(self, table: DataFrame) -> DataFrame:
        """Adds ``prediction``, the label with the greatest margin (the first of equals)."""
        return predicted(table, self)


def varying_features(edges: list[np.ndarray]) -> np.ndarray:
    """Features with more than one bin; the first one if there is none."""
    found = np.flatnonzero([len(edge) > 0 for edge in edges])
    return found if len(found) else np.zeros(1, np.int64)


def binned(blocks: Blocks, edges: list[np.ndarray]) -> RDD:
    """The blocks with bins of the varying features, before the first round."""
    sent = blocks.spark.sparkContext.broadcast([edges, varying_features(edges)])
    n_splits, n_classes = len(blocks.seeds), blocks.n_classes

    def of_block(block: Block) -> BinnedBlock:
        edges, varying = sent.value
        margins = np.zeros((n_splits, len(block.labels), n_classes))
        bins = to_bins(block.x[:, varying], [edges[f] for f in varying])
        return BinnedBlock(block.id, block.keys, block.labels, bins, block.held, margins, 0)

    return blocks.rdd.map(of_block)


def without_held(block: BinnedBlock) -> BinnedBlock:
    """The rows that some split trains with."""
    train = np.flatnonzero(~block.held.all(0))
    if len(train) == len(block.labels):
        return block
    return block._replace(
        keys=block.keys[train], labels=block.labels[train], bins=block.bins[train],
        held=block.held[:, train], margins=block.margins[:, train],
    )


def joined(parts: list[BinnedBlock]) -> BinnedBlock:
    """One block with the rows of several, before the first round."""
    # Its name tells the order of the rows.
    name = hashlib.md5(" ".join(part.id for part in parts).encode()).hexdigest()
    keys, labels, bins = (np.concatenate([part[i] for part in parts]) for i in (1, 2, 3))
    held, margins = (np.concatenate([part[i] for part in parts], axis=1) for i in (4, 5))
    return BinnedBlock(name, keys, labels, bins, held, margins, 0)


def gathered(blocks: Blocks, edges: list[np.ndarray], n_bins: int) -> RDD:
    """Training rows in few large blocks of cells: about a partition per core, and a block in each.

    What a pass costs besides its rows (tasks, sums by pair and node, what comes to the driver) is
    paid per block, and blocks of the linear fits have some thousand rows only. A partition has up
    to ``LOCAL_BYTES`` of bins.
    """
    rdd = binned(blocks, edges)
    varying = [edges[f] for f in varying_features(edges)]
    size = blocks.n_rows * len(varying_features(edges)) * (1 if n_bins <= 256 else 2)
    wanted = max(rdd.context.defaultParallelism, -(-size // LOCAL_BYTES))

    def merged(parts: Iterable[BinnedBlock]) -> Iterator[BinnedBlock]:
        found, rows = [], 0
        for part in map(without_held, parts):
            if found and rows + len(part.labels) > BLOCK_ROWS:
                yield in_cells(joined(found))
                found, rows = [], 0
            found.append(part)
            rows += len(part.labels)
        if found:
            yield in_cells(joined(found))

    def in_cells(block: BinnedBlock) -> BinnedBlock:
        return block._replace(bins=grouped(block.bins, varying, n_bins))

    return rdd.coalesce(min(wanted, rdd.getNumPartitions())).mapPartitions(merged)


def _fit_here(blocks: Blocks, edges: list[np.ndarray], params: BoostParams) -> list[list[list[Tree]]]:
    """The rounds of every split, each grown by a task of its own."""
    # Bounded by ``LOCAL_BYTES``.
    parts = sorted(binned(blocks, edges).collect(), key=lambda part: part.id)
    whole = BinnedBlock(
        "whole",
        *[np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)],
        np.concatenate([p.held for p in parts], axis=1),
        np.zeros((1, blocks.n_rows, blocks.n_classes)),
        0,
    )
    context = blocks.spark.sparkContext
    sent = context.broadcast(whole)
    n_features, n_classes = blocks.n_features, blocks.n_classes

    def of_split(item: tuple[int, int]) -> tuple[int, list[list[Tree]]]:
        s, seed = item
        block = without_held(sent.value._replace(held=sent.value.held[s : s + 1]))
        grower = Here(block, seed, n_features, n_classes, edges, params)
        for _ in range(params.rounds):
            grower.grow()
        return s, grower.rounds

    splits = list(enumerate(blocks.seeds))
    grown = context.parallelize(splits, len(splits)).map(of_split).collect()
    sent.unpersist()
    return [rounds for _, rounds in sorted(grown, key=lambda item: item[0])]


def _fit_everywhere(
    blocks: Blocks, edges: list[np.ndarray], params: BoostParams
) -> list[list[list[Tree]]]:
    """The rounds of every split, all grown together over the blocks."""
    grower = Everywhere(blocks, edges, params)
    for _ in range(params.rounds):
        grower.grow()
    grower.release()
    k = blocks.n_classes
    return [
        [trees[s * k : (s + 1) * k] for trees in grower.rounds] for s in range(len(blocks.seeds))
    ]


def fit_boosted_trees(
    blocks: Blocks,
    edges: list[np.ndarray],
    params: BoostParams = BoostParams(),
    local_bytes: int = LOCAL_BYTES,
) -> list[BoostedTrees]:
    """One model per split of ``blocks``."""
    varying = varying_features(edges)
    n_bins = max(map(len, edges), default=0) + 1
    size = blocks.n_rows * len(varying) * (1 if n_bins <= 256 else 2)
    fit = _fit_here if size <= local_bytes else _fit_everywhere
    padded = np.full((len(varying), n_bins), np.inf)
    for i, f in enumerate(varying):
        padded[i, : len(edges[f])] = edges[f]
    models = []
    for seed, rounds in zip(blocks.seeds, fit(blocks, edges, params)):
        place = np.array([[t.feature for t in trees] for trees in rounds])
        cut = np.array([[t.bin for t in trees] for trees in rounds])
        values = np.array([[t.values for t in trees] for trees in rounds])
        edge = padded[np.maximum(place, 0), cut]
        models.append(BoostedTrees(np.where(place < 0, -1, varying[place]), edge, values, seed))
    return models
