"""The classifiers and their shared comparison.

Every estimator is another implementation than a single-machine library's, so
what carries over is the protocol and the hyper-parameters, not the last digit;
the mapping is written at each builder. Linear models and boosted trees are fitted for all
splits of a repeated holdout together (:mod:`linear`, :mod:`boosting`), forests
(:mod:`forests`) one by one. Predictions of each fit go straight to a table of the
ledger, so fitted models do not pile up on the driver and a rerun does not repeat them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from threading import Lock

import numpy as np
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.operators.baselines import (
    PREDICTION_COLUMNS,
    most_frequent_predictions,
    stratified_predictions,
)
from sensorloom.operators.blocks import Blocks, pack
from sensorloom.operators.boosting import BoostedTrees, BoostParams, bin_edges, fit_boosted_trees
from sensorloom.operators.forests import Forest, fit_forest, limited
from sensorloom.operators.ledger import Fit, Ledger, digest, fingerprint
from sensorloom.operators.linear import LinearModel, fit_logistic, fit_svm
from sensorloom.operators.scoring import macro_f1
from sensorloom.operators.splits import (
    assemble,
    class_table,
    held_out_seeds,
    split_sizes,
    stratified_splits,
    with_label,
)
from sensorloom.sources.scratch import materialize

# Bytes of features in one partition of a training table.
FIT_PARTITION_BYTES = 64 << 20


@dataclass(frozen=True)
class ForestParams:
    """One point of the forest grid; ``max_depth`` None means no limit."""

    n_estimators: int = 500
    max_depth: int | None = None
    max_features: str = "sqrt"
    min_samples_leaf: int = 1


# The six forests that are tried, in order.
FOREST_GRID = (
    ForestParams(300, None, "sqrt", 1),
    ForestParams(500, None, "sqrt", 1),
    ForestParams(500, 20, "sqrt", 1),
    ForestParams(500, 10, "sqrt", 1),
    ForestParams(500, None, "sqrt", 2),
    ForestParams(500, None, "sqrt", 5),
)


@dataclass(frozen=True)
class FitSettings:
    """Sizes of the fits. The defaults are the full protocol."""

    forest: ForestParams = field(default_factory=ForestParams)
    grid: tuple[ForestParams, ...] = FOREST_GRID
    linear_penalty: float = 1.0
    logistic_iterations: int = 3000
    svm_iterations: int = 1000
    boost_rounds: int = 400
    boost_depth: int = 6
    boost_rate: float = 0.05
    boost_row_share: float = 0.9
    boost_column_share: float = 0.9
    boost_penalty: float = 1.0
    # Fits submitted at a time.
    parallel_fits: int = 4
    # Split candidates per feature; trees see features in this many quantile bins.
    tree_bins: int = 32


# A small protocol for smoke runs and tests.
LIGHT = FitSettings(
    forest=ForestParams(20, 5),
    grid=(ForestParams(10, 5), ForestParams(20, 5), ForestParams(20, 5, "sqrt", 5)),
    logistic_iterations=10,
    svm_iterations=10,
    boost_rounds=10,
    boost_depth=3,
    boost_rate=0.3,
)


def standard_scaler() -> StandardScaler:
    """Centre and scale (M6). MLlib divides by the sample deviation; the linear fits, which
    scale by themselves, by the population's."""
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)


def scaler_statistics(vectors: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, mean, std)`` as the scaler learns them, one row per feature."""
    moments = vectors.select(
        Summarizer.metrics("mean", "std").summary(F.col("features")).alias("m")
    ).select(vector_to_array("m.mean").alias("mean"), vector_to_array("m.std").alias("std"))
    names = F.lit(features)
    return moments.select(F.inline(F.arrays_zip(names.alias("feature"), "mean", "std"))).toDF(
        "feature", "mean", "std"
    )


def forest(
    data: HoldoutData, params: ForestParams, seed: int, settings: FitSettings, balanced: bool
) -> Forest:
    """A random forest for one grid point on one split."""
    return fit_forest(
        data.blocks(data.seeds),
        data.edges(settings.tree_bins),
        params.n_estimators,
        params.max_depth,
        params.max_features,
        params.min_samples_leaf,
        seed,
        data.seeds.index(seed),
        balanced,
    )


def grid_forests(
    data: HoldoutData, points: list[ForestParams], seed: int, settings: FitSettings
) -> list[Forest]:
    """A forest for each of some grid points on one split.

    Points that differ in the number of trees or in depth only have the same trees as far as
    their limits go: the largest of them is grown, the others are what their limits leave of it.
    """
    grown: dict[tuple[str, int], Forest] = {}
    for kind in dict.fromkeys(_kind(p) for p in points):
        alike = [p for p in points if _kind(p) == kind]
        depths = [p.max_depth for p in alike]
        largest = ForestParams(
            max(p.n_estimators for p in alike), None if None in depths else max(depths), *kind
        )
        grown[kind] = forest(data, largest, seed, settings, balanced=True)
    return [limited(grown[_kind(p)], p.n_estimators, p.max_depth) for p in points]


def _kind(params: ForestParams) -> tuple[str, int]:
    return params.max_features, params.min_samples_leaf


def logistic_regressions(data: HoldoutData, seeds: list[int], settings: FitSettings) -> list[LinearModel]:
    """Scaled multinomial logistic regressions with an L2 penalty, all splits together (M7)."""
    return fit_logistic(
        data.blocks(seeds), settings.linear_penalty, settings.logistic_iterations
    )


def linear_svms(data: HoldoutData, seeds: list[int], settings: FitSettings) -> list[LinearModel]:
    """Scaled one-vs-rest linear SVMs with squared hinge loss, all splits together (M8)."""
    return fit_svm(data.blocks(seeds), settings.linear_penalty, settings.svm_iterations)


def random_forests(data: HoldoutData, seeds: list[int], settings: FitSettings) -> list[Forest]:
    """The comparison forests: no class weights (M9)."""
    return [forest(data, settings.forest, seed, settings, balanced=False) for seed in seeds]


def boosted_trees(data: HoldoutData, seeds: list[int], settings: FitSettings) -> list[BoostedTrees]:
    """Softmax gradient boosting, the trees of all classes and splits together."""
    params = BoostParams(
        settings.boost_rounds,
        settings.boost_depth,
        settings.boost_rate,
        settings.boost_row_share,
        settings.boost_column_share,
        settings.boost_penalty,
    )
    return fit_boosted_trees(data.blocks(seeds), data.edges(settings.tree_bins), params)


LEARNERS: dict[str, Callable[[HoldoutData, list[int], FitSettings], list]] = {
    "LR": logistic_regressions,
    "SVM": linear_svms,
    "RF": random_forests,
    "GBT": boosted_trees,
}
# Learners whose fits of several splits share their passes over the rows.
TOGETHER = {"LR", "SVM", "GBT"}
DUMMIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "Dummy_most_frequent": most_frequent_predictions,
    "Dummy_stratified": stratified_predictions,
}
MODELS = [*DUMMIES, *LEARNERS]


@dataclass(frozen=True)
class HoldoutData:
    """Everything the repeated fits read: written once, scanned by every fit.

    ``table`` has session_id, user_id, label, features and ``held_out``, the
    seeds for which the session is a validation row; ``splits`` is the long form;
    ``classes`` maps labels to users.
    """

    table: DataFrame
    splits: DataFrame
    seeds: list[int]
    n_rows: int
    n_train: int
    n_features: int
    classes: DataFrame
    n_classes: int
    _packed: dict[tuple[int, ...], Blocks] = field(default_factory=dict)
    _edges: dict[int, list[np.ndarray]] = field(default_factory=dict)
    _lock: Lock = field(default_factory=Lock)

    def blocks(self, seeds: list[int]) -> Blocks:
        """All rows as numpy blocks with the splits of some seeds; packed once."""
        key = tuple(seeds)
        with self._lock:
            if key not in self._packed:
                self._packed[key] = pack(
                    self.table, self.n_rows, self.n_features, self.n_classes, list(seeds)
                )
            return self._packed[key]

    def edges(self, bins: int) -> list[np.ndarray]:
        """What separates the quantile bins of each feature, over all rows; found once."""
        with self._lock:
            if bins not in self._edges:
                self._edges[bins] = bin_edges(self.table, self.n_features, bins)
            return self._edges[bins]

    def release(self) -> None:
        """Lets go of the blocks that the cluster holds."""
        with self._lock:
            for blocks in self._packed.values():
                blocks.release()
            self._packed.clear()

    def train(self, seed: int) -> DataFrame:
        return self.table.where(~F.array_contains("held_out", seed))

    def valid(self, seed: int) -> DataFrame:
        return self.table.where(F.array_contains("held_out", seed))


def prepare_holdout(
    table: DataFrame, features: list[str], seeds: Iterable[int], test_size: float = 0.2
) -> HoldoutData:
    """Vectors, label index and splits of an aligned, labelled table.

    The split flags of all seeds are joined on once, so a fit filters instead of
    joining, whatever the number of seeds and models.
    """
    seeds = list(dict.fromkeys(seeds))
    sizes = split_sizes(table, test_size)
    splits = materialize(stratified_splits(table, seeds, test_size, sizes=sizes), "splits")
    vectors = assemble(table, features, ["session_id", "user_id"])
    classes, n_classes = class_table(table)
    labelled = with_label(vectors, classes, n_classes)
    flagged = labelled.join(held_out_seeds(splits), "session_id")
    stored = materialize(_in_fit_partitions(flagged, sizes.sessions, len(features)), "holdout")
    return HoldoutData(
        stored, splits, seeds, sizes.sessions, sizes.n_train, len(features), classes, n_classes
    )


def _in_fit_partitions(table: DataFrame, rows: int, width: int) -> DataFrame:
    """``table`` in partitions of some 64 MB of features: an iterative fit runs a task
    per partition in every one of its many short jobs."""
    return table.repartition(max(1, -(-rows * (width + 1) * 8 // FIT_PARTITION_BYTES)))


def _named(predictions: DataFrame, classes: DataFrame) -> DataFrame:
    names = classes.select(F.col("label").alias("prediction"), F.col("user_id").alias("named"))
    return predictions.join(names, "prediction")


def learner_predictions(
    data: HoldoutData, model: str, seeds: list[int], settings: FitSettings
) -> dict[int, DataFrame]:
    """Fit one learner on some splits and predict the validation sessions of each."""
    found = {}
    for seed, fitted in zip(seeds, LEARNERS[model](data, seeds, settings)):
        named = _named(fitted.transform(data.valid(seed)), data.classes)
        found[seed] = named.select(
            F.lit(model).alias("model"),
            F.lit(seed).alias("seed"),
            "session_id",
            "user_id",
            F.col("named").alias("prediction"),
        )
    return found


_PREDICTIONS = "model string, seed int, session_id string, user_id string, prediction string"
Job = tuple[list[Fit], Callable[[list[Fit]], dict[Fit, DataFrame]]]


def _model_jobs(data: HoldoutData, model: str, settings: FitSettings, rows: str) -> list[Job]:
    """The fits of one model: a job for all splits where they share their passes."""
    relevant = settings_of(model, settings)
    if model in DUMMIES:
        # One plan covers all seeds.
        fit = Fit(model, digest(rows, model, data.seeds))
        return [([fit], lambda missing: {fit: DUMMIES[model](data.splits)})]
    seed_of = {
        Fit(f"{model}, seed {seed}", digest(rows, model, seed, relevant)): seed
        for seed in data.seeds
    }

    def job(missing: list[Fit]) -> dict[Fit, DataFrame]:
        seeds = [seed_of[fit] for fit in missing]
        found = learner_predictions(data, model, seeds, settings)
        return {fit: found[seed_of[fit]] for fit in missing}

    fits = list(seed_of)
    return [(fits, job)] if model in TOGETHER else [([fit], job) for fit in fits]


def settings_of(model: str, settings: FitSettings) -> dict[str, object]:
    """The settings that the fits of a model depend on."""
    prefixes = {
        "LR": ("linear_", "logistic_"),
        "SVM": ("linear_", "svm_"),
        "RF": ("forest", "tree_bins"),
        "GBT": ("boost_", "tree_bins"),
    }
    chosen = prefixes.get(model, ())
    return {
        name: value
        for name, value in vars(settings).items()
        if chosen and name.startswith(chosen)
    }


def _fingerprint(data: HoldoutData) -> str:
    """What the fits of a holdout depend on; the order of ``held_out`` does not matter."""
    return fingerprint(
        data.table.select(
            "session_id",
            "user_id",
            vector_to_array("features").alias("x"),
            F.array_sort("held_out").alias("held_out"),
        )
    )


def compare_predictions(
    data: HoldoutData,
    settings: FitSettings = FitSettings(),
    models: Iterable[str] = MODELS,
    ledger: Ledger | None = None,
) -> DataFrame:
    """Validation predictions of every (model, seed), one table.

    With a ``ledger``, fits that an earlier run has finished on the same data are read.
    """
    spark = SparkSession.active()
    ledger = ledger or Ledger(spark)
    rows = _fingerprint(data)
    jobs = [job for model in models for job in _model_jobs(data, model, settings, rows)]
    gathered = ledger.run(jobs, settings.parallel_fits, _PREDICTIONS)
    return gathered.select(*PREDICTION_COLUMNS)


def compare_models_repeated(
    table: DataFrame,
    features: list[str],
    seeds: Iterable[int],
    test_size: float = 0.2,
    settings: FitSettings = FitSettings(),
    models: Iterable[str] = MODELS,
    ledger: Ledger | None = None,
) -> DataFrame:
    """Macro-F1 of every model on the same splits: ``(model, seed, macro_f1)``."""
    data = prepare_holdout(table, features, seeds, test_size)
    return macro_f1(compare_predictions(data, settings, models, ledger))


def rank_grid(scores: DataFrame) -> DataFrame:
    """Mean, population deviation, scores by seed and rank per grid point.

    ``scores`` is ``(grid_id, seed, macro_f1)``; equal means keep grid order.
    """
    by_seed = F.sort_array(F.collect_list(F.struct("seed", "macro_f1")))
    means = scores.groupBy("grid_id").agg(
        F.avg("macro_f1").alias("mean"),
        F.stddev_pop("macro_f1").alias("std"),
        by_seed["macro_f1"].alias("scores"),
    )
    # A handful of grid points.
    order = Window.orderBy(F.desc("mean"), "grid_id")
    return means.withColumn("rank", F.row_number().over(order))


def grid_scores(
    data: HoldoutData, settings: FitSettings = FitSettings(), ledger: Ledger | None = None
) -> DataFrame:
    """Macro-F1 of every grid point and seed; forests with class weights per bag."""
    rows = _fingerprint(data)

    def job_of(grid_ids: list[int], seed: int) -> Job:
        grid_id_of = {
            Fit(
                f"grid point {i}, seed {seed}",
                digest(rows, "grid", settings.grid[i], seed, settings.tree_bins),
            ): i
            for i in grid_ids
        }

        def job(missing: list[Fit]) -> dict[Fit, DataFrame]:
            wanted = [grid_id_of[fit] for fit in missing]
            points = [settings.grid[i] for i in wanted]
            found = {}
            for fit, i, fitted in zip(missing, wanted, grid_forests(data, points, seed, settings)):
                named = _named(fitted.transform(data.valid(seed)), data.classes)
                columns = [F.lit(i).alias("grid_id"), F.lit(seed).alias("seed"), "user_id"]
                found[fit] = named.select(*columns, F.col("named").alias("prediction"))
            return found

        return list(grid_id_of), job

    # A job for the points that share their trees.
    alike: dict[tuple[str, int], list[int]] = {}
    for i, params in enumerate(settings.grid):
        alike.setdefault(_kind(params), []).append(i)
    jobs = [job_of(grid_ids, seed) for grid_ids in alike.values() for seed in data.seeds]
    ledger = ledger or Ledger(SparkSession.active())
    schema = "grid_id int, seed int, user_id string, prediction string"
    return macro_f1(ledger.run(jobs, settings.parallel_fits, schema), ["grid_id", "seed"])


def tune_on(
    data: HoldoutData, settings: FitSettings = FitSettings(), ledger: Ledger | None = None
) -> tuple[ForestParams, DataFrame]:
    """:func:`tune_random_forest` on prepared splits."""
    ranked = materialize(rank_grid(grid_scores(data, settings, ledger)), "tuning")
    # Literal map of the grid: as many entries as there are grid points.
    params = F.lit(None)
    for grid_id, p in enumerate(settings.grid):
        point = F.struct(
            F.lit(p.n_estimators).alias("n_estimators"),
            F.lit(p.max_depth).cast("int").alias("max_depth"),
            F.lit(p.max_features).alias("max_features"),
            F.lit(p.min_samples_leaf).alias("min_samples_leaf"),
        )
        params = F.when(F.col("grid_id") == grid_id, point).otherwise(params)
    best = settings.grid[ranked.where("rank = 1").first()["grid_id"]]
    results = ranked.select("rank", "grid_id", params.alias("params"), "mean", "std", "scores")
    return best, results.orderBy("rank")


def tune_random_forest(
    table: DataFrame,
    features: list[str],
    seeds: Iterable[int],
    settings: FitSettings = FitSettings(),
) -> tuple[ForestParams, DataFrame]:
    """The best grid point over repeated splits, and all of them ranked."""
    return tune_on(prepare_holdout(table, features, seeds), settings)


def train_final_random_forest(
    table: DataFrame,
    features: list[str],
    best_parameters: ForestParams = ForestParams(),
    random_state: int = 42,
    settings: FitSettings = FitSettings(),
) -> FinalForest:
    """Fit on all labelled sessions, with class weights balanced within each tree's bag."""
    classes, n_classes = class_table(table)
    vectors = assemble(table, features, ["session_id", "user_id"])
    train = materialize(with_label(vectors, classes, n_classes), "final_train")
    blocks = pack(train, train.count(), len(features), n_classes, [])
    fitted = fit_forest(
        blocks,
        bin_edges(train, len(features), settings.tree_bins),
        best_parameters.n_estimators,
        best_parameters.max_depth,
        best_parameters.max_features,
        best_parameters.min_samples_leaf,
        random_state,
        balanced=True,
    )
    blocks.release()
    return FinalForest(fitted, classes)


@dataclass(frozen=True)
class FinalForest:
    """A fitted forest, whose predictions are labels, and the table of its classes."""

    forest: Forest
    classes: DataFrame


def predict_users(model: FinalForest, table: DataFrame, features: list[str]) -> DataFrame:
    """``(session_id, user_id)`` with a known user for each session."""
    scored = model.forest.transform(assemble(table, features, ["session_id"]))
    return _named(scored, model.classes).select("session_id", F.col("named").alias("user_id"))
