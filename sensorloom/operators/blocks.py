"""Rows of a training table as numpy blocks, for fits that scan them many times.

An iterative fit runs hundreds of short passes over the same rows. Packed once into blocks
of some megabytes, a pass is one task per partition with matrix arithmetic inside, and what
comes back is a sum of a size that does not depend on the number of rows. Blocks
are written to a scratch table first, so a lost executor sends us back to that table only.
"""

from __future__ import annotations

import operator
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.sources.scratch import materialize

# Bytes of features of one block, and of one partition of blocks.
BLOCK_BYTES = 4 << 20
PARTITION_BYTES = 64 << 20
# Fewer rows are not worth a task of their own.
LEAST_ROWS = 512
# Partial sums that are gathered without an exchange between tasks.
GATHERED = 64


class Block(NamedTuple):
    """Some rows: a hash of each row's key, its class, its features, and which fits hold it out."""

    id: str
    keys: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    held: np.ndarray


@dataclass(frozen=True)
class Blocks:
    """All rows; ``seeds`` numbers the fits (first axis of ``held``)."""

    rdd: RDD
    n_rows: int
    n_features: int
    n_classes: int
    seeds: list[int]

    @property
    def spark(self) -> SparkSession:
        return SparkSession.active()

    def release(self) -> None:
        self.rdd.unpersist()


def pack(table: DataFrame, n_rows: int, n_features: int, n_classes: int, seeds: list[int]) -> Blocks:
    """Packs ``session_id, label, features`` and, if there, ``held_out`` (array of seeds)."""
    held = F.col("held_out") if "held_out" in table.columns else F.array().cast("array<int>")
    context = table.sparkSession.sparkContext
    width = max(1, n_features) * 8
    per_block = max(1, BLOCK_BYTES // width)
    by_size = -(-n_rows * width // PARTITION_BYTES)
    cores = context.defaultParallelism
    n_parts = max(1, by_size, min(cores, n_rows // LEAST_ROWS))
    if n_parts > cores:
        # Passes are many and short: no core waits for the last few partitions.
        n_parts = -(-n_parts // cores) * cores
    rows = table.select(
        F.xxhash64("session_id").alias("key"),
        F.col("label").cast("int").alias("label"),
        vector_to_array("features").alias("x"),
        held.alias("held"),
    ).repartition(n_parts)
    names = ["id", "n", "keys", "labels", "x", "held"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, per_block):
                part = batch.slice(start, per_block)
                out = np.zeros((len(seeds), part.num_rows), bool)
                for row, chosen in enumerate(part["held"].to_pylist()):
                    for seed in chosen or ():
                        if seed in place:
                            out[place[seed], row] = True
                values = part["x"].flatten().to_numpy(zero_copy_only=False)
                columns = [
                    [uuid.uuid4().hex],
                    [part.num_rows],
                    [part["key"].to_numpy().astype("<i8").tobytes()],
                    [part["label"].to_numpy().astype("<i4").tobytes()],
                    [values.astype("<f8").tobytes()],
                    [out.tobytes()],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    place = {seed: i for i, seed in enumerate(seeds)}
    packed = materialize(
        rows.mapInArrow(
            run, "id string, n bigint, keys binary, labels binary, x binary, held binary"
        ),
        "blocks",
    )

    def unpack(row: Any) -> Block:
        return Block(
            row["id"],
            np.frombuffer(row["keys"], "<i8").view(np.uint64),
            np.frombuffer(row["labels"], "<i4"),
            np.frombuffer(row["x"], "<f8").reshape(row["n"], n_features),
            np.frombuffer(row["held"], bool).reshape(len(seeds), row["n"]),
        )

    rdd = packed.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)
    return Blocks(rdd, n_rows, n_features, n_classes, list(seeds))


def summed(rdd: RDD, function: Callable[[Any], Any], gathered: int = GATHERED) -> Any:
    """The sum of ``function`` over all blocks; None without blocks.

    Each task adds up its own blocks; with many tasks, their sums are added up on the way, about
    ``gathered`` by a task, before at most as many come to the driver.
    """

    def of_task(blocks: Iterable[Any]) -> Iterator[Any]:
        total = None
        for block in blocks:
            part = function(block)
            total = part if total is None else operator.iadd(total, part)
        if total is not None:
            yield total

    parts = rdd.mapPartitions(of_task)
    n = rdd.getNumPartitions()
    while n > gathered:
        n = -(-n // gathered)
        parts = _merged(parts, n)
    total = None
    for part in parts.collect():
        total = part if total is None else total + part
    return total


def _merged(parts: RDD, n: int) -> RDD:
    """Sums of neighbouring partial sums, in ``n`` tasks."""
    keyed = parts.mapPartitionsWithIndex(lambda i, rows: ((i % n, row) for row in rows))
    return keyed.reduceByKey(operator.add, n).values()


class WorkerCache:
    """What a worker process keeps between tasks, up to a number of bytes.

    It only saves work: whatever is missing is made anew from the block.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.held: OrderedDict[Any, tuple[Any, int]] = OrderedDict()
        self.size = 0

    def get(self, key: Any) -> Any:
        found = self.held.get(key)
        if found is None:
            return None
        self.held.move_to_end(key)
        return found[0]

    def put(self, key: Any, value: Any, size: int) -> None:
        self.drop(key)
        self.held[key] = (value, size)
        self.size += size
        while self.size > self.limit and len(self.held) > 1:
            _, (_, gone) = self.held.popitem(last=False)
            self.size -= gone

    def drop(self, key: Any) -> None:
        if key in self.held:
            self.size -= self.held.pop(key)[1]


def predicted(table: DataFrame, model: Any) -> DataFrame:
    """Adds ``prediction``, the label with the greatest of ``model.margins`` (the first of equals),
    in place of ``features``."""
    sent = table.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in table.columns if c != "features"]
    # Last, and under no name that a table's own column could have.
    rows = table.select(*kept, vector_to_array("features")).toDF(
        *[f"c{i}" for i in range(len(kept) + 1)]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(kept)).flatten().to_numpy(zero_copy_only=False)
            x = x.reshape(batch.num_rows, -1)
            best = sent.value.margins(x).argmax(1) if len(x) else np.zeros(0)
            columns = [*batch.columns[: len(kept)], pa.array(best.astype(float))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [f"c{i}" for i in range(len(kept))] + ["prediction"]
    schema = rows.select(*names[:-1]).schema.add("prediction", "double")
    return rows.mapInArrow(run, schema).toDF(*kept, "prediction")
