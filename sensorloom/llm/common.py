"""What several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Writes a table under a name and returns a scan of it: ``materialize`` for what has to
# last, the method of a ``ScratchTables`` for what may go when the operator is done.
Store = Callable[[DataFrame, str], DataFrame]

# Text bytes that a Python function looks at together.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_of(df: DataFrame, column: str) -> str:
    """DDL type of a column."""
    return df.schema[column].dataType.simpleString()


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no piece holds much more than ``limit`` bytes of ``column``.

    A single longer value is a piece of its own, so what is held at once is
    bounded by the limit or the longest value.
    """
    start, held = 0, 0
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    for row, size in enumerate(sizes):
        size = size or 0
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_slices(
    df: DataFrame,
    text: str,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: StructType | str,
) -> DataFrame:
    """``mapInArrow`` over slices that are balanced by the bytes of ``text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_slices(batch, text):
                yield function(piece)

    return df.mapInArrow(run, schema)


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (string, null read as empty) of any table with both."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def free_name(docs: DataFrame, wanted: str) -> str:
    """``wanted`` as the name of a new column, with as many ``_`` behind it as it takes to differ
    from every column of ``docs``, in upper or lower case."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
