"""Intermediate tables that outlive executors.

A stage result that several later jobs read is written as Parquet under the
shared folder the cluster names in ``spark.checkpoint.dir`` and read back. That
cuts the lineage (a lost executor never sends us back to the raw events) and
keeps the data columnar, so later readers still prune columns.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

Result = TypeVar("Result")

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session.

    ``spark.checkpoint.dir`` wins. Where it is unset, a temporary folder is made
    for a local master only; on a cluster a machine-local folder would be
    invisible to the other machines, so that is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(
            "spark.checkpoint.dir must name a shared folder when running on a cluster"
        )
    if context.applicationId not in _local_roots:
        root = tempfile.mkdtemp(prefix="sensorloom-")
        # Ours alone, and gone with this process.
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _local_roots[context.applicationId] = root
    return _local_roots[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the scratch folder that nothing has used before."""
    return f"{scratch_root(spark)}/sensorloom/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new scratch table and return a scan of that table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class ScratchTables:
    """Scratch tables of one piece of work, all in one folder that goes as a whole.

    Used as a context: whatever :meth:`materialize` wrote is deleted at the end, so
    only results that do not read it any more may be handed out. What has to
    outlive it is written by the plain :func:`materialize`.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = fresh_path(spark, "work")

    def __enter__(self) -> ScratchTables:
        return self

    def materialize(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *failure: object) -> None:
        delete_folder(self.spark, self.folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of our own in whatever file system it lies."""
    if "/sensorloom/" not in folder:
        raise ValueError(f"{folder} is not a scratch folder")
    if not hasattr(spark, "_jvm"):
        # A remote session reaches no file system; the folder's owner expires it.
        return
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_parallel(
    spark: SparkSession, tasks: list[Callable[[], Result]], at_a_time: int
) -> list[Result]:
    """Run actions from a few driver threads, so that their stages share the cluster."""

    def run(task: Callable[[], Result]) -> Result:
        return task()

    with ThreadPoolExecutor(max_workers=max(1, at_a_time)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), tasks))
