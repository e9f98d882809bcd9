"""Prediction sink (S5): whole or not at all."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Readers of a folder skip names that begin with an underscore.
MANIFEST = "_manifest.json"


def _checksum() -> tuple[Column, Column]:
    """Number of rows, and a sum over hashes of the rows that no order changes. CSV does not
    tell an empty text from NULL, so the sum does not either."""
    parts = [F.coalesce(c, F.lit("")) for c in ("session_id", "user_id")]
    row = F.pmod(F.xxhash64(*parts), F.lit(1 << 31))
    return F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0)).alias("checksum")


def _file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Write ``session_id,user_id`` as CSV with a header, sorted by session.

    The sort is a range shuffle, so the part files are in order too; who needs one
    file concatenates them.

    Everything goes to a staging folder beside ``path`` first, with a manifest of row count and
    checksum that were counted while writing. Only then the former output steps aside, the staging
    folder gets its name by one rename, and the former output goes. A run that dies before leaves the
    former output as it was; what it staged is in the way of nothing.
    """
    spark, path = predictions.sparkSession, path.rstrip("/")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    counted = Observation("predictions")
    chosen = predictions.select(
        F.col("session_id").cast("string"), F.col("user_id").cast("string")
    )
    # Behind the exchange, whose sampling would count the rows once more.
    out = chosen.orderBy("session_id").observe(counted, *_checksum())
    out.write.option("header", True).csv(staging)
    files, staged = _file_system(spark, staging)
    manifest = {"columns": ["session_id", "user_id"], **counted.get}
    _, place = _file_system(spark, f"{staging}/{MANIFEST}")
    stream = files.create(place)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    _swap(files, staged, _file_system(spark, path)[1], _file_system(spark, f"{staging}.former")[1])


def _swap(files: Any, staged: Any, final: Any, former: Any) -> None:
    had_former = files.exists(final)
    if had_former and not files.rename(final, former):
        raise OSError(f"cannot move {final} aside")
    if not files.rename(staged, final):
        if had_former:
            files.rename(former, final)
        raise OSError(f"cannot move {staged} to {final}")
    if had_former:
        files.delete(former, True)


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    """Row count, checksum and columns of a written output."""
    files, place = _file_system(spark, f"{path.rstrip('/')}/{MANIFEST}")
    stream = files.open(place)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The predictions under ``path``; ``ValueError`` if they are not those of the manifest."""
    manifest = read_manifest(spark, path)
    schema = "session_id string, user_id string"
    rows = spark.read.schema(schema).option("header", True).csv(path)
    found = rows.agg(*_checksum()).first()
    if (found["rows"], found["checksum"]) != (manifest["rows"], manifest["checksum"]):
        raise ValueError(f"{path} does not hold what its manifest says")
    return rows
