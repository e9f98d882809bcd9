"""Finished fits that outlive a failed run.

Hundreds of fits take hours on a cluster, and one of them may fail. Each fit's result is a Parquet
table of its own, under a name made of what it depends on: the data, the model, the seed and the
settings. Spark's commit mark says that it is whole. A run that meets failures finishes
everything else first and then raises; the next run with the same ledger folder reads what is
finished and fits the rest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, is_dataclass
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sensorloom.sources.scratch import fresh_path, in_parallel

# Spark writes it when all files of a table are in place.
COMMIT_MARK = "_SUCCESS"


class FitsFailed(RuntimeError):
    """Some fits failed; ``failures`` has (name, exception) pairs. The others are stored."""

    def __init__(self, failures: list[tuple[str, Exception]]):
        names = ", ".join(name for name, _ in failures)
        super().__init__(f"{len(failures)} fits failed ({names}): {failures[0][1]}")
        self.failures = failures


def fingerprint(table: DataFrame) -> str:
    """A digest of all rows and columns, whatever their order."""
    row = F.xxhash64(*table.columns)
    # Two halves, so that no sum overflows below 2^31 rows.
    low, high = F.pmod(row, F.lit(1 << 32)), F.shiftright(row, 32)
    sums = table.agg(F.count("*").alias("n"), F.sum(low).alias("low"), F.sum(high).alias("high"))
    types = json.dumps(table.dtypes)
    return hashlib.sha256(f"{types}{tuple(sums.first())}".encode()).hexdigest()


def digest(*parts: Any) -> str:
    """A name for a combination of plain values and dataclasses."""

    def plain(value: Any) -> Any:
        return asdict(value) if is_dataclass(value) else str(value)

    text = json.dumps(parts, default=plain, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


@dataclass(frozen=True)
class Fit:
    """One table of results: its name, what it depends on, and the schema it has."""

    name: str
    key: str


class Ledger:
    """Finished fits in a folder; without a folder in a new one that nobody reads again."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or fresh_path(spark, "ledger")).rstrip("/")

    def path(self, fit: Fit) -> str:
        return f"{self.folder}/{fit.key}"

    def finished(self, fit: Fit) -> bool:
        jvm = self.spark.sparkContext._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.path(fit)}/{COMMIT_MARK}")
        return mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)

    def store(self, fit: Fit, rows: DataFrame) -> None:
        """Writes the result of a fit; what an earlier attempt left there goes."""
        rows.write.mode("overwrite").parquet(self.path(fit))

    def run(
        self,
        jobs: list[tuple[list[Fit], Callable[[list[Fit]], dict[Fit, DataFrame]]]],
        at_a_time: int,
        schema: StructType | str,
    ) -> DataFrame:
        """Does what is not finished and gathers the rows of all fits.

        A job answers for several fits at once: it gets those of its fits that are missing and
        returns their rows. Jobs run ``at_a_time``; one that fails does not stop the others.
        """
        fits = [fit for wanted, _ in jobs for fit in wanted]
        if not fits:
            raise ValueError("no model or no seed to fit")

        def attempt(wanted: list[Fit], job: Callable) -> list[tuple[str, Exception]]:
            missing = [fit for fit in wanted if not self.finished(fit)]
            if not missing:
                return []
            try:
                found = job(missing)
            except Exception as error:  # every other fit still gets its turn
                return [(", ".join(fit.name for fit in missing), error)]
            failures = []
            for fit in missing:
                try:
                    self.store(fit, found[fit])
                except Exception as error:
                    failures.append((fit.name, error))
            return failures

        tasks = [partial(attempt, wanted, job) for wanted, job in jobs]
        failures = [f for found in in_parallel(self.spark, tasks, at_a_time) for f in found]
        if failures:
            raise FitsFailed(failures) from failures[0][1]
        return self.spark.read.schema(schema).parquet(*[self.path(fit) for fit in fits])
