"""Event tables: schemas, readers, audit and preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.columns import MEASUREMENTS

# The event columns in file order and their types.
_COLUMNS = {
    "uid": T.StringType(),
    "timestamp": T.LongType(),
    "sensor_type": T.StringType(),
    **{measurement: T.DoubleType() for measurement in MEASUREMENTS},
    "session_id": T.StringType(),
    "user_id": T.StringType(),
}

LABEL = "user_id"
TRAIN_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in _COLUMNS.items()])
TEST_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in _COLUMNS.items() if n != LABEL])


# Holds a CSV line that does not fit the schema.
_BAD_LINE = "_bad_line"


def read_events(
    spark: SparkSession,
    path: str,
    labelled: bool,
    fmt: str = "csv",
    bad_fields: Observation | None = None,
) -> DataFrame:
    """Scan an event table under its fixed schema.

    CSV: a bad number is NULL (permissive mode), the text ``NaN`` is a real NaN,
    an empty cell is NULL. The header must name the columns in schema order:
    with Spark's default a reordered file would be bound by position, so that
    check is switched on here.

    Parquet: columns are found by name and cast to the schema; only the columns
    a query uses are read.

    ``bad_fields`` counts on the way, in the first action on the table, per column the CSV
    fields that were there and became NULL, and as ``bad_lines`` the lines with such a field or with
    too few or too many fields. Every field is then parsed in that pass.
    """
    schema = TRAIN_SCHEMA if labelled else TEST_SCHEMA
    if fmt == "csv":
        options = {"header": True, "enforceSchema": False}
        if bad_fields is None:
            return spark.read.schema(schema).options(**options).csv(path)
        noted = T.StructType([*schema.fields, T.StructField(_BAD_LINE, T.StringType(), True)])
        reader = spark.read.schema(noted).options(**options, columnNameOfCorruptRecord=_BAD_LINE)
        return _counted(reader.csv(path), schema, bad_fields)
    if fmt == "parquet":
        return conform(spark.read.parquet(path), labelled)
    raise ValueError(f"unsupported event format: {fmt}")


def _counted(lines: DataFrame, schema: T.StructType, bad_fields: Observation) -> DataFrame:
    """Counts what could not be parsed while the lines pass by."""
    texts = ", ".join(f"`{f.name}` string" for f in schema)
    # Only lines that did not fit are taken apart once more.
    raw = F.from_csv(F.col(_BAD_LINE), texts)
    lost = [
        F.count_if(raw[f.name].isNotNull() & F.col(f.name).isNull()).alias(f.name) for f in schema
    ]
    bad_lines = F.count_if(F.col(_BAD_LINE).isNotNull()).alias("bad_lines")
    return lines.observe(bad_fields, *lost, bad_lines).drop(_BAD_LINE)


def bad_field_table(spark: SparkSession, table_name: str, bad_fields: Observation) -> DataFrame:
    """``table_name, column_name, n_bad``: what an observation of :func:`read_events` has counted;
    waits for the first action on that table."""
    rows = [(table_name, name, count) for name, count in bad_fields.get.items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, n_bad bigint")


def conform(df: DataFrame, labelled: bool) -> DataFrame:
    """Select and cast any table that has the event columns to the event schema."""
    schema = TRAIN_SCHEMA if labelled else TEST_SCHEMA
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def load_train_data(
    spark: SparkSession, path: str, fmt: str = "csv", bad_fields: Observation | None = None
) -> DataFrame:
    """Labelled events (13 columns)."""
    return read_events(spark, path, True, fmt, bad_fields)


def load_test_data(
    spark: SparkSession, path: str, fmt: str = "csv", bad_fields: Observation | None = None
) -> DataFrame:
    """Unlabelled events (12 columns)."""
    return read_events(spark, path, False, fmt, bad_fields)


def write_events(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Store an event table in a form :func:`read_events` takes back."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported event format: {fmt}")


def dataset_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, sessions, users and columns of each table, one output row per table.

    Each table is first cut down to one row per (session, user) with map-side
    aggregation, so the distinct counts never expand the raw rows. Tables
    without ``user_id`` report no users.
    """
    audits = []
    for name, df in tables.items():
        labelled = LABEL in df.columns
        keys = ["session_id", LABEL] if labelled else ["session_id"]
        grain = df.groupBy(*keys).agg(F.count("*").alias("rows"))
        users = F.countDistinct(LABEL) if labelled else F.lit(None).cast("bigint")
        audits.append(
            grain.agg(
                F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"),
                F.countDistinct("session_id").alias("n_sessions"),
                users.alias("n_users"),
            ).select(
                F.lit(name).alias("table_name"),
                "n_rows",
                "n_sessions",
                "n_users",
                F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
            )
        )
    result = audits[0]
    for audit in audits[1:]:
        result = result.unionByName(audit)
    return result


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows; with ``order_by`` a repeatable top-n."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
