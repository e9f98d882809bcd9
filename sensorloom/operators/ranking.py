"""Ranks and running totals without one task per group.

``row_number() over (partition by g order by x)`` puts a whole group into one
task. Here the caller names a *bin*: a value that grows with the order and cuts
every group into pieces of bounded size. Bins are counted (map-side partial),
the counts are accumulated per group over the bins, and only the rows of one bin
are sorted together. The result is the exact rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a table that a join may send to all machines by way of the driver.
SENT_ROWS = 100_000


def sized(df: DataFrame, n_rows: int) -> DataFrame:
    """``df``, of at most ``n_rows`` rows, marked for the join it goes into.

    Left alone, Spark goes by bytes on disk, and names and small numbers are packed there to a
    thirtieth of what the driver then holds.
    """
    return F.broadcast(df) if n_rows <= SENT_ROWS else df.hint("merge")


def binned_running_total(
    df: DataFrame, group: list[str], bin_col: str, order: list[Column | str], weight: Column
) -> DataFrame:
    """Adds ``before``: the total ``weight`` of the rows ahead in (bin, order)."""
    bins = df.groupBy(*group, bin_col).agg(F.sum(weight).alias("bin_total"))
    earlier_bins = (
        Window.partitionBy(*group)
        .orderBy(bin_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = bins.select(
        *group,
        bin_col,
        F.coalesce(F.sum("bin_total").over(earlier_bins), F.lit(0)).alias("offset"),
    )
    earlier_rows = (
        Window.partitionBy(*group, bin_col)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    in_bin = F.coalesce(F.sum(weight).over(earlier_rows), F.lit(0))
    # Merged whatever its size: the windows above need the same exchange.
    return (
        df.join(offsets.hint("merge"), [*group, bin_col])
        .withColumn("before", F.col("offset") + in_bin)
        .drop("offset")
    )


def binned_rank(
    df: DataFrame,
    group: list[str],
    bin_col: str,
    order: list[Column | str],
    one_bin: bool = False,
) -> DataFrame:
    """Adds ``position``: 1, 2, ... within ``group`` by (bin, order).

    ``one_bin``: the caller has checked that whole groups are small enough to be
    sorted in one task each; a plain window then saves the counting and a join.
    """
    if one_bin:
        window = Window.partitionBy(*group).orderBy(bin_col, *order)
        return df.withColumn("position", F.row_number().over(window))
    counted = binned_running_total(df, group, bin_col, order, F.lit(1))
    return counted.withColumn("position", F.col("before") + 1).drop("before")
