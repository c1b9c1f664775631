"""Positions in a total order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_ordinal(df: DataFrame, coarse: Column, fine: list[Column], name: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row by (coarse, fine).

    Rows are numbered within each value of ``coarse``; a running sum over the counts of those
    values gives the offsets. Only the table of counts is ordered as a whole.
    """
    tagged = df.withColumn("_c", coarse)
    counts = tagged.groupBy("_c").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_c").alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    placed = tagged.withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy(*fine)))
    joined = placed.join(offsets, F.col("_c").eqNullSafe(F.col("_k")))
    return joined.withColumn(name, F.col("_o") + F.col("_r") - 1).drop("_c", "_k", "_o", "_r")


def running_total(df: DataFrame, parts: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Add the inclusive running sum of ``value`` within ``parts``."""
    w = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


#: Places in an order that a task handles together.
STRETCH = 1 << 16


def running_count(df: DataFrame, flag: Column, order: str, name: str) -> DataFrame:
    """Add ``name``: how many rows up to and with this one have the flag, by the number ``order``.

    Rows are counted within stretches of the order; only the table of one row a stretch is summed as a whole.
    """
    tagged = df.withColumns({"_s": F.floor(F.col(order) / STRETCH), "_f": F.coalesce(flag.cast("bigint"), F.lit(0).cast("bigint"))})
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = tagged.groupBy("_s").agg(F.sum("_f").alias("_n")).select(F.col("_s").alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    within = F.sum("_f").over(Window.partitionBy("_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return tagged.withColumn("_r", within).join(sums, F.col("_s") == F.col("_k")).withColumn(name, F.col("_o") + F.col("_r")).drop("_s", "_f", "_k", "_o", "_r")


def last_known(df: DataFrame, value: Column, order: str, name: str) -> DataFrame:
    """Add ``name``: the last value that isn't null up to and with this row, in the same way."""
    tagged = df.withColumns({"_s": F.floor(F.col(order) / STRETCH), "_v": value})
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ends = tagged.groupBy("_s").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_e")).select(F.col("_s").alias("_k"), F.last("_e", ignorenulls=True).over(before).alias("_o"))
    within = F.last("_v", ignorenulls=True).over(Window.partitionBy("_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return tagged.withColumn("_r", within).join(ends, F.col("_s") == F.col("_k")).withColumn(name, F.coalesce("_r", "_o")).drop("_s", "_v", "_k", "_o", "_r")
