"""Numbers and running sums over a whole table, without a window of one task.

Rows are dealt by ranges of the order, numbered or summed within their range, and what the ranges
before hold is added; there is one row a range to add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, small


def _ranged(spark: SparkSession, df: DataFrame, by: list) -> DataFrame:
    """``df`` written in ranges of ``by``, with ``_part``; ranges rise with it and equal rows share one."""
    return Scratch(spark, "ordered").table(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")


def numbered(spark: SparkSession, df: DataFrame, by: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with places from ``start`` in order of ``by``."""
    x = _ranged(spark, df, [F.col(c) for c in by])
    sums = x.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return x.withColumn("_own", own).join(small(before), "_part").withColumn(name, F.col("_own") + F.col("_before") - 1 + start).drop("_own", "_before", "_part")


def running(spark: SparkSession, df: DataFrame, by: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """``df`` with running sums (new column: summed column) in order of ``by``; equal rows count together."""
    order = F.col(by).desc() if descending else F.col(by)
    x = _ranged(spark, df, [order])
    totals = x.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    all_before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = small(totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(all_before), F.lit(0)).alias(f"_{n}") for n in sums]))
    own = Window.partitionBy("_part").orderBy(order)
    y = x.withColumns({n: F.sum(c).over(own) for n, c in sums.items()}).join(before, "_part")
    return y.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def running_max(spark: SparkSession, df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """``df`` with the greatest ``value`` up to each row in order of ``by``."""
    x = _ranged(spark, df, [F.col(by)])
    tops = x.groupBy("_part").agg(F.max(value).alias("_top"))
    before = tops.select("_part", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    y = x.withColumn(name, F.max(value).over(Window.partitionBy("_part").orderBy(by))).join(small(before), "_part")
    return y.select(*df.columns, F.greatest(name, "_before").alias(name))
