"""Helpers shared by the training-data operators: scratch tables, joins of checked size, row packing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.plans.scratch import Scratch, small  # noqa: F401  the operators take them from here


#: What operators keep in a Python worker from task to task.
KEPT: list[dict] = []


def release() -> None:
    """Forget what other operators keep in this worker, and hand the memory back to the system; called
    where a stage without need of it begins."""
    if not any(KEPT):
        return
    for cache in KEPT:
        cache.clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python gets at most so many rows at once in what is run inside; for rows that are wide."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns also packed in the struct ``_row``, under names that can't clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
