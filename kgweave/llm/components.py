"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours the smallest node it knows."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(edges.select(F.col("v").alias("n"), F.col("u").alias("m"))).groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("m"))
    out = both.join(least, both.u == least.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours and itself to the smallest of them (edges have u > v)."""
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    out = edges.join(least, edges.u == least.n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns of one ordered type, any direction).

    root is the smallest node of the component; a root has no row. Each round is written to the
    shared scratch folder; stops when a round changes nothing. Loops and null ends are dropped.
    Hubs meet only in joins on shuffled keys, which AQE splits, and in partial aggregates.
    """
    a, b = edges.columns
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    now = scratch.table(pair, "edges")
    seen = _digest(now)
    while seen[0]:
        nxt = scratch.table(_small_star(_large_star(now)), "star")
        scratch.drop(now)
        now, before, seen = nxt, seen, _digest(nxt)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
