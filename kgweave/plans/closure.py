"""Closures by semi-naive rounds: only pairs that are new meet the base facts again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import Rule, chains
from .scratch import Scratch


def compose(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (h, t) with left(h, z) and right(z, t)."""
    r = right.select(F.col("h").alias("z"), F.col("t").alias("to"))
    return left.join(r, left.t == r.z).select("h", F.col("to").alias("t")).distinct()


def transitive_closure(spark: SparkSession, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(h, t, depth): pairs joined by a path of edges, with the length of the shortest.

    edges: (h, t). Without ``max_depth`` it runs until nothing is new, cycles included.
    """
    scratch = Scratch(spark, "closure")
    base = edges.select("h", "t").distinct()
    delta = scratch.table(base.withColumn("depth", F.lit(1)), "delta")
    seen, depth = delta, 1
    while (max_depth is None or depth < max_depth) and not delta.isEmpty():
        depth += 1
        step = compose(delta, base).join(seen, ["h", "t"], "left_anti").withColumn("depth", F.lit(depth))
        delta = scratch.table(step, "delta")
        seen = seen.unionByName(delta)
    return seen


def chain_closure(spark: SparkSession, facts: DataFrame, rules: list[Rule], max_rounds: int | None = None) -> DataFrame:
    """(pred, h, t) that two-atom chain rules derive from ``facts`` (pred, h, t), facts included.

    Every rule of a head counts. In each round at least one side of a composition is new.
    """
    scratch, program = Scratch(spark, "chains"), chains(rules)
    total = scratch.table(facts.select("pred", "h", "t").distinct(), "facts")
    delta, rounds = total, 0
    while program and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        step = None
        for head, one, flip1, two, flip2 in program:
            for a, b in ((delta, total), (total, delta)):
                pair = compose(_of(a, one, flip1), _of(b, two, flip2)).select(F.lit(head).alias("pred"), "h", "t")
                step = pair if step is None else step.unionAll(pair)
        delta = scratch.table(step.distinct().join(total, ["pred", "h", "t"], "left_anti"), "delta")
        if delta.isEmpty():
            break
        total = total.unionByName(delta)
    return total


def _of(facts: DataFrame, pred: str, flipped: bool) -> DataFrame:
    h, t = ("t", "h") if flipped else ("h", "t")
    return facts.where(F.col("pred") == pred).select(F.col(h).alias("h"), F.col(t).alias("t"))
