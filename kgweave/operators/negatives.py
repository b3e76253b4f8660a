"""Negatives of known triples: of either side or both, over all entities or a domain, and of relations.

Draws are arithmetic hashes of (query, number), so any engine repeats them and no state is kept.
Pools carry each member's place from 0, so a draw is an equi-join on (domain, place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ordered import numbered
from ..plans.scratch import small
from .graph import draw, novel

SIDES = {"head": ("h",), "tail": ("t",), "both": ("h", "t")}


def placed(spark: SparkSession, pool: DataFrame, by: str = "entity") -> DataFrame:
    """(domain, entity, place, size): members of each domain from 0 in order of ``by``."""
    x = numbered(spark, pool, ["domain", by], "_at")
    bounds = x.groupBy("domain").agg(F.min("_at").alias("_first"), F.count("*").alias("size"))
    return x.join(small(bounds), "domain").select("domain", "entity", (F.col("_at") - F.col("_first")).alias("place"), "size")


def shares(mode: str, k: int) -> dict[str, int]:
    """How many of k negatives each side gets; what does not divide goes to the first."""
    sides = SIDES[mode]
    return {s: k // len(sides) + (i < k % len(sides)) for i, s in enumerate(sides)}


def _replaced(side: str, new: Column) -> list[Column]:
    return ["pred", *[(new if c == side else F.col(c)).alias(c) for c in ("h", "t")]]


def corrupt(queries: DataFrame, pool: DataFrame, mode: str = "tail", k: int | None = None, seed: int = 17, known: DataFrame | None = None) -> DataFrame:
    """(qid, side, pred, h, t): ``k`` negatives of each query (qid long, pred, h, t), or all of them.

    pool: (domain, entity, place, size) of ``placed``; a side is replaced by another member of the
    domain that its entity is in. A domain for all makes draws uniform. The only member of a domain
    keeps its place. With ``known`` (pred, h, t), known triples and repeats go, and nothing is drawn
    in their place, so fewer than k may be left; without it every draw is a row.
    """
    out = None
    own = pool.select(F.col("entity").alias("_e"), F.col("domain").alias("_d"), F.col("place").alias("_p"), "size")
    to = pool.select(F.col("domain").alias("_td"), F.col("entity").alias("_new"), F.col("place").alias("_tp"))
    for side, n in (shares(mode, k) if k is not None else dict.fromkeys(SIDES[mode], 0)).items():
        x = queries.select("qid", "pred", "h", "t").join(own, F.col(side) == F.col("_e"))
        if k is None:
            x = x.join(to, (F.col("_d") == F.col("_td")) & (F.col("_tp") != F.col("_p")))
        else:
            if not n:
                continue
            x = x.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            at = draw(F.col("qid") * k + F.col("_j"), seed, F.greatest(F.col("size") - 1, F.lit(1)))
            x = x.withColumn("_at", F.when(F.col("size") == 1, F.col("_p")).when(at >= F.col("_p"), at + 1).otherwise(at))
            x = x.join(to, (F.col("_d") == F.col("_td")) & (F.col("_at") == F.col("_tp")))
        part = x.select("qid", F.lit("head" if side == "h" else "tail").alias("side"), *_replaced(side, F.col("_new")))
        out = part if out is None else out.unionAll(part)
    return filtered(out, known) if known is not None else out


def filtered(negatives: DataFrame, known: DataFrame) -> DataFrame:
    """Negatives without known triples and without repeats of a query's."""
    return novel(negatives.dropDuplicates(["qid", "pred", "h", "t"]), known).select(*negatives.columns)


def ordered(negatives: DataFrame) -> DataFrame:
    """Negatives with their place in their query, from 1, by relation, head and tail."""
    return negatives.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("pred", "h", "t")))


def bernoulli_corrupt(queries: DataFrame, pool: DataFrame, p_head: DataFrame, n: int, seed: int = 23) -> DataFrame:
    """(qid, k, side, pred, h, t): n negatives a query, all of one side, unfiltered.

    p_head: (pred, p_head); a relation without one has a half. The side is the head if a hash of the
    query falls below it. Entities are drawn from the whole pool (entity, place, size).
    """
    side = F.when(draw(F.col("qid"), seed, F.lit(1000003)) / 1000003 < F.coalesce("p_head", F.lit(0.5)), "head").otherwise("tail")
    x = queries.join(small(p_head.select("pred", "p_head")), "pred", "left").select("qid", "pred", "h", "t", side.alias("side"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    size = pool.select(F.max("size").alias("_size"))
    x = x.crossJoin(F.broadcast(size)).withColumn("_at", draw(F.col("qid") * n + F.col("k"), seed + 1, F.col("_size")))
    x = x.join(pool.select(F.col("place").alias("_p"), F.col("entity").alias("_new")), F.col("_at") == F.col("_p"))
    head = F.col("side") == "head"
    return x.select("qid", "k", "side", "pred", F.when(head, F.col("_new")).otherwise(F.col("h")).alias("h"), F.when(head, F.col("t")).otherwise(F.col("_new")).alias("t"))


def corrupt_relations(queries: DataFrame, relations: DataFrame, n: int, seed: int = 29) -> DataFrame:
    """(qid, k, pred, h, t): n draws a query of another relation; relations: (pred, place), from 0."""
    size = relations.agg(F.count("*").alias("_size"))
    own = relations.select("pred", F.col("place").alias("_p"))
    x = queries.join(small(own), "pred").crossJoin(F.broadcast(size)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = draw(F.col("qid") * n + F.col("k"), seed, F.greatest(F.col("_size") - 1, F.lit(1)))
    x = x.withColumn("_at", F.when(F.col("_size") == 1, F.col("_p")).when(at >= F.col("_p"), at + 1).otherwise(at))
    new = small(relations.select(F.col("pred").alias("_new"), F.col("place").alias("_np")))
    return x.join(new, F.col("_at") == F.col("_np")).select("qid", "k", F.col("_new").alias("pred"), "h", "t")


def sampled_candidates(queries: DataFrame, pool: DataFrame, known: DataFrame, n: int, side: str = "t", seed: int = 31) -> DataFrame:
    """(qid, entity): n of the pool's members that make no known triple with a query, all if fewer.

    pool: (domain, entity, place, size), the domain of the side's entity. The query's own triple is
    known. The n are the first by a hash, kept a query before the shuffle.
    """
    own = queries.select("qid", "pred", "h", "t").join(pool.select(F.col("entity").alias(side), F.col("domain").alias("_d")), side)
    all_ = own.join(pool.select(F.col("domain").alias("_d"), "entity", "place"), "_d").where(F.col("entity") != F.col(side))
    x = novel(all_.select("qid", "place", "entity", *_replaced(side, F.col("entity"))), known)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(draw(F.col("qid") * 31 + F.col("place"), seed, F.lit(1000003)), "place"))
    return x.withColumn("_r", rank).where(F.col("_r") <= n).select("qid", "entity")


def corrupt_states(states: DataFrame, pool: DataFrame, mode: str, k: int, seed: int = 37) -> DataFrame:
    """(sid, side, atoms): k negatives of each state (sid long, atoms: array of (p, a, b)), which
    replace an argument of its first atom; the other atoms stay."""
    first = states.select(F.col("sid").alias("qid"), F.get("atoms", F.lit(0))["p"].alias("pred"), F.get("atoms", F.lit(0))["a"].alias("h"), F.get("atoms", F.lit(0))["b"].alias("t"))
    x = corrupt(first, pool, mode, k, seed).join(states, F.col("qid") == F.col("sid"))
    rest = F.slice("atoms", 2, F.greatest(F.size("atoms") - 1, F.lit(0)))
    new = F.array(F.struct(F.col("pred").alias("p"), F.col("h").alias("a"), F.col("t").alias("b")))
    return x.select("sid", "side", F.concat(new, rest).alias("atoms"))


def alternation(spark: SparkSession, queries: DataFrame, by: str, ratio: int, modes: tuple[str, ...] = ("head", "tail")) -> DataFrame:
    """Queries numbered from 1 in order of ``by``: all but every (ratio + 1)th are negatives; their
    modes come in turn."""
    x = numbered(spark, queries, [by], "i", 1)
    return x.withColumns({"negative": F.col("i") % (ratio + 1) != 0, "mode": F.element_at(F.array(*map(F.lit, modes)), (F.col("i") % len(modes) + 1).cast("int"))})
