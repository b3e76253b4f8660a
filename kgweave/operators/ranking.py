"""Ranks of true answers among candidates, and metrics of ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import running, running_max


def ranks(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, optimistic, realistic, pessimistic of candidates (keys, score, truth).

    One aggregate after the true scores are spread by a window over each key: g better and e equal
    others make ranks g + 1, g + 1 + e / 2 and g + 1 + e. Of several true candidates of a key the
    best score counts; the others are left out of its comparison. A key without one has rank 1.
    """
    best = F.max(F.when(F.col("truth"), F.col("score"))).over(Window.partitionBy(*keys))
    x = scored.withColumn("_true", best).where("not truth").groupBy(*keys)
    g, e = F.count_if(F.col("score") > F.col("_true")), F.count_if(F.col("score") == F.col("_true"))
    return x.agg((g + 1).alias("optimistic"), (g + 1 + e / 2).alias("realistic"), (g + 1 + e).alias("pessimistic"))


def tie_ranks(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rank of candidates (keys, score, truth, tie): equal scores go by the greater tie key."""
    at = Window.partitionBy(*keys)
    best, own = F.max(F.when(F.col("truth"), F.col("score"))).over(at), F.max(F.when(F.col("truth"), F.col("tie"))).over(at)
    x = scored.withColumns({"_s": best, "_t": own})
    ahead = (F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("tie") > F.col("_t")))
    return x.groupBy(*keys).agg((F.count_if(~F.col("truth") & ahead) + 1).alias("rank"))


def metrics(ranked: DataFrame, keys: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """mrr and hits at 1, 3, 10 of ranks, by keys; 0 where there are none."""
    r = F.col(rank)
    share = lambda k: F.coalesce(F.avg((r <= k).cast("double")), F.lit(0.0)).alias(f"hits{k}")
    return ranked.groupBy(*(keys or [])).agg(F.coalesce(F.avg(1 / r), F.lit(0.0)).alias("mrr"), share(1), share(3), share(10), F.count("*").alias("n"))


def metrics_of_modes(ranked: DataFrame, mode: str = "mode") -> DataFrame:
    """Mean over modes of each mode's metrics."""
    return metrics(ranked, [mode]).agg(*[F.avg(k).alias(k) for k in ("mrr", "hits1", "hits3", "hits10")])


def metrics_by_depth(ranked: DataFrame) -> DataFrame:
    """mrr and hits overall, by provability (depth of 1 or more) and by depth, in one pass."""
    x = ranked.withColumn("provable", F.col("depth") >= 1)
    sets = x.groupingSets([[], ["provable"], ["depth"]], "provable", "depth")
    r = F.col("rank")
    return sets.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg(1 / r).alias("mrr"), F.avg((r <= 1).cast("double")).alias("hits1"), F.avg((r <= 10).cast("double")).alias("hits10"))


def proof_ranks(proved: DataFrame) -> DataFrame:
    """(qid, rank) of (qid, truth, proved): 1 for a proved positive, else 1 + proved corruptions."""
    return proved.groupBy("qid").agg(F.when(F.bool_or(F.col("truth") & F.col("proved")), F.lit(1).cast("long")).otherwise(F.count_if(~F.col("truth") & F.col("proved")) + 1).alias("rank"))


def average_precision(scored: DataFrame) -> DataFrame:
    """ap over (score, label), equal scores together: precision at each score weighted by recall."""
    by = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("p"))
    x = running(scored.sparkSession, by, "score", {"cn": "n", "cp": "p"}, descending=True)
    return x.agg((F.sum(F.col("p") * F.col("cp") / F.col("cn")) / F.sum("p")).alias("ap"))


def top_k(scored: DataFrame, keys: list[str], k: int, order: str = "entity") -> DataFrame:
    """The k best of each key with rank; Spark keeps k a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def running_best(metrics_: DataFrame, step: str, value: str) -> DataFrame:
    """step, value, best so far and the step it was reached at first."""
    x = running_max(metrics_.sparkSession, metrics_, step, value, "best")
    return x.withColumn("best_step", F.min(F.when(F.col(value) == F.col("best"), F.col(step))).over(Window.partitionBy("best").orderBy(step)))


def domain_ranks(scored: DataFrame, domain: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """Ranks among candidates (keys, pred, entity, score, truth) of the relation's own domain.

    domain: (pred, entity) seen on the side that is asked for. The true candidate counts whether it
    is in the domain or not; ``known`` (keys, entity) are left out.
    """
    inside = domain.select("pred", "entity").distinct().withColumn("_in", F.lit(True))
    x = scored.join(inside, ["pred", "entity"], "left").where("truth or _in").drop("_in")
    if known is not None:
        x = x.join(known.select(*keys, "entity").withColumn("_k", F.lit(True)), [*keys, "entity"], "left").where("truth or _k is null").drop("_k")
    return ranks(x, keys)


def sampled_ranks(scored: DataFrame, n: int, keys: list[str], known: DataFrame | None = None, order: str = "tie") -> DataFrame:
    """Ranks among the truth and the first n other candidates of a key in order of ``order``.

    ``known`` (keys, entity) are no candidates; there are fewer than n where a key has not as many.
    """
    x = scored
    if known is not None:
        x = x.join(known.select(*keys, "entity").withColumn("_k", F.lit(True)), [*keys, "entity"], "left").where("truth or _k is null").drop("_k")
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "entity"))
    others = x.where("not truth").withColumn("_r", r).where(F.col("_r") <= n).drop("_r")
    return ranks(others.unionByName(x.where("truth")), keys)


def sorted_position(scored: DataFrame, keys: list[str], mask: str = "masked") -> DataFrame:
    """keys, rank: place of the truth after sorting by score and then tie, both falling; candidates
    whose ``mask`` is true have the least score there is."""
    s = F.when(F.col(mask), F.lit(float("-inf"))).otherwise(F.col("score").cast("double"))
    return tie_ranks(scored.withColumn("score", s), keys)
