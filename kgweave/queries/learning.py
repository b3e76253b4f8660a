"""Queries of losses, ensembles, attention and order-dependent learning data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import losses as L
from . import register
from .episodes import BF, factors
from .graph import CUST
from .ranking import CAND, candidates


@register(f"WITH x AS (SELECT *, score - 6 AS s FROM ({CAND})), w AS (SELECT *, exp(s - max(s) OVER q) / sum(exp(s - m)) OVER q AS p FROM (SELECT *, max(s) OVER (PARTITION BY qid) AS m FROM x WHERE NOT truth) WINDOW q AS (PARTITION BY qid)), n AS (SELECT qid, sum(p * ln(1 + exp(s))) AS neg FROM w GROUP BY qid) SELECT x.qid, round((ln(1 + exp(-s)) + neg) / 2, 6) AS loss FROM x JOIN n ON x.qid = n.qid WHERE truth")
def negative_sampling_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-sigmoid loss with negatives weighted by a softmax of their own scores."""
    x = candidates(spark, sf_dir).withColumn("s", (F.col("score") - 6).cast("double"))
    p = L.softmax(F.when(~F.col("truth"), F.col("s")), Window.partitionBy("qid"))
    y = x.withColumn("p", p).groupBy("qid").agg(F.sum(F.when(F.col("truth"), -L.log_sigmoid(F.col("s")))).alias("pos"), F.sum(F.when(~F.col("truth"), -F.col("p") * L.log_sigmoid(-F.col("s")))).alias("neg"))
    return y.select("qid", F.round((F.col("pos") + F.col("neg")) / 2, 6).alias("loss"))


@register(f"WITH x AS ({CAND}), t AS (SELECT qid, score AS s FROM x WHERE truth) SELECT x.qid, round(avg(greatest(0.0, 2.0 - t.s + x.score)), 6) AS hinge, round(-ln(exp(any_value(t.s) - 12.0) / (exp(any_value(t.s) - 12.0) + sum(exp(x.score - 12.0)))), 6) AS cross_entropy FROM x JOIN t ON x.qid = t.qid WHERE NOT truth GROUP BY x.qid")
def ranking_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = candidates(spark, sf_dir).withColumn("s", F.max(F.when(F.col("truth"), F.col("score"))).over(Window.partitionBy("qid")))
    y = x.withColumn("p", L.softmax(F.col("score").cast("double"), Window.partitionBy("qid")))
    h = F.avg(F.when(~F.col("truth"), L.hinge(F.col("s"), F.col("score"), 2.0)))
    return y.groupBy("qid").agg(F.round(h, 6).alias("hinge"), F.round(-F.ln(F.max(F.when(F.col("truth"), F.col("p")))), 6).alias("cross_entropy"))


@register(f"SELECT qid, entity, round((a + b + c) / 3, 6) AS mean, greatest(a, b, c) AS max, round((a * exp(1.0) + b * exp(0.0) + c * exp(0.5)) / (exp(1.0) + exp(0.0) + exp(0.5)), 6) AS weighted FROM (SELECT qid, entity, CAST(score AS DOUBLE) AS a, CAST(tie % 12 AS DOUBLE) AS b, CAST((score + tie) % 12 AS DOUBLE) AS c FROM ({CAND}))")
def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = [F.col("score").cast("double"), (F.col("tie") % 12).cast("double"), ((F.col("score") + F.col("tie")) % 12).cast("double")]
    x = candidates(spark, sf_dir)
    return x.select("qid", F.col("entity").cast("int").alias("entity"), F.round(L.ensemble(s, "mean"), 6).alias("mean"), L.ensemble(s, "max").alias("max"), F.round(L.ensemble(s, "softmax", [1.0, 0.0, 0.5]), 6).alias("weighted"))


@register(f"WITH x AS (SELECT qid, entity, (score + 0.5 * (tie % 7)) / 2.0 AS a FROM ({CAND})), m AS (SELECT *, max(a) OVER (PARTITION BY qid) AS top FROM x) SELECT qid, entity, round(exp(a - top) / sum(exp(a - top)) OVER (PARTITION BY qid), 6) AS attention FROM m")
def rule_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax at temperature 2 of logits and half a score."""
    a = L.softmax(F.col("score") + 0.5 * (F.col("tie") % 7), Window.partitionBy("qid"), 2.0)
    return candidates(spark, sf_dir).select("qid", F.col("entity").cast("int").alias("entity"), F.round(a, 6).alias("attention"))


@register(f"SELECT q.h AS qid, k, CASE WHEN k % 2 = 0 THEN 'c:' || (replace(q.h, 'c:', '')::BIGINT + k) ELSE q.h END AS h, CASE WHEN k % 2 = 1 THEN 'n:' || ((replace(q.t, 'n:', '')::BIGINT + k) % 25) ELSE q.t END AS t FROM ({CUST}) q, (SELECT CAST(unnest(range(4)) AS INTEGER) AS k)")
def contrastive_alternating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four negatives a fact, heads at even places and tails at odd ones; unfiltered."""
    from ..operators.graph import relation

    x = relation(spark, sf_dir, "custIn").select(F.col("h").alias("qid"), "h", "t", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    number = lambda c: F.substring(c, 3, 20).cast("long")
    h = F.when(F.col("k") % 2 == 0, F.concat(F.lit("c:"), (number("h") + F.col("k")).cast("string"))).otherwise(F.col("h"))
    t = F.when(F.col("k") % 2 == 1, F.concat(F.lit("n:"), ((number("t") + F.col("k")) % 25).cast("string"))).otherwise(F.col("t"))
    return x.select("qid", "k", h.alias("h"), t.alias("t"))


@register("SELECT event_id, row_number() OVER (ORDER BY (event_id * 7919 + 3 * 104729) % 1000003, event_id) - 1 AS place, CAST((row_number() OVER (ORDER BY (event_id * 7919 + 3 * 104729) % 1000003, event_id) - 1) // 64 AS BIGINT) AS minibatch FROM events")
def minibatch_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One permutation of a pass by an arithmetic hash, in minibatches of 64.

    Places come from counts of hash buckets and a rank within each, so no task sorts all rows.
    """
    h = (F.col("event_id") * 7919 + 3 * 104729) % 1000003
    x = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", h.alias("h"), F.floor(h / 2000).alias("bucket"))
    before = x.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    y = x.join(F.broadcast(before), "bucket")  # 501 buckets at most
    place = F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("h", "event_id")) - 1
    return y.select("event_id", place.alias("place"), F.floor(place / 64).alias("minibatch"))


@register(f"SELECT 'b' || bf % 3 AS module, count(*) AS calls, CAST(sum(bf) AS BIGINT) AS total, round(avg(bf), 6) AS mean, min(bf) AS fastest, max(bf) AS slowest FROM ({BF}) GROUP BY 1")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = factors(spark, sf_dir)
    m = F.concat(F.lit("b"), (F.col("bf") % 3).cast("string"))
    return x.groupBy(m.alias("module")).agg(F.count("*").alias("calls"), F.sum("bf").alias("total"), F.round(F.avg("bf"), 6).alias("mean"), F.min("bf").alias("fastest"), F.max("bf").alias("slowest"))
