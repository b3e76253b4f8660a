"""Queries of filtered ranking: scores of the true nation of each customer among all nations.

Scores are integers from an arithmetic hash, so ties are many and exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..plans.scratch import small
from . import register

CAND = (
    "SELECT c_custkey AS qid, n_nationkey AS entity, n_nationkey = c_nationkey AS truth, ((c_custkey * 31 + n_nationkey * 17) * 7919 % 1000003) % 12 AS score, "
    "((c_custkey * 13 + n_nationkey * 29) * 104729) % 1000003 AS tie, CASE WHEN c_custkey % 2 = 0 THEN 'head' ELSE 'tail' END AS mode, c_custkey % 5 - 1 AS depth FROM customer, nation"
)
RANKED = f"WITH x AS ({CAND}), t AS (SELECT qid, score AS s, tie AS k FROM x WHERE truth), r AS (SELECT x.qid, any_value(mode) AS mode, any_value(depth) AS depth, count(*) FILTER (WHERE NOT truth AND score > s) AS g, count(*) FILTER (WHERE NOT truth AND score = s) AS e, count(*) FILTER (WHERE NOT truth AND (score > s OR score = s AND tie > k)) + 1 AS rank FROM x JOIN t ON x.qid = t.qid GROUP BY x.qid)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").cast("long").alias("own"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("entity"))
    q, e = F.col("c_custkey"), F.col("entity")
    x = c.crossJoin(small(n))
    return x.select(q.alias("qid"), "entity", (e == F.col("own")).alias("truth"), ((q * 31 + e * 17) * 7919 % 1000003 % 12).alias("score"), ((q * 13 + e * 29) * 104729 % 1000003).alias("tie"), F.when(q % 2 == 0, "head").otherwise("tail").alias("mode"), (q % 5 - 1).alias("depth"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tie_ranks(candidates(spark, sf_dir), ["qid", "mode", "depth"])


@register(RANKED + " SELECT qid, g + 1 AS optimistic, g + 1 + e / 2 AS realistic, g + 1 + e AS pessimistic FROM r")
def rank_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranks(candidates(spark, sf_dir), ["qid"])


@register(RANKED + " SELECT qid, rank FROM r")
def rank_tie_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("qid", "rank")


@register(RANKED + " SELECT round(avg(1.0 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hits1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS hits3, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hits10, count(*) AS n FROM r")
def mrr_hits_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.metrics(ranked(spark, sf_dir))
    return m.select(*[F.round(k, 6).alias(k) for k in ("mrr", "hits1", "hits3", "hits10")], "n")


@register(RANKED + " SELECT round(avg(mrr), 6) AS mrr, round(avg(hits1), 6) AS hits1, round(avg(hits3), 6) AS hits3, round(avg(hits10), 6) AS hits10 FROM (SELECT mode, avg(1.0 / rank) AS mrr, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS hits1, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END) AS hits3, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS hits10 FROM r GROUP BY mode)")
def mrr_hits_per_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.metrics_of_modes(ranked(spark, sf_dir))
    return m.select(*[F.round(k, 6).alias(k) for k in ("mrr", "hits1", "hits3", "hits10")])


@register(RANKED + " SELECT depth >= 1 AS provable, depth, grouping(provable) * 2 + grouping(depth) AS level, count(*) AS n, round(avg(1.0 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hits1, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hits10 FROM (SELECT *, depth >= 1 AS provable FROM r) GROUP BY GROUPING SETS ((), (provable), (depth))".replace("SELECT depth >= 1 AS provable, depth, grouping", "SELECT provable, depth, grouping"))
def metrics_by_depth_groupingsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.metrics_by_depth(ranked(spark, sf_dir))
    return m.select("provable", "depth", F.col("level").cast("long").alias("level"), "n", *[F.round(k, 6).alias(k) for k in ("mrr", "hits1", "hits10")])


@register(f"WITH x AS ({CAND}) SELECT qid, CASE WHEN bool_or(truth AND score > 5) THEN 1 ELSE 1 + count(*) FILTER (WHERE NOT truth AND score > 5) END AS rank FROM x GROUP BY qid")
def proof_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.proof_ranks(candidates(spark, sf_dir).withColumn("proved", F.col("score") > 5))


@register(f"WITH x AS ({CAND}), s AS (SELECT score, count(*) AS n, sum(CASE WHEN truth THEN 1 ELSE 0 END) AS p FROM x GROUP BY score), c AS (SELECT p, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER (ORDER BY score DESC) AS cp FROM s) SELECT round(sum(CAST(p AS DOUBLE) * cp / cn) / sum(p), 8) AS ap FROM c")
def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = candidates(spark, sf_dir).select("score", F.col("truth").cast("int").alias("label"))
    return R.average_precision(x).select(F.round("ap", 8).alias("ap"))


@register(f"WITH x AS ({CAND}), k AS (SELECT qid, entity, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, entity) AS rank FROM x) SELECT qid, x.entity, CASE WHEN k.rank <= 5 THEN x.score ELSE -1000000000 END AS score FROM ({CAND}) x JOIN k USING (qid, entity)")
def candidate_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates past a query's five best get a score below all others."""
    x = candidates(spark, sf_dir)
    best = R.top_k(x, ["qid"], 5).select("qid", "entity", F.lit(True).alias("in"))
    return x.join(best, ["qid", "entity"], "left").select("qid", F.col("entity").cast("int").alias("entity"), F.when(F.col("in"), F.col("score")).otherwise(-1000000000).alias("score"))


@register(f"WITH x AS ({CAND}), c AS (SELECT qid, entity, tie, row_number() OVER (PARTITION BY qid ORDER BY tie, entity) AS r FROM x WHERE NOT truth) SELECT qid, entity FROM c WHERE r <= 10")
def sampled_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives a query in order of a hash: sampling is the feature here."""
    x = candidates(spark, sf_dir).where("not truth").select("qid", F.col("entity").cast("int").alias("entity"), (-F.col("tie")).alias("score"))
    return R.top_k(x, ["qid"], 10).select("qid", "entity")


DOMAIN = "SELECT DISTINCT c_nationkey AS entity FROM customer WHERE c_custkey % 3 = 0"
KNOWN = "SELECT c_custkey AS qid, (c_nationkey + 1) % 25 AS entity FROM customer"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("qid"), ((F.col("c_nationkey") + 1) % 25).cast("long").alias("entity"))


COUNTED = "r AS (SELECT x.qid, count(*) FILTER (WHERE NOT truth AND score > s) AS g, count(*) FILTER (WHERE NOT truth AND score = s) AS e FROM x JOIN (SELECT qid, score AS s FROM x WHERE truth) t ON x.qid = t.qid GROUP BY x.qid) SELECT qid, g + 1 AS optimistic, g + 1 + e / 2 AS realistic, g + 1 + e AS pessimistic FROM r WHERE qid IN (SELECT qid FROM x WHERE NOT truth)"


@register(f"WITH x AS (SELECT * FROM ({CAND}) WHERE (truth OR entity IN ({DOMAIN})) AND (truth OR (qid, entity) NOT IN ({KNOWN}))), {COUNTED}")
def domain_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks among the tails that every third customer has, less known ones."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 = 0")
    domain = c.select(F.lit("custIn").alias("pred"), F.col("c_nationkey").cast("long").alias("entity"))
    return R.domain_ranks(candidates(spark, sf_dir).withColumn("pred", F.lit("custIn")), domain, ["qid"], _known(spark, sf_dir))


@register(f"WITH a AS (SELECT * FROM ({CAND}) WHERE truth OR (qid, entity) NOT IN ({KNOWN})), x AS (SELECT * FROM a QUALIFY truth OR row_number() OVER (PARTITION BY qid, truth ORDER BY tie, entity) <= 8), {COUNTED}")
def sampled_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks among eight others of a query that aren't known: sampling is the feature."""
    return R.sampled_ranks(candidates(spark, sf_dir), 8, ["qid"], _known(spark, sf_dir))


@register(f"WITH x AS (SELECT *, CASE WHEN entity % 7 = 3 AND NOT truth THEN -1e308 ELSE score END AS s2 FROM ({CAND})) SELECT qid, rank FROM (SELECT qid, truth, row_number() OVER (PARTITION BY qid ORDER BY s2 DESC, tie DESC, truth DESC) AS rank FROM x) WHERE truth")
def sort_position_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the truth where every seventh nation is masked."""
    x = candidates(spark, sf_dir).withColumn("masked", (F.col("entity") % 7 == 3) & ~F.col("truth"))
    return R.sorted_position(x, ["qid"])
