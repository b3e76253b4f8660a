"""Queries of negatives: customers' nations with either side replaced, by draws that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import negatives as N
from . import register
from .graph import CUST, PLACES, REGION

Q = "SELECT CAST(c_custkey AS BIGINT) AS qid, 'custIn' AS pred, 'c:' || c_custkey AS h, 'n:' || c_nationkey AS t FROM customer"
POOL = "SELECT domain, entity, row_number() OVER (PARTITION BY domain ORDER BY entity) - 1 AS place, count(*) OVER (PARTITION BY domain) AS size FROM (SELECT 'c' AS domain, 'c:' || c_custkey AS entity FROM customer UNION ALL SELECT 'n', 'n:' || n_nationkey FROM nation)"


def _drawn(key: str, seed: int, size: str) -> str:
    return f"((({key}) * 7919 + {seed} * 104729) % 1000003) % greatest({size}, 1)"


def _other(key: str, seed: int) -> str:
    """The place of a draw among the other members of ``o``'s domain."""
    at = _drawn(key, seed, "o.size - 1")
    return f"CASE WHEN o.size = 1 THEN o.place WHEN {at} >= o.place THEN {at} + 1 ELSE {at} END"


def _side(side: str, n: int, k: int, seed: int, pool: str = "pool") -> str:
    other = "t" if side == "h" else "h"
    both = f"e.entity AS h, q.{other} AS t" if side == "h" else f"q.{other} AS h, e.entity AS t"
    return f"SELECT q.qid, '{'head' if side == 'h' else 'tail'}' AS side, q.pred, {both} FROM q JOIN {pool} o ON q.{side} = o.entity, range({n}) r(j) JOIN {pool} e ON e.domain = o.domain AND e.place = {_other(f'q.qid * {k} + j', seed)}"


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    return c.select(F.col("c_custkey").cast("long").alias("qid"), F.lit("custIn").alias("pred"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("h"), F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")).alias("t"))


def pools(spark: SparkSession, sf_dir: str, one: bool = False) -> DataFrame:
    """Customers and nations as two domains, or as one."""
    c = queries_of(spark, sf_dir).select(F.lit("c").alias("domain"), F.col("h").alias("entity"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("n").alias("domain"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("entity"))
    x = c.unionAll(n)
    return N.placed(spark, x.withColumn("domain", F.lit("all")) if one else x)


KEPT = "SELECT DISTINCT x.* FROM ({rows}) x WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.pred = x.pred AND q.h = x.h AND q.t = x.t)"
BOTH = f"WITH q AS ({Q}), pool AS ({POOL}) "


@register(BOTH + KEPT.format(rows=_side("h", 3, 5, 17) + " UNION ALL " + _side("t", 2, 5, 17)))
def corrupt_both_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five a query, three heads and two tails of their domains, less known facts and repeats."""
    q = queries_of(spark, sf_dir)
    return N.corrupt(q, pools(spark, sf_dir), "both", 5, known=q)


@register(f"WITH q AS ({Q}), pool AS (SELECT 'all' AS domain, entity, row_number() OVER (ORDER BY entity) - 1 AS place, count(*) OVER () AS size FROM ({POOL})) " + _side("h", 2, 4, 5) + " UNION ALL " + _side("t", 2, 4, 5))
def corrupt_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four a query, drawn among all entities but the true one."""
    return N.corrupt(queries_of(spark, sf_dir), pools(spark, sf_dir, one=True), "both", 4, 5)


@register(BOTH + f"SELECT qid, side, pred, h, t, CAST(row_number() OVER (PARTITION BY qid ORDER BY pred, h, t) AS INTEGER) AS place FROM ({KEPT.format(rows=_side('t', 6, 6, 3))})")
def ordered_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queries_of(spark, sf_dir)
    return N.ordered(N.corrupt(q, pools(spark, sf_dir), "tail", 6, 3, q))


@register(BOTH + "SELECT q.qid, 'tail' AS side, q.pred, q.h, e.entity AS t FROM q JOIN pool e ON e.domain = 'n' AND e.entity <> q.t")
def corrupt_all_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a number all members of the domain are taken."""
    q = queries_of(spark, sf_dir)
    return N.corrupt(q, pools(spark, sf_dir), "tail", None, known=q)


BERNOULLI = (
    f"WITH q AS ({Q}), pool AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS place, count(*) OVER () AS size FROM ({POOL})), "
    "p AS (SELECT least(0.95, greatest(0.05, tph / (tph + hpt))) AS p FROM (SELECT count(*) / count(DISTINCT h) AS tph, count(*) / count(DISTINCT t) AS hpt FROM q)), "
    f"s AS (SELECT q.*, CASE WHEN ({_drawn('qid', 23, '1000003')}) / 1000003.0 < (SELECT p FROM p) THEN 'head' ELSE 'tail' END AS side FROM q), "
    f"d AS (SELECT s.*, CAST(k AS INTEGER) AS k, {_drawn('qid * 3 + k', 24, '(SELECT max(size) FROM pool)')} AS nth FROM s, range(3) r(k)) "
    "SELECT qid, k, side, pred, CASE side WHEN 'head' THEN entity ELSE h END AS h, CASE side WHEN 'head' THEN t ELSE entity END AS t FROM d JOIN pool ON place = nth"
)


@register(BERNOULLI)
def bernoulli_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three a query, all of the side that the relation's statistics favour."""
    q = queries_of(spark, sf_dir)
    return N.bernoulli_corrupt(q, pools(spark, sf_dir, one=True), G.bernoulli(q), 3)


@register(
    f"WITH f AS (SELECT pred, h, t, row_number() OVER (ORDER BY pred, h, t) AS qid FROM ({PLACES})), r AS (SELECT pred, row_number() OVER (ORDER BY pred) - 1 AS place, count(*) OVER () AS size FROM (SELECT DISTINCT pred FROM f)) "
    f"SELECT q.qid, CAST(k AS INTEGER) AS k, e.pred, q.h, q.t FROM f q JOIN r o ON q.pred = o.pred, range(2) x(k) JOIN r e ON e.place = {_other('q.qid * 2 + k', 29)}"
)
def relation_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.ordered import numbered

    facts = numbered(spark, G.graph(spark, sf_dir, "custIn", "suppIn", "inRegion"), ["pred", "h", "t"], "qid", 1)
    return N.corrupt_relations(facts, numbered(spark, facts.select("pred").distinct(), ["pred"], "place"), 2)


@register(
    f"WITH q AS ({Q}), pool AS ({POOL}), k AS (SELECT h, 'n:' || (CAST(substr(t, 3) AS BIGINT) + 1) % 25 AS t FROM q), c AS (SELECT qid, e.entity, e.place FROM q JOIN pool e ON e.domain = 'n' AND e.entity <> q.t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.h = q.h AND k.t = e.entity)) "
    f"SELECT qid, entity FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {_drawn('qid * 31 + place', 31, '1000003')}, place) <= 8"
)
def known_filtered_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight nations a query that are neither the true one nor a known one: sampling is the feature."""
    q = queries_of(spark, sf_dir)
    known = q.select("pred", "h", F.concat(F.lit("n:"), ((F.substring("t", 3, 20).cast("long") + 1) % 25).cast("string")).alias("t"))
    return N.sampled_candidates(q, pools(spark, sf_dir), known, 8)


@register(f"WITH q AS ({Q}), pool AS ({POOL}) SELECT qid AS sid, side, h AS a, t AS b, 2 AS atoms FROM ({_side('h', 1, 2, 37)} UNION ALL {_side('t', 1, 2, 37)})")
def state_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of two atoms, whose first has one argument replaced."""
    atom = lambda p, a, b: F.struct(F.lit(p).alias("p"), a.alias("a"), b.alias("b"))
    s = queries_of(spark, sf_dir).select(F.col("qid").alias("sid"), F.array(atom("custIn", F.col("h"), F.col("t")), atom("inRegion", F.col("t"), F.lit("?0"))).alias("atoms"))
    x = N.corrupt_states(s, pools(spark, sf_dir), "both", 2)
    return x.select("sid", "side", F.col("atoms")[0]["a"].alias("a"), F.col("atoms")[0]["b"].alias("b"), F.size("atoms").alias("atoms"))


@register(f"WITH f AS ({PLACES}) SELECT pred, h AS anchor, 'tail' AS side, 0 AS part, string_agg(t, ',' ORDER BY t) AS entities FROM f GROUP BY pred, h UNION ALL SELECT pred, t, 'head', 0, string_agg(h, ',' ORDER BY h) FROM f GROUP BY pred, t")
def filter_map_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.filter_sets(G.graph(spark, sf_dir, "custIn", "suppIn", "inRegion"))
    return x.withColumn("entities", F.array_join("entities", ","))


@register(f"WITH f AS ({PLACES}), g AS (SELECT 'a:' || n_nationkey AS qid, 'custIn' AS pred, NULL AS h, 'n:' || n_nationkey AS t FROM nation UNION ALL SELECT 'b:' || n_nationkey, 'inRegion', 'n:' || n_nationkey, NULL FROM nation UNION ALL SELECT 'c', 'suppIn', NULL, NULL) SELECT qid, f.h, f.t FROM g JOIN f ON g.pred = f.pred AND (g.h IS NULL OR g.h = f.h) AND (g.t IS NULL OR g.t = f.t) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY f.h, f.t) <= 7")
def facts_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven facts that fit goals with either side, or both, free: the limit is the feature."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("k"))
    none = F.lit(None).cast("string")
    a = n.select(F.concat(F.lit("a:"), "k").alias("qid"), F.lit("custIn").alias("pred"), none.alias("h"), F.concat(F.lit("n:"), "k").alias("t"))
    b = n.select(F.concat(F.lit("b:"), "k").alias("qid"), F.lit("inRegion").alias("pred"), F.concat(F.lit("n:"), "k").alias("h"), none.alias("t"))
    c = spark.range(1).select(F.lit("c").alias("qid"), F.lit("suppIn").alias("pred"), none.alias("h"), none.alias("t"))
    return G.matching(a.unionAll(b).unionAll(c), G.graph(spark, sf_dir, "custIn", "suppIn", "inRegion"), 7)


@register(f"SELECT * FROM (SELECT h AS entity FROM ({CUST}) WHERE t = 'n:3' ORDER BY 1 LIMIT 10) UNION ALL SELECT * FROM (SELECT DISTINCT t FROM ({REGION}))")
def entities_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten customers of a nation, and all regions."""
    f = G.graph(spark, sf_dir, "custIn", "inRegion")
    return G.entities_at(f, "custIn", "h", "n:3", 10).unionAll(G.entities_at(f, "inRegion", "t"))
