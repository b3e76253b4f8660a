"""Queries of fact scans, binding joins, candidates and set operators over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..plans.bodies import bindings, constrained
from ..plans.rules import Atom, Rule, rule_table
from ..plans.scratch import small
from . import register

CUST = "SELECT 'custIn' AS pred, 'c:' || c_custkey AS h, 'n:' || c_nationkey AS t FROM customer"
SUPP = "SELECT 'suppIn' AS pred, 's:' || s_suppkey AS h, 'n:' || s_nationkey AS t FROM supplier"
REGION = "SELECT 'inRegion' AS pred, 'n:' || n_nationkey AS h, 'r:' || n_regionkey AS t FROM nation"
PLACED = "SELECT 'placed' AS pred, 'c:' || o_custkey AS h, 'o:' || o_orderkey AS t FROM orders"
CONTAINS = "SELECT DISTINCT 'contains' AS pred, 'o:' || l_orderkey AS h, 'p:' || l_partkey AS t FROM lineitem"
SUPPLIES = "SELECT DISTINCT 'supplies' AS pred, 's:' || l_suppkey AS h, 'p:' || l_partkey AS t FROM lineitem"
PLACES = f"{CUST} UNION ALL {SUPP} UNION ALL {REGION}"
ALL = f"{PLACES} UNION ALL {PLACED} UNION ALL {CONTAINS} UNION ALL {SUPPLIES}"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph(spark, sf_dir, "custIn", "suppIn", "inRegion")


@register(f"SELECT pred, count(*) AS n, count(DISTINCT h) AS heads, count(DISTINCT t) AS tails FROM ({ALL}) GROUP BY pred")
def fact_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = G.graph(spark, sf_dir, *G.RELATIONS)
    return facts.groupBy("pred").agg(F.count("*").alias("n"), F.countDistinct("h").alias("heads"), F.countDistinct("t").alias("tails"))


@register(f"SELECT DISTINCT name, kind FROM (SELECT h AS name, 'constant' AS kind FROM ({PLACES}) UNION ALL SELECT t, 'constant' FROM ({PLACES}) UNION ALL SELECT pred, 'predicate' FROM ({PLACES}))")
def vocabulary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.vocabulary(places(spark, sf_dir))


@register(f"WITH f AS ({PLACES}), v AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT h AS name FROM f UNION SELECT t FROM f)) SELECT pred, a.id AS h_id, b.id AS t_id FROM f JOIN v a ON h = a.name JOIN v b ON t = b.name")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.text import sorted_ids

    facts = places(spark, sf_dir)
    ids = sorted_ids(facts.select(F.explode(F.array("h", "t")).alias("name"))).select("name", F.col("id").cast("long").alias("id"))
    return G.encode(facts, ids)


@register(f"SELECT pred, h, t FROM ({PLACES}) WHERE pred IN ('custIn', 'inRegion') ORDER BY h, t LIMIT 100")
def rule_semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred queries whose predicate heads a rule; the limit counts what is left."""
    rules = [Rule(Atom("custIn", "X", "Y"), (Atom("suppIn", "X", "Y"),)), Rule(Atom("inRegion", "X", "Y"), (Atom("near", "X", "Z"), Atom("inRegion", "Z", "Y")))]
    lines = places(spark, sf_dir).withColumn("line", F.struct("h", "t"))
    return G.head_filter(lines, rule_table(spark, rules), 100).select("pred", "h", "t")


@register(f"SELECT c.h AS qid, s.h AS supplier, c.t AS nation FROM ({CUST}) c JOIN ({SUPP}) s ON c.t = s.t JOIN ({REGION}) r ON r.h = c.t AND r.t = 'r:' || (CAST(substr(c.h, 3) AS BIGINT) % 5) QUALIFY row_number() OVER (PARTITION BY c.h ORDER BY c.t, s.h) <= 6")
def body_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """served(C, R) :- custIn(C, N), suppIn(S, N), inRegion(N, R): the first six bindings of each goal."""
    rule = Rule(Atom("served", "C", "R"), (Atom("custIn", "C", "N"), Atom("suppIn", "S", "N"), Atom("inRegion", "N", "R")))
    goals = G.relation(spark, sf_dir, "custIn").select(F.col("h").alias("qid"), "h", F.concat(F.lit("r:"), (F.substring("h", 3, 20).cast("long") % 5).cast("string")).alias("t"))
    x = bindings(rule, places(spark, sf_dir), goals, 6)
    return x.select("qid", F.col("v_S").alias("supplier"), F.col("v_N").alias("nation"))


@register(f"WITH g AS (SELECT 's:' || s_suppkey AS qid, 's:' || s_suppkey AS h, 'r:' || s_suppkey % 5 AS t FROM supplier), b AS (SELECT g.qid, s.t AS n FROM g JOIN ({SUPP}) s ON s.h = g.h JOIN ({REGION}) r ON r.h = s.t AND r.t = g.t) SELECT qid, CAST(1 AS INTEGER) AS rank, n AS nation, 3 AS atoms FROM b GROUP BY qid, n")
def constrained_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """serves(S, R) :- suppIn(S, N), inRegion(N, R), custIn(C, N): N comes from the first atom, the second
    must then be a fact, and of the third, whose C stays free, there must be some."""
    rule = Rule(Atom("serves", "S", "R"), (Atom("suppIn", "S", "N"), Atom("inRegion", "N", "R"), Atom("custIn", "C", "N")))
    goals = G.relation(spark, sf_dir, "suppIn").select(F.col("h").alias("qid"), "h", F.concat(F.lit("r:"), (F.substring("h", 3, 20).cast("long") % 5).cast("string")).alias("t"))
    x = constrained(rule, places(spark, sf_dir), goals)
    return x.select("qid", "rank", F.col("body")[0]["b"].alias("nation"), F.size("body").alias("atoms"))


def _goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.relation(spark, sf_dir, "suppIn")
    return s.select(F.col("h").alias("qid"), F.lit("custIn").alias("pred"), F.lit("?").alias("h"), "t")


@register(f"SELECT s.h AS qid, c.h, c.t FROM ({SUPP}) s JOIN ({CUST}) c ON s.t = c.t")
def unify_fb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """custIn(?, n) for each supplier's nation."""
    return G.bindings(_goals(spark, sf_dir), G.relation(spark, sf_dir, "custIn"), "fb")


@register(f"SELECT c.h AS qid, o.h, o.t FROM ({CUST}) c JOIN ({PLACED}) o ON c.h = o.h")
def unify_bf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """placed(c, ?) for each customer."""
    goals = G.relation(spark, sf_dir, "custIn").select(F.col("h").alias("qid"), F.lit("placed").alias("pred"), "h", F.lit("?").alias("t"))
    return G.bindings(goals, G.relation(spark, sf_dir, "placed"), "bf")


@register(f"SELECT c.h AS qid, c.h, c.t FROM ({CUST}) c JOIN ({SUPP}) s ON c.t = s.t AND replace(c.h, 'c:', '') = replace(s.h, 's:', '')")
def unify_bb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """custIn(c, n) for the customer numbered as a supplier, in the supplier's nation."""
    goals = G.relation(spark, sf_dir, "suppIn").select(F.regexp_replace("h", "s:", "c:").alias("qid"), F.lit("custIn").alias("pred"), F.regexp_replace("h", "s:", "c:").alias("h"), "t")
    return G.bindings(goals, G.relation(spark, sf_dir, "custIn"), "bb")


@register("SELECT 'q' AS qid, 'k:' || n_nationkey AS h, 'k:' || n_regionkey AS t FROM nation WHERE n_nationkey = n_regionkey")
def unify_repeated_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inRegion(X, X) where nations and regions share their numbers."""
    facts = G.relation(spark, sf_dir, "inRegion").select("pred", F.regexp_replace("h", "n:", "k:").alias("h"), F.regexp_replace("t", "r:", "k:").alias("t"))
    goal = spark.createDataFrame([("q", "inRegion", "X", "X")], "qid string, pred string, h string, t string")
    return G.bindings(goal, facts, "same")


@register(f"SELECT h, t FROM ({PLACED}) WHERE h IN (SELECT h FROM ({CUST}) WHERE t IN (SELECT t FROM ({SUPP})))")
def fact_membership_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.relation(spark, sf_dir, "custIn").join(G.relation(spark, sf_dir, "suppIn").select("t"), "t", "left_semi")
    return G.relation(spark, sf_dir, "placed").join(c.select("h"), "h", "left_semi").select("h", "t")


@register(
    f"WITH f AS ({PLACES}), a AS (SELECT c.h AS qid, 'custIn' AS pred, c.h, s.t, 1 AS pos FROM ({CUST}) c JOIN ({SUPP}) s ON replace(c.h, 'c:', '') = replace(s.h, 's:', '') "
    "UNION ALL SELECT c.h, 'inRegion', c.t, 'r:0', 2 FROM (" + CUST + ") c) "
    "SELECT qid, count(*) FILTER (WHERE f.pred IS NULL) AS remaining, count(*) FILTER (WHERE f.pred IS NULL) = 0 AS all_facts FROM a LEFT JOIN f ON a.pred = f.pred AND a.h = f.h AND a.t = f.t GROUP BY qid"
)
def ground_prune_all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of two ground atoms a customer after facts are pruned, and if nothing is."""
    from ..plans.prove import prune

    c, s = G.relation(spark, sf_dir, "custIn"), G.relation(spark, sf_dir, "suppIn")
    num = F.substring("h", 3, 20)
    one = c.select("h", num.alias("k")).join(s.select("t", num.alias("k")), "k").select(F.col("h").alias("qid"), F.lit("custIn").alias("pred"), "h", "t")
    two = c.select(F.col("h").alias("qid"), F.lit("inRegion").alias("pred"), F.col("t").alias("h"), F.lit("r:0").alias("t"))
    atom = F.struct(F.col("pred").alias("p"), F.col("h").alias("a"), F.col("t").alias("b"))
    states = one.unionByName(two).groupBy("qid").agg(F.sort_array(F.collect_list(atom)).alias("atoms"))
    states = states.select("qid", *[F.lit("").alias(c) for c in ("qp", "qa", "qb")], "atoms")
    x = prune(states, places(spark, sf_dir))
    return x.select("qid", F.size("atoms").cast("long").alias("remaining"), (F.size("atoms") == 0).alias("all_facts"))


@register(f"SELECT c.h, r.t FROM ({CUST}) c JOIN ({REGION}) r ON c.t = r.h")
def rule_chain2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locatedIn(C, R) :- custIn(C, N), inRegion(N, R)."""
    r = G.relation(spark, sf_dir, "inRegion").select(F.col("h").alias("n"), F.col("t").alias("r"))
    c = G.relation(spark, sf_dir, "custIn")
    return c.join(small(r), c.t == r.n).select("h", F.col("r").alias("t"))


@register(f"SELECT DISTINCT c.h, p.t FROM ({CUST}) c JOIN ({PLACED}) o ON c.h = o.h JOIN ({CONTAINS}) p ON o.t = p.h")
def rule_chain3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bought(C, P) :- custIn(C, N), placed(C, O), contains(O, P)."""
    c = G.relation(spark, sf_dir, "custIn").select("h")
    o = G.relation(spark, sf_dir, "placed").select("h", F.col("t").alias("o"))
    p = G.relation(spark, sf_dir, "contains").select(F.col("h").alias("o"), "t")
    return c.join(o, "h").join(p, "o").select("h", "t").distinct()


@register(f"SELECT DISTINCT a.h, b.h AS t FROM ({REGION}) a JOIN ({REGION}) b ON a.t = b.t AND a.h <> b.h")
def rule_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """neighbour(X, Y) :- neighbour(Y, X), over nations of one region."""
    r = G.relation(spark, sf_dir, "inRegion")
    one = r.join(r.select(F.col("h").alias("g"), "t"), "t").where("h < g").select("h", F.col("g").alias("t"))
    return one.union(one.select("t", "h")).distinct()


@register(f"SELECT DISTINCT c.h, s.h AS t FROM ({CUST}) c JOIN ({PLACED}) o ON c.h = o.h JOIN ({CONTAINS}) p ON o.t = p.h JOIN ({SUPPLIES}) u ON p.t = u.t JOIN ({SUPP}) s ON u.h = s.h AND s.t = c.t")
def conjunctive_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near(C, S) :- placed(C, O), contains(O, P), supplies(S, P), custIn(C, N), suppIn(S, N)."""
    body = ("placed C O", "contains O P", "custIn C N", "supplies S P", "suppIn S N")
    rule = Rule(Atom("near", "C", "S"), tuple(Atom(*x.split()) for x in body))
    return bindings(rule, G.graph(spark, sf_dir, "placed", "contains", "supplies", "custIn", "suppIn"))


@register(f"SELECT t AS entity, count(*) AS n FROM ({SUPPLIES}) GROUP BY t")
def entities_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relation(spark, sf_dir, "supplies").groupBy(F.col("t").alias("entity")).agg(F.count("*").alias("n"))


@register(f"SELECT pred, h, t FROM ({PLACES}) UNION ALL SELECT pred || '__inv', t, h FROM ({PLACES})")
def reciprocal_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reciprocal(places(spark, sf_dir))


@register(f"WITH f AS ({ALL}) SELECT pred, round(tph, 6) AS tph, round(hpt, 6) AS hpt, round(least(0.95, greatest(0.05, tph / (tph + hpt))), 6) AS p_head FROM (SELECT pred, count(*) / count(DISTINCT h) AS tph, count(*) / count(DISTINCT t) AS hpt FROM f GROUP BY pred)")
def bernoulli_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.bernoulli(G.graph(spark, sf_dir, *G.RELATIONS))
    return x.select("pred", *[F.round(c, 6).alias(c) for c in ("tph", "hpt", "p_head")])


@register(f"WITH f AS ({ALL}) SELECT pred, h AS anchor, count(DISTINCT t) AS n, 'tail' AS side FROM f GROUP BY pred, h UNION ALL SELECT pred, t, count(DISTINCT h), 'head' FROM f GROUP BY pred, t")
def filter_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.filter_sizes(G.graph(spark, sf_dir, *G.RELATIONS))


@register(f"WITH f AS ({ALL}) SELECT DISTINCT pred, 'head' AS role, h AS entity FROM f UNION ALL SELECT DISTINCT pred, 'tail', t FROM f")
def relation_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relation_domains(G.graph(spark, sf_dir, *G.RELATIONS))


def nation_pool(spark: SparkSession, sf_dir: str, pred: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.lit(pred).alias("pred"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("entity"))


@register(f"SELECT c.h AS qid, 'custIn' AS pred, c.h, 'n:' || n_nationkey AS t FROM ({CUST}) c, nation WHERE 'n:' || n_nationkey <> c.t")
def corrupt_exhaustive_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = G.relation(spark, sf_dir, "custIn").withColumn("qid", F.col("h"))
    return G.corrupt_all(q, small(nation_pool(spark, sf_dir, "custIn")), "t", G.relation(spark, sf_dir, "custIn"))


@register(f"WITH f AS ({REGION}) SELECT q.h AS qid, q.pred, p.h, q.t FROM f q JOIN (SELECT DISTINCT pred, h FROM f) p ON q.pred = p.pred AND p.h <> q.h WHERE NOT EXISTS (SELECT 1 FROM f k WHERE k.h = p.h AND k.t = q.t)")
def corrupt_domain_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of the relation's own domain that aren't known for the tail."""
    f = G.relation(spark, sf_dir, "inRegion")
    pool = f.select("pred", F.col("h").alias("entity")).distinct()
    return G.corrupt_all(f.withColumn("qid", F.col("h")), pool, "h", f)


SAMPLED = (
    "WITH p AS (SELECT 'n:' || n_nationkey AS entity, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation), "
    "q AS (SELECT c_custkey AS qid, 'c:' || c_custkey AS h, 'n:' || c_nationkey AS t FROM customer), "
    "d AS (SELECT q.qid, k, h, place, ((((qid * 5 + k) * 7919 + 17 * 104729) % 1000003) % ((SELECT count(*) FROM p) - 1)) AS at FROM q JOIN p ON q.t = p.entity, range(5) r(k)) "
    "SELECT qid, CAST(k AS INTEGER) AS k, h, entity AS t FROM d JOIN p ON p.place = CASE WHEN d.at >= d.place THEN d.at + 1 ELSE d.at END"
)


@register(SAMPLED)
def corrupt_sampled_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    pool = F.broadcast(G.numbered(n, "n_nationkey", "place").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("entity"), F.col("place").cast("long").alias("place")))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    q = c.select(F.col("c_custkey").alias("qid"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("h"), F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")).alias("t"))
    return G.corrupt_sampled(q.join(pool.withColumnRenamed("entity", "t"), "t"), pool, 5)


@register(f"WITH a AS (SELECT DISTINCT 's:' || l_suppkey AS h, 'p:' || l_partkey AS t FROM lineitem WHERE l_quantity >= 40) SELECT s.h, s.t FROM ({SUPPLIES}) s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.h = s.h AND a.t = s.t)")
def known_filter_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 40").select(F.lit("supplies").alias("pred"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("h"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("t")).distinct()
    return G.novel(G.relation(spark, sf_dir, "supplies"), known).select("h", "t")


@register(f"SELECT c.h AS qid, i % 4 <> 0 AS negative, CASE WHEN i % 2 = 0 THEN 'head' ELSE 'tail' END AS mode FROM (SELECT h, row_number() OVER (ORDER BY h) AS i FROM ({CUST})) c")
def label_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth query is a positive; modes come in turn."""
    from ..operators.negatives import alternation

    return alternation(spark, G.relation(spark, sf_dir, "custIn"), "h", 3).select(F.col("h").alias("qid"), "negative", "mode")


@register(f"SELECT q.h AS qid, q.t AS h, e.t AS t, coalesce(d.n, -1) AS depth FROM ({CUST}) q JOIN ({REGION}) e ON q.t = e.h LEFT JOIN (SELECT n_nationkey, CAST(2 AS INTEGER) AS n FROM nation WHERE n_regionkey < 3) d ON e.h = 'n:' || d.n_nationkey")
def depth_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join of depths with -1 for those unknown."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey < 3").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("n"), F.lit(2).alias("d"))
    q = G.relation(spark, sf_dir, "custIn").select(F.col("h").alias("qid"), F.col("t").alias("h"))
    e = G.relation(spark, sf_dir, "inRegion").select("h", "t")
    x = q.join(small(e), "h")
    return x.join(small(n), x.h == n.n, "left").select("qid", "h", "t", F.coalesce("d", F.lit(-1)).alias("depth"))
