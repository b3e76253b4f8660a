"""Queries of closures and proof search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..plans import derive
from ..plans.closure import chain_closure, transitive_closure
from ..plans.prove import exact_depths, min_depths, statuses
from ..plans.rules import Atom, Rule
from . import register
from .graph import CUST, REGION, SUPP

#: Nations in a row: each with the next of its region, regions' rows joined end to end.
NEXT = "SELECT 'n:' || a AS h, 'n:' || b AS t FROM (SELECT n_nationkey AS a, lead(n_nationkey) OVER (ORDER BY n_regionkey, n_nationkey) AS b FROM nation) WHERE b IS NOT NULL"


def _next(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.lead("n_nationkey").over(Window.orderBy("n_regionkey", "n_nationkey")).alias("b")).where("b is not null")
    return n.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("h"), F.concat(F.lit("n:"), F.col("b").cast("string")).alias("t"))


@register(f"WITH RECURSIVE e AS ({NEXT}), p(h, t, depth) AS (SELECT h, t, 1 FROM e UNION ALL SELECT p.h, e.t, p.depth + 1 FROM p JOIN e ON p.t = e.h WHERE p.depth < 100) SELECT h, t, CAST(min(depth) AS INTEGER) AS depth FROM p GROUP BY h, t")
def transitive_closure_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitive_closure(spark, _next(spark, sf_dir))


@register(f"WITH RECURSIVE e AS ({NEXT}), p(h, t, depth) AS (SELECT h, t, 1 FROM e UNION ALL SELECT p.h, e.t, p.depth + 1 FROM p JOIN e ON p.t = e.h WHERE p.depth < 4) SELECT h, t, CAST(min(depth) AS INTEGER) AS depth FROM p GROUP BY h, t")
def closure_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitive_closure(spark, _next(spark, sf_dir), 4)


@register(f"SELECT 'inRegion' AS pred, h, t FROM ({REGION}) UNION SELECT 'custIn', h, t FROM ({CUST}) UNION SELECT 'suppIn', h, t FROM ({SUPP}) UNION SELECT 'locatedIn', c.h, r.t FROM ({CUST}) c JOIN ({REGION}) r ON c.t = r.h UNION SELECT 'hosts', r.t, s.h FROM ({SUPP}) s JOIN ({REGION}) r ON s.t = r.h")
def composition_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locatedIn by a chain, and hosts(R, S) :- inRegion(N, R), suppIn(S, N) against its direction."""
    rules = [Rule(Atom("locatedIn", "X", "Y"), (Atom("custIn", "X", "Z"), Atom("inRegion", "Z", "Y"))), Rule(Atom("hosts", "X", "Y"), (Atom("inRegion", "Z", "X"), Atom("suppIn", "Y", "Z")))]
    return chain_closure(spark, G.graph(spark, sf_dir, "custIn", "suppIn", "inRegion"), rules)


LOCATED = [Rule(Atom("locatedIn", "X", "Y"), (Atom("custIn", "X", "Z"), Atom("inRegion", "Z", "Y")))]


def located_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locatedIn(c, r) for every customer and region."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("r"))
    c = G.relation(spark, sf_dir, "custIn").select("h")
    return c.crossJoin(F.broadcast(r)).select(F.concat_ws("|", "h", "r").alias("qid"), F.lit("locatedIn").alias("pred"), "h", F.col("r").alias("t"))


LOCATED_SQL = f"SELECT c.h || '|r:' || r_regionkey AS qid, EXISTS (SELECT 1 FROM ({REGION}) n WHERE n.h = c.t AND n.t = 'r:' || r_regionkey) AS ok FROM ({CUST}) c, region"


@register(f"SELECT qid, CASE WHEN ok THEN 2 ELSE -1 END AS depth FROM ({LOCATED_SQL})")
def min_proof_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof depth of every customer's location: the rule, then the fact that binds the nation."""
    return min_depths(spark, located_goals(spark, sf_dir), G.graph(spark, sf_dir, "custIn", "inRegion"), LOCATED, max_depth=4)


@register(f"SELECT qid, CASE WHEN ok THEN 3 ELSE -1 END AS depth FROM ({LOCATED_SQL})")
def exact_proof_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one atom a step: the rule, then two facts."""
    return exact_depths(spark, located_goals(spark, sf_dir), G.graph(spark, sf_dir, "custIn", "inRegion"), LOCATED, exclude=False)


@register(f"SELECT qid, CASE WHEN ok THEN 'provable' ELSE 'not_provable' END AS status, CASE WHEN ok THEN 2 ELSE -1 END AS depth FROM ({LOCATED_SQL})")
def proof_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = statuses(spark, located_goals(spark, sf_dir), G.graph(spark, sf_dir, "custIn", "inRegion"), LOCATED, max_depth=4)
    return found


@register(f"SELECT depth, count(*) AS goals, CAST(sum(bf) AS BIGINT) AS children FROM (SELECT qid, 1 AS depth, 1 AS bf FROM ({LOCATED_SQL}) UNION ALL SELECT qid, 2, 1 FROM ({LOCATED_SQL})) GROUP BY depth")
def branching_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals and their children in each round of the search."""
    _, factors = statuses(spark, located_goals(spark, sf_dir), G.graph(spark, sf_dir, "custIn", "inRegion"), LOCATED, max_depth=2)
    return factors.groupBy("depth").agg(F.count("*").alias("goals"), F.sum("bf").alias("children"))


#: Nations in a row within their region.
ROW = "SELECT 'n:' || a AS h, 'n:' || b AS t FROM (SELECT n_nationkey AS a, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation) WHERE b IS NOT NULL"


@register(f"WITH RECURSIVE e AS ({ROW}), p(h, t, depth) AS (SELECT h, t, 1 FROM e UNION ALL SELECT p.h, e.t, p.depth + 1 FROM p JOIN e ON p.t = e.h), g AS (SELECT 'n:' || a.n_nationkey AS h, 'n:' || b.n_nationkey AS t FROM nation a, nation b) SELECT g.h || '|' || g.t AS qid, CAST(coalesce(min(2 * depth - 1), -1) AS INTEGER) AS depth FROM g LEFT JOIN p ON g.h = p.h AND g.t = p.t GROUP BY g.h, g.t")
def recursive_proof_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reach(X, Y) :- next(X, Y). reach(X, Y) :- next(X, Z), reach(Z, Y). For all pairs of nations.

    A path of d edges is 2 d - 1 steps: one of reach replaces it, one of next binds Z. The search
    goes on until no state is left.
    """
    rules = [Rule(Atom("reach", "X", "Y"), (Atom("next", "X", "Y"),)), Rule(Atom("reach", "X", "Y"), (Atom("next", "X", "Z"), Atom("reach", "Z", "Y")))]
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    name = lambda c: F.concat(F.lit("n:"), F.col(c).cast("string"))
    row = nation.select("n_nationkey", F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("b")).where("b is not null")
    facts = row.select(F.lit("next").alias("pred"), name("n_nationkey").alias("h"), name("b").alias("t"))
    n = nation.select(name("n_nationkey").alias("h"))
    goals = n.crossJoin(F.broadcast(n.select(F.col("h").alias("t")))).select(F.concat_ws("|", "h", "t").alias("qid"), F.lit("reach").alias("pred"), "h", "t")
    return min_depths(spark, goals, facts, rules)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph(spark, sf_dir, "custIn", "inRegion")


def _atom(p: str, a, b):
    return F.struct(F.lit(p).alias("p"), a.alias("a"), b.alias("b"))


def _states(spark: SparkSession, sf_dir: str, letter: str, *atoms) -> DataFrame:
    """States of the located goals with ids that begin with a letter."""
    g = located_goals(spark, sf_dir)
    return g.select(F.concat(F.lit(letter + "|"), "qid").alias("qid"), F.col("pred").alias("qp"), F.col("h").alias("qa"), F.col("t").alias("qb"), F.array(*atoms).alias("atoms"))


@register(
    f"WITH l AS ({LOCATED_SQL}) SELECT 'a|' || qid AS qid, 0 AS action, 'open' AS kind, 2 AS atoms FROM l UNION ALL SELECT 'a|' || qid, 1, 'end', 1 FROM l "
    "UNION ALL SELECT 'b|' || qid, 0, CASE WHEN ok THEN 'true' ELSE 'open' END, 1 FROM l UNION ALL SELECT 'b|' || qid, 1, 'end', 1 FROM l WHERE NOT ok "
    "UNION ALL SELECT 'c|' || qid, 0, 'false', 1 FROM l UNION ALL SELECT 'd|' || qid, 0, 'false', 1 FROM l UNION ALL SELECT 'e|' || qid, 0, 'false', 1 FROM l"
)
def one_step_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successors of states of five kinds: a goal; its rule's body; a goal without fact or rule; one that
    failed; and a goal whose only child is past the number of atoms."""
    h, t, free = F.col("h"), F.col("t"), F.lit("?0")
    goal = _atom("locatedIn", h, t)
    a = _states(spark, sf_dir, "a", goal)
    b = _states(spark, sf_dir, "b", _atom("custIn", h, free), _atom("inRegion", free, t))
    c = _states(spark, sf_dir, "c", _atom("nothing", h, t))
    d = _states(spark, sf_dir, "d", _atom("False", F.lit(""), F.lit("")))
    facts = _facts(spark, sf_dir)
    x = derive.successors(a.unionAll(b).unionAll(c).unionAll(d), facts, LOCATED, 20, end_action=True)
    x = x.unionAll(derive.successors(_states(spark, sf_dir, "e", goal), facts, LOCATED, 20, max_atoms=1))
    return x.select("qid", "action", "kind", F.size("atoms").alias("atoms"))


@register(f"SELECT qid, CASE WHEN ok THEN 'true' ELSE 'false' END AS kind, CASE WHEN ok THEN 2 ELSE 3 END AS depth, CASE WHEN ok THEN 2 ELSE 3 END AS moves, CAST(CASE WHEN ok THEN 1 ELSE -1 END AS DOUBLE) AS reward FROM ({LOCATED_SQL})")
def episode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of an episode for each goal, which take the first action every time."""
    from ..functions.scores import reward
    from ..plans.scratch import Scratch

    scratch, facts = Scratch(spark, "episode"), _facts(spark, sf_dir)
    e = derive.start(located_goals(spark, sf_dir)).select("*", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("history"))
    for _ in range(3):
        e = scratch.table(e.select(*derive.KEY, "atoms", "depth", "history"), "episodes")
        c = derive.successors(e, facts, LOCATED)
        e = derive.episode_step(e, e.select("qid", F.lit(0).alias("action")), c, 10)
    paid = reward(4, F.col("done"), F.col("kind") == "true", F.lit(1), F.col("kind") == "end")
    return e.select("qid", "kind", "depth", F.size("history").alias("moves"), paid.cast("double").alias("reward"))


@register(f"SELECT qid, CASE WHEN ok THEN 1 ELSE 2 END AS steps, CASE WHEN ok THEN 2 ELSE 1 END AS atoms FROM ({LOCATED_SQL})")
def unary_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals moved along their only child, up to the state that has none or a proof."""
    x = derive.advance(spark, derive.start(located_goals(spark, sf_dir)), _facts(spark, sf_dir), LOCATED)
    return x.select("qid", "steps", F.size("atoms").alias("atoms"))


@register(f"WITH g AS (SELECT s.h || '|r:' || r_regionkey AS goal, EXISTS (SELECT 1 FROM ({REGION}) n WHERE n.h = s.t AND n.t = 'r:' || r_regionkey) AS ok FROM ({SUPP}) s, region) SELECT goal, CAST(k AS INTEGER) AS trial, CASE WHEN ok THEN 2 ELSE 3 END AS depth, ok AS success FROM g, range(3) t(k)")
def random_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """served(S, R) :- inRegion(N, R), suppIn(S, N). A walk draws one of the region's nations unless one
    is a proof, and then fails."""
    rules = [Rule(Atom("served", "S", "R"), (Atom("inRegion", "N", "R"), Atom("suppIn", "S", "N")))]
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("r"))
    s = G.relation(spark, sf_dir, "suppIn").select("h").crossJoin(F.broadcast(r))
    goals = s.select(F.concat_ws("|", "h", "r").alias("qid"), F.lit("served").alias("pred"), "h", F.col("r").alias("t"))
    return derive.random_walks(spark, goals, G.graph(spark, sf_dir, "suppIn", "inRegion"), rules, 3, 5)


AT = Rule(Atom("at", "X", "Y"), (Atom("locatedIn", "X", "Y"),))


@register(f"SELECT qid, CASE WHEN ok THEN 2 ELSE -1 END AS depth FROM ({LOCATED_SQL})")
def ground_proof_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """at(X, Y) :- locatedIn(X, Y), by ground states: two rule applications."""
    goals = located_goals(spark, sf_dir).withColumn("pred", F.lit("at"))
    return derive.ground_depths(spark, goals, _facts(spark, sf_dir), [AT, *LOCATED])


@register(f"SELECT qid, r < 2 AS found, r < 2 AND ok AS proved, CASE WHEN r < 2 AND ok THEN 2 ELSE -1 END AS depth FROM (SELECT *, CAST(substr(qid, -1) AS INTEGER) AS r FROM ({LOCATED_SQL}))")
def proof_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memo holds the depths of the first two regions' goals; all are looked up."""
    goals, memo = located_goals(spark, sf_dir), derive.Memo(spark)
    some = goals.where("t in ('r:0', 'r:1')")
    memo.put("first", some.join(min_depths(spark, some, _facts(spark, sf_dir), LOCATED, max_depth=4), "qid"))
    return memo.look(goals.select("qid", "pred", "h", "t")).select("qid", "found", "proved", "depth")


@register(f"SELECT qid, 1 AS kind, 2 AS atoms FROM ({LOCATED_SQL})")
def rule_then_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two rules only the one whose first atom a fact resolves gives a child."""
    rules = [*LOCATED, Rule(Atom("locatedIn", "X", "Y"), (Atom("livesIn", "X", "Z"), Atom("inRegion", "Z", "Y")))]
    x = derive.rule_then_fact(derive.start(located_goals(spark, sf_dir)), _facts(spark, sf_dir), rules)
    return x.select("qid", "kind", F.size("atoms").alias("atoms"))


@register(f"SELECT qid, CASE WHEN ok THEN 2 ELSE -1 END AS depth FROM ({LOCATED_SQL}) UNION ALL SELECT h, 0 FROM ({CUST})")
def direct_fact_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without exclusion a goal that is a fact has depth 0."""
    c = G.relation(spark, sf_dir, "custIn").select(F.col("h").alias("qid"), "pred", "h", "t")
    goals = located_goals(spark, sf_dir).unionByName(c)
    return min_depths(spark, goals, _facts(spark, sf_dir), LOCATED, max_depth=4, exclude=False)


@register(f"SELECT qid, CASE WHEN ok THEN 2 ELSE -1 END AS depth FROM ({LOCATED_SQL})")
def deepened_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches to depths 1, 2 and 3, each over the goals that the ones before did not prove."""
    return derive.deepened(spark, located_goals(spark, sf_dir), _facts(spark, sf_dir), LOCATED, [1, 2, 3], derive.Memo(spark))
