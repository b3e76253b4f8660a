"""One-step derivation of proof states, and what is built on it: episodes, chains, walks, strategies.

A state is a row (qid, qp, qa, qb, atoms): an id, the query's atom, the atoms to prove. Terminal
states are one atom whose predicate is True, False or Endf; no atoms at all is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .prove import _fact_children, _free, _rule_children, canonical, prune
from .rules import Rule
from .scratch import Scratch, small

KEY = ("qid", "qp", "qa", "qb")


def terminal(name: str) -> Column:
    return F.array(F.struct(F.lit(name).alias("p"), F.lit("").alias("a"), F.lit("").alias("b")))


def kind(atoms: Column) -> Column:
    """empty, true, false, end or open."""
    first = F.get(atoms, F.lit(0))["p"]
    alone = F.size(atoms) == 1
    true = F.forall(atoms, lambda x: x["p"] == "True")
    return F.when(F.size(atoms) == 0, "empty").when(true, "true").when(F.exists(atoms, lambda x: x["p"] == "False"), "false").when(alone & (first == "Endf"), "end").otherwise("open")


def variable_positions(atoms: Column) -> Column:
    """array<struct<a:boolean,b:boolean>>: which arguments of each atom are variables."""
    return F.transform(atoms, lambda x: F.struct(_free(x["a"]).alias("a"), _free(x["b"]).alias("b")))


def start(goals: DataFrame) -> DataFrame:
    """The first state of goals (qid, pred, h, t)."""
    atom = F.array(F.struct(F.col("pred").alias("p"), F.col("h").alias("a"), F.col("t").alias("b")))
    return goals.select("qid", F.col("pred").alias("qp"), F.col("h").alias("qa"), F.col("t").alias("qb"), canonical(atom).alias("atoms"))


def successors(states: DataFrame, facts: DataFrame, rules: list[Rule], max_children: int | None = None, max_atoms: int | None = None, end_action: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """(qid, qp, qa, qb, action, kind, atoms): what each state becomes, actions numbered from 0.

    Children by facts come before those by rules, each in order of the fact or rule; the query
    itself is no fact. ``max_children`` keeps the first so many. Atoms that are facts are pruned
    from every child. If any child is a proof, the state has one successor, True. Children of more
    than ``max_atoms`` atoms, and those in ``seen`` (qid, atoms), are dropped. Without a child the
    successor is False. With ``end_action`` states whose children are all open, and that have room,
    get Endf as the last. Terminal states succeed themselves; an empty one is false.
    """
    now = kind(F.col("atoms"))
    live = states.select(*KEY, "atoms").where(now == "open")
    children = _fact_children(live, facts, ground=True)
    by_rules = _rule_children(live, rules)
    children = children.unionAll(by_rules) if by_rules is not None else children
    order = Window.partitionBy("qid")
    if max_children is not None:
        children = children.withColumn("_r", F.row_number().over(order.orderBy("kind", "via"))).where((F.col("_r") <= max_children) | (F.size("atoms") == 0)).drop("_r")
    x = prune(children.withColumnRenamed("kind", "_k"), facts, ("_k", "via")).withColumn("atoms", canonical(F.col("atoms")))
    x = x.withColumn("proof", F.bool_or(F.size("atoms") == 0).over(order))
    proofs = x.where("proof").select(*KEY, terminal("True").alias("atoms")).distinct().withColumn("action", F.lit(0))
    rest = x.where("not proof").groupBy(*KEY, "atoms").agg(F.min(F.struct("_k", "via")).alias("by"))
    if max_atoms is not None:
        rest = rest.where(F.size("atoms") <= max_atoms)
    if seen is not None:
        rest = rest.join(seen.select("qid", "atoms"), ["qid", "atoms"], "left_anti").select(*KEY, "atoms", "by")
    rest = rest.select(*KEY, "atoms", (F.row_number().over(order.orderBy("by", "atoms")) - 1).alias("action"))
    out = proofs.select(*KEY, "atoms", "action").unionAll(rest)
    none = live.select(*KEY).join(out.select("qid").distinct(), "qid", "left_anti").select(*KEY, terminal("False").alias("atoms"), F.lit(0).alias("action"))
    if end_action:
        room = rest.groupBy(*KEY).agg(F.count("*").cast("int").alias("n"))
        room = room if max_children is None else room.where(F.col("n") < max_children)
        out = out.unionAll(room.select(*KEY, terminal("Endf").alias("atoms"), F.col("n").alias("action")))
    done = states.where(now != "open").select(*KEY, F.when(now == "empty", terminal("False")).otherwise(F.col("atoms")).alias("atoms"), F.lit(0).alias("action"))
    return out.unionAll(none).unionAll(done).select(*KEY, "action", kind(F.col("atoms")).alias("kind"), "atoms")


def episode_step(episodes: DataFrame, choice: DataFrame, children: DataFrame, max_depth: int) -> DataFrame:
    """Episodes after their chosen action: (qid, qp, qa, qb, atoms, depth, history, kind, done, truncated).

    episodes: KEY, atoms, depth, history (array of actions); choice: (qid, action); children: of
    ``successors``. An episode that is over, or has no such action, stays as it is.
    """
    c = children.join(choice, ["qid", "action"]).select("qid", F.col("action").alias("_a"), F.col("atoms").alias("_to"))
    over = kind(F.col("atoms")) != "open"
    moves = ~over & F.col("_a").isNotNull()
    x = episodes.join(c, "qid", "left").select(
        *KEY, F.when(moves, F.col("_to")).otherwise(F.col("atoms")).alias("atoms"), (F.col("depth") + moves.cast("int")).alias("depth"), F.when(moves, F.concat("history", F.array("_a"))).otherwise(F.col("history")).alias("history")
    )
    k = kind(F.col("atoms"))
    truncated = (F.col("depth") >= max_depth) & (k == "open")
    return x.select("*", k.alias("kind"), ((k != "open") | truncated).alias("done"), truncated.alias("truncated"))


def advance(spark: SparkSession, states: DataFrame, facts: DataFrame, rules: list[Rule], limit: int = 20) -> DataFrame:
    """States moved along while they have exactly one successor that is open: KEY, atoms, steps."""
    scratch = Scratch(spark, "advance")
    open_, still = scratch.table(states.select(*KEY, "atoms", F.lit(0).alias("steps")), "states"), None
    for _ in range(limit):
        s = successors(open_, facts, rules)
        only = s.groupBy("qid").agg(F.count("*").alias("n"), F.min("kind").alias("kind"), F.first("atoms").alias("_to")).where("n = 1 and kind = 'open'")
        x = scratch.table(open_.join(only.select("qid", "_to"), "qid", "left"), "advanced")
        halt = x.where("_to is null").select(*KEY, "atoms", "steps")
        still = halt if still is None else still.unionAll(halt)
        open_ = x.where("_to is not null").select(*KEY, F.col("_to").alias("atoms"), (F.col("steps") + 1).alias("steps"))
        if open_.isEmpty():
            return still
    return still.unionAll(open_) if still is not None else open_


def draw_of(qid: Column, trial: Column, step: int, size: Column) -> Column:
    """A number from 0 to size - 1 by a hash of the goal, the trial and the step."""
    h = F.conv(F.substring(F.md5(qid), 1, 8), 16, 10).cast("long")
    return F.pmod((h + trial * 7919 + F.lit(step) * 104729) % 1000003, size)


def random_walks(spark: SparkSession, goals: DataFrame, facts: DataFrame, rules: list[Rule], trials: int, max_depth: int) -> DataFrame:
    """(goal, trial, depth, success): walks that take a successor by a seeded hash at every step."""
    scratch = Scratch(spark, "walks")
    each = start(goals).select(F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"), F.col("qid").alias("goal"), "qp", "qa", "qb", "atoms")
    walk = scratch.table(each.select(F.concat_ws("#", "goal", "trial").alias("qid"), "goal", "trial", "qp", "qa", "qb", "atoms", F.lit(0).alias("depth")), "walks")
    for step in range(max_depth):
        live = walk.where(kind(F.col("atoms")) == "open")
        if live.isEmpty():
            break
        s = scratch.table(successors(live, facts, rules), "successors")
        size = F.count("*").over(Window.partitionBy("qid"))
        s = s.join(live.select("qid", "goal", "trial"), "qid").withColumn("_n", size)
        took = s.where(F.col("action") == draw_of(F.col("goal"), F.col("trial"), step, F.col("_n"))).select("qid", F.col("atoms").alias("_to"))
        x = walk.join(took, "qid", "left").select("qid", "goal", "trial", "qp", "qa", "qb", F.coalesce("_to", "atoms").alias("atoms"), (F.col("depth") + F.col("_to").isNotNull().cast("int")).alias("depth"))
        walk = scratch.table(x, "walks")
    return walk.select("goal", "trial", "depth", (kind(F.col("atoms")) == "true").alias("success"))


def rule_then_fact(states: DataFrame, facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(qid, qp, qa, qb, kind, atoms): children by facts (kind 0), and of those by rules (kind 1)
    only the ones whose first atom some fact, other than the query, resolves at once."""
    live = states.select(*KEY, "atoms").where(kind(F.col("atoms")) == "open")
    f = _fact_children(live, facts, ground=True).select(*KEY, "kind", "atoms")
    r = _rule_children(live, rules)
    if r is None:
        return f.distinct()
    named = r.select(*KEY, "kind", canonical(F.col("atoms")).alias("atoms")).distinct()
    tried = named.select(F.concat_ws("#", "qid", F.md5(F.to_json("atoms"))).alias("qid"), F.col("qid").alias("_q"), "qp", "qa", "qb", "atoms")
    good = _fact_children(tried.select(*KEY, "atoms"), facts, ground=True).select("qid").distinct()
    kept = tried.join(good, "qid", "left_semi").select(F.col("_q").alias("qid"), "qp", "qa", "qb", F.lit(1).alias("kind"), "atoms")
    return f.unionAll(kept).select(*KEY, "kind", canonical(F.col("atoms")).alias("atoms")).distinct()


def ground_depths(spark: SparkSession, goals: DataFrame, facts: DataFrame, rules: list[Rule], max_depth: int = 6, max_subgoals: int | None = 8, candidates: int | None = 50, rules_each: int | None = 5) -> DataFrame:
    """(qid, depth): rule applications of the shortest proof through ground states, -1 without one.

    Each rule goes on with the first binding of ``bodies.constrained`` only, so it finds fewer proofs
    than ``prove.min_depths``. The goal is never a fact. The first subgoal that is no fact is expanded
    next; ``rules_each`` bounds the rules tried after the first step.
    """
    from .bodies import constrained

    scratch = Scratch(spark, "ground")
    facts = small(scratch.table(facts.select("pred", "h", "t").distinct(), "facts"))
    todo = scratch.table(start(goals).withColumn("rest", F.slice("atoms", 2, 1)), "goals")
    proved, seen = None, None
    for depth in range(1, max_depth + 1):
        goal = todo.select(F.concat_ws("#", "qid", F.md5(F.to_json("atoms"))).alias("sid"), *KEY, F.get("atoms", F.lit(0)).alias("g"), "rest")
        goal = scratch.table(goal, "expand")
        found = None
        heads: dict[str, int] = {}
        for r in rules:
            heads[r.head.p] = heads.get(r.head.p, 0) + 1
            if depth > 1 and rules_each is not None and heads[r.head.p] > rules_each:
                continue
            g = goal.where(F.col("g.p") == r.head.p).select(F.col("sid").alias("qid"), F.col("g.a").alias("h"), F.col("g.b").alias("t"))
            body = constrained(r, facts, g, candidates, 1).select(F.col("qid").alias("sid"), "body")
            body = body.where(~F.exists("body", lambda x: x["a"].startswith("?") | x["b"].startswith("?")))
            part = goal.join(body, "sid").select(*KEY, F.concat("rest", "body").alias("atoms"))
            found = part if found is None else found.unionAll(part)
        if found is None:
            break
        if max_subgoals is not None:
            found = found.where(F.size("atoms") <= max_subgoals)
        left = scratch.table(prune(found.distinct(), facts).distinct(), "left")
        done = left.where(F.size("atoms") == 0).select("qid", F.lit(depth).alias("depth")).distinct()
        proved = done if proved is None else proved.unionAll(done)
        fresh = left.where(F.size("atoms") > 0).join(done, "qid", "left_anti")
        if seen is not None:
            fresh = fresh.join(seen, ["qid", "atoms"], "left_anti")
        todo = scratch.table(fresh.select(*KEY, "atoms", F.slice("atoms", 2, F.greatest(F.size("atoms") - 1, F.lit(0))).alias("rest")), "todo")
        seen = todo.select("qid", "atoms") if seen is None else seen.unionAll(todo.select("qid", "atoms"))
        if todo.isEmpty():
            break
    if proved is None:
        return goals.select("qid", F.lit(-1).alias("depth"))
    best = proved.groupBy("qid").agg(F.min("depth").alias("depth"))
    return goals.select("qid").join(best, "qid", "left").select("qid", F.coalesce("depth", F.lit(-1)).alias("depth"))


class Memo:
    """Proved depths of goals between searches: ``look`` finds them, ``put`` adds a batch once.

    goals: (pred, h, t); a batch is a folder that is there only when it is whole.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or Scratch(spark, "memo").path("memo")

    def _all(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        parts = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        whole = [x.toString() for x in parts if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        schema = "pred string, h string, t string, depth int"
        return self.spark.read.schema(schema).parquet(*whole) if whole else self.spark.createDataFrame([], schema)

    def look(self, goals: DataFrame) -> DataFrame:
        """goals with found, proved and depth; of entries that differ the least proved depth counts."""
        best = self._all().groupBy("pred", "h", "t").agg(F.lit(True).alias("found"), F.min(F.when(F.col("depth") >= 0, F.col("depth"))).alias("depth"))
        x = goals.join(best, ["pred", "h", "t"], "left")
        return x.select(*goals.columns, F.coalesce("found", F.lit(False)).alias("found"), F.col("depth").isNotNull().alias("proved"), F.coalesce("depth", F.lit(-1)).alias("depth"))

    def put(self, batch: str, depths: DataFrame) -> None:
        depths.select("pred", "h", "t", F.col("depth").cast("int").alias("depth")).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def deepened(spark: SparkSession, goals: DataFrame, facts: DataFrame, rules: list[Rule], depths: list[int], memo: Memo, max_atoms: int = 20) -> DataFrame:
    """(qid, depth) by searches of growing depth; each takes only goals not proved yet, and saves what
    it proved under the depth's name, so a search that is begun again goes on where it stopped."""
    from .prove import min_depths

    for d in depths:
        open_ = memo.look(goals.select("qid", "pred", "h", "t")).where("not proved").select("qid", "pred", "h", "t")
        found = min_depths(spark, open_, facts, rules, d, max_atoms).where("depth >= 0")
        memo.put(f"depth-{d}", goals.join(found, "qid").select("pred", "h", "t", "depth"))
    return memo.look(goals.select("qid", "pred", "h", "t")).select("qid", "depth")
