"""Proof search from goals: a frontier of states that grows by joins with facts and rules.

A state is the list of atoms still to be proved; the first is resolved next. Variables are "?0",
"?1", ... in order of appearance, so equal states are equal arrays. All goals share one frontier,
keyed by goal id, and each round is one written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import Rule, is_variable
from .scratch import Scratch, small

MAX_ATOMS, MAX_DEPTH = 20, 20
#: Keys that a relation's facts are dealt over where goals bind neither argument.
SALT = 16


def _free(c: Column) -> Column:
    return c.startswith("?")


def _replaced(atoms: Column, pairs: list[tuple[Column, Column]]) -> Column:
    """Atoms with each first column of ``pairs`` replaced by its second, all at once."""

    def arg(c: Column) -> Column:
        out = c
        for old, new in reversed(pairs):
            out = F.when(c == old, new).otherwise(out)
        return out

    return F.transform(atoms, lambda x: F.struct(x["p"].alias("p"), arg(x["a"]).alias("a"), arg(x["b"]).alias("b")))


def canonical(atoms: Column) -> Column:
    """Variables renamed in order of first appearance; the order of atoms stays."""
    names = F.array_distinct(F.filter(F.flatten(F.transform(atoms, lambda x: F.array(x["a"], x["b"]))), _free))

    def arg(c: Column) -> Column:
        return F.when(_free(c), F.concat(F.lit("?"), (F.array_position(names, c) - 1).cast("string"))).otherwise(c)

    return F.transform(atoms, lambda x: F.struct(x["p"].alias("p"), arg(x["a"]).alias("a"), arg(x["b"]).alias("b")))


def _fact_children(frontier: DataFrame, facts: DataFrame, ground: bool = False, exclude: bool = True) -> DataFrame:
    """Children by facts that bind the goal's free arguments; kind 0, via the fact.

    One equi-join for each pattern of free arguments; ``ground`` takes goals without any too,
    which eager pruning has left none of. With ``exclude`` the goal's own query is no fact.
    """
    f = facts.select(F.col("pred").alias("fp"), F.col("h").alias("fh"), F.col("t").alias("ft"))
    rest = F.slice("atoms", 2, F.greatest(F.size("atoms") - 1, F.lit(0)))
    own = (F.col("fp") == F.col("qp")) & (F.col("fh") == F.col("qa")) & (F.col("ft") == F.col("qb"))
    g = frontier.withColumns({"gp": F.get("atoms", F.lit(0))["p"], "ga": F.get("atoms", F.lit(0))["a"], "gb": F.get("atoms", F.lit(0))["b"]})
    tail = g.where(~_free(F.col("ga")) & _free(F.col("gb"))).join(f, (F.col("gp") == F.col("fp")) & (F.col("ga") == F.col("fh")))
    head = g.where(_free(F.col("ga")) & ~_free(F.col("gb"))).join(f, (F.col("gp") == F.col("fp")) & (F.col("gb") == F.col("ft")))
    # These meet a whole relation, so its facts are dealt over SALT keys, and the goals go to each.
    salted = g.where(_free(F.col("ga")) & _free(F.col("gb"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = f.withColumn("fs", F.pmod(F.xxhash64("fh", "ft"), F.lit(SALT)).cast("int"))
    both = salted.join(dealt, (F.col("gp") == F.col("fp")) & (F.col("salt") == F.col("fs")) & ((F.col("ga") != F.col("gb")) | (F.col("fh") == F.col("ft")))).drop("salt", "fs")
    out = tail.unionByName(head).unionByName(both)
    if ground:
        out = out.unionByName(g.where(~_free(F.col("ga")) & ~_free(F.col("gb"))).join(f, (F.col("gp") == F.col("fp")) & (F.col("ga") == F.col("fh")) & (F.col("gb") == F.col("ft"))))
    out = out.where(~own) if exclude else out
    atoms = _replaced(rest, [(F.col("ga"), F.col("fh")), (F.col("gb"), F.col("ft"))])
    return out.select("qid", "qp", "qa", "qb", atoms.alias("atoms"), F.lit(0).alias("kind"), F.concat_ws("|", "fh", "ft").alias("via"))


def _rule_children(frontier: DataFrame, rules: list[Rule], behind: bool = False) -> DataFrame | None:
    """Children by rules: body, then the remaining atoms (``behind``: the other way round), under
    the most general unifier; kind 1, via the rule's place."""
    out = None
    g = frontier.withColumns({"gp": F.get("atoms", F.lit(0))["p"], "ga": F.get("atoms", F.lit(0))["a"], "gb": F.get("atoms", F.lit(0))["b"]})
    for i, r in enumerate(rules):
        x = g.where(F.col("gp") == r.head.p)
        bind: dict[str, Column] = {}
        remaining: list[tuple[Column, Column]] = []
        ga, gb = F.col("ga"), F.col("gb")
        for side, (arg, goal) in enumerate(((r.head.a, ga), (r.head.b, gb))):
            if is_variable(arg) and arg not in bind:
                bind[arg] = goal
                continue
            # A constant, or a variable met before: the goal's argument must be it or become it.
            want = bind[arg] if is_variable(arg) else F.lit(arg)
            x = x.where((goal == want) | _free(goal) | _free(want))
            new = F.when(_free(goal), want).otherwise(goal)
            remaining += [(goal, new), (want, new)] if is_variable(arg) else [(goal, new)]
            if is_variable(arg):
                bind[arg] = new
            elif side == 0:
                gb = F.when(gb == ga, new).otherwise(gb)

        def term(arg: str, bind=bind) -> Column:
            return (bind[arg] if arg in bind else F.lit("?_" + arg)) if is_variable(arg) else F.lit(arg)

        body = F.array(*[F.struct(F.lit(a.p).alias("p"), term(a.a).alias("a"), term(a.b).alias("b")) for a in r.body])
        rest = F.slice("atoms", 2, F.greatest(F.size("atoms") - 1, F.lit(0)))
        rest = _replaced(rest, remaining) if remaining else rest
        part = x.select("qid", "qp", "qa", "qb", (F.concat(rest, body) if behind else F.concat(body, rest)).alias("atoms"), F.lit(1).alias("kind"), F.lit(f"{i:06d}").alias("via"))
        out = part if out is None else out.unionAll(part)
    return out


def prune(children: DataFrame, facts: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Children without their atoms that are facts, other than the query itself; in order.

    ``extra`` columns are kept beside them.
    """
    key = ["qid", "qp", "qa", "qb", *extra, "atoms"]
    each = children.select(*key, F.posexplode_outer("atoms").alias("pos", "atom"))
    each = each.withColumns({"p": F.col("atom.p"), "a": F.col("atom.a"), "b": F.col("atom.b")})
    f = facts.select(F.col("pred").alias("fp"), F.col("h").alias("fh"), F.col("t").alias("ft")).distinct()
    hit = each.join(f, (F.col("p") == F.col("fp")) & (F.col("a") == F.col("fh")) & (F.col("b") == F.col("ft")), "left")
    own = (F.col("p") == F.col("qp")) & (F.col("a") == F.col("qa")) & (F.col("b") == F.col("qb"))
    stays = F.when(F.col("fp").isNull() | own, F.struct("pos", "atom"))
    kept = hit.groupBy(*key).agg(F.sort_array(F.collect_list(stays)).alias("kept"))
    left = F.filter(F.transform("kept", lambda x: x["atom"]), lambda x: x.isNotNull())
    return kept.select("qid", "qp", "qa", "qb", *extra, left.alias("atoms"))


def _state_key() -> Column:
    return F.unhex(F.md5(F.concat_ws("|", F.col("qid").cast("string"), F.to_json("atoms"))))


class Search:
    """A breadth-first search for all goals at once, one written table a round.

    ``eager`` prunes ground facts from children as they are made and never takes a goal as its own
    premise; without it one atom is resolved a step, bodies go behind the remaining atoms, and
    ``exclude`` says if goals are premises.
    """

    def __init__(self, spark: SparkSession, facts: DataFrame, rules: list[Rule], max_depth: int, max_atoms: int, eager: bool = True, exclude: bool = True):
        self.scratch = Scratch(spark, "prove")
        self.facts = small(self.scratch.table(facts.select("pred", "h", "t").distinct(), "facts"))
        self.rules, self.max_depth, self.max_atoms, self.eager, self.exclude = rules, max_depth, max_atoms, eager, exclude

    def _children(self, frontier: DataFrame) -> DataFrame:
        key = ["qid", "qp", "qa", "qb"]
        out = _fact_children(frontier, self.facts, not self.eager, self.exclude)
        by_rules = _rule_children(frontier, self.rules, not self.eager)
        out = out.unionAll(by_rules) if by_rules is not None else out
        out = out.select(*key, canonical(F.col("atoms")).alias("atoms")).distinct()
        return prune(out, self.facts).select(*key, canonical(F.col("atoms")).alias("atoms")).distinct() if self.eager else out

    def run(self, goals: DataFrame) -> None:
        """Sets ``proved`` (qid, depth), ``left`` (states not followed for depth) and ``factors``
        (qid, depth, bf: children of a goal's states in a round)."""
        start = F.array(F.struct(F.col("pred").alias("p"), F.col("h").alias("a"), F.col("t").alias("b")))
        states = goals.select("qid", F.col("pred").alias("qp"), F.col("h").alias("qa"), F.col("t").alias("qb"), start.alias("atoms"))
        if self.exclude:
            known = states.select("qid", F.lit(0).alias("depth")).limit(0)
        else:
            f = self.facts.select(F.col("pred").alias("qp"), F.col("h").alias("qa"), F.col("t").alias("qb"))
            known = states.join(f, ["qp", "qa", "qb"], "left_semi").select("qid", F.lit(0).alias("depth"))
        self.proved = self.scratch.table(known, "proved")
        self.left = self.scratch.table(states.join(self.proved, "qid", "left_anti").withColumn("key", _state_key()), "frontier")
        self.factors = None
        # States met before, as 128-bit keys: what is read again each round does not grow with the atoms.
        seen = self.left.select("key")
        for depth in range(1, self.max_depth + 1):
            children = self.scratch.table(self._children(self.left), "children")
            made = children.groupBy("qid").agg(F.count("*").alias("bf")).select("qid", F.lit(depth).alias("depth"), "bf")
            self.factors = made if self.factors is None else self.factors.unionAll(made)
            done = children.where(F.size("atoms") == 0).select("qid", F.lit(depth).alias("depth"))
            self.proved = self.proved.unionAll(done)
            fresh = children.where(F.size("atoms").between(1, self.max_atoms)).join(done, "qid", "left_anti").withColumn("key", _state_key()).join(seen, "key", "left_anti")
            self.left = self.scratch.table(fresh, "frontier")
            if self.left.isEmpty():
                break
            seen = seen.unionAll(self.left.select("key"))

    def depths(self, goals: DataFrame) -> DataFrame:
        best = self.proved.groupBy("qid").agg(F.min("depth").alias("depth"))
        return goals.select("qid").join(best, "qid", "left").select("qid", F.coalesce("depth", F.lit(-1)).alias("depth"))

    def statuses(self, goals: DataFrame) -> DataFrame:
        """(qid, status, depth): provable, not_provable, or depth_limit_exceeded where states are left."""
        open_ = self.left.select("qid").distinct().withColumn("open", F.lit(True))
        x = self.depths(goals).join(open_, "qid", "left")
        status = F.when(F.col("depth") >= 0, "provable").when(F.col("open"), "depth_limit_exceeded").otherwise("not_provable")
        return x.select("qid", status.alias("status"), "depth")


def min_depths(spark: SparkSession, goals: DataFrame, facts: DataFrame, rules: list[Rule], max_depth: int = MAX_DEPTH, max_atoms: int = MAX_ATOMS, exclude: bool = True) -> DataFrame:
    """qid, depth of every goal in ``goals`` (qid, pred, h, t): resolution steps of its shortest
    proof, -1 if there is none within ``max_depth`` steps and ``max_atoms`` atoms.

    The goal itself is never a premise; without ``exclude`` it may be, and a goal that is a fact has
    depth 0. Facts are pruned as soon as they are ground. A state that a goal has met before, up to
    names of variables, is not followed again; proved goals leave.
    """
    search = Search(spark, facts, rules, max_depth, max_atoms, exclude=exclude)
    search.run(goals)
    return search.depths(goals)


def exact_depths(spark: SparkSession, goals: DataFrame, facts: DataFrame, rules: list[Rule], exclude: bool, max_depth: int = 7, max_atoms: int = 10) -> DataFrame:
    """qid, depth by one atom a step without pruning: a goal that is a fact has depth 0, unless
    ``exclude`` keeps goals from being premises."""
    search = Search(spark, facts, rules, max_depth, max_atoms, eager=False, exclude=exclude)
    search.run(goals)
    return search.depths(goals)


def statuses(spark: SparkSession, goals: DataFrame, facts: DataFrame, rules: list[Rule], max_depth: int, max_atoms: int = MAX_ATOMS) -> tuple[DataFrame, DataFrame]:
    """(qid, status, depth) and branching factors (qid, depth, bf) of an exhaustive search."""
    search = Search(spark, facts, rules, max_depth, max_atoms)
    search.run(goals)
    return search.statuses(goals), search.factors
