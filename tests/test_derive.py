import random

from pyspark.sql import functions as F

from kgweave.operators import negatives, ranking
from kgweave.plans import derive
from kgweave.plans.bodies import bindings, constrained
from kgweave.plans.ordered import numbered, running, running_max
from kgweave.plans.prove import min_depths
from kgweave.plans.rules import Atom, Rule


def rule(head, *body):
    return Rule(Atom(*head.split()), tuple(Atom(*b.split()) for b in body))


def facts_of(spark, rows):
    return spark.createDataFrame(rows, "pred string, h string, t string")


def goals_of(spark, rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "qid string, pred string, h string, t string")


FACTS = [("n", "a", "b"), ("n", "b", "c"), ("n", "b", "d"), ("m", "c", "z"), ("m", "d", "z"), ("n", "e", "e")]


def shown(df):
    return sorted((r.qid, r.action, r.kind, [(x.p, x.a, x.b) for x in r.atoms]) for r in df.collect())


def test_successors_in_order_with_caps_and_ends(spark):
    rules = [rule("l X Y", "n X Z", "k Z Y"), rule("l X Y", "m X Y")]
    facts = facts_of(spark, FACTS)
    start = derive.start(goals_of(spark, [("l", "a", "q"), ("n", "b", "?0"), ("n", "x", "y"), ("l", "c", "z")]))
    got = shown(derive.successors(start, facts, rules, end_action=True))
    assert got == [
        ("0", 0, "open", [("n", "a", "?0"), ("k", "?0", "q")]),
        ("0", 1, "open", [("m", "a", "q")]),
        ("0", 2, "end", [("Endf", "", "")]),
        ("1", 0, "true", [("True", "", "")]),
        ("2", 0, "false", [("False", "", "")]),
        ("3", 0, "true", [("True", "", "")]),
    ]
    capped = shown(derive.successors(start.where("qid = '0'"), facts, rules, max_children=1, end_action=True))
    assert capped == [got[0]]
    seen = derive.successors(start.where("qid = '0'"), facts, rules).where("action = 0").select("qid", "atoms")
    assert shown(derive.successors(start.where("qid = '0'"), facts, rules, seen=seen)) == [("0", 0, "open", [("m", "a", "q")])]
    assert shown(derive.successors(start.where("qid = '0'"), facts, rules, max_atoms=1)) == [("0", 0, "open", [("m", "a", "q")])]
    # The query is no premise, and terminal states stay.
    own = derive.start(goals_of(spark, [("n", "a", "b")]))
    assert shown(derive.successors(own, facts, rules)) == [("0", 0, "false", [("False", "", "")])]
    for name, kind in (("True", "true"), ("False", "false"), ("Endf", "end")):
        state = own.withColumn("atoms", derive.terminal(name))
        assert shown(derive.successors(state, facts, rules)) == [("0", 0, kind, [(name, "", "")])]
    empty = own.withColumn("atoms", F.slice("atoms", 2, 1))
    assert [r.kind for r in derive.successors(empty, facts, rules).collect()] == ["false"]
    assert derive.successors(own.limit(0), facts, rules, end_action=True).count() == 0


def test_variable_positions(spark):
    x = derive.start(goals_of(spark, [("n", "a", "?x")])).select(derive.variable_positions(F.col("atoms")).alias("v")).first().v
    assert [(v.a, v.b) for v in x] == [(False, True)]


def test_chains_advance_and_steps_stop_at_the_end(spark):
    rules = [rule("p X Y", "q X Y"), rule("q X Y", "r X Y"), rule("r X Y", "s X Y"), rule("r X Y", "n X Y")]
    facts = facts_of(spark, FACTS)
    start = derive.start(goals_of(spark, [("p", "u", "v"), ("s", "u", "v")]))
    got = {r.qid: (r.steps, r.atoms[0].p) for r in derive.advance(spark, start, facts, rules).collect()}
    assert got == {"0": (2, "r"), "1": (0, "s")}
    assert {r.steps for r in derive.advance(spark, start, facts, rules, 1).collect()} == {0, 1}
    e = start.select("*", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("history"))
    c = derive.successors(e, facts, rules)
    x = {r.qid: (r.kind, r.depth, r.done, r.truncated, list(r.history)) for r in derive.episode_step(e, e.select("qid", F.lit(0).alias("action")), c, 1).collect()}
    assert x == {"0": ("open", 1, True, True, [0]), "1": ("false", 1, True, False, [0])}
    x = {r.qid: r.depth for r in derive.episode_step(e, e.select("qid", F.lit(7).alias("action")), c, 1).collect()}
    assert x == {"0": 0, "1": 0}


def test_random_walks_draw_all_children(spark):
    # Both ways of b lead on, one of them to a proof.
    rules = [rule("l X Y", "n X Z", "m2 Z Y"), rule("m2 X Y", "end X Y")]
    facts = facts_of(spark, [*FACTS, ("end", "d", "w")])
    goals = goals_of(spark, [("l", "b", "w")])
    got = derive.random_walks(spark, goals, facts, rules, 40, 8)
    wins = {r.trial: r.success for r in got.collect()}
    assert len(wins) == 40 and {True, False} == set(wins.values())
    assert {r.trial: r.success for r in derive.random_walks(spark, goals, facts, rules, 40, 8).collect()} == wins


def test_rule_then_fact_needs_a_fact_at_once(spark):
    rules = [rule("l X Y", "n X Z", "m Z Y"), rule("l X Y", "none X Z", "m Z Y")]
    got = derive.rule_then_fact(derive.start(goals_of(spark, [("l", "a", "z"), ("n", "b", "?0")])), facts_of(spark, FACTS), rules)
    assert sorted((r.qid, r.kind, len(r.atoms)) for r in got.collect()) == [("0", 1, 2), ("1", 0, 0)]


def test_ground_search_keeps_the_first_binding(spark):
    rules = [rule("l X Y", "n X Z", "m Z Y"), rule("far X Y", "n X Z", "n Z Z2", "m Z2 Y"), rule("at X Y", "l X Y")]
    goals = [("l", "b", "z"), ("at", "b", "z"), ("l", "a", "z"), ("m", "c", "z"), ("at", "a", "z")]
    got = {r.qid: r.depth for r in derive.ground_depths(spark, goals_of(spark, goals), facts_of(spark, FACTS), rules).collect()}
    assert [got[str(i)] for i in range(5)] == [1, 2, -1, -1, -1]
    # What it proves has a proof in the full search.
    full = {r.qid: r.depth for r in min_depths(spark, goals_of(spark, goals), facts_of(spark, FACTS), rules).collect()}
    assert all(full[q] > 0 for q, d in got.items() if d > 0)


def test_memo_batches_count_once(spark, tmp_path):
    memo = derive.Memo(spark, f"file://{tmp_path}/memo")
    goals = goals_of(spark, [("l", "a", "b"), ("l", "a", "c")])
    assert {(r.found, r.proved, r.depth) for r in memo.look(goals).collect()} == {(False, False, -1)}
    one = goals.where("qid = '0'").withColumn("depth", F.lit(3))
    memo.put("x", one)
    memo.put("x", one)
    memo.put("y", one.withColumn("depth", F.lit(-1)))
    assert sorted((r.qid, r.found, r.proved, r.depth) for r in memo.look(goals).collect()) == [("0", True, True, 3), ("1", False, False, -1)]


def test_bindings_against_nested_loops(spark):
    rng = random.Random(5)
    rows = sorted({(rng.choice("pq"), rng.choice("abcd"), rng.choice("abcd")) for _ in range(14)})
    facts = facts_of(spark, rows)
    for head, *body in (("g X Y", "p X Z", "q Z Y"), ("g X X", "p X Z", "p Z X"), ("g X b", "q X Z", "p Z Z"), ("g X Y", "p Y Z", "q X W", "p W Z")):
        r = rule(head, *body)
        names = sorted({v for a in r.body for v in (a.a, a.b) if v[0].isupper()})
        found = [{}]
        for a in r.body:
            found = [{**b, **new} for b in found for p, h, t in rows if p == a.p for new in [{v: x for v, x in ((a.a, h), (a.b, t)) if v[0].isupper()}] if all(b.get(v, x) == x for v, x in ((a.a, h), (a.b, t)) if v[0].isupper()) and (a.a != a.b or h == t)]
        value = lambda b, v: b[v] if v[0].isupper() else v
        heads = {(value(b, r.head.a), value(b, r.head.b)) for b in found}
        assert {(x.h, x.t) for x in bindings(r, facts).collect()} == heads
        goals = spark.createDataFrame([(a + b, a, b) for a in "abcd" for b in "abcd"], "qid string, h string, t string")
        got = {(x.qid, *(x[f"v_{n}"] for n in names)) for x in bindings(r, facts, goals).collect()}
        assert got == {(value(b, r.head.a) + value(b, r.head.b), *(b[n] for n in names)) for b in found}
    first = bindings(rule("g X Y", "p X Z", "q Z Y"), facts, goals, 1).groupBy("qid").count()
    assert first.where("count > 1").count() == 0


def test_constrained_bodies(spark):
    facts = facts_of(spark, FACTS)
    goals = spark.createDataFrame([("1", "b", "z"), ("2", "a", "z")], "qid string, h string, t string")
    got = constrained(rule("l X Y", "n X Z", "m Z Y"), facts, goals).collect()
    assert sorted((r.qid, r["rank"], r.body[0].b) for r in got) == [("1", 1, "c"), ("1", 2, "d")]
    assert [r.body[0].b for r in constrained(rule("l X Y", "n X Z", "m Z Y"), facts, goals, keep=1).collect()] == ["c"]
    loose = constrained(rule("l X Y", "n X Z", "m W Y"), facts, goals).collect()
    assert all(r.body[1].a == "?W" for r in loose) and len(loose) == 3
    assert constrained(rule("l X Y", "n X Z", "none W Y"), facts, goals).count() == 0


def test_numbers_and_running_sums(spark):
    x = spark.createDataFrame([(i * 37 % 101, f"v{i:03d}") for i in range(101)] + [(50, "again")], "k int, v string").repartition(7)
    rows = numbered(spark, x, ["k", "v"], "i", 5).collect()
    assert [r.i for r in sorted(rows, key=lambda r: (r.k, r.v))] == list(range(5, 107))
    sums = {(r.k, r.s) for r in running(spark, x.withColumn("one", F.lit(1)), "k", {"s": "one"}, descending=True).collect()}
    assert sums == {(k, sum(r.k >= k for r in rows)) for k in {r.k for r in rows}}
    top = {r.k: r.m for r in running_max(spark, x.withColumn("w", F.col("k") % 13), "k", "w", "m").collect()}
    assert top == {k: min(k, 12) for k in top}
    assert numbered(spark, x.limit(0), ["k"], "i").count() == 0


def test_corruption_of_small_and_lonely_pools(spark):
    pool = negatives.placed(spark, spark.createDataFrame([("d", x) for x in "abc"] + [("lone", "z")], "domain string, entity string"))
    q = spark.createDataFrame([(1, "p", "a", "z"), (2, "p", "b", "z"), (3, "p", "nobody", "z")], "qid long, pred string, h string, t string")
    both = negatives.corrupt(q, pool, "both", 5).collect()
    assert sum(r.qid == 1 and r.side == "head" for r in both) == 3 and sum(r.qid == 1 and r.side == "tail" for r in both) == 2
    assert all(r.h != {1: "a", 2: "b"}[r.qid] for r in both if r.side == "head")
    assert all(r.t == "z" for r in both)
    kept = negatives.corrupt(q, pool, "head", 9, known=q)
    assert kept.count() == kept.distinct().count()
    assert {(r.qid, r.h) for r in kept.collect()} <= {(1, "c"), (2, "c")} | {(1, "b"), (2, "a")} - {(1, "b"), (2, "a")}
    assert negatives.shares("both", 5) == {"h": 3, "t": 2} and negatives.shares("tail", 5) == {"t": 5}
    assert negatives.corrupt(q, pool, "head").where("qid = 1").count() == 2


def test_domain_and_sampled_ranks(spark):
    rows = [("q", "p", e, s, e == 0, e) for e, s in enumerate((5.0, 9.0, 5.0, 1.0, 7.0))]
    x = spark.createDataFrame(rows, "qid string, pred string, entity int, score double, truth boolean, tie int")
    domain = spark.createDataFrame([("p", e) for e in (1, 2, 3)], "pred string, entity int")
    assert tuple(ranking.domain_ranks(x, domain, ["qid"]).first()) == ("q", 2, 2.5, 3)
    known = spark.createDataFrame([("q", 1)], "qid string, entity int")
    assert tuple(ranking.domain_ranks(x, domain, ["qid"], known).first()) == ("q", 1, 1.5, 2)
    assert tuple(ranking.sampled_ranks(x, 2, ["qid"]).first()) == ("q", 2, 2.5, 3)
    assert ranking.sorted_position(x.withColumn("masked", F.col("entity") == 1), ["qid"]).first()["rank"] == 3
