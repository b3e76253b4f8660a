import random

import pytest
from oracle import min_depth

from kgweave.plans.bodies import bindings
from kgweave.plans.closure import chain_closure, transitive_closure
from kgweave.plans.prove import min_depths
from kgweave.plans.rules import Atom, Rule, chains, symmetric_predicates


def rule(head, *body):
    return Rule(Atom(*head.split()), tuple(Atom(*b.split()) for b in body))


def prove(spark, goals, facts, rules, **kw):
    g = spark.createDataFrame([(str(i), *x) for i, x in enumerate(goals)], "qid string, pred string, h string, t string")
    f = spark.createDataFrame(facts, "pred string, h string, t string")
    found = {r.qid: r.depth for r in min_depths(spark, g, f, rules, **kw).collect()}
    return [found[str(i)] for i in range(len(goals))]


def plain(goals, facts, rules, **kw):
    rs = [((r.head.p, r.head.a, r.head.b), [(a.p, a.a, a.b) for a in r.body]) for r in rules]
    return [min_depth(g, facts, rs, **kw) for g in goals]


def test_chain_depths_and_exclusion(spark):
    facts = [("n", "a", "b"), ("n", "b", "c"), ("n", "c", "d"), ("l", "d", "z")]
    rules = [rule("l X Z", "n X Y", "l Y Z")]
    goals = [("l", x, "z") for x in "cbad"]
    got = prove(spark, goals, facts, rules)
    assert got == plain(goals, facts, rules)
    assert got[0] < got[1] < got[2]
    assert got[3] == -1


def test_cycle_ends(spark):
    facts = [("n", "a", "b"), ("n", "b", "a")]
    assert prove(spark, [("l", "a", "z")], facts, [rule("l X Z", "n X Y", "l Y Z")]) == [-1]


def test_symmetric_shared_and_repeated_variables(spark):
    facts = [("p", "a", "b"), ("aunt", "m", "s"), ("brother", "k", "s"), ("brother", "j", "t"), ("e", "u", "u"), ("e", "u", "v")]
    rules = [rule("p X Y", "p Y X"), rule("unc X Y", "aunt X Z", "brother Y Z"), rule("loop X X", "e X X"), rule("any X Y", "e Z Z", "p X Y")]
    goals = [("p", "b", "a"), ("p", "a", "b"), ("unc", "m", "k"), ("unc", "m", "j"), ("loop", "u", "u"), ("loop", "u", "v"), ("any", "a", "b")]
    got = prove(spark, goals, facts, rules, max_depth=5)
    assert got == plain(goals, facts, rules, max_depth=5)
    assert [d > 0 for d in got] == [True, False, True, False, True, False, True]


@pytest.mark.parametrize("seed", range(3))
def test_random_programs_against_plain_search(spark, seed):
    rng = random.Random(seed)
    names, preds, variables = "abcd", "pqr", "XYZ"
    facts = sorted({(rng.choice(preds), rng.choice(names), rng.choice(names)) for _ in range(8)})
    rules = []
    for _ in range(3):
        body = [f"{rng.choice(preds)} {rng.choice(variables)} {rng.choice(variables)}" for _ in range(rng.randint(1, 2))]
        rules.append(rule(f"{rng.choice(preds)} {rng.choice(variables)} {rng.choice(variables + 'a')}", *body))
    goals = [(p, a, b) for p in preds for a in names for b in names[:2]]
    kw = {"max_depth": 4, "max_atoms": 4}
    assert prove(spark, goals, facts, rules, **kw) == plain(goals, facts, rules, **kw)


def test_closures(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    got = {(r.h, r.t): r.depth for r in transitive_closure(spark, spark.createDataFrame(edges, "h string, t string")).collect()}
    want, reach = {e: 1 for e in edges}, set(edges)
    for depth in range(2, 6):
        reach = {(a, d) for a, b in reach for c, d in edges if b == c}
        for p in reach:
            want.setdefault(p, depth)
    assert got == want
    facts = spark.createDataFrame([("p", "a", "b"), ("q", "c", "b"), ("q", "d", "c")], "pred string, h string, t string")
    rules = [rule("s X Y", "p X Z", "q Y Z"), rule("s X Y", "s X Z", "q Y Z")]
    assert {(r.h, r.t) for r in chain_closure(spark, facts, rules).where("pred = 's'").collect()} == {("a", "c"), ("a", "d")}
    assert chains([rule("h X Y", "p X Z", "q Z Y"), rule("h X Y", "p Z X", "q Y Z"), rule("h X Y", "p X Y", "q X Y")]) == [("h", "p", False, "q", False), ("h", "p", True, "q", True)]
    assert symmetric_predicates([rule("p X Y", "p Y X"), rule("q X Y", "p X Y")]) == ["p"]


def test_exact_depths_and_statuses(spark):
    from kgweave.plans.prove import exact_depths, statuses

    facts = spark.createDataFrame([("n", "a", "b"), ("n", "b", "c"), ("l", "c", "z")], "pred string, h string, t string")
    goals = spark.createDataFrame([("0", "l", "c", "z"), ("1", "l", "b", "z"), ("2", "l", "a", "z"), ("3", "l", "z", "a")], "qid string, pred string, h string, t string")
    rules = [rule("l X Z", "n X Y", "l Y Z")]
    got = {r.qid: r.depth for r in exact_depths(spark, goals, facts, rules, exclude=False).collect()}
    # A rule step, then a step for each atom of its body.
    assert got == {"0": 0, "1": 3, "2": 5, "3": -1}
    assert {r.qid: r.depth for r in exact_depths(spark, goals, facts, rules, exclude=True).collect()}["0"] == -1
    found, factors = statuses(spark, goals, facts, rules, max_depth=2)
    assert {r.qid: (r.status, r.depth) for r in found.collect()} == {"0": ("not_provable", -1), "1": ("provable", 2), "2": ("depth_limit_exceeded", -1), "3": ("not_provable", -1)}
    assert {(r.qid, r.depth): r.bf for r in factors.collect()}["1", 1] == 1


def test_a_limit_is_taken_before_the_last_join(spark):
    """The first bindings of a goal are those of all bindings, but no goal meets all facts of its key."""
    rule = Rule(Atom("served", "C", "R"), (Atom("custIn", "C", "N"), Atom("suppIn", "S", "N"), Atom("inRegion", "N", "R")))
    # A customer in two nations, one of them without supplier; suppliers by the hundred, one of them told twice.
    rows = [("custIn", f"c:{i}", f"n:{i % 3}") for i in range(20)] + [("custIn", "c:0", "n:1"), ("custIn", "c:1", "n:3")] + [("inRegion", f"n:{i}", "r:0") for i in range(4)]
    rows += [("suppIn", f"s:{i}", f"n:{i % 3}") for i in range(300)] + [("suppIn", "s:0", "n:0")]
    facts = spark.createDataFrame(rows, "pred string, h string, t string")
    goals = spark.createDataFrame([(f"q{i % 19}", f"c:{i}", f"r:{i % 2}") for i in range(20)], "qid string, h string, t string")
    cut = bindings(rule, facts, goals, 6)
    by: dict = {}
    for r in bindings(rule, facts, goals).collect():
        by.setdefault(r.qid, set()).add((r.v_C, r.v_N, r.v_R, r.v_S))
    want = {(q, *x) for q, some in by.items() for x in sorted(some)[:6]}
    assert len(want) == 6 * len(by) and {(r.qid, r.v_C, r.v_N, r.v_R, r.v_S) for r in cut.collect()} == want
    plan = cut._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-!"))
    top = next(i for i, line in enumerate(plan) if "Join Inner" in line)
    assert any("Window" in line and depth(line) > depth(plan[top]) for line in plan[top + 1 :])
