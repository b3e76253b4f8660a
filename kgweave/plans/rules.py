"""Horn rules: a small driver-side program that plans are compiled from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

ATOM = "struct<p:string,a:string,b:string>"


@dataclass(frozen=True)
class Atom:
    p: str
    a: str
    b: str


@dataclass(frozen=True)
class Rule:
    """head :- body. Arguments whose first letter is a capital, or an underscore, are variables."""

    head: Atom
    body: tuple[Atom, ...]


def is_variable(arg: str) -> bool:
    return bool(arg) and (arg[0].isupper() or arg[0] == "_")


def symmetric_predicates(rules: list[Rule]) -> list[str]:
    """Predicates with a rule p(X, Y) :- p(Y, X)."""
    return sorted({r.head.p for r in rules if len(r.body) == 1 and r.body[0] == Atom(r.head.p, r.head.b, r.head.a) and r.head.a != r.head.b})


def chains(rules: list[Rule]) -> list[tuple[str, str, bool, str, bool]]:
    """(head, first, flipped, second, flipped) of rules whose two atoms are a path from X to Y.

    An atom that is written against the path's direction is flipped.
    """
    out = []
    for r in rules:
        if len(r.body) != 2 or not (is_variable(r.head.a) and is_variable(r.head.b)) or r.head.a == r.head.b:
            continue
        x, y = r.head.a, r.head.b
        for one, two in (r.body, r.body[::-1]):
            mid = {one.a, one.b} - {x}
            if len(mid) == 1 and x in (one.a, one.b) and {two.a, two.b} == mid | {y} and is_variable(z := mid.pop()) and z != y:
                out.append((r.head.p, one.p, one.a != x, two.p, two.a == y))
                break
    return out


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """rule_id, head, body."""
    rows = [(i, (r.head.p, r.head.a, r.head.b), [(x.p, x.a, x.b) for x in r.body]) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, f"rule_id int, head {ATOM}, body array<{ATOM}>")
