"""Rule bodies as joins: bindings of their variables through facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import Atom, Rule, is_variable

#: Prefix of the columns that hold a variable's constant.
VAR = "v_"


def _next(body: list[Atom], bound: set[str]) -> Atom:
    """The atom with the most arguments that are constants or bound; of equals the first."""
    return max(body, key=lambda a: sum(not is_variable(x) or x in bound for x in (a.a, a.b)))


def _term(arg: str) -> Column:
    return F.col(VAR + arg) if is_variable(arg) else F.lit(arg)


def bind_atom(rows: DataFrame | None, atom: Atom, facts: DataFrame, bound: set[str], limit: int | None = None) -> DataFrame:
    """``rows`` (with a column for each bound variable) joined with the facts that fit an atom.

    limit: a row meets the first so many different facts only, in order of the new variables' names.
    """
    f = facts.where(F.col("pred") == atom.p)
    if atom.a == atom.b:
        f = f.where("h = t")
    on, new = [], {}
    for arg, side in ((atom.a, "_h"), (atom.b, "_t")):
        if not is_variable(arg):
            f = f.where(F.col(side[1]) == arg)
        elif arg in bound:
            on.append(F.col(VAR + arg) == F.col(side))
        else:
            new[arg] = side
    f = f.select(F.col("h").alias("_h"), F.col("t").alias("_t"))
    columns = [F.col(side).alias(VAR + arg) for arg, side in new.items()]
    if rows is None:
        return f.select(*columns).distinct()
    if limit is not None and new:
        key = [side for side in ("_h", "_t") if side not in new.values()]
        order = [new[x] for x in sorted(new)]
        f = f.distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*key or [F.lit(0)]).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")
    condition = on[0] if on else F.lit(True)
    for c in on[1:]:
        condition = condition & c
    return rows.join(f, condition, "inner" if new else "left_semi").select(*rows.columns, *columns)


def bindings(rule: Rule, facts: DataFrame, goals: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Distinct bindings of a rule's head under which all atoms of its body are ``facts`` (pred, h, t).

    goals: (qid, h, t), the head's arguments; without it all heads (h, t) are found. Each step
    joins the atom with the most bound arguments; variables that no later atom and not the head
    needs are dropped at once. With goals the result has all variables of the body, so each proof
    is a row; ``limit`` keeps the first so many of a goal in order of its variables. No row of the
    last join needs more than the first ``limit`` facts of its key, so those are taken before it.
    """
    body, rows, bound = list(rule.body), None, set()
    if goals is not None:
        same = rule.head.a == rule.head.b and is_variable(rule.head.a)
        rows = goals.where("h = t") if same else goals
        for arg, side in ((rule.head.a, "h"), (rule.head.b, "t")):
            if not is_variable(arg):
                rows = rows.where(F.col(side) == arg)
        heads = {x: s for x, s in ((rule.head.b, "t"), (rule.head.a, "h")) if is_variable(x)}
        rows, bound = rows.select("qid", *[F.col(s).alias(VAR + x) for x, s in heads.items()]), set(heads)
    while body:
        atom = _next(body, bound)
        body.remove(atom)
        rows = bind_atom(rows, atom, facts, bound, limit if goals is not None and not body else None)
        bound |= {x for x in (atom.a, atom.b) if is_variable(x)}
        # What can be checked now only takes rows away, so it goes before anything is shuffled.
        for ready in [a for a in body if all(not is_variable(x) or x in bound for x in (a.a, a.b))]:
            body.remove(ready)
            rows = bind_atom(rows, ready, facts, bound)
        if goals is None:
            needed = {x for a in (*body, rule.head) for x in (a.a, a.b)} & bound
            if needed != bound:
                rows, bound = rows.select(*[VAR + x for x in sorted(needed)]).distinct(), needed
    if goals is None:
        return rows.select(_term(rule.head.a).alias("h"), _term(rule.head.b).alias("t")).distinct()
    names = [VAR + x for x in sorted(bound)]
    out = rows.select("qid", *names).distinct()
    if limit is not None:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(*names))).where(F.col("_r") <= limit).drop("_r")
    return out


def constrained(rule: Rule, facts: DataFrame, goals: DataFrame, candidates: int | None = 50, keep: int | None = 5) -> DataFrame:
    """(qid, rank, body): bodies under bindings from the first atom that has an unbound variable.

    Of its facts the first ``candidates`` of a goal, in order (h, t), give bindings. The other atoms
    that had unbound variables must then be facts where they are ground; where they are not, their
    predicate must have some. The first ``keep`` that do are kept; None sets no bound. goals: qid,
    h, t. body: array of atoms (p, a, b), with "?X" for what is still unbound.
    """
    start, bound = bindings(Rule(rule.head, ()), facts, goals), {x for x in (rule.head.a, rule.head.b) if is_variable(x)}
    loose = [a for a in rule.body if any(is_variable(x) and x not in bound for x in (a.a, a.b))]
    rows = start.withColumn("_n", F.lit(1))
    if loose:
        names = set(bound)
        rows = bind_atom(start, loose[0], facts, names)
        new = [VAR + x for x in (loose[0].a, loose[0].b) if is_variable(x) and x not in bound]
        bound |= {x for x in (loose[0].a, loose[0].b) if is_variable(x)}
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(*new)))
        if candidates is not None:
            rows = rows.where(F.col("_n") <= candidates)
        for a in loose[1:]:
            if all(not is_variable(x) or x in bound for x in (a.a, a.b)):
                rows = bind_atom(rows, a, facts, bound)
            else:
                rows = rows.join(facts.where(F.col("pred") == a.p).select(F.col("pred").alias("_p")).limit(1), F.lit(True), "left_semi")
    term = lambda x: F.lit("?" + x) if is_variable(x) and x not in bound else _term(x)
    body = F.array(*[F.struct(F.lit(a.p).alias("p"), term(a.a).alias("a"), term(a.b).alias("b")) for a in rule.body])
    out = rows.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("_n")).alias("rank"), body.alias("body"))
    return out if keep is None else out.where(F.col("rank") <= keep)
