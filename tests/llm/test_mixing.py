import hashlib
import random

from helpers import ODD, documents

from kgweave.llm import mixing


def brute(rows):
    size = lambda t: len((t or "").encode().split())
    place = lambda d, t: int(hashlib.md5(f"{'' if d is None else d}|{t or ''}".encode()).hexdigest()[:15], 16)
    by = {}
    for d, t, s in rows:
        by.setdefault(s, []).append((place(d, t), size(t), d))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(z for _, z, _ in by[s]) for s in names}
    target, open_, rest = {}, set(names), 1.5 * sum(total.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else level * weight[s]
        rest -= sum(target[s] for s in full)
        open_ -= full or open_
    out = []
    for s in names:
        base = int(target[s] >= total[s])
        budget, start = target[s] - base * total[s], 0
        for _, z, d in sorted(by[s], key=lambda r: r[0]):
            out.append((d, z, total[s], round(target[s], 6), z * (base + (2 * start + z < 2 * budget))))
            start += z
    return sorted(out, key=str)


def run(spark, rows):
    got = mixing.mix_plan(spark, documents(spark, rows)).collect()
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "b", "b", "b", "c", None, "é"])) for i in range(400)]
    rows += [(d, (t or "")[:400] if t else t, "odd") for d, t in ODD]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows) == run(spark, rows)


def test_repeated_rows_meet_the_target(spark):
    # One row 150 times in a source: the budget ends among its copies.
    rows = [(1, "w " * 10, "a")] * 150 + [(i, "w " * 10, "a") for i in range(2, 22)] + [(i, "v " * 7, "b") for i in range(100, 160)] + [(9, "x y", None)] * 30
    got = run(spark, rows)
    assert got == brute(rows)
    for size in {r[2] for r in got}:
        of = [r for r in got if r[2] == size]
        assert abs(sum(r[4] for r in of) - of[0][3]) <= 5
    out = mixing.mix(spark, documents(spark, rows))
    assert out.count() == sum(r[4] // r[1] for r in got)


def test_mix_of_odd_rows(spark):
    rows = [(d, t[:300] if t else t, s) for (d, t), s in zip(ODD, ["a", None, "a", "b", "b", None, None, "c"], strict=True)]
    docs = documents(spark, rows)
    plan = mixing.mix_plan(spark, docs).where("size > 0")
    assert mixing.mix(spark, docs).where("trim(text) <> ''").where("text rlike '[^ \\t\\n]'").count() == plan.selectExpr("sum(taken div size)").first()[0]
    assert mixing.mix(spark, docs.limit(0)).columns == docs.columns and mixing.mix(spark, docs.limit(0)).isEmpty()


def test_one_source_ties_and_empty(spark):
    rows = [(7, "a b c", "s")] * 5 + [(8, "d e", "s")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None, None), (2, "", None)]) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mix_rows_are_the_plan(spark):
    rows = [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(60)]
    docs = documents(spark, rows)
    out = mixing.mix(spark, docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    plan = {r.doc_id: r.taken // r.size for r in mixing.mix_plan(spark, docs).collect()}
    assert {d: n for d, n in plan.items() if n} == copies
