import numpy as np
import pytest

from kgweave.llm import nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int, node long, s double"


def brute(ids, vectors):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for v, k in zip(vectors, ok)]
    n = len(ids)
    near = [[i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95 for j in range(n)] for i in range(n)]
    comp = list(range(n))
    while True:
        new = [min([comp[i]] + [comp[j] for j in range(n) if near[i][j]]) for i in range(n)]
        if new == comp:
            break
        comp = new
    least = {c: min(i for i, k in zip(ids, comp) if k == c) for c in set(comp)}
    return {i: (sum(row), least[c], least[c] == i) for i, row, c in zip(ids, near, comp)}


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    vectors = []
    for g in range(25):
        base = rng.normal(size=16)
        size = 40 if g == 0 else rng.integers(1, 6)
        vectors += [(base + rng.normal(size=16) * 0.04).astype(np.float32).tolist() for _ in range(size)]
    vectors += [vectors[0]] * 30
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, vectors[0][:8], (np.array(vectors[1]) * 2).tolist()]
    return list(range(100, 100 + len(vectors))), vectors


def test_against_brute_force(spark, table):
    ids, vectors = table
    df = spark.createDataFrame([(i, v, 0, 1, 0.5) for i, v in zip(ids, vectors)], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(spark, df, k=6).collect()}
    want = brute(ids, vectors)
    assert got.keys() == want.keys()
    links = sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(g[0] for g in got.values()) >= 0.98 * links
    assert np.mean([got[i] == want[i] for i in ids]) >= 0.98


def test_empty_and_lonely(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nn_descent.near_duplicates(spark, none).count() == 0
    one = spark.createDataFrame([(5, [1.0, 0.0], 0, 1, 0.5), (6, None, 0, 1, 0.5)], SCHEMA)
    assert {tuple(r) for r in nn_descent.near_duplicates(spark, one).collect()} == {(5, 0, 5, True), (6, 0, 6, True)}


def groups(seed, spreads):
    """Groups of some sizes and spreads, three small ones that touch at their rims, and lone vectors."""
    rng = np.random.default_rng(seed)
    vectors = []
    for size, spread in spreads:
        base = rng.normal(size=24)
        vectors.append(base + rng.normal(size=(size, 24)) * spread * np.linalg.norm(base))
    base, step = rng.normal(size=24), rng.normal(size=24)
    for far in (0.0, 0.1, 0.2):
        vectors.append(base + far * step + rng.normal(size=(60, 24)) * 0.02 * np.linalg.norm(base))
    vectors.append(rng.normal(size=(300, 24)))
    x = np.concatenate(vectors).astype(np.float32)
    x = x[rng.permutation(len(x))]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], len(x)).min(1))
        if (new == comp).all():
            return x, near.sum(1), comp
        comp = new


def linked(spark, x):
    df = spark.createDataFrame([(i, v.tolist(), 0, 1, 0.5) for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: r for r in nn_descent.near_duplicates(spark, df).collect()}
    return [got[i] for i in range(len(x))]


def test_dense_groups_equal_brute_force(spark):
    x, n, comp = groups(8, ((71, 0.02), (500, 0.03), (3000, 0.03)))
    got = linked(spark, x)
    assert [(r.n_links, r.component_id, r.kept) for r in got] == [(int(k), int(c), bool(c == i)) for i, (k, c) in enumerate(zip(n, comp, strict=True))]


def test_wide_groups_lose_hardly_a_link(spark):
    x, n, comp = groups(9, ((71, 0.05), (500, 0.07), (1500, 0.062)))
    got = linked(spark, x)
    assert all(r.n_links <= k for r, k in zip(got, n, strict=True))
    assert sum(r.n_links for r in got) >= 0.999 * n.sum()
    assert np.mean([r.component_id == c for r, c in zip(got, comp, strict=True)]) >= 0.98


def test_all_are_compared_when_recall_stays_low(spark, table, monkeypatch):
    monkeypatch.setattr(nn_descent, "STARTS", 1)
    monkeypatch.setattr(nn_descent, "audit", lambda *a: 0.0)
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    ids, vectors = table
    df = spark.createDataFrame([(i, v, 0, 1, 0.5) for i, v in zip(ids, vectors)], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(spark, df).collect()}
    assert got == brute(ids, vectors)


def test_repeated_and_null_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.01, 0.0]
    rows = [(3, a), (3, a), (3, [0.0, 1.0, 0.0]), (None, b), (None, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, 1, 0.5) for i, v in rows], SCHEMA)
    got = sorted((tuple(r) for r in nn_descent.near_duplicates(spark, df).collect()), key=str)
    want = [(3, 2, 3, True), (3, 2, 3, True), (3, 0, 3, True), (None, 2, 3, None), (None, 0, None, None)]
    assert got == sorted(want, key=str)
