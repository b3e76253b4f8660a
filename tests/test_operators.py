import pytest
from pyspark.sql import functions as F

from kgweave.operators import episodes, graph, ranking


def test_ties(spark):
    x = spark.createDataFrame([("q", 1.0, True, 5), ("q", 1.0, False, 9), ("q", 1.0, False, 1), ("q", 0.5, False, 9)], "qid string, score double, truth boolean, tie long")
    assert tuple(ranking.ranks(x, ["qid"]).first())[1:] == (1, 2.0, 3)
    assert ranking.tie_ranks(x, ["qid"]).first()["rank"] == 2


def test_rank_bounds_and_empty_metrics(spark):
    x = spark.range(200).select((F.col("id") % 10).alias("qid"), (F.col("id") * 7919 % 5).alias("score"), (F.col("id") < 10).alias("truth"))
    for r in ranking.ranks(x, ["qid"]).collect():
        assert 1 <= r.optimistic <= r.realistic <= r.pessimistic <= 20
    empty = spark.createDataFrame([], "rank long")
    assert tuple(ranking.metrics(empty).first())[:4] == (0.0, 0.0, 0.0, 0.0)


def test_negatives_never_known_and_singleton_pool(spark):
    known = spark.createDataFrame([("p", "a", "b"), ("p", "a", "c")], "pred string, h string, t string")
    pool = spark.createDataFrame([("p", x) for x in "abcd"], "pred string, entity string")
    got = {(r.h, r.t) for r in graph.corrupt_all(known.withColumn("qid", F.lit(1)), pool, "t", known).collect()}
    assert got == {("a", "a"), ("a", "d")}
    one = spark.createDataFrame([("p", "b")], "pred string, entity string")
    assert graph.corrupt_all(known.where("t = 'b'").withColumn("qid", F.lit(1)), one, "t").count() == 0
    ids = spark.createDataFrame([("a", 1), ("b", 2)], "name string, id int")
    with pytest.raises(ValueError, match="'c'|c"):
        graph.encode(known, ids)


def test_n_step_worked_example(spark):
    x = spark.createDataFrame([("e", t, 1.0, 0.0, t == 5) for t in range(1, 6)], "env string, t long, reward double, value double, done boolean")
    assert episodes.n_step(x, 3).where("t = 1").first().target == pytest.approx(2.9701)


def test_gae_against_loop(spark):
    rows = [("e", t, float(t % 3), float(t % 4), t == 9) for t in range(10)]
    got = {r.t: r.advantage for r in episodes.gae(spark.createDataFrame(rows, "env string, t long, reward double, value double, done boolean")).collect()}
    acc = 0.0
    for i in reversed(range(10)):
        _, t, r, v, done = rows[i]
        nxt = 0.0 if done else rows[i + 1][3]
        acc = r + 0.99 * nxt - v + 0.99 * 0.95 * (0.0 if done else 1.0) * acc
        assert got[t] == pytest.approx(acc)


def test_seed_average_needs_every_seed(spark):
    x = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (1, "b", 1.0)], "seed int, metric string, value double")
    assert [tuple(r) for r in episodes.seed_average(x, 2).collect()] == [("a", 2.0, 1.0)]


def test_branching_buckets(spark):
    x = spark.createDataFrame([(3,), (9,), (10,), (14,), (17,)], "bf long")
    assert {tuple(r) for r in episodes.branching_histogram(x).collect()} == {(3, 1), (9, 1), (10, 2), (15, 1)}


def test_neural_scorers_against_loops(spark):
    import numpy as np

    from kgweave.operators import neural

    rng = np.random.default_rng(0)
    rows = [(i, *(rng.normal(size=8).tolist() for _ in range(3))) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, hv array<double>, r array<double>, tv array<double>")
    core = rng.normal(size=(8, 8, 8))
    got = {r.id: r.score for r in neural.tucker(df, core, ["id"]).collect()}
    for i, h, r, t in rows:
        assert got[i] == pytest.approx(sum(core[a, b, c] * h[a] * r[b] * t[c] for a in range(8) for b in range(8) for c in range(8)))
    filters, project = rng.normal(size=(2, 2, 2)), rng.normal(size=(2 * 3 * 3, 8))
    got = {r.id: r.score for r in neural.conv_e(df, filters, project, 4, ["id"]).collect()}
    for i, h, r, t in rows:
        image = np.array([h[:4], h[4:], r[:4], r[4:]])
        maps = [max(0, sum(f[a, b] * image[y + a, x + b] for a in range(2) for b in range(2))) for f in filters for y in range(3) for x in range(3)]
        assert got[i] == pytest.approx(float(np.maximum(np.array(maps) @ project, 0) @ np.array(t)))
    two = spark.createDataFrame([(1, 0.5, 2.0), (2, -1.0, 0.0)], "id int, proof double, kge double")
    got = {r.id: r.score for r in neural.mlp_bridge(two, np.eye(2), np.array([0.0, 1.0]), np.array([2.0, 3.0]), ["id"]).collect()}
    assert got == {1: 10.0, 2: 3.0}


def test_rounding_of_halves_is_that_of_sql(spark):
    """Sums of gae_returns that fall on a half, as two orders of summation give them; and odd values."""
    import math

    from kgweave.functions import scores

    duckdb = pytest.importorskip("duckdb")
    values = [94.95515, 94.95514999999999, 62.908449999999995, 192.37845, 55.6948 - 5e-5, -4.00165, -4.001650000000001, 2.9983499999999994, 0.0, -0.00001, 1e300, -1e17, 0.49999999999999994e-4]
    df = spark.createDataFrame([*((i, v) for i, v in enumerate(values)), (97, None), (98, math.nan), (99, -math.inf)], "i int, x double")
    got = {r.i: r.x for r in df.select("i", scores.rounded(df.x, 4).alias("x")).collect()}
    for i, v in enumerate(values):
        assert got[i] == duckdb.execute("select round(cast(? as double), 4)", [v]).fetchone()[0], v
    assert got[97] is None and math.isnan(got[98]) and got[99] == -math.inf


@pytest.mark.parametrize("few", [True, False])
def test_a_frequent_value_is_met_in_many_tasks(spark, monkeypatch, few):
    """Free-bound goals of one value: all pairs, a fair share of them in each of many tasks."""
    from kgweave.plans import scratch

    if not few:
        monkeypatch.setattr(scratch, "BROADCAST_ROWS", 10)
    goals = spark.createDataFrame([(f"s:{i}", "custIn", "?", "n:0") for i in range(40)] + [("x", "custIn", "?", "n:9")], "qid string, pred string, h string, t string")
    facts = spark.range(500).selectExpr("'custIn' AS pred", "concat('c:', id) AS h", "'n:0' AS t")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it makes one task of tables as small as these
    try:
        got = graph.bindings(goals, facts, "fb")
        rows = got.select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {(r.qid, r.h, r.t) for r in rows} == {(f"s:{i}", f"c:{k}", "n:0") for i in range(40) for k in range(500)} and len(rows) == 20000
    assert len({r.task for r in rows}) > 1 and max(sum(r.task == k for r in rows) for k in {r.task for r in rows}) < 12000
