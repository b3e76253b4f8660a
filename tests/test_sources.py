from pyspark.sql import functions as F

from kgweave.sources import sinks, text


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "line int, value string")


def test_atoms_and_facts(spark):
    x = lines(spark, ' p( "a", b ). ', "flag", "bad(a", "(a,b)", "q(a,b,c).", "% p(a,b).", ":- dynamic p/2.", "p(X,Y) :- q(X,Y).", "one_step_list(a,b).", "", "--")
    got = x.select(text.parse_atom(F.col("value")).alias("a")).collect()
    assert (got[0].a.pred, list(got[0].a.args)) == ("p", ["a", "b"])
    assert (got[1].a.pred, list(got[1].a.args)) == ("flag", [])
    assert got[2].a is None and got[3].a is None
    assert [tuple(r) for r in text.facts(x).collect()] == [("p", "a", "b")]


def test_rules(spark):
    x = lines(spark, "r0:0.7475:n(x,y), l(y,z) -> l(x,z)", "r1:3:a(x,y) -> b(y,x)", "l(x,z) :- n(x,y), l(y,z).", "p(a,b).", "junk")
    got = text.rules(x).orderBy("line").collect()
    show = [(tuple(r.head), [tuple(b) for b in r.body]) for r in got]
    chain = (("l", "X", "Z"), [("n", "X", "Y"), ("l", "Y", "Z")])
    assert show == [chain, (("b", "Y", "X"), [("a", "X", "Y")]), chain, (("p", "A", "B"), [])]


def test_queries_depths_and_limits(spark):
    x = lines(spark, "p(a,b) 3", "p(a,c)", "p(a,d) x", "p(a,e) -1", "p(a,b) 5")
    assert [(r.t, r.depth) for r in text.queries(x).orderBy("line").collect()] == [("b", 3), ("c", -1), ("e", -1), ("b", 5)]
    assert [(r.t, r.depth) for r in text.queries(x, {-1}, 1).collect()] == [("c", -1)]
    assert {(r.t, r.depth) for r in text.depth_map(x).collect()} == {("b", 5), ("c", -1), ("e", -1)}


def test_soft_facts_domains_and_logs(spark):
    soft = lines(spark, "# c", "p(a,b) 0.9 1", "p(a,b) 0.1 2", "p(a,c) 0.2", "p(a,d) 0.8 9", "p(a,e) x")
    assert {(r.t, r.score, r["rank"]) for r in text.soft_facts(soft, 5, 0.15).collect()} == {("b", 0.9, 1), ("c", 0.2, None)}
    d, p = text.domains(lines(spark, "likes:man:food", "man bob al", "food pie", "men al"))
    assert {tuple(r) for r in d.collect()} == {("man", "bob"), ("men", "al"), ("food", "pie")}
    assert [tuple(r) for r in p.collect()] == [("likes", "man", "food")]
    log = text.run_log(lines(spark, "test;mrr:0.5 +/- 0.1 (3);name:x;h:2"))
    assert {(r.key, r.value) for r in log.collect()} == {("mrr_mean", 0.5), ("mrr_std", 0.1), ("mrr_count", 3.0), ("name", None), ("h", 2.0)}


def test_triple_formats_and_ids(spark, tmp_path):
    for name, body in (("a.tsv", "h\tr\tt\n"), ("a.csv", "h,r,t\n"), ("a.pl", "r(h,t).\n")):
        (tmp_path / name).write_text(body)
        assert [tuple(r) for r in text.triples(spark, f"file://{tmp_path / name}").collect()] == [("r", "h", "t")]
    (tmp_path / "q.txt").write_text("x\ny\r\nz")
    assert [tuple(r) for r in text.read_numbered(spark, f"file://{tmp_path / 'q.txt'}").collect()] == [(0, "x"), (1, "y"), (2, "z")]
    names = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "line int, name string")
    assert {tuple(r) for r in text.sorted_ids(names.select("name")).collect()} == {("a", 1), ("b", 2)}
    assert {tuple(r) for r in text.appearance_ids(names).collect()} == {("b", 0), ("a", 1)}


def test_sinks(spark, tmp_path):
    soft = spark.createDataFrame([("p", "a", "b", 0.5, 1)], "pred string, h string, t string, score double, rank int")
    assert sinks.soft_fact_lines(soft).first().value == "p(a,b) 0.500000 1"
    sinks.write_soft_facts(soft, f"file://{tmp_path}/soft")
    assert tuple(spark.read.parquet(f"file://{tmp_path}/soft").select("predicate", "head", "tail", "score", "rank").first()) == ("p", "a", "b", 0.5, 1)
    assert sinks.depth_lines(soft.withColumn("depth", F.lit(-1))).first().value == "p(a,b) -1"
    assert sinks.metric_table(soft.select("pred", "score")) == "| pred | score |\n| --- | --- |\n| p | 0.5000 |"
    sinks.write_runs(soft.select("pred", "score"), f"file://{tmp_path}/runs")
    assert spark.read.option("header", True).option("sep", ";").csv(f"file://{tmp_path}/runs").first().score == "0.5"
