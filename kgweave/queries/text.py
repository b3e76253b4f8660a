"""Queries of the text readers and writers, over lines that are made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..plans.rules import Atom, Rule, symmetric_predicates
from ..plans.scratch import Scratch
from ..sources import sinks, text
from . import register
from .graph import CUST, REGION


def _s(name: str):
    return F.col(name).cast("string")


@register(f"SELECT pred, h, t FROM ({CUST})")
def fact_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts among comments, directives, rules and unary atoms."""
    c = G.relation(spark, sf_dir, "custIn")
    forms = F.array(F.format_string(' %s( "%s", %s ). ', "pred", "h", "t"), F.concat(F.lit("% "), F.col("h")), F.concat(F.lit("one_step_"), F.col("h")), F.lit(":- dynamic custIn/2."), F.format_string("custIn(%s,X) :- big(X).", F.col("h")), F.format_string("big(%s).", F.col("h")), F.lit("  "))
    return text.facts(c.select(F.explode(forms).alias("value")))


@register("SELECT 'r' || n_nationkey AS id, 'HEADX' AS a, 'Z' AS b, 2 AS atoms, 'p' || n_regionkey AS first FROM nation")
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule lines with an id and a confidence that counts for nothing."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    v = F.format_string("r%s:0.75:p%s(headx,y), q(y,z) -> h%s(headx,z)", _s("n_nationkey"), _s("n_regionkey"), _s("n_nationkey"))
    r = text.rules(n.select(F.concat(F.lit("r"), _s("n_nationkey")).alias("id"), v.alias("value")))
    return r.select("id", F.col("head.a").alias("a"), F.col("head.b").alias("b"), F.size("body").alias("atoms"), F.col("body")[0]["p"].alias("first"))


@register("SELECT CAST(o_orderkey AS BIGINT) AS line, 'q' AS pred, 'o:' || o_orderkey AS h, 'c:' || o_custkey AS t, CAST(o_custkey % 6 - 1 AS INTEGER) AS depth FROM orders WHERE o_custkey % 6 - 1 IN (2, 3)")
def query_scan_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    v = F.format_string("q(o:%s,c:%s) %s", _s("o_orderkey"), _s("o_custkey"), (F.col("o_custkey") % 6 - 1).cast("string"))
    return text.queries(o.select(F.col("o_orderkey").alias("line"), v.alias("value")), {2, 3})


@register("WITH l AS (SELECT event_id AS line, 'u:' || user_id AS h, 'e:' || event_type AS t, event_id % 100 / 100.0 AS score, CAST(event_id % 7 AS INTEGER) AS rank FROM events), k AS (SELECT * FROM l WHERE rank <= 4 AND score >= 0.25) SELECT 'did' AS pred, h, t, CAST(arg_min(score, line) AS DOUBLE) AS score, arg_min(rank, line) AS rank FROM k GROUP BY h, t")
def soft_fact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.concat_ws(" ", F.format_string("did(u:%s,e:%s)", _s("user_id"), F.col("event_type")), (F.col("event_id") % 100 / 100.0).cast("string"), (F.col("event_id") % 7).cast("string"))
    return text.soft_facts(e.select(F.col("event_id").alias("line"), v.alias("value")), 4, 0.25)


@register("SELECT 'region' || n_regionkey AS domain, 'n:' || n_nationkey AS entity FROM nation")
def domain_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lines = n.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("n:"), _s("n_nationkey")))), " ").alias("m"))
    # Names hold a colon here, so they are written with another sign and put back.
    v = F.concat(F.lit("region"), _s("n_regionkey"), F.lit(" "), F.replace("m", F.lit(":"), F.lit("_")))
    found, _ = text.domains(lines.select(F.col("n_regionkey").alias("line"), v.alias("value")))
    return found.select("domain", F.replace("entity", F.lit("_"), F.lit(":")).alias("entity"))


@register("WITH r AS (SELECT c_custkey AS line, CASE WHEN c_custkey % 2 = 0 THEN 'train' ELSE 'test' END AS label, c_nationkey FROM customer) SELECT line, label, 'mrr_mean' AS key, CAST(c_nationkey AS DOUBLE) / 4 AS value FROM r UNION ALL SELECT line, label, 'mrr_std', 0.5 FROM r UNION ALL SELECT line, label, 'mrr_count', 10 FROM r UNION ALL SELECT line, label, 'hits', CAST(line AS DOUBLE) FROM r UNION ALL SELECT line, label, 'name', NULL FROM r")
def run_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    v = F.concat_ws(";", F.when(F.col("c_custkey") % 2 == 0, "train").otherwise("test"), F.concat(F.lit("mrr:"), (F.col("c_nationkey") / 4).cast("string"), F.lit(" +/- 0.5 (10)")), F.concat(F.lit("hits:"), _s("c_custkey")), F.lit("name:run"))
    return text.run_log(c.select(F.col("c_custkey").alias("line"), v.alias("value"))).select("line", "label", "key", "value")


@register("SELECT 'pred(c:' || c_custkey || ',n:' || c_nationkey || ') ' || (c_custkey % 5 - 1) AS value FROM customer UNION ALL SELECT 'custIn(c:' || c_custkey || ',n:' || c_nationkey || ') 0.250000 ' || (c_custkey % 5 - 1) FROM customer".replace("'pred(", "'custIn("))
def depth_and_soft_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.relation(spark, sf_dir, "custIn").withColumn("depth", (F.substring("h", 3, 20).cast("long") % 5 - 1).cast("int"))
    return sinks.depth_lines(c).union(sinks.soft_fact_lines(c.select("pred", "h", "t", F.lit(0.25).alias("score"), F.col("depth").alias("rank"))))


@register(f"SELECT 0 AS part, ':- dynamic inRegion/2.' AS value UNION ALL SELECT 0, ':- discontiguous inRegion/2.' UNION ALL SELECT 0, ':- dynamic near/2.' UNION ALL SELECT 0, ':- discontiguous near/2.' UNION ALL SELECT 1, 'inRegion(\"' || h || '\",\"' || t || '\").' FROM ({REGION}) UNION ALL SELECT 2, 'near(X,Y) :- inRegion(X,Z), inRegion(Y,Z).'")
def prolog_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = text.rules(spark.createDataFrame([("_near(x,y) :- inRegion(x,z), inRegion(y,z)",)], "value string"))
    return sinks.program_lines(G.relation(spark, sf_dir, "inRegion"), rules)


@register("SELECT name, CAST(row_number() OVER (ORDER BY line, name) - 1 AS INTEGER) AS id FROM (SELECT 'c:' || o_custkey AS name, min(o_orderkey) AS line FROM orders GROUP BY 1)")
def first_appearance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("c:"), _s("o_custkey")).alias("name"), F.col("o_orderkey").alias("line"))
    return text.appearance_ids(o)


def _written(spark: SparkSession, lines: DataFrame, name: str, order: str | None = None) -> str:
    """A folder with the lines as one text file; ``name`` ends the path."""
    path = Scratch(spark, "files").path("text") + "/" + name
    lines = lines.orderBy(order).select("value") if order else lines
    lines.select("value").coalesce(1).write.text(path)
    return path


@register("SELECT CAST(n_nationkey AS BIGINT) AS line, 'q' AS pred, 'n:' || n_nationkey AS h, 'r:' || n_regionkey AS t, CAST(n_regionkey AS INTEGER) AS depth FROM nation WHERE n_regionkey > 1 ORDER BY 1 LIMIT 8")
def query_scan_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of depths beside a file of queries stands in for it; the limit counts kept lines."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey")
    path = _written(spark, n.select("n_nationkey", F.lit("q(only,here) 3").alias("value")), "test.txt")
    v = F.format_string("q(n:%s,r:%s) %s", _s("n_nationkey"), _s("n_regionkey"), _s("n_regionkey"))
    n.select(v.alias("value")).coalesce(1).write.text(path.removesuffix(".txt") + "_depths.txt")
    return text.query_file(spark, path, {2, 3, 4}, 8)


@register(f"SELECT 'tab' AS form, 'rel' AS pred, h, t FROM ({CUST}) UNION ALL SELECT 'comma', 'rel', h, t FROM ({CUST}) UNION ALL SELECT 'facts', 'custIn', h, t FROM ({CUST})")
def triple_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table as tab-separated, as comma-separated and as facts; the format is told from the first line."""
    c = G.relation(spark, sf_dir, "custIn")
    forms = {"tab": F.concat_ws("\t", "h", F.lit("rel"), "t"), "comma": F.concat_ws(",", "h", F.lit("rel"), "t"), "facts": F.concat(sinks.atom_text(), F.lit("."))}
    out = None
    for name, value in forms.items():
        x = text.triples(spark, _written(spark, c.select(value.alias("value")), name)).select(F.lit(name).alias("form"), "pred", "h", "t")
        out = x if out is None else out.unionAll(x)
    return out


@register("SELECT 'q' AS pred, 'c:' || o_custkey AS h, 's' AS t, CAST(arg_max(o_orderkey % 5, o_orderkey) AS INTEGER) AS depth FROM orders GROUP BY o_custkey")
def depth_map_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of lines that repeat an atom the last one counts."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.format_string("q(c:%s,s) %s", _s("o_custkey"), (F.col("o_orderkey") % 5).cast("string")).alias("value"))
    return text.depth_map(text.read_numbered(spark, _written(spark, o, "depths.txt", "o_orderkey")))


@register(f"SELECT pred, h, t, CAST(CAST(substr(h, 3) AS BIGINT) % 100 / 100.0 AS DOUBLE) AS score FROM ({CUST})")
def score_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms and scores between tabs, a first line without a number, and earlier scores that later lines replace."""
    c = G.relation(spark, sf_dir, "custIn").withColumn("k", F.substring("h", 3, 20).cast("long"))
    good = c.select(F.concat(F.lit("2"), F.lpad(F.col("k").cast("string"), 12, "0")).alias("o"), F.concat_ws("\t", sinks.atom_text(), (F.col("k") % 100 / 100.0).cast("string")).alias("value"))
    old = c.select(F.concat(F.lit("1"), "h").alias("o"), F.concat_ws("\t", sinks.atom_text(), F.lit("7.5")).alias("value"))
    head = spark.range(1).select(F.lit("0").alias("o"), F.lit("atom\tscore").alias("value"))
    return text.score_table(spark, _written(spark, head.unionAll(old).unionAll(good), "scores.tsv", "o"))


@register(f"SELECT 'fact' AS kind, count(*) AS n FROM ({REGION}) UNION ALL SELECT 'rule', count(*) FROM nation")
def program_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and rules of one file, as it was exported with directives, tables and helper clauses."""
    rules = text.rules(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.format_string("near%s(x,y) :- inRegion(x,z), inRegion(y,z)", _s("n_nationkey")).alias("value")))
    path = _written(spark, sinks.program_lines(G.relation(spark, sf_dir, "inRegion"), rules, table=True, helper=True), "program.pl")
    facts, found = text.program(text.read_lines(spark, path))
    kind = lambda df, name: df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return kind(facts, "fact").unionAll(kind(found, "rule"))


@register("SELECT 'id' AS kind, n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT * FROM (VALUES ('config', 'model.dim', '64'), ('config', 'model.name', 'rotate'), ('config', 'seed', '3'))")
def model_files_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids and the nested configuration that a model is saved with."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    ids = n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("long"))))).alias("value"))
    conf = spark.range(1).select(F.lit('{"model": {"name": "rotate", "dim": 64}, "seed": 3}').alias("value"))
    a = text.id_map(spark, _written(spark, ids, "entity2id.json")).select(F.lit("id").alias("kind"), F.col("name").alias("key"), F.col("id").cast("string").alias("value"))
    return a.unionAll(text.config(spark, _written(spark, conf, "config.json")).select(F.lit("config").alias("kind"), "key", "value"))


@register(f"SELECT pred AS predicate, h AS head, t AS tail, 0.5 AS score, 1 AS rank FROM ({CUST}) UNION ALL SELECT pred, h, t, 0.5, 1 FROM ({REGION})".replace("0.5", "CAST(0.5 AS DOUBLE)"))
def soft_fact_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft facts written by predicate and read back."""
    path = Scratch(spark, "soft").path("facts")
    sinks.write_soft_facts(G.graph(spark, sf_dir, "custIn", "inRegion").select("*", F.lit(0.5).alias("score"), F.lit(1).alias("rank")), path)
    return spark.read.parquet(path).select(F.col("predicate").cast("string").alias("predicate"), "head", "tail", "score", "rank")


@register("WITH m AS (SELECT 'd' || n_regionkey % 2 AS d, n_regionkey AS depth, count(*) AS n FROM nation GROUP BY 1, 2) SELECT 1 AS ok, string_agg('## dataset ' || d || ', split test' || chr(10) || chr(10) || '| depth | n |' || chr(10) || '| --- | --- |' || chr(10) || rows, chr(10) || chr(10) ORDER BY d) || chr(10) AS report FROM (SELECT d, string_agg('| ' || depth || ' | ' || n || ' |', chr(10) ORDER BY depth) AS rows FROM m GROUP BY d)")
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown with a table for each dataset and split, a row a depth."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    m = n.groupBy(F.concat(F.lit("d"), (F.col("n_regionkey") % 2).cast("string")).alias("dataset"), F.lit("test").alias("split"), F.col("n_regionkey").alias("depth")).agg(F.count("*").alias("n"))
    return spark.range(1).select(F.lit(1).alias("ok"), F.lit(sinks.metric_report(m)).alias("report"))


@register("SELECT 'r' || user_id % 3 AS run, '[' || CAST(round(avg(v), 3) AS VARCHAR) || ', ' || CAST(round(stddev_pop(v), 3) AS VARCHAR) || ']' AS level FROM (SELECT user_id, event_id % 11 AS v FROM events) GROUP BY 1")
def run_rows_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations of runs, appended twice to a file with a separator and read back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("run"), F.lit("level").alias("metric"), (F.col("event_id") % 11).cast("double").alias("value"))
    rows, path = sinks.run_rows(e, ["run"]), Scratch(spark, "runs").path("csv")
    sinks.write_runs(rows, path)
    sinks.write_runs(rows, path)
    return spark.read.option("sep", ";").option("header", True).csv(path).distinct()


@register("WITH m AS (SELECT user_id % 4 AS step, avg(value) AS v FROM events GROUP BY 1), b AS (SELECT step FROM m ORDER BY round(v, 6) DESC, step LIMIT 1) SELECT CAST(step AS BIGINT) AS step, 'p' || n_nationkey AS name, CAST(n_nationkey * 10 + step AS DOUBLE) AS value FROM b, nation")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four steps saved with a metric; the parameters of the best are restored."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy((F.col("user_id") % 4).alias("step")).agg(F.round(F.avg("value"), 6).alias("v"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    kept = sinks.Checkpoints(spark, Scratch(spark, "checkpoints").path("steps"))
    for r in e.orderBy("step").collect():
        kept.save(r.step, n.select(F.concat(F.lit("p"), _s("n_nationkey")).alias("name"), (F.col("n_nationkey") * 10 + r.step).cast("double").alias("value")), {"mrr": r.v})
    return kept.restore("mrr").select(F.lit(kept.best("mrr")).cast("long").alias("step"), "name", "value")


@register("SELECT 'p' || n_nationkey AS pred FROM nation WHERE n_nationkey % 2 = 0")
def symmetric_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates with a rule p(X, Y) :- p(Y, X), among as many chains."""
    keys = [r.n_nationkey for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect()]
    body = lambda k: (Atom(f"p{k}", "Y", "X"),) if k % 2 == 0 else (Atom(f"p{k}", "X", "Y"),)
    found = symmetric_predicates([Rule(Atom(f"p{k}", "X", "Y"), body(k)) for k in keys])
    return spark.createDataFrame([(p,) for p in found], "pred string")
