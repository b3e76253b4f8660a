"""Writers of depth, soft-fact, program and metric text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Clauses by which a Prolog system resolves one goal of a list in all ways.
ONE_STEP = (
    "one_step_list([G|Gs], Next) :- findall(N, (clause(G, B), one_step_body(B, As), append(As, Gs, N)), Next).",
    "one_step_body((A, B), [A|As]) :- !, one_step_body(B, As).",
    "one_step_body(true, []) :- !.",
    "one_step_body(A, [A]).",
)


def atom_text(pred: str = "pred", h: str = "h", t: str = "t"):
    return F.format_string("%s(%s,%s)", F.col(pred), F.col(h), F.col(t))


def depth_lines(depths: DataFrame) -> DataFrame:
    """``value``: ``pred(a,b) depth`` without other blanks; depths: (pred, h, t, depth)."""
    return depths.select(F.concat_ws(" ", F.regexp_replace(atom_text(), " ", ""), F.col("depth").cast("string")).alias("value"))


def soft_fact_lines(soft: DataFrame) -> DataFrame:
    """``value``: ``pred(h,t) score rank``, score to six places."""
    return soft.select(F.concat_ws(" ", atom_text(), F.format_string("%.6f", F.col("score")), F.col("rank").cast("string")).alias("value"))


def write_soft_facts(soft: DataFrame, path: str) -> None:
    """Soft facts as Parquet, a folder a predicate, so a reader of one predicate skips the others."""
    soft.select(F.col("pred").alias("predicate"), F.col("h").alias("head"), F.col("t").alias("tail"), "score", "rank").write.mode("overwrite").partitionBy("predicate").parquet(path)


def program_lines(facts: DataFrame, rules: DataFrame, table: bool = False, helper: bool = False) -> DataFrame:
    """``part, value`` of a Prolog program: directives, quoted facts, rules, and with ``helper`` the
    clauses ``one_step_list``, which resolve the first of a list of goals by every fact and rule;
    order by part, value.

    rules: (head, body) of upper-cased atoms. Leading underscores of predicates go.
    """
    name = lambda c: F.regexp_replace(c, "^_+", "")
    preds = facts.select(name(F.col("pred")).alias("p")).union(rules.select(name(F.col("head.p")))).distinct()
    kinds = ["dynamic", "discontiguous", *(["table"] if table else [])]
    heads = preds.select(F.lit(0).alias("part"), F.explode(F.array(*[F.format_string(f":- {k} %s/2.", F.col("p")) for k in kinds])).alias("value"))
    body = facts.select(F.lit(1).alias("part"), F.format_string('%s("%s","%s").', name(F.col("pred")), F.col("h"), F.col("t")).alias("value"))
    atom = lambda x: F.format_string("%s(%s,%s)", name(x["p"]), x["a"], x["b"])
    clauses = rules.select(F.lit(2).alias("part"), F.concat(atom(F.col("head")), F.lit(" :- "), F.array_join(F.transform("body", atom), ", "), F.lit(".")).alias("value"))
    out = heads.union(body).union(clauses)
    if helper:
        out = out.union(facts.sparkSession.range(1).select(F.lit(3), F.explode(F.array(*map(F.lit, ONE_STEP)))))
    return out


def metric_table(metrics: DataFrame) -> str:
    """A markdown table of a small frame of metrics, in its order."""
    rows = [metrics.columns, ["---"] * len(metrics.columns), *([f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in metrics.collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def metric_report(metrics: DataFrame, by: tuple[str, ...] = ("dataset", "split"), order: str = "depth") -> str:
    """Markdown with a section and a table for each value of ``by``, rows in order of ``order``.

    metrics: a small frame, a row for each dataset, split and depth.
    """
    rest = [c for c in metrics.columns if c not in by]
    parts = []
    for keys in sorted(metrics.select(*by).distinct().collect()):
        some = metrics
        for c, v in zip(by, keys, strict=True):
            some = some.where(F.col(c) == v)
        parts.append("## " + ", ".join(f"{c} {v}" for c, v in zip(by, keys, strict=True)) + "\n\n" + metric_table(some.orderBy(order).select(*rest)))
    return "\n\n".join(parts) + "\n"


def run_rows(runs: DataFrame, keys: list[str]) -> DataFrame:
    """A row of each experiment with ``[mean, std]`` of its metrics, rounded to three places.

    runs: (keys, metric, value), a value of each seed; deviations are of the population.
    """
    text = F.format_string("[%s, %s]", F.round(F.avg("value"), 3).cast("string"), F.round(F.stddev_pop("value"), 3).cast("string"))
    names = [r.metric for r in runs.select("metric").distinct().orderBy("metric").collect()]
    return runs.groupBy(*keys).pivot("metric", names).agg(text)


def write_runs(runs: DataFrame, path: str) -> None:
    """Append run metrics as ``;``-separated text with a header."""
    runs.write.mode("append").option("sep", ";").option("header", True).csv(path)


class Checkpoints:
    """Parameters under a folder, by step, with the metrics they reached; the best can be restored."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, step: int, params: DataFrame, metrics: dict[str, float]) -> None:
        """params: (name, values). Metrics go last, so a step without them was not saved whole."""
        params.write.mode("overwrite").parquet(f"{self.path}/params/step={step}")
        rows = [(step, k, float(v)) for k, v in sorted(metrics.items())]
        self.spark.createDataFrame(rows, "step long, metric string, value double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/metrics/saved={step}")

    def metrics(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/metrics").select("step", "metric", "value")

    def best(self, metric: str) -> int:
        """The first step of those with the greatest value."""
        return self.metrics().where(F.col("metric") == metric).orderBy(F.col("value").desc(), "step").first().step

    def restore(self, metric: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/params/step={self.best(metric)}")
