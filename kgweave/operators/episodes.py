"""Returns, shaping and statistics of episodes: rows (env, t, reward, value, done)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Steps of an episode whose discounts are relative to one another.
BLOCK = 512


def gae(steps: DataFrame, gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """(env, t, advantage, ret): generalised advantages of each env's steps in order of t.

    The value after an env's last step is 0, and a done step cuts what comes after it. Between such
    cuts, advantages are discounted sums of what follows, null deltas left out: each step's delta and
    the discounted sum after it, from the last step of a block back, plus what the blocks after
    carry, one row a block. Nothing is scaled up again, so sums keep the last digits of a loop's.
    """
    env = Window.partitionBy("env").orderBy("t")
    nxt, g = F.lead("value", 1, 0.0).over(env), gamma * lam
    on = F.when(F.col("done"), 0.0).otherwise(1.0)
    x = steps.select("env", "t", "value", F.col("done").cast("int").alias("done"), (F.col("reward") + gamma * nxt * on - F.col("value")).alias("delta"))
    x = x.withColumn("run", F.sum("done").over(env) - F.col("done"))
    x = x.withColumn("at", F.row_number().over(Window.partitionBy("env", "run").orderBy("t")) - 1)
    x = x.withColumns({"block": F.floor(F.col("at") / BLOCK).cast("int"), "p": F.col("at") % BLOCK})
    t = steps.schema["t"].dataType.simpleString()
    start = F.struct(F.lit(None).cast("double").alias("acc"), F.array().cast(f"array<struct<p:int,t:{t},value:double,s:double>>").alias("out"))

    def plus(delta: Column, later: Column) -> Column:
        return F.coalesce(delta + later, delta, later)

    def back(a, r):
        s = plus(r["delta"], g * a["acc"])
        one = F.struct(r["p"].alias("p"), r["t"].alias("t"), r["value"].alias("value"), s.alias("s"))
        return F.struct(s.alias("acc"), F.concat(a["out"], F.array(one)).alias("out"))

    rows = F.collect_list(F.struct(F.col("p").cast("int").alias("p"), "t", F.col("value").cast("double").alias("value"), "delta"))
    blocks = x.groupBy("env", "run", "block").agg(F.count("*").alias("n"), F.aggregate(F.reverse(F.array_sort(rows)), start, back).alias("f"))
    blocks = blocks.select("env", "run", "block", "n", F.col("f.acc").alias("s"), F.col("f.out").alias("rows"))
    first = F.struct(F.lit(None).cast("double").alias("acc"), F.array().cast("array<struct<block:int,carry:double>>").alias("out"))

    def fold(a, r):
        one = F.struct(r["block"].alias("block"), a["acc"].alias("carry"))
        return F.struct(plus(r["s"], F.pow(F.lit(g), r["n"]) * a["acc"]).alias("acc"), F.concat(a["out"], F.array(one)).alias("out"))

    after = blocks.groupBy("env", "run").agg(F.aggregate(F.reverse(F.array_sort(F.collect_list(F.struct("block", "s", "n")))), first, fold).alias("f"))
    carry = after.select("env", "run", F.explode("f.out").alias("c")).select("env", "run", "c.block", "c.carry")
    y = blocks.join(carry, ["env", "run", "block"]).select("env", "n", "carry", F.explode("rows").alias("r"))
    y = y.select("env", F.col("r.t").alias("t"), F.col("r.value").alias("value"), plus(F.col("r.s"), F.pow(F.lit(g), F.col("n") - F.col("r.p")) * F.col("carry")).alias("advantage"))
    return y.select("env", "t", "advantage", (F.col("advantage") + F.col("value")).alias("ret"))


def n_step(steps: DataFrame, n: int, gamma: float = 0.99, last: str | None = None) -> DataFrame:
    """(env, t, target): n discounted rewards, and the value n steps on where the env has them.

    last: a column with the value of the state after an episode that was cut off by length, null
    where it ended; its steps with fewer than n after them are discounted up to it.
    """
    w = Window.partitionBy("env").orderBy("t")
    target = F.col("reward")
    for j in range(1, n):
        target = target + gamma**j * F.coalesce(F.lead("reward", j).over(w), F.lit(0.0))
    boot = gamma**n * F.lead("value", n).over(w)
    if last is not None:
        left = F.count("*").over(Window.partitionBy("env").orderBy(F.desc("t")))
        cut = F.when(left <= n, F.pow(F.lit(gamma), left) * F.max(last).over(Window.partitionBy("env")))
        boot = F.coalesce(boot, cut)
    return steps.select("env", "t", (target + F.coalesce(boot, F.lit(0.0))).alias("target"))


def shaped(steps: DataFrame, gamma: float = 0.99, beta: float = 1.0, eps: float = 1e-9) -> DataFrame:
    """(env, t, shaped): reward + gamma * phi(next) - phi, with phi = beta * log of the state's score;
    a terminal state, and one without a score, has 0."""
    w = Window.partitionBy("env").orderBy("t")
    phi = F.coalesce(beta * F.ln(F.greatest("score", F.lit(eps))), F.lit(0.0))
    nxt = F.when(F.col("done"), 0.0).otherwise(F.coalesce(F.lead(phi, 1).over(w), F.lit(0.0)))
    return steps.select("env", "t", (F.col("reward") + gamma * nxt - phi).alias("shaped"))


def statistics(episodes: DataFrame) -> DataFrame:
    """Mean and population deviation of reward and length by label, by (label, depth) and by
    (label, depth, pred), in one pass of grouping sets. Negatives have depth -1."""
    return _by_label(episodes, {"reward": F.col("reward"), "length": F.col("length")})


def _by_label(episodes: DataFrame, values: dict) -> DataFrame:
    x = episodes.withColumn("depth", F.when(F.col("label") == 1, F.col("depth")).otherwise(-1))
    sets = x.groupingSets([["label"], ["label", "depth"], ["label", "depth", "pred"]], "label", "depth", "pred")
    stats = [f(v).alias(f"{k}_{name}") for k, v in values.items() for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return sets.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *stats)


def episode_metrics(events: DataFrame) -> DataFrame:
    """``statistics`` with success beside reward and length, of events (env, episode, label, depth, pred,
    reward, length, success): each (env, episode) counts once, however often it was reported."""
    once = events.dropDuplicates(["env", "episode"])
    return _by_label(once, {"reward": F.col("reward"), "length": F.col("length"), "success": F.col("success").cast("double")})


def formatted(mean: Column, std: Column, n: Column) -> Column:
    """``mean +/- deviation (n)`` with three and two places."""
    return F.format_string("%.3f +/- %.2f (%d)", mean, std, n)


def proof_statistics(episodes: DataFrame) -> DataFrame:
    """(label, depth, n, proven, length, reward): share proved and means of length and reward, of each
    label, and of positives by depth; depth is null in a label's own row."""
    share = [F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("proven"), F.avg("length").alias("length"), F.avg("reward").alias("reward")]
    all_ = episodes.groupBy("label").agg(*share).select("label", F.lit(None).cast("int").alias("depth"), "n", "proven", "length", "reward")
    by = episodes.where("label = 1").groupBy("label", F.col("depth").cast("int").alias("depth")).agg(*share)
    return all_.unionByName(by)


def trial_summary(walks: DataFrame) -> DataFrame:
    """(mean, std, min, max) over trials of each trial's share of successes; walks: (trial, success)."""
    each = walks.groupBy("trial").agg(F.avg(F.col("success").cast("double")).alias("rate"))
    return each.agg(F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("std"), F.min("rate").alias("min"), F.max("rate").alias("max"))


def branching(factors: DataFrame) -> DataFrame:
    """mean, median, min, max and linear percentiles 25, 75, 95 of ``bf``."""
    p = lambda q, name: F.percentile("bf", F.lit(q)).alias(name)
    return factors.agg(F.avg("bf").alias("mean"), p(0.5, "median"), F.min("bf").alias("min"), F.max("bf").alias("max"), p(0.25, "p25"), p(0.75, "p75"), p(0.95, "p95"))


def branching_histogram(factors: DataFrame) -> DataFrame:
    """bucket, n: single factors under 10, then steps of 5."""
    b = F.when(F.col("bf") < 10, F.col("bf")).otherwise(F.floor(F.col("bf") / 5) * 5).cast("long")
    return factors.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def seed_average(runs: DataFrame, seeds: int) -> DataFrame:
    """(metric, mean, std): of metrics (seed, metric, value) that every seed has."""
    return runs.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.countDistinct("seed").alias("n")).where(F.col("n") == seeds).select("metric", "mean", "std")


def explained_variance(pairs: DataFrame) -> DataFrame:
    """1 - var(y - p) / (var(y) + 1e-8) of (y, p)."""
    return pairs.agg((1 - F.var_samp(F.col("y") - F.col("p")) / (F.var_samp("y") + 1e-8)).alias("explained"))
