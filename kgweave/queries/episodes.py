"""Queries of episodes: events of a user in order of (ts, event_id), reward = value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import episodes as E
from . import register

#: value of a state: an arithmetic hash of its event, 0 to 9.
STEPS = (
    "SELECT user_id AS env, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value AS reward, CAST(event_id * 7919 % 10 AS DOUBLE) AS value, "
    "lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS done, event_type, event_id FROM events"
)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("env"), F.row_number().over(w).cast("long").alias("t"), F.col("value").alias("reward"), (F.col("event_id") * 7919 % 10).cast("double").alias("value"), F.lead("event_id").over(w).isNull().alias("done"), "event_type", "event_id")


@register(
    f"WITH s AS ({STEPS}), d AS (SELECT env, t, value, reward + 0.99 * CASE WHEN done THEN 0 ELSE lead(value) OVER (PARTITION BY env ORDER BY t) END - value AS delta FROM s), "
    "g AS (SELECT a.env, a.t, any_value(a.value) AS value, sum(b.delta * pow(0.99 * 0.95, b.t - a.t)) AS adv FROM d a JOIN d b ON a.env = b.env AND b.t >= a.t GROUP BY a.env, a.t) SELECT env, t, round(adv, 4) AS advantage, round(adv + value, 4) AS ret FROM g"
)
def gae_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gae(steps(spark, sf_dir)).select("env", "t", S.rounded(F.col("advantage"), 4).alias("advantage"), S.rounded(F.col("ret"), 4).alias("ret"))


@register(
    f"WITH s AS ({STEPS}) SELECT env, t, round(reward + 0.99 * coalesce(lead(reward, 1) OVER w, 0) + pow(0.99, 2) * coalesce(lead(reward, 2) OVER w, 0) + pow(0.99, 3) * coalesce(lead(value, 3) OVER w, 0), 6) AS target FROM s WINDOW w AS (PARTITION BY env ORDER BY t)"
)
def nstep_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.n_step(steps(spark, sf_dir), 3).select("env", "t", F.round("target", 6).alias("target"))


@register(f"WITH s AS ({STEPS}), p AS (SELECT *, ln(greatest(value / 10, 1e-9)) AS phi FROM s) SELECT env, t, round(reward + 0.99 * CASE WHEN done THEN 0 ELSE coalesce(lead(phi) OVER (PARTITION BY env ORDER BY t), 0) END - phi, 4) AS shaped FROM p")
def pbrs_shaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = steps(spark, sf_dir).withColumn("score", F.col("value") / 10)
    return E.shaped(x).select("env", "t", F.round("shaped", 4).alias("shaped"))


@register(f"WITH s AS ({STEPS}) SELECT env, t, round(sum(ln((value + 1) / 11)) OVER (PARTITION BY env ORDER BY t), 4) AS cum_log_prob FROM s")
def cumulative_log_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("env").orderBy("t")
    return steps(spark, sf_dir).select("env", "t", F.round(F.sum(F.ln((F.col("value") + 1) / 11)).over(w), 4).alias("cum_log_prob"))


EPISODES = f"WITH s AS ({STEPS}), e AS (SELECT env, env % 2 AS label, CASE WHEN env % 2 = 1 THEN env % 4 ELSE -1 END AS depth, 'p' || env % 3 AS pred, round(sum(reward), 6) AS reward, count(*) AS length FROM s GROUP BY env)"


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("env")
    x = steps(spark, sf_dir).groupBy("env").agg(F.round(F.sum("reward"), 6).alias("reward"), F.count("*").alias("length"))
    return x.select("env", (e % 2).alias("label"), (e % 4).alias("depth"), F.concat(F.lit("p"), (e % 3).cast("string")).alias("pred"), "reward", "length")


@register(EPISODES + " SELECT label, depth, pred, grouping(label) * 4 + grouping(depth) * 2 + grouping(pred) AS level, count(*) AS n, round(avg(reward), 4) AS reward_mean, round(stddev_pop(reward), 4) AS reward_std, round(avg(length), 4) AS length_mean, round(stddev_pop(length), 4) AS length_std FROM e GROUP BY GROUPING SETS ((label), (label, depth), (label, depth, pred))")
def episode_stats_groupingsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.statistics(episodes(spark, sf_dir))
    return x.select("label", "depth", "pred", F.col("level").cast("long").alias("level"), "n", *[F.round(c, 4).alias(c) for c in ("reward_mean", "reward_std", "length_mean", "length_std")])


BF = "SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS bf FROM events GROUP BY 1, 2"


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("bf"))


@register(f"SELECT round(avg(bf), 6) AS mean, CAST(quantile_cont(bf, 0.5) AS DOUBLE) AS median, min(bf) AS min, max(bf) AS max, round(quantile_cont(bf, 0.25), 6) AS p25, round(quantile_cont(bf, 0.75), 6) AS p75, round(quantile_cont(bf, 0.95), 6) AS p95 FROM ({BF})")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.branching(factors(spark, sf_dir))
    return x.select(F.round("mean", 6).alias("mean"), "median", "min", "max", *[F.round(c, 6).alias(c) for c in ("p25", "p75", "p95")])


@register("SELECT CASE WHEN bf < 10 THEN bf ELSE CAST(floor(bf / 5) * 5 AS BIGINT) END AS bucket, count(*) AS n FROM (SELECT user_id, count(*) AS bf FROM events GROUP BY user_id) GROUP BY 1")
def branching_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.branching_histogram(spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count("*").alias("bf")))


@register(EPISODES + ", h AS (SELECT depth, count(*) AS n, sum(CASE WHEN reward > 1000 THEN 1 ELSE 0 END) AS proven FROM e GROUP BY depth) SELECT depth, n, CAST(proven AS BIGINT) AS proven, CAST(sum(proven) OVER (ORDER BY depth) AS BIGINT) AS cumulative, round(proven / n, 6) AS ratio FROM h")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = episodes(spark, sf_dir).withColumn("depth", F.when(F.col("label") == 1, F.col("depth")).otherwise(-1))
    h = x.groupBy("depth").agg(F.count("*").alias("n"), F.count_if(F.col("reward") > 1000).alias("proven"))
    return h.select("depth", "n", "proven", F.sum("proven").over(Window.orderBy("depth")).alias("cumulative"), F.round(F.col("proven") / F.col("n"), 6).alias("ratio"))


@register("WITH r AS (SELECT user_id % 5 AS seed, event_type AS metric, avg(value) AS value FROM events WHERE NOT (event_type = (SELECT min(event_type) FROM events) AND user_id % 5 = 0) GROUP BY 1, 2) SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM r GROUP BY metric HAVING count(DISTINCT seed) = 5")
def seed_average_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five seeds; the first event type lacks one and goes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = F.broadcast(e.agg(F.min("event_type").alias("first")))
    x = e.crossJoin(first).where(~((F.col("event_type") == F.col("first")) & (F.col("user_id") % 5 == 0)))
    runs = x.groupBy((F.col("user_id") % 5).alias("seed"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return E.seed_average(runs, 5).select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register(f"WITH s AS ({STEPS}) SELECT round(1 - var_samp(reward - value) / (var_samp(reward) + 1e-8), 6) AS explained FROM s")
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = steps(spark, sf_dir).select(F.col("reward").alias("y"), F.col("value").alias("p"))
    return E.explained_variance(x).select(F.round("explained", 6).alias("explained"))


REWARD_SQL = " ".join(
    f"CAST(CASE WHEN NOT done THEN 0.0 WHEN label = 1 THEN CASE WHEN success THEN {tp} ELSE {fn} END WHEN success THEN {fp} ELSE {0.5 if tn is None else tn}{' + CASE WHEN ended THEN 0.3 ELSE 0.0 END' if k == 5 else ''} END AS DOUBLE) AS reward{k}," for k, (tp, fn, fp, tn) in S.REWARDS.items()
)


@register(f"SELECT doc_id, {REWARD_SQL[:-1]} FROM (SELECT doc_id, quality AS label, toxic = 1 AS success, doc_id % 4 <> 0 AS done, doc_id % 5 = 0 AS ended FROM labels)")
def reward_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    x = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"), (F.col("toxic") == 1).alias("success"), (d % 4 != 0).alias("done"), (d % 5 == 0).alias("ended"))
    return x.select("doc_id", *[S.reward(k, F.col("done"), F.col("success"), F.col("label"), F.col("ended"), 0.5).alias(f"reward{k}") for k in S.REWARDS])


@register("SELECT event_id, round(p * 1.0, 6) AS progress, round(CASE WHEN p < 0.1 THEN 0.001 * p / 0.1 ELSE 0.001 + (0.0001 - 0.001) * greatest(0.0, (p - 0.1) / 0.9) END, 9) AS linear, round(0.001 * pow(0.1, p), 9) AS exp, round(0.0001 + (0.001 - 0.0001) * (1 + cos(p * pi())) / 2, 9) AS cos FROM (SELECT event_id, event_id % 101 / 100.0 AS p FROM events)")
def annealing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 101 / 100.0).alias("p"))
    p = F.col("p")
    return x.select("event_id", F.round("p", 6).alias("progress"), F.round(S.anneal(p, 1e-3, 1e-4, "linear", 0.1), 9).alias("linear"), F.round(S.anneal(p, 1e-3, 1e-4, "exp"), 9).alias("exp"), F.round(S.anneal(p, 1e-3, 1e-4, "cos"), 9).alias("cos"))


@register(f"WITH s AS ({STEPS}), m AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY env)) SELECT env, t, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value END + (ln((1 + n + 19652.0) / 19652.0) + 1.25) / n * sqrt(greatest(n, 1)) / (1 + t), 6) AS puct FROM m")
def puct_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("env")
    x = steps(spark, sf_dir).withColumns({"lo": F.min("value").over(w), "hi": F.max("value").over(w), "n": F.count("*").over(w)})
    return x.select("env", "t", F.round(S.puct(F.col("value"), F.col("lo"), F.col("hi"), 1 / F.col("n"), F.col("n"), F.col("t")), 6).alias("puct"))


@register(f"WITH s AS ({STEPS}), x AS (SELECT *, max(value) OVER (PARTITION BY env) AS top FROM s) SELECT env, t, round(value - top - ln(sum(exp(value - top)) OVER (PARTITION BY env)), 6) AS log_prob, row_number() OVER (PARTITION BY env ORDER BY value DESC, t) = 1 AS mode FROM x")
def log_softmax_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("env")
    x = steps(spark, sf_dir).withColumn("top", F.max("value").over(w))
    lp = F.col("value") - F.col("top") - F.ln(F.sum(F.exp(F.col("value") - F.col("top"))).over(w))
    return x.select("env", "t", F.round(lp, 6).alias("log_prob"), (F.row_number().over(w.orderBy(F.col("value").desc(), "t")) == 1).alias("mode"))


@register("SELECT user_id AS trial, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_id * 7919 + 17 * 104729) % 1000003, event_id) AS r FROM events) WHERE r = 1")
def random_walk_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One child a state, uniform by an arithmetic hash."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    r = F.row_number().over(Window.partitionBy("user_id").orderBy((F.col("event_id") * 7919 + 17 * 104729) % 1000003, "event_id"))
    return e.withColumn("r", r).where("r = 1").select(F.col("user_id").alias("trial"), "event_id")


@register("WITH m AS (SELECT user_id AS step, round(avg(value), 6) AS mrr FROM events GROUP BY 1), b AS (SELECT step, mrr, max(mrr) OVER (ORDER BY step) AS best FROM m) SELECT step, mrr, best, min(CASE WHEN mrr = best THEN step END) OVER (PARTITION BY best ORDER BY step) AS best_step FROM b")
def best_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import running_best

    m = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("step")).agg(F.round(F.avg("value"), 6).alias("mrr"))
    return running_best(m, "step", "mrr")


@register(f"WITH s AS ({STEPS}), x AS (SELECT event_type, exp((value - 5) / 10) AS ratio, reward / 100 AS adv FROM s) SELECT event_type, round(avg(-least(ratio * adv, greatest(0.8, least(1.2, ratio)) * adv)), 6) AS policy_loss, round(avg(CASE WHEN abs(ratio - 1) > 0.2 THEN 1.0 ELSE 0.0 END), 6) AS clip_fraction, round(avg(ratio - 1 - ln(ratio)), 6) AS approx_kl FROM x GROUP BY event_type")
def policy_loss_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = steps(spark, sf_dir).select("event_type", F.exp((F.col("value") - 5) / 10).alias("ratio"), (F.col("reward") / 100).alias("adv"))
    r, a = F.col("ratio"), F.col("adv")
    clipped = F.greatest(F.lit(0.8), F.least(F.lit(1.2), r))
    return x.groupBy("event_type").agg(F.round(F.avg(-F.least(r * a, clipped * a)), 6).alias("policy_loss"), F.round(F.avg(F.when(F.abs(r - 1) > 0.2, 1.0).otherwise(0.0)), 6).alias("clip_fraction"), F.round(F.avg(r - 1 - F.ln(r)), 6).alias("approx_kl"))


@register(
    f"WITH s AS ({STEPS}), l AS (SELECT *, count(*) OVER (PARTITION BY env ORDER BY t DESC) AS n, CASE WHEN env % 3 = 0 THEN NULL ELSE CAST(env % 7 AS DOUBLE) END AS last FROM s) SELECT env, t, round(reward + 0.99 * coalesce(lead(reward, 1) OVER w, 0) + pow(0.99, 2) * coalesce(lead(reward, 2) OVER w, 0) + coalesce(pow(0.99, 3) * lead(value, 3) OVER w, CASE WHEN n <= 3 THEN pow(0.99, n) * last END, 0), 6) AS target FROM l WINDOW w AS (PARTITION BY env ORDER BY t)"
)
def nstep_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three episodes were cut off, and have the value of the state after them."""
    last = F.when(F.col("env") % 3 == 0, None).otherwise((F.col("env") % 7).cast("double"))
    return E.n_step(steps(spark, sf_dir).withColumn("last", last), 3, last="last").select("env", "t", F.round("target", 6).alias("target"))


RUNS = f"{EPISODES}, v AS (SELECT env, label, CAST(depth AS INTEGER) AS depth, pred, reward, length, length % 2 = 0 AS success FROM e)"


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(spark, sf_dir).withColumns({"depth": F.when(F.col("label") == 1, F.col("depth")).otherwise(-1).cast("int"), "success": F.col("length") % 2 == 0, "episode": F.lit(0)})


@register(
    f"{RUNS}, g AS (SELECT label, depth, pred, count(*) AS n, avg(reward) AS rm, stddev_pop(reward) AS rs, avg(CAST(success AS INTEGER)) AS sm, stddev_pop(CAST(success AS INTEGER)) AS ss FROM v GROUP BY GROUPING SETS ((label), (label, depth), (label, depth, pred))) "
    "SELECT label, depth, pred, n, round(rm, 4) AS reward, round(rs, 4) AS reward_std, printf('%.3f +/- %.2f (%d)', round(sm, 3), round(ss, 2), n) AS success FROM g"
)
def episode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode is reported twice here, and counts once."""
    x = finished(spark, sf_dir)
    m = E.episode_metrics(x.unionAll(x))
    return m.select("label", "depth", "pred", "n", F.round("reward_mean", 4).alias("reward"), F.round("reward_std", 4).alias("reward_std"), E.formatted(F.col("success_mean"), F.col("success_std"), F.col("n")).alias("success"))


@register(f"{RUNS}, a AS (SELECT label, NULL AS depth, success, length, reward FROM v UNION ALL SELECT label, depth, success, length, reward FROM v WHERE label = 1) SELECT label, CAST(depth AS INTEGER) AS depth, count(*) AS n, round(avg(CAST(success AS INTEGER)), 6) AS proven, round(avg(length), 4) AS length, round(avg(reward), 4) AS reward FROM a GROUP BY label, depth")
def proof_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.proof_statistics(finished(spark, sf_dir))
    return x.select("label", "depth", "n", F.round("proven", 6).alias("proven"), F.round("length", 4).alias("length"), F.round("reward", 4).alias("reward"))


@register("SELECT round(avg(rate), 6) AS mean, round(stddev_pop(rate), 6) AS std, round(min(rate), 6) AS min, round(max(rate), 6) AS max FROM (SELECT user_id % 7 AS trial, avg(CASE WHEN event_id * 7919 % 10 < 4 THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY 1)")
def trial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    x = E.trial_summary(e.select((F.col("user_id") % 7).alias("trial"), (F.col("event_id") * 7919 % 10 < 4).alias("success")))
    return x.select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


@register("SELECT event_id, CASE WHEN p < 0.5 THEN 1.0 WHEN p < 0.75 THEN 0.5 ELSE 0.25 END AS temperature FROM (SELECT event_id, event_id % 101 / 100.0 AS p FROM events)".replace("CASE WHEN p", "CAST(CASE WHEN p").replace("0.25 END", "0.25 END AS DOUBLE)"))
def temperature_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", S.temperature(F.col("event_id") % 101 / 100.0).alias("temperature"))


PUCT = "round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value END + (ln((1 + n + 19652.0) / 19652.0) + 1.25) / n * sqrt(greatest(n, 1)) / (1 + t), 9)"


@register(f"WITH s AS ({STEPS}), m AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY env)), c AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY env ORDER BY {PUCT} DESC, t) = 1) SELECT env, t AS action, round(value + (reward + 0.99 * value - value) / (t + 1), 6) AS value, t + 1 AS visits FROM c")
def puct_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child of the greatest score, and its value after one more return went up through it."""
    w = Window.partitionBy("env")
    x = steps(spark, sf_dir).withColumns({"lo": F.min("value").over(w), "hi": F.max("value").over(w), "n": F.count("*").over(w)})
    score = F.round(S.puct(F.col("value"), F.col("lo"), F.col("hi"), 1 / F.col("n"), F.col("n"), F.col("t")), 9)
    best = x.withColumn("r", F.row_number().over(w.orderBy(score.desc(), "t"))).where("r = 1")
    value, visits = S.backed_up(F.col("value"), F.col("t"), F.col("reward") + 0.99 * F.col("value"))
    return best.select("env", F.col("t").alias("action"), F.round(value, 6).alias("value"), visits.alias("visits"))


@register(f"WITH s AS ({STEPS}), x AS (SELECT *, max(value) OVER (PARTITION BY env) AS top FROM s), p AS (SELECT env, t, event_id, value, exp(value - top) / sum(exp(value - top)) OVER (PARTITION BY env) AS p FROM x), g AS (SELECT *, value - ln(-ln(((event_id * 7919 + 104729) % 1000003 + 0.5) / 1000003)) AS g FROM p) SELECT env, round(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END), 6) AS entropy, arg_max(t, g) AS sample FROM g GROUP BY env")
def entropy_and_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of each env's softmax, and one seeded draw of it."""
    from ..functions import losses as L

    x = steps(spark, sf_dir).withColumn("p", L.softmax(F.col("value"), Window.partitionBy("env")))
    x = x.withColumns({"e": L.entropy(F.col("p"), Window.partitionBy("env")), "g": F.col("value") + L.gumbel(F.col("event_id"))})
    return x.groupBy("env").agg(F.round(F.max("e"), 6).alias("entropy"), F.max_by("t", "g").alias("sample"))


@register(f"WITH s AS ({STEPS}), x AS (SELECT event_type, value AS new, value - (event_id % 5 - 2) AS old, reward / 20 AS target FROM s) SELECT event_type, round(avg(greatest((new - target) ** 2, (old + greatest(-0.5, least(0.5, new - old)) - target) ** 2) / 2), 4) AS loss FROM x GROUP BY event_type")
def clipped_value_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import losses as L

    x = steps(spark, sf_dir).select("event_type", F.col("value").alias("new"), (F.col("value") - (F.col("event_id") % 5 - 2)).alias("old"), (F.col("reward") / 20).alias("target"))
    return x.groupBy("event_type").agg(F.round(F.avg(L.clipped_value_loss(F.col("new"), F.col("old"), F.col("target"), 0.5)), 4).alias("loss"))


@register(f"WITH s AS ({STEPS}) SELECT env, round(avg(greatest(0, 3 + value - p)), 6) AS loss FROM (SELECT env, t, value, first_value(value) OVER (PARTITION BY env ORDER BY t) AS p FROM s) WHERE t > 1 GROUP BY env")
def margin_contrastive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first state of an env against all its others."""
    from ..functions import losses as L

    x = steps(spark, sf_dir).withColumn("p", F.first("value").over(Window.partitionBy("env").orderBy("t"))).where("t > 1")
    return x.groupBy("env").agg(F.round(F.avg(L.margin_contrastive(F.col("p"), F.col("value"), 3.0)), 6).alias("loss"))
