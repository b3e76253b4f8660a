"""Statistics of episodes as they end, for a stream of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ended(steps: DataFrame, late: str = "10 minutes", gap: str = "1 hour") -> DataFrame:
    """(env, start, end, reward, length) of every episode of a stream of steps (env, ts, reward).

    An episode is a session of its env: it ends when no step comes for ``gap``, and is final, and
    its state dropped, once the watermark of ``late`` has passed it. Batch frames work as well.
    """
    s = F.session_window("ts", gap)
    x = steps.withWatermark("ts", late).groupBy("env", s.alias("s")).agg(F.sum("reward").alias("reward"), F.count("*").alias("length"))
    return x.select("env", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "reward", "length")


def running(steps: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window start, label, n, reward_mean) of finished steps (ts, label, reward) by event time."""
    x = steps.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "label")
    return x.agg(F.count("*").alias("n"), F.avg("reward").alias("reward_mean")).select(F.col("w.start").alias("start"), "label", "n", "reward_mean")
