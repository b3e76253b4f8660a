"""Mixing sources to target weights by hash-threshold histograms.

A document's hash gives its place in its source. Words are summed by source and hash bucket; the
bucket in which a source's budget ends is the only one that is summed again in finer buckets, down
to a single hash. What is below the threshold is taken: no sort, and a larger budget takes a
superset of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, packed, small, unpacked

WEIGHTS, SHARE, CEILING = (3, 1, 2), 1.5, 2
#: Hash bits, and bits that one histogram resolves (at most 2 ** BUCKET_BITS rows a source).
HASH_BITS, BUCKET_BITS = 60, 12


def place(doc_id: Column, text: Column) -> Column:
    """60 hash bits of a document, as a long."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple, share: float, ceiling: int) -> DataFrame:
    """source, source_size, target of every source.

    Targets stop at ``ceiling`` times the source, the rest is shared by weight: target is the less
    of that and level * weight. Sources are filled in order of ceiling / weight, so a running sum
    gives the level at which the next source would not be full.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    full = (F.col("source_size") * ceiling).cast("double")
    x = by_source.withColumn("w", weight).withColumn("full", full)
    filled = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    x = x.select(
        "source", "source_size", "w", "full", (F.sum("source_size").over(whole) * share).alias("goal"), F.coalesce(F.sum("full").over(before), F.lit(0.0)).alias("spent"), (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("open")
    )
    x = x.withColumn("level", (F.col("goal") - F.col("spent")) / F.col("open"))
    # The level is right at the first source that it doesn't fill; beyond the last, all are full.
    level = F.min(F.when(F.col("full") >= F.col("level") * F.col("w"), F.struct((F.col("full") / F.col("w")).alias("k"), "level"))).over(whole)["level"]
    return x.select("source", "source_size", F.least("full", F.coalesce(level * F.col("w"), F.col("full"))).alias("target"))


def thresholds(slim: DataFrame, goals: DataFrame, scratch: Scratch) -> DataFrame:
    """source, source_size, target, base, budget, below, at, copies: a document is taken base times,
    and once more if its hash is less than ``below``. ``at`` words lie below it; ``copies`` rows have
    the hash itself, of which as many as the budget has room for. slim: source, size, h."""
    base = (F.col("target") >= F.col("source_size")).cast("int")
    state = goals.select("source", "source_size", "target", base.alias("base"), (F.col("target") - base * F.col("source_size")).alias("budget"))
    none = F.lit(None).cast("long")
    state = scratch.table(state.select("*", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("cum"), none.alias("below"), none.cast("double").alias("at"), F.lit(1).cast("long").alias("copies")), "targets")
    left = HASH_BITS
    while left:
        open_ = state.where("below is null")
        if open_.isEmpty():
            break
        shift = left - BUCKET_BITS
        at = small(open_.select(F.col("source").alias("s"), "prefix"))
        rows = slim.join(at, slim.source.eqNullSafe(F.col("s")) & (F.shiftright("h", left) == F.col("prefix")))
        hist = rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.min("h").alias("low"), F.max("h").alias("high"))
        upto = Window.partitionBy("source").orderBy("bucket")
        hist = hist.select("source", "bucket", "n", "rows", "low", "high", (F.sum("n").over(upto) - F.col("n")).alias("ahead"))
        x = hist.join(small(open_.select(F.col("source").alias("s"), "budget", "cum")), F.col("source").eqNullSafe(F.col("s")))
        x = x.withColumn("start", F.col("cum") + F.col("ahead"))
        # The budget ends in this bucket.
        ends = x.where("start < budget and start + n > budget")
        single = F.col("low") == F.col("high")
        ends = ends.select(F.col("source").alias("s"), F.struct(F.col("bucket").alias("prefix"), F.col("start").alias("cum"), F.when(single, F.col("low")).alias("below"), "rows").alias("next"))
        # No bucket holds the end: it is between two, and what starts before it is taken.
        edge = x.groupBy(F.col("source").alias("e")).agg(F.max(F.when(F.col("start") < F.col("budget"), F.col("high") + 1)).alias("edge"))
        nxt = state.join(small(ends), state.source.eqNullSafe(F.col("s")), "left").join(small(edge), state.source.eqNullSafe(F.col("e")), "left")
        open_now, between = F.col("below").isNull(), F.col("next").isNull()
        state = scratch.table(
            nxt.select(
                *("source", "source_size", "target", "base", "budget"),
                F.coalesce("next.prefix", "prefix").alias("prefix"),
                F.coalesce("next.cum", "cum").alias("cum"),
                F.when(~open_now, F.col("below")).when(between, F.coalesce("edge", F.lit(0).cast("long"))).otherwise(F.col("next.below")).alias("below"),
                F.when(~open_now, F.col("at")).when(between, F.col("budget")).when(F.col("next.below").isNotNull(), F.col("next.cum").cast("double")).alias("at"),
                F.when(open_now & F.col("next.below").isNotNull(), F.col("next.rows")).otherwise(F.col("copies")).alias("copies"),
            ),
            "state",
        )
        left = shift
    return state.select("source", "source_size", "target", "base", "budget", "below", "at", "copies")


def _times(rows: DataFrame, cut: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (source, size, h, ...) with what ``cut`` says of their source, and ``times`` taken.

    Rows that share a source's boundary hash are numbered: by themselves within the task that reads
    them, and by the rows of the tasks before it. So a row that fills a third of the table is no
    window of one task.
    """
    cut = cut.withColumnRenamed("source", "_s")
    x = rows.join(small(cut), rows.source.eqNullSafe(F.col("_s"))).drop("_s")

    def times(number: Column) -> Column:
        room = 2 * (F.col("at") + (number - 1) * F.col("size")) + F.col("size") < 2 * F.col("budget")
        return (F.col("base") + ((F.col("h") < F.col("below")) | ((F.col("h") == F.col("below")) & room)).cast("int")).alias("times")

    if cut.where("copies > 1").isEmpty():
        return x.select("*", times(F.lit(1)))
    shared = (F.col("h") == F.col("below")) & (F.col("copies") > 1)
    some = scratch.table(x.where(shared).withColumn("_part", F.spark_partition_id()), "shared")
    own = F.row_number().over(Window.partitionBy("source", "_part").orderBy("h"))
    sums = some.groupBy("source", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_part")) - F.col("_n")
    sums = sums.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), before.alias("_before"))
    numbered = some.withColumn("_own", own).join(small(sums), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    return x.where(~shared).select("*", times(F.lit(1))).unionAll(numbered.select(*x.columns, times(F.col("_own") + F.col("_before"))))


def _plan(docs: DataFrame, scratch: Scratch, weights: tuple, share: float, ceiling: int) -> tuple[DataFrame, DataFrame]:
    text, doc_id = F.col("text").cast("string"), F.col("doc_id")
    slim = scratch.table(docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), words(text).alias("size"), place(doc_id, text).alias("h")), "sizes")
    return slim, thresholds(slim, targets(slim, weights, share, ceiling), scratch)


def mix_plan(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken.

    size counts words (null or empty text: 0). Sources, by code point with null last, take
    ``weights`` in turn and share ``share`` times all sizes; targets stop at ``ceiling`` (2) times
    their source. taken is 0, size or twice size: whole documents by hash threshold, so a source
    misses its target by half a document at most. Rows that agree in doc_id and text share a hash;
    where the budget ends among them, as many as it has room for are taken. Reruns agree. An empty
    table gives no row.
    """
    scratch = Scratch(spark, "mixing")
    slim, cut = _plan(docs, scratch, weights, share, ceiling)
    return _times(slim, cut, scratch).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """The mix itself: rows of ``docs``, those taken twice two times; documents without words once
    or twice like their neighbours. The documents are filtered where they are read, not sorted.

    Nulls and repeated rows as in ``mix_plan``; of rows that agree in doc_id and text but differ
    in other columns, which are taken follows the order in which they are read. An empty table
    gives no row. Columns of any name pass as they are.
    """
    scratch = Scratch(spark, "mixing")
    _, cut = _plan(docs, scratch, weights, share, ceiling)
    text = F.col("_row.text").cast("string")
    rows = packed(docs).select("_row", F.col("_row.source").cast("string").alias("source"), words(text).alias("size"), place(F.col("_row.doc_id"), text).alias("h"))
    x = _times(rows, cut, scratch).select("_row", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("copy"), "times")
    return unpacked(x.where("copy <= times"), docs)
