"""Token counts as rollups that are maintained by deltas.

A batch of changes becomes signed rows: an insert adds a document's tokens, a delete takes them
off, a revision does both. The signed rows are summed by source, language and tokenizer version
and added to the totals, so no batch reads what earlier ones counted. Each batch is one folder of
sums, named by its id: committing an id again finds the folder and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small
from .token_codes import encoded

KEYS = ("source", "lang", "tokenizer")
#: Rows of a text beyond which they meet its first id by broadcast.
HOT = 100_000
SUMS = "source string, lang string, tokenizer string, documents long, tokens long"


def _bpe(batches: Iterator[pa.RecordBatch], path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(x) for x in encoded(batch.column("text").to_pylist(), path)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(n, pa.int64())], [*columns, "tokens"])


def count_tokens(docs: DataFrame, version: str, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens of every row of ``docs``, for one tokenizer version.

    path: a tokenizer file, whose ids are counted; without it words between white space are. A null
    text has 0 tokens. Counting needs no shuffle.
    """
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    if path:
        keep = ["doc_id", "source", "lang"]
        counted = slim.mapInArrow(lambda it: _bpe(it, path, keep), "doc_id long, source string, lang string, tokens long")
    else:
        counted = slim.select("doc_id", "source", "lang", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"))
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "tokens")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("documents"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """What was counted before goes, what is counted now comes; keys may differ."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Additive totals under a folder: ``commit`` adds a batch once, ``totals`` sums the batches.

    A batch is in if its folder has Spark's success marker, which is written last; a batch whose
    writer died is written again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = p.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _folder(self, batch: str) -> str:
        from urllib.parse import quote

        return f"batch={quote(batch, safe='')}"

    def committed(self, batch: str) -> bool:
        return self.fs.exists(self._at(self._folder(batch), "_SUCCESS"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add signed rows under the batch's id; False, and nothing is read, if it is in already.

        Rows are summed before they are shuffled, so a source with most of the rows sends as much
        as any other: a row of each key from each task.
        """
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/{self._folder(batch)}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens; keys whose documents are all deleted are gone.

        Null sources and languages are keys of their own. Without a batch there is no row.
        """
        if not self.fs.exists(self._at()):
            return self.spark.createDataFrame([], SUMS)
        done = [s.getPath().toString() for s in self.fs.listStatus(self._at()) if self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        if not done:
            return self.spark.createDataFrame([], SUMS)
        out = self.spark.read.schema(SUMS).parquet(*done).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return out.where("documents <> 0 or tokens <> 0")


def _first_ids(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, t, ...) with ``first``: the smallest doc_id of their t, null if it has one row.

    A t of over HOT rows meets its id by a broadcast of such, so no task gets all of its rows.
    """
    groups = rows.groupBy("t").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    hot = groups.where(F.col("n") > HOT).select(F.col("t").alias("_t"), F.col("first").alias("_hot"))
    x = rows.join(small(hot), F.col("t") == F.col("_t"), "left").drop("_t")
    rest = groups.where(F.col("n") <= HOT).select(F.col("t").alias("_t"), "first")
    cold = x.where("_hot is null").join(small(rest), F.col("t") == F.col("_t"), "left").select(*rows.columns, "first")
    return x.where("_hot is not null").select(*rows.columns, F.col("_hot").alias("first")).unionAll(cold)


def maintained_counts(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Totals of ``docs`` (doc_id, text, source, lang) after a history of batches:

    all documents by words; all by the tokenizer file; the first batch a second time, which adds
    nothing; deletion of every row whose text a smaller doc_id has, under both versions; revision
    of the word counts to version words-2, which counts line feeds too.

    A null text is an empty one. A row with a null doc_id is never deleted, nor are rows that agree
    in doc_id and text. Null sources and languages are keys. An empty table has no totals. Texts are
    read once; what follows reads their counts and a hash of them.
    """
    scratch = Scratch(spark, "rollup")
    rollup = Rollup(spark, scratch.path("totals"))
    text = F.col("text").cast("string")
    number = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")
    keep = ["doc_id", "source", "lang", "t", "w1", "w2"]
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.col(c).cast("string").alias(c) for c in ("source", "lang")),
        F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("t"),
        number(r"[^\x20\x09-\x0D]+").alias("w1"),
        number(r"\n|[^\x20\x09-\x0D]+").alias("w2"),
        text.alias("text"),
    )
    each = scratch.table(slim.mapInArrow(lambda it: _bpe(it, tokenizer, keep), "doc_id long, source string, lang string, t binary, w1 long, w2 long, tokens long"), "counts")
    each = scratch.table(_first_ids(each).withColumn("dead", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("t", "first"), "copies")

    def of(rows: DataFrame, version: str, count: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(count).alias("tokens"))

    rollup.commit("load/words-1", inserts(of(each, "words-1", "w1")))
    rollup.commit("load/byte_bpe_50k", inserts(of(each, "byte_bpe_50k", "tokens")))
    rollup.commit("load/words-1", inserts(of(each, "words-1", "w1")))
    dead, alive = each.where("dead"), each.where("not dead")
    rollup.commit("dedup/1", deletes(of(dead, "words-1", "w1").unionByName(of(dead, "byte_bpe_50k", "tokens"))))
    rollup.commit("revise/words-2", revisions(of(alive, "words-1", "w1"), of(alive, "words-2", "w2")))
    return rollup.totals()
