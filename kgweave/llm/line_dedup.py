"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a document are hashed. A window that occurs more than once is
kept where it comes first in order of (doc_id, text hash, line); the lines that its later
occurrences cover, merged, are removed. A removed line always has an equal line that stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, packed, small, unpacked

LINES = 3
#: Windows in a batch on their way from Python.
WINDOWS = 1 << 14


def _text_key(text: Column) -> Column:
    """Part of a row's key beside doc_id, so rows of one id and other text are other documents."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _windows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of each text: its line and a 128-bit hash of its lines."""
    import xxhash

    at, line, window = [], [], []

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        take = pa.array(at, pa.int64())
        out = pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(line, pa.int32()), pa.array(window, pa.binary())], ["doc_id", "key", "line", "window"])
        for some in (at, line, window):
            some.clear()
        return out

    for batch in batches:
        for k, text in enumerate(batch.column("text")):
            lines = (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
            for i in range(len(lines) - n + 1):
                at.append(k)
                line.append(i)
                window.append(xxhash.xxh3_128_digest(b"\n".join(lines[i : i + n])))
                if len(at) == WINDOWS:
                    yield rows(batch)
        yield rows(batch)


def covered(docs: DataFrame, scratch: Scratch, n: int = LINES) -> DataFrame:
    """doc_id, key, gone: ranges (from, to; from 0, both included) of the lines to remove, for
    documents that have some. Covered positions are merged, so a long passage is one range.

    docs: doc_id, text. The first occurrence of each window is found by a partial aggregate, so a
    window of very many documents is no hot key; occurrences then meet the repeated windows in a
    join that AQE can split.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(text).alias("key"), text.alias("text"))
    each = scratch.table(rows.mapInArrow(lambda it: _windows(it, n), "doc_id long, key binary, line int, window binary"), "windows")
    at = F.struct("doc_id", "key", "line")
    repeated = each.groupBy("window").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last")
    repeated = scratch.table(repeated.select("window", "first"), "repeated")
    later = each.join(small(repeated), "window").where(~at.eqNullSafe(F.col("first")))
    found = later.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    # A window begins a range unless another begins within the n lines before it; likewise at its end.
    first = lambda x, i: (i == 0) | (x - F.get("lines", i - 1) > n)
    last = lambda x, i: (i == F.size("lines") - 1) | (F.get("lines", i + 1) - x > n)
    gone = F.arrays_zip(F.filter("lines", first).alias("a"), F.transform(F.filter("lines", last), lambda x: x + (n - 1)).alias("z"))
    return scratch.table(found.select("doc_id", "key", gone.alias("gone")), "gone")


def _cut(text: str | None, gone: list[dict] | None) -> tuple[str | None, int]:
    """The text without its lines in the ranges, and how many those are."""
    if not gone:
        return text, 0
    lines = text.split("\n")
    ends = [-1, *(r["z"] for r in gone)]
    starts = [*(r["a"] for r in gone), len(lines)]
    kept = [x for end, start in zip(ends, starts, strict=True) for x in lines[end + 1 : start]]
    return "\n".join(kept), len(lines) - len(kept)


def _joined(spark: SparkSession, docs: DataFrame, n: int) -> DataFrame:
    """_row, doc_id, text and gone (null where nothing goes) of every row of ``docs``."""
    gone = covered(docs, Scratch(spark, "lines"), n).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    rows = packed(docs).withColumns({"doc_id": F.col("_row.doc_id").cast("long"), "text": F.col("_row.text").cast("string")})
    # A document's ranges take 16 bytes and 8 for each; beyond a bound on all of them the join shuffles.
    return rows.join(small(gone, 16 + 8 * F.size("gone")), rows.doc_id.eqNullSafe(F.col("_id")) & (_text_key(rows.text) == F.col("_key")), "left")


def dedup_lines(spark: SparkSession, docs: DataFrame, n: int = LINES) -> DataFrame:
    """``docs`` (doc_id, text and any others) with the removed lines cut out of text.

    A text with fewer lines than a window, an empty or a null text stays as it is. A text whose
    lines all go is empty. Lines are split at line feeds and compared as they are. Rows that agree
    in doc_id and text are one document: their windows are the same occurrences. An empty table stays
    empty. Columns of any name pass as they are.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_cut(t, g)[0] for t, g in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(texts, pa.string())], ["_row", "text"])

    rows = _joined(spark, docs, n).select("_row", "text", "gone")
    out = rows.mapInArrow(cut, rows.select("_row", "text").schema)
    return unpacked(out.select(F.col("_row").withField("text", F.col("text")).alias("_row")), docs)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total, removed, md5 = [], [], []
        for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
            total.append(0 if text is None else text.count("\n") + 1)
            left, n = _cut(text, gone)
            removed.append(n)
            md5.append(hashlib.md5((left or "").encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(md5, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_md5"])


def line_report(spark: SparkSession, docs: DataFrame, n: int = LINES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines (null text: 0), n_removed, kept_md5 (of the text that is
    left; a null text counts as empty)."""
    rows = _joined(spark, docs, n).select("doc_id", "text", "gone")
    return rows.mapInArrow(_report, "doc_id long, n_lines long, n_removed long, kept_md5 string")
