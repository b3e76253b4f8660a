"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks that overlap by the width of a filter, so every window of
bytes is seen once. Each filter is a table of weights by offset and byte; its outputs are
max-pooled in a chunk, averaged over all chunks of the document, and one logistic layer makes one
probability of them. Trained by Adam on whole texts, longest ones split into as many chunks as
they need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled documents a class that the network is fitted on, at most; chosen by a hash of doc_id.
FIT_DOCS = 500
FOLDS, CUT = 5, 0.3
#: Filters, bytes a filter spans, values a byte is embedded in, windows in a chunk.
FILTERS, WIDTH, EMBED, CHUNK = 12, 7, 6, 96
EPOCHS, BATCH, RATE, SEED = 8, 24, 0.01, 7
#: Windows that are scored at once.
BLOCK = 1 << 16


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def _bytes(text: str | None) -> np.ndarray:
    """Bytes of a text, zeros behind it up to one window at least."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return np.concatenate([raw, np.zeros(max(WIDTH - 1, WIDTH - len(raw)), np.uint8)])


class Network:
    def __init__(self, rng: np.random.Generator):
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)),
            "conv": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.3, 2 * FILTERS),
            "offset": np.zeros(1),
        }

    def pooled(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean and maximum over chunks of the filters' chunk maxima, which windows gave them, all
        chunk maxima. Chunks are worked off in blocks of bounded size."""
        p, n = self.p, len(raw) - WIDTH + 1
        tops, where = [], []
        for a in range(0, n, BLOCK // CHUNK * CHUNK):
            z = min(n, a + BLOCK // CHUNK * CHUNK)
            x = p["embed"][raw[a : z + WIDTH - 1]].astype(np.float32)
            windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH, 0)  # windows, embed, width
            v = windows.transpose(0, 2, 1).reshape(z - a, WIDTH * EMBED) @ p["conv"].astype(np.float32) + p["bias"].astype(np.float32)
            pad = -(z - a) % CHUNK
            if pad:
                v = np.concatenate([v, np.full((pad, FILTERS), -np.inf, np.float32)])
            v = v.reshape(-1, CHUNK, FILTERS)
            k = v.argmax(1)
            where.append(k + a + CHUNK * np.arange(len(v))[:, None])
            tops.append(np.take_along_axis(v, k[:, None], 1)[:, 0])
        top, at = np.tanh(np.concatenate(tops).astype(np.float64)), np.concatenate(where)
        return np.concatenate([top.mean(0), top.max(0)]), at, top

    def logit(self, raw: np.ndarray) -> float:
        return float(self.pooled(raw)[0] @ self.p["out"] + self.p["offset"][0])

    def gradients(self, raw: np.ndarray, y: float, weight: float, into: dict) -> None:
        p = self.p
        h, at, top = self.pooled(raw)
        z = h @ p["out"] + p["offset"][0]
        d = weight * (1 / (1 + np.exp(-z)) - y)
        into["offset"] += d
        into["out"] += d * h
        back = np.repeat(d * p["out"][None, :FILTERS] / len(top), len(top), 0)
        best = top.argmax(0)
        back[best, np.arange(FILTERS)] += d * p["out"][FILTERS:]
        back *= 1 - top**2
        into["bias"] += back.sum(0)
        taps = raw[at[..., None] + np.arange(WIDTH)]  # chunks, filters, width
        x = p["embed"][taps].reshape(len(top), FILTERS, WIDTH * EMBED)
        into["conv"] += np.einsum("cf,cfk->kf", back, x)
        np.add.at(into["embed"], taps, np.einsum("cf,kf->cfk", back, p["conv"]).reshape(len(top), FILTERS, WIDTH, EMBED))


def train(texts: tuple[list[str], list[str]], totals: tuple[int, int]) -> Network | float:
    """The network, or the smoothed share of label 1 where a class has no text.

    Classes weigh as ``totals`` says: the labelled rows that each sample stands for.
    """
    if not all(texts):
        return (totals[1] + 0.5) / (sum(totals) + 1)
    rng = np.random.default_rng(SEED)
    net = Network(rng)
    data = [(_bytes(t), c) for c in (0, 1) for t in texts[c]]
    share = [totals[c] / len(texts[c]) for c in (0, 1)]
    scale = len(data) / sum(totals)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    total_steps = EPOCHS * -(-len(data) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for i in range(0, len(order), BATCH):
            g = {k: np.zeros_like(v) for k, v in net.p.items()}
            for j in order[i : i + BATCH]:
                raw, c = data[j]
                net.gradients(raw, float(c), share[c] * scale / BATCH, g)
            step += 1
            rate = RATE * (1 - 0.9 * step / total_steps)
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return net


def probability(net: Network | float, text: str | None) -> float:
    if isinstance(net, float):
        return net
    return float(1 / (1 + np.exp(-np.clip(net.logit(_bytes(text)), -30, 30))))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Network | float:
    """A network from ``labels`` (doc_id, quality) of rows that are not held out.

    At most ``fit_docs`` documents of each class, by a hash of doc_id, are read to the driver, by a
    broadcast of those ids; it trains in numpy for some CPU seconds, whatever the tables' size. Of
    rows that repeat a doc_id, one text is read, the least.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    texts = []
    for c in (0, 1):
        chosen = known.where(F.col("y") == c).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id", "left_semi")
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
        texts.append([r.text for r in sorted(rows.collect(), key=lambda r: r.doc_id)])
    return train(tuple(texts), (totals.get(0, 0), totals.get(1, 0)))


def _score(batches: Iterator[pa.RecordBatch], net: Network | float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [probability(net, t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Whole texts are scored in place, without a shuffle. Null and empty texts are one window of
    zero bytes. Without labels of both classes all scores are the smoothed share of label 1.
    held_out of a null id is null. Repeated rows give repeated results; an empty table gives none.
    Other columns of ``docs`` are not read.
    """
    shared = spark.sparkContext.broadcast(fit(spark, docs, labels))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.mapInArrow(lambda it: _score(it, shared.value), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
