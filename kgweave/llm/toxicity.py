"""Toxicity by class-conditional Kneser-Ney bigram models.

Two bigram models, of toxic and of ordinary texts, back off to unigram counts of their class and
from there to one distribution that both share: in how many different contexts a word was seen in
either class. So an expression that is rare or new to one class costs both nearly the same. The
score is a calibrated logistic of two inputs. One is the difference of the log-likelihoods, each
normalised by the length. It alone tells texts that are toxic throughout; in a long text it drowns
in what the language or subject is worth. So the other is what stands out: each word's ratio over
the text's median, small excesses counted as none, over the root of the length, with which the
noise of a sum of words grows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release, small

#: Words seen less often in them share one symbol; bigrams seen less often are left to backoff.
LEAST_WORD, LEAST_BIGRAM = 2, 2
#: Discounts of stems, words and bigrams, in standard errors of a count.
DISCOUNTS = (2.5, 2.5, 6.0)
#: A rare word backs off to the words that start with the same so many bytes.
STEM = 4
#: Log-likelihood ratios that are nearer to the text's median than this count as the median.
SLACK = 1.3
FOLDS = 5
#: Trigrams that a task holds to make them distinct before a shuffle; words whose symbols a worker keeps.
HELD, KNOWN_WORDS = 1 << 20, 1 << 18

_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


def _less(n: np.ndarray, discount: float) -> np.ndarray:
    return np.maximum(n - discount * np.sqrt(n), 0)


def _discounted(n: np.ndarray, discount: float, lower: np.ndarray) -> np.ndarray:
    """Counts less the discount as probabilities, what was taken off spread by ``lower``."""
    kept = _less(n, discount) / max(1.0, n.sum())
    return kept + (1 - kept.sum()) * lower


class Model:
    """From texts at hand, as the definition says: word symbols, bigram probabilities above backoff, and backoff weights, for two classes."""

    shift = 21

    def __init__(self, texts: tuple[list[list[bytes]], list[list[bytes]]]):
        seen = Counter(w for docs in texts for d in docs for w in d)
        stems = sorted({w[:STEM] for w in seen})
        self.stems = {s: i + 1 for i, s in enumerate(stems)}
        # Words without a symbol of their own share that of their stem; 0: no known stem; 1: start of a text.
        kept = sorted(w for w, n in seen.items() if n >= LEAST_WORD)
        self.symbols = {w: i + 2 for i, w in enumerate(kept)}
        self.n_words = len(kept) + 2
        size = self.n_words + len(stems) + 1
        stem_of = np.zeros(size, np.int64)
        stem_of[2 : self.n_words] = [self.stems[w[:STEM]] for w in kept]
        stem_of[self.n_words :] = np.arange(len(stems) + 1)
        counts = []
        for docs in texts:
            pairs = [np.zeros(0, np.int64)]
            for d in docs:
                ids = self.ids(d)
                pairs.append(np.concatenate([ids[:1], ids[:-2]]) << 42 | ids[:-1] << 21 | ids[1:])
            # A bigram counts once for each different word before it, so copies add nothing.
            counts.append(np.unique(np.unique(np.concatenate(pairs)) & (1 << 42) - 1, return_counts=True))
        every = np.unique(np.concatenate([k for k, _ in counts]))
        # In how many contexts was a word seen: of a class, and of both for what they share.
        contexts = [np.bincount(k & (1 << 21) - 1, minlength=size).astype(float) for k, _ in counts]
        shared = np.bincount(every & (1 << 21) - 1, minlength=size).astype(float)
        by_stem = np.bincount(stem_of, shared, len(stems) + 1)
        base = (by_stem + 1) / (by_stem + 1).sum()
        within = (shared + 1) / (by_stem + np.bincount(stem_of, minlength=len(stems) + 1))[stem_of]
        total = sum((np.bincount(np.searchsorted(every, k), n, len(every)) for k, n in counts), np.zeros(len(every)))
        self.keys = every[total >= LEAST_BIGRAM]
        self.above, self.backoff, self.single = [], [], []
        for (keys, n), c in zip(counts, contexts, strict=True):
            stem = _discounted(np.bincount(stem_of, c, len(stems) + 1), DISCOUNTS[0], base)
            self.single.append(_discounted(c, DISCOUNTS[1], stem[stem_of] * within))
            first = keys >> 21
            by_first = np.bincount(first, n, size)
            at = np.searchsorted(self.keys, keys)
            held = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
            p = np.zeros(len(self.keys))
            p[at[held]] = _less(n[held], DISCOUNTS[2]) / by_first[first[held]]
            self.above.append(p)
            self.backoff.append(1 - np.bincount(self.keys >> 21, p, size))

    def ids(self, doc: list[bytes]) -> np.ndarray:
        word, stem, n = self.symbols.get, self.stems.get, self.n_words
        return np.array([1, *[word(w) or n + stem(w[:STEM], 0) for w in doc]], np.int64)

    def ratios(self, doc: list[bytes]) -> tuple[float, float]:
        """Log-likelihood of class 1 less that of class 0, each over the length; and what of it is
        beyond SLACK of the text's median, over the root of the length. Zeros for no words."""
        if not doc:
            return 0.0, 0.0
        ids = self.ids(doc)
        first, second = ids[:-1], ids[1:]
        if len(self.keys):
            key = first << self.shift | second
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
        logs = []
        for c in (0, 1):
            p = self.backoff[c][first] * self.single[c][second]
            if len(self.keys):
                p = p + np.where(hit, self.above[c][at], 0.0)
            logs.append(np.log(p))
        each = logs[1] - logs[0]
        over = each - np.median(each)
        return float(each.mean()), float((over - np.clip(over, -SLACK, SLACK)).sum() / np.sqrt(len(over)))


def word_key(word: bytes) -> int:
    """64 bits of a word, as a signed number: its stem, and a hash. 0 is the start of a text."""
    key = int.from_bytes(word[:STEM].ljust(STEM, b"\0"), "big") << 32 | zlib.crc32(word)
    return key - (1 << 64) if key >> 63 else key


class Keys(dict):
    """Keys of words, kept for the next time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        key = self[word] = word_key(word)
        return key


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of the words of texts, distinct among HELD of them: the key of the last word, then
    packed CRC-32 of the middle word, 30 bits of that of the first word, and class and half; and two
    bits of the middle word, over which the trigrams of a frequent word are dealt."""
    release()
    keys, parts, size = Keys(), [], 0

    def distinct() -> pa.RecordBatch:
        second, rest = np.concatenate(parts, 1)
        order = np.lexsort((rest, second))
        second, rest = second[order], rest[order]
        new = np.concatenate([[True], (second[1:] != second[:-1]) | (rest[1:] != rest[:-1])])
        second, rest = second[new], rest[new]
        return pa.RecordBatch.from_arrays([pa.array(second), pa.array((rest.view(np.uint64) >> np.uint64(62)).astype(np.int32)), pa.array(rest)], ["second", "salt", "rest"])

    for batch in batches:
        for text, part in zip(batch.column("text"), batch.column("part").to_pylist(), strict=True):
            ids = np.array([0, *map(keys.__getitem__, words(text.as_py()))], np.int64)
            for i in range(0, len(ids) - 1, HELD):
                first, second = ids[i : i + HELD], ids[i + 1 : i + 1 + HELD]
                first = first[: len(second)]
                prev = np.concatenate([ids[max(i - 1, 0) : i or 1], first[:-1]])
                parts.append(np.stack([second, first << 32 | (prev & (1 << 30) - 1) << 2 | part]))
                size += len(second)
                if size >= HELD:
                    yield distinct()
                    parts, size = [], 0
    if parts:
        yield distinct()


#: Classes and halves: the bit of one is class * 2 + half; the models of a half, the other, and both.
_PARTS = ((1, 2, 3), (4, 8, 12))
_SUMS = [f"n{c}{m}" for c in (0, 1) for m in range(3)]


def _evidence(trigrams: DataFrame, scratch: Scratch) -> DataFrame:
    """What the models need of all trigrams: rows (kind, a, b, sums, shared sums).

    Kind 0: a word of key a as second of a bigram, in how many contexts; kind 1: a word of CRC-32 a as
    first, of how many trigrams; kind 2: a bigram (a, b) of a CRC-32 and a key that a discount leaves
    something of, its different words before. Rows of a word meet in four tasks, not in one.
    """
    bit = F.call_function("shiftleft", F.lit(1), F.col("rest").bitwiseAND(3).cast("int"))
    x = trigrams.repartition("second", "salt").select("second", "salt", F.shiftrightunsigned("rest", 32).alias("first"), F.shiftright("rest", 2).alias("both"), bit.alias("bit"))
    x = x.groupBy("second", "salt", "first", "both").agg(F.bit_or("bit").alias("mask"))
    has = [F.count_if(F.col("mask").bitwiseAND(_PARTS[c][m]) != 0).alias(f"n{c}{m}") for c in (0, 1) for m in range(3)]
    pairs = x.groupBy("second", "salt", "first").agg(*has)
    least = int(DISCOUNTS[2] ** 2)
    once = lambda n: (F.col(n) > 0).cast("long").alias(n)
    none = F.lit(0).cast("long")
    either = [(F.col(f"n0{m}") + F.col(f"n1{m}") > 0).cast("long").alias(f"s{m}") for m in range(3)]
    rows = [
        F.struct(F.lit(0).alias("kind"), F.col("second").alias("a"), none.alias("b"), *map(once, _SUMS), *either),
        F.struct(F.lit(1).alias("kind"), F.col("first").alias("a"), none.alias("b"), *_SUMS, *[none.alias(f"s{m}") for m in range(3)]),
        F.when(reduce(or_, [F.col(n) > least for n in _SUMS]), F.struct(F.lit(2).alias("kind"), F.col("first").alias("a"), F.col("second").alias("b"), *_SUMS, *[none.alias(f"s{m}") for m in range(3)])),
    ]
    each = pairs.select(F.explode(F.array(*rows)).alias("r")).where("r is not null").select("r.*")
    return scratch.table(each.groupBy("kind", "a", "b").agg(*[F.sum(c).alias(c) for c in (*_SUMS, "s0", "s1", "s2")]), "evidence")


class Counted(Model):
    """The model from counts of all texts, of which just those are held that a discount leaves something of.

    A word or stem of fewer is as likely in both classes but for what backs off, so its ratio is that
    of a word never seen: ratios are those of all counts. The class with more trigrams has its counts
    scaled down to the other's number, so that discounts leave both about as much to back off.
    """

    shift = 31

    def __init__(self, found: list, stem_rows: list, totals: dict, m: int):
        names = [f"n0{m}", f"n1{m}"]
        total = np.array([totals["trigrams"][m, c] for c in (0, 1)], float)
        scale = total.min() / np.maximum(total, 1)
        by_word = {r.a: [r[names[0]], r[names[1]], r[f"s{m}"]] for r in found if r.kind == 0}
        firsts = {r.a: [r[n] for n in names] for r in found if r.kind == 1}
        if 0 in firsts:  # the start of a text, which is never second
            by_word[0] = [0, 0, 0]
        stem_keys = sorted(r.stem for r in stem_rows)
        at_stem = {r.stem: r for r in stem_rows}
        self.stems = {k: i + 1 for i, k in enumerate(stem_keys)}
        some = sorted(by_word)
        self.symbols, self.n_words = {k: i + 2 for i, k in enumerate(some)}, len(some) + 2
        size = self.n_words + len(stem_keys) + 1
        stem_of = np.zeros(size, np.int64)
        stem_of[2 : self.n_words] = [self.stems.get(k >> 32, 0) for k in some]
        stem_of[self.n_words :] = np.arange(len(stem_keys) + 1)
        shared_stem = np.array([0, *[at_stem[k][f"s{m}"] for k in stem_keys]], float)
        base = (shared_stem + 1) / (totals["shared"][m] + totals["stems"] + 1)
        n_stem = np.array([1, *[at_stem[k].words + 1 for k in stem_keys]], float)
        shared = np.zeros(size)
        shared[2 : self.n_words] = [by_word[k][2] for k in some]
        within = (shared + 1) / (shared_stem + n_stem)[stem_of]
        by_crc = {k & (1 << 32) - 1: i for k, i in self.symbols.items()}
        rows = [(by_crc[r.a], self.symbols[r.b], r) for r in found if r.kind == 2]
        rows.sort(key=lambda x: x[:2])
        first = np.array([x[0] for x in rows], np.int64)
        self.keys = first << self.shift | np.array([x[1] for x in rows], np.int64)
        self.above, self.backoff, self.single = [], [], []
        for c in (0, 1):
            per = max(1.0, totals["contexts"][m, c] * scale[c])
            stem = _less(np.array([0, *[at_stem[k][names[c]] for k in stem_keys]], float) * scale[c], DISCOUNTS[0]) / per
            stem = stem + (1 - stem.sum()) * base
            word = np.zeros(size)
            word[2 : self.n_words] = [by_word[k][c] for k in some]
            word = _less(word * scale[c], DISCOUNTS[1]) / per
            self.single.append(word + (1 - word.sum()) * stem[stem_of] * within)
            n = np.array([x[2][names[c]] for x in rows], float) * scale[c]
            follow = np.array([firsts[x[2].a][c] for x in rows], float) * scale[c]
            p = _less(n, DISCOUNTS[2]) / np.maximum(follow, 1e-9)
            self.above.append(p)
            self.backoff.append(1 - np.bincount(first, p, size))
        self.known: dict[bytes, int] = {}

    def _symbol(self, word: bytes) -> int:
        key = word_key(word)
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        i = self.known[word] = self.symbols.get(key) or self.n_words + self.stems.get(key >> 32, 0)
        return i

    def ids(self, doc: list[bytes]) -> np.ndarray:
        known, symbol = self.known.get, self._symbol
        return np.array([self.symbols.get(0, 1), *[known(w) or symbol(w) for w in doc]], np.int64)


class Scorer:
    """A model and its calibration. Without texts of both classes every score is the prior."""

    def __init__(self, model: Model | None, weights: np.ndarray):
        self.model, self.weights = model, weights

    def score(self, text: str | None) -> float:
        x = self.model.ratios(words(text)) if self.model else (0.0, 0.0)
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, (*x, 1.0)), -30, 30))))


def models(trigrams: DataFrame, scratch: Scratch) -> list[Counted]:
    """The models of one half, of the other, and of all texts."""
    every = _evidence(trigrams, scratch)
    words_ = every.where("kind = 0")
    t = {(r.kind): r for r in every.where("kind < 2").groupBy("kind").agg(*[F.sum(n).alias(n) for n in (*_SUMS, "s0", "s1", "s2")]).collect()}
    of = lambda kind, n: t[kind][n] if kind in t else 0
    stems = scratch.table(words_.groupBy(F.shiftright("a", 32).alias("stem")).agg(F.count("*").alias("words"), *[F.sum(n).alias(n) for n in (*_SUMS, "s0", "s1", "s2")]), "stems")
    totals = {
        "contexts": {(m, c): of(0, f"n{c}{m}") for c in (0, 1) for m in range(3)},
        "trigrams": {(m, c): of(1, f"n{c}{m}") for c in (0, 1) for m in range(3)},
        "shared": [of(0, f"s{m}") for m in range(3)],
        "stems": stems.count(),
    }
    kept = lambda d: reduce(or_, [F.col(n) > int(d**2) for n in _SUMS])
    pairs = every.where("kind = 2")
    crcs = small(pairs.select(F.col("a").alias("crc")).distinct())
    heads = every.where("kind = 1").join(crcs, F.col("a") == F.col("crc"), "left_semi")
    lone = words_.where(~kept(DISCOUNTS[1]))
    held = lone.join(crcs, F.col("a").bitwiseAND(0xFFFFFFFF) == F.col("crc"), "left_semi").union(lone.join(small(pairs.select(F.col("b").alias("key")).distinct()), F.col("a") == F.col("key"), "left_semi"))
    found = words_.where(kept(DISCOUNTS[1])).union(held).union(heads).union(pairs).collect()
    stem_rows = stems.where(kept(DISCOUNTS[0])).collect()
    return [Counted(found, stem_rows, totals, m) for m in range(3)]


def _features(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        parts = batch.column("part").to_pylist()
        # Each half is scored by the model of the other.
        x = [shared.value[1 - p % 2].ratios(words(t.as_py())) for t, p in zip(batch.column("text"), parts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), pa.array([float(p // 2) for p in parts])], ["a", "b", "y"])


def calibrated(rows: DataFrame) -> np.ndarray:
    """Slopes and, last, offset of a logistic of (a, b, y), by Newton steps over sums of all rows."""
    z, beta = [F.col("a"), F.col("b"), F.lit(1.0)], np.zeros(3)
    at = [(i, j) for i in range(3) for j in range(i, 3)]
    for _ in range(60):
        x = sum((float(w) * c for w, c in zip(beta, z, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))
        s = rows.withColumn("p", p).agg(*[F.sum((F.col("p") - F.col("y")) * c).alias(f"g{i}") for i, c in enumerate(z)], *[F.sum(F.col("p") * (1 - F.col("p")) * z[i] * z[j]).alias(f"h{i}{j}") for i, j in at]).first()
        g, h = np.array([s[f"g{i}"] for i in range(3)]) + 1e-3 * beta, 1e-3 * np.eye(3)
        for i, j in at:
            h[i, j] += s[f"h{i}{j}"]
            h[j, i] = h[i, j]
        step = np.linalg.solve(h, g)
        beta -= np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-7:
            break
    # Sums of tasks come in any order; what they leave open is far behind these places.
    return np.round(beta, 9)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Scorer:
    """A scorer from all ``labels`` (doc_id, toxic) of rows that are not held out, and all their texts.

    Trigrams of texts are made distinct, counted and summed on executors; what discounts leave something
    of goes to the driver. Null labels don't count. Rows that repeat a doc_id are texts of their own;
    copies add no counts.
    """
    scratch = Scratch(spark, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    known = scratch.table(known.select("doc_id", (F.col("y") * 2 + F.pmod(F.xxhash64("doc_id"), F.lit(2))).cast("int").alias("part")), "known")
    totals = {r.y: r.n for r in known.groupBy(F.expr("part div 2").alias("y")).agg(F.count("*").alias("n")).collect()}
    prior = np.array([0.0, 0.0, np.log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5))])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(small(known), "doc_id").select("part", "text")
    halves = {r.part for r in texts.select("part").distinct().collect()} if len(totals) == 2 else set()
    if len(halves) < 4:
        return Scorer(None, prior)
    all_ = models(texts.mapInArrow(_trigrams, "second long, salt int, rest long"), scratch)
    shared = spark.sparkContext.broadcast(all_[:2])
    rows = scratch.table(texts.mapInArrow(lambda it: _features(it, shared), "a double, b double, y double"), "features")
    out = Scorer(all_[2], calibrated(rows))
    shared.unpersist()
    return out


def _score(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        scores = [scorer.score(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Whole texts are scored in place, without a shuffle; the model, of what has evidence in it, goes
    out as a broadcast. Null, empty and wordless texts get the score of ratios of 0. Without labels
    of both classes all scores are the smoothed share of label 1. held_out of a null id is null.
    Texts of any length are scored whole. Repeated rows give repeated results with one score; an
    empty table gives none. Other columns of ``docs`` are not read.
    """
    shared = spark.sparkContext.broadcast(fit(spark, docs, labels))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.mapInArrow(lambda it: _score(it, shared.value), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a score under 0.5, with their columns.

    Only texts go to Python, and one truth value a row comes back. Null and empty texts stay or go
    by the score of ratios of 0, repeated rows together. An empty table stays empty. Columns of any
    name pass as they are.
    """
    shared = spark.sparkContext.broadcast(fit(spark, docs, labels))

    @F.arrow_udf("boolean")
    def fine(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for some in texts:
            yield pa.array([shared.value.score(t.as_py()) < 0.5 for t in some], pa.bool_())

    return docs.where(fine(F.col("text").cast("string")))
