"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Each word of the benchmark is one symbol, so the automaton has at most ``window`` states a window
and its match positions are word positions. A document is scanned once; only where something
matched are word positions mapped back to character offsets of the original text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release

WINDOW = 10
#: Words of benchmark text in one automaton (about 60 bytes a state, ``window`` states a word).
#: A larger benchmark is cut into blocks of items, and documents pass one automaton after another.
AUTOMATON_WORDS = 200_000

#: ASCII letters to lower case, other ASCII that is no digit to a space; bytes over 127 stay.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_SCHEMA = pa.list_(pa.struct([("item", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


class Automaton:
    """Windows of items as words of symbols; one code point stands for one benchmark word."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        import ahocorasick

        self.symbols: dict[bytes, str] = {}
        owners: dict[str, set] = defaultdict(set)
        for item, text in items:
            coded = "".join(self._symbol(w) for w in words_of(text))
            for i in range(max(1, len(coded) - window + 1) if coded else 0):
                owners[coded[i : i + window]].add(item)
        self.machine = ahocorasick.Automaton()
        for key, who in owners.items():
            self.machine.add_word(key, (len(key), tuple(who)))
        self.machine.make_automaton()
        self.empty = not owners

    def _symbol(self, word: bytes) -> str:
        s = self.symbols.get(word)
        if s is None:
            n = len(self.symbols) + 2
            s = self.symbols[word] = chr(n if n < 0xD800 else n + 0x800)
        return s

    def find(self, words: list[bytes]) -> list[tuple[str | None, int, int]]:
        """(item, first word, last word) with overlapping or touching windows of an item merged."""
        if self.empty or not words:
            return []
        get = self.symbols.get
        open_: dict = {}
        out = []
        for end, (length, who) in self.machine.iter("".join([get(w, "\x01") for w in words])):
            first = end - length + 1
            for item in who:
                run = open_.get(item)
                if run and first <= run[1] + 1:
                    run[0], run[1] = min(run[0], first), end
                else:
                    if run:
                        out.append((item, *run))
                    open_[item] = [first, end]
        return out + [(item, *run) for item, run in open_.items()]


def _scan(batches: Iterator[pa.RecordBatch], items: list, window: int, first: bool) -> Iterator[pa.RecordBatch]:
    machine = Automaton(items, window)
    for batch in batches:
        found, counts = [], []
        earlier = None if first else batch.column("spans").to_pylist()
        for k, text in enumerate(batch.column("text")):
            words = words_of(text.as_py())
            counts.append(len(words))
            found.append((earlier[k] if earlier else []) + [{"item": i, "first": a, "last": b} for i, a, b in machine.find(words)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(counts, pa.int64()), pa.array(found, _SCHEMA)], ["doc_id", "text", "n_words", "spans"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hit words, items and character spans from the word spans of all blocks."""
    for batch in batches:
        hits, items, spans = [], [], []
        for text, found in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            n, end = 0, -1
            for a, b in sorted((x["first"], x["last"]) for x in found):
                n += max(0, b - max(a, end + 1) + 1)
                end = max(end, b)
            hits.append(n)
            items.append(sorted({x["item"] for x in found if x["item"] is not None}))
            at = [m.span() for m in _WORD.finditer(text.as_py())] if found else []
            spans.append(sorted(({"item": x["item"], "first": at[x["first"]][0], "last": at[x["last"]][1]} for x in found), key=lambda s: (s["first"], s["last"], s["item"] or "")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SCHEMA)], ["doc_id", "n_words", "n_hit", "items", "spans"]
        )


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """Blocks of items with at most ``limit`` words each; longer items make a block alone."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where("text is not null").distinct().orderBy("i", "text").toLocalIterator()
    for item, text in rows:
        n = len(words_of(text))
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, items, spans.

    items: sorted ids (as strings) of benchmark items of which a window occurs; spans: item, first
    and last, character offsets [first, last) in the original text. A null text has no words. An
    item with fewer words than a window is one window; one without words, or null, has none. Items
    with equal ids count as one; an item with a null id marks hits but is not listed. Repeated
    document rows give repeated results. An empty benchmark hits nothing. No shuffle: documents
    are scanned in place, and a benchmark past ``automaton_words`` takes one more scan a block.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    span = "array<struct<item:string,first:long,last:long>>"
    for k, block in enumerate(_blocks(benchmark, automaton_words)):
        shared = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(lambda it, shared=shared, first=k == 0: _scan(it, shared.value, window, first), f"doc_id long, text string, n_words long, spans {span}")
    return out.mapInArrow(_finish, f"doc_id long, n_words long, n_hit long, items array<string>, spans {span}")


def leak_digest(leaks: DataFrame) -> DataFrame:
    return leaks.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_leaked(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without a hit word, with their columns; scanned in place, no join.

    Only texts go to Python, and one truth value a row comes back. Null and empty texts stay; repeated
    rows stay or go together; an empty table stays empty. Columns of any name pass as they are.
    """
    for block in _blocks(benchmark, AUTOMATON_WORDS):
        docs = docs.where(_clean(spark.sparkContext.broadcast(block))(F.col("text").cast("string")))
    return docs


def _clean(shared):
    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        machine = Automaton(shared.value, WINDOW)
        for some in texts:
            yield pa.array([not machine.find(words_of(t.as_py())) for t in some], pa.bool_())

    return clean
