"""Token ids as directly addressable codes.

An id is split into chunks of 8 bits. Level 0 holds the lowest chunk of every id; a bitmap says
which ids continue, and level k + 1 holds the next chunk of just those, in order. A directory of
ranks (set bits before each block of bitmap) finds an id's chunk on the next level, so any token is
read with a few lookups and no block is decoded. Ids go out in segments of whole documents; a
segment is one binary value of a row, so Spark's committers make the files safe to write again.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEPT, Scratch, small

MAGIC, CHUNK = b"DAC1", 8
#: Bits of bitmap between two entries of a rank directory.
RANK_BITS = 512
#: A segment ends with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 18
#: Characters of text that are encoded together.
ENCODE_CHARS = 1 << 20
#: Words whose ids a worker keeps.
KNOWN_WORDS = 1 << 19
END_ID = 0

_DOUBLE = re.compile(r"\s\s")
#: Words of characters whose kind is beyond doubt, and how byte-level BPE cuts them, with a space before.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-/:-@\[-`{-~"
_SURE = re.compile(f"[{_LETTERS}0-9{_SIGNS}]+")
_PIECES = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+")
_ENCODERS: dict = {}
KEPT.append(_ENCODERS)


def encode_levels(ids: np.ndarray) -> bytes:
    """Levels of an id sequence: number of ids, then chunks, bitmap and ranks of each level."""
    out, rest = [struct.pack("<Q", len(ids))], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little").tobytes()
        per = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_BITS), dtype=np.uint64) if len(rest) else np.zeros(0, np.uint64)
        ranks = (np.cumsum(per) - per).astype(np.uint32).tobytes()
        out += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), bitmap, ranks]
        rest = more[goes_on]
        if not len(rest):
            return b"".join(out)


class Levels:
    """Reader of ``encode_levels``: ``levels[i]`` is one id, ``all()`` every id."""

    def __init__(self, blob: bytes, at: int = 0):
        (self.n,) = struct.unpack_from("<Q", blob, at)
        at += 8
        self.levels = []
        while at < len(blob):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            chunks = np.frombuffer(blob, np.uint8, n, at)
            at += n
            bitmap = np.frombuffer(blob, np.uint8, -(-n // 8), at)
            at += -(-n // 8)
            ranks = np.frombuffer(blob, np.uint32, -(-n // RANK_BITS), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            first = i // RANK_BITS * RANK_BITS
            bits = int.from_bytes(bitmap[first >> 3 : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - first)) - 1)
            i, shift = int(ranks[i // RANK_BITS]) + bits.bit_count(), shift + CHUNK
        return value

    def all(self) -> np.ndarray:
        value = np.zeros(self.n, np.uint32)
        at = np.arange(self.n)
        for shift, (chunks, bitmap, _) in enumerate(self.levels):
            value[at] |= chunks.astype(np.uint32) << np.uint32(CHUNK * shift)
            at = at[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return value


def pack_segment(doc_ids: list[int | None], parts: list[np.ndarray]) -> bytes:
    """A self-contained segment: magic, documents, their ids and lengths, the levels of all ids."""
    sizes = np.array([len(p) for p in parts], np.uint64)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], np.int64)
    return b"".join([MAGIC, struct.pack("<Q", len(doc_ids)), known.tobytes(), ids.tobytes(), sizes.tobytes(), encode_levels(np.concatenate(parts))])


def open_segment(blob: bytes) -> tuple[list[int | None], np.ndarray, Levels]:
    """Document ids, start of each document's ids (and the end of all), levels."""
    if blob[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    (n,) = struct.unpack_from("<Q", blob, 4)
    known = np.frombuffer(blob, np.uint8, n, 12)
    ids = np.frombuffer(blob, np.int64, n, 12 + n)
    sizes = np.frombuffer(blob, np.uint64, n, 12 + 9 * n)
    return [int(d) if k else None for d, k in zip(ids, known, strict=True)], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), Levels(blob, 12 + 17 * n)


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE names each byte: its own if it is visible, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)}.difference(seen)))}


class _Words(dict):
    """Ids, as bytes, of words with ``space`` before them; a word's are found when it is first asked for.

    A word of sure characters is cut into pieces here, and the library's model gets each of them; of
    other words the library gets the whole. If there are too many, all are forgotten.
    """

    def __init__(self, tok, space: str):
        self.tok, self.space, self.cut, self.names = tok, space, tok.model.tokenize, _byte_letters()
        self.mark = self.names[32] if space else ""
        self.tails: dict[str, bytes] = {"": b""}

    def _ids(self, piece: str) -> bytes:
        named = piece.encode().decode("latin-1").translate(self.names)
        return array("I", [t.id for t in self.cut(named)]).tobytes()

    def _letters(self, core: str) -> bytes:
        # ASCII letters are named by themselves.
        return array("I", [t.id for t in self.cut(self.mark + core)]).tobytes() if core.isascii() else self._ids(self.space + core)

    def __missing__(self, word: str) -> bytes:
        if len(self) + len(self.tails) >= KNOWN_WORDS:
            self.clear()
            self.tails = {"": b""}
        core = word.rstrip(punctuation)
        if core.isalpha() and (core.isascii() or max(core) <= "ɏ"):
            tail = word[len(core) :]
            if tail not in self.tails:
                self.tails[tail] = self._ids(tail)
            raw = (tail and self.get(core) or self._letters(core)) + self.tails[tail]
        elif _SURE.fullmatch(word):
            raw = b"".join(map(self._ids, _PIECES.findall(self.space + word)))
        else:
            raw = array("I", self.tok.encode(self.space + word, add_special_tokens=False).ids).tobytes()
        self[word] = raw
        return raw


class Encoder:
    """The tokenizer at ``path``, as the library applies it: a special token's own text is that token.

    Byte-level BPE cuts a text into pieces before it merges, and a lone line feed, or a space
    between two other characters, always starts a piece. So the ids of a text without double white
    space are those of its words, with the space before them, and of its line feeds. Words' ids are
    kept as bytes; texts with double white space, or with the text of an added token in them, are
    encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.feed = self.whole(["\n"])[0]
        #: Ids of words as they are, and of words after a space.
        self.bare, self.spaced = _Words(self.tok, ""), _Words(self.tok, " ")

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 4096):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return out

    def _apart(self, text: str) -> bool:
        return _DOUBLE.search(text) is not None or any(t in text for t in self.added)

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; those that are encoded whole go to the library together."""
        apart = [bool(t) and self._apart(t) for t in texts]
        whole = iter(self.whole([t for t, a in zip(texts, apart, strict=True) if a]))
        first, later = self.bare.__getitem__, self.spaced.__getitem__
        for text, a in zip(texts, apart, strict=True):
            if a:
                raw = next(whole)
            else:
                lines = [x.split(" ") for x in (text or "").split("\n")]
                raw = self.feed.join([first(x[0]) + b"".join(map(later, x[1:])) for x in lines])
            yield np.frombuffer(raw, np.uint32)


def encoded(texts: list[str | None], path: str) -> Iterator[np.ndarray]:
    """Ids of each text, by one encoder a worker, about ENCODE_CHARS of text at a time."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text or "")
        if size >= ENCODE_CHARS:
            yield from _ENCODERS[path].ids(some)
            some, size = [], 0
    yield from _ENCODERS[path].ids(some)


def _segments(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    part, seg, start = TaskContext.get().partitionId(), 0, 0
    docs, parts, size = [], [], 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": [part], "segment": [seg], "part_start": [start], "n_docs": [len(docs)], "n_ids": [size], "codes": [pack_segment(docs, parts)]}, _SEGMENT)

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for doc, got in zip(ids, encoded(batch.column("text").to_pylist(), path), strict=True):
            docs.append(doc)
            parts.append(np.append(got, np.uint32(END_ID)))
            size += len(got) + 1
            if size >= SEGMENT_IDS:
                yield close()
                seg, start, docs, parts, size = seg + 1, start + size, [], [], 0
    if docs:
        yield close()


_SEGMENT = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("part_start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("codes", pa.binary())])


def write_ids(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str) -> None:
    """Write the ids of ``docs`` (doc_id, text) under ``path``, in ascending doc_id order.

    One shuffle, by ranges of doc_id; texts are encoded in order after it, a segment at a time. A
    null text is empty: it has the end id alone. A null doc_id comes first. Rows with equal doc_id
    go by their text. An empty table writes no segment. A document lies in one segment, which is a
    value of under 2 GB: ids of texts of some 600 MB and more may not fit, and the write fails.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = slim.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(lambda it: _segments(it, tokenizer), "part int, segment long, part_start long, n_docs long, n_ids long, codes binary").write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, at, blob in zip(batch.column("base").to_pylist(), batch.column("part_start").to_pylist(), batch.column("codes"), strict=True):
            docs, starts, levels = open_segment(blob.as_py())
            ids = levels.all()
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts[:-1] + (before + at)), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments under ``path`` with ``base``: ids in all parts before theirs.

    A part is one task of the writer. One row a part is summed up over all parts, so there are as
    many as the writer had tasks, whatever they held; they go out by broadcast if they are few.
    """
    schema = "part int, segment long, part_start long, n_docs long, n_ids long, codes binary"
    found = spark.read.schema(schema).parquet(path)
    parts = found.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return found.join(small(base), "part")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    return segments(spark, path).select("base", "part_start", "codes").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at a global position: one segment is fetched, and a few bytes of it are looked at."""
    first = F.col("base") + F.col("part_start")
    row = segments(spark, path).where((first <= position) & (first + F.col("n_ids") > position)).select(first.alias("first"), "codes").first()
    if row is None:
        raise IndexError(position)
    return open_segment(row.codes)[2][position - row.first]


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to the shared scratch folder and describe the documents from what is read."""
    path = Scratch(spark, "tokens").path("ids")
    write_ids(spark, docs, tokenizer, path)
    return read_documents(spark, path)
