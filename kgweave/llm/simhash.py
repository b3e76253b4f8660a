"""SimHash near-duplicates: a binary trie self-join with an error budget.

Pairs within a budget of e differing bits agree exactly on one of e + 1 blocks of bits. So the trie
is built e + 1 times, each time with another block on top, where no error is allowed; every value
of that block is then a subtrie of its own, joined with itself. Subtries with many fingerprints
are cut again: the bits below are dealt into e + 1 blocks, one of which must agree too. In a
subtrie, pairs of nodes are traversed together bit by bit, differing bits are added up, and a pair
beyond the budget is cut.

``near_duplicates`` links fingerprints by their distance alone. ``similar_groups`` links texts by the
exact similarity of their shingle sets. The trie join gives it the first candidates; fingerprints of
texts just over the bound differ in too many bits for that, so texts that it leaves apart are
candidates too where they share a band of min-hashes. Not all pairs of a band are: its nodes meet
the one in the midst of it, and what that leaves apart are pairs whose sets share one of their
rarest shingles, as sets of that similarity must (prefix filter).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batches_of, packed, release, small, unpacked
from .components import components

BITS, SEED = 64, 42
#: Subtries with more fingerprints are cut by one more exact block.
SUBTRIE = 1024
#: Node pairs held at once in a task.
PAIRS = 1 << 17
#: Bands of min-hashes and min-hashes a band: a pair of similarity s shares no band with a chance
#: of (1 - s ** ROWS) ** BANDS, which is 7e-5 at 0.8, whatever the length of the texts.
BANDS, ROWS = 24, 5
#: Rows with texts or shingle sets that Python gets at once.
WIDE_ROWS = 512


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of every n-word shingle; of the whole sequence if it is shorter, none if it is empty."""
    import xxhash

    if len(words) <= n:
        grams = [b" ".join(words)] if words else []
    else:
        grams = words if n == 1 else list(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64, len(grams))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, n: int = 3) -> int:
    """Bits set in over half of the shingles' XXH64 values; 0 for a text without words."""
    return _majority(_hashes(_words(text), n))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The hashes of the different n-word shingles, sorted."""
    return np.unique(_hashes(_words(text), n))


_MIX = np.random.default_rng(SEED).integers(0, 2**63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(shingle: np.ndarray) -> np.ndarray:
    """A hash of each band of min-hashes of a set; two sets share a band if all of its ROWS agree."""
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingle), 1 << 10):
        x = shingle[None, i : i + (1 << 10)] * _MIX[:, :1]
        x ^= x >> np.uint64(29)
        x *= _MIX[:, 1:]
        np.minimum(least, x.min(1), out=least)
    return np.array([xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) for i in range(BANDS)], np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _fingerprints(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.fromiter((fingerprint(t.as_py(), n) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row of ``docs`` (doc_id, text)."""
    return _slim(docs).mapInArrow(lambda it: _fingerprints(it, n), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(fixed: int, budget: int) -> list[int]:
    """Masks that fix, besides ``fixed``, one of budget + 1 blocks of the other bits."""
    free = [b for b in reversed(range(BITS)) if not fixed >> b & 1]
    cuts = [round(i * len(free) / (budget + 1)) for i in range(budget + 2)]
    return [fixed | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _keyed(points: DataFrame, masks: list[int]) -> DataFrame:
    """A row of each point for each mask, with the mask and the bits under it."""
    some = points.select(F.explode(F.array(*[F.lit(_signed(x)) for x in masks])).alias("mask"), *points.columns)
    return some.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("top"), *points.columns)


def trie_links(keys: np.ndarray, bounds: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``keys`` within ``budget`` bits, in each group between ``bounds``.

    keys: sorted as unsigned numbers in each group. A node is a range of keys that share their
    leading bits; a frontier of pairs of nodes, with the bits that differ so far, goes down bit by
    bit. Pairs of single keys are settled at once; equal keys meet at the end.
    """
    zero = np.zeros(len(bounds) - 1, np.int64)
    todo = [(BITS - 1, (bounds[:-1], bounds[1:], bounds[:-1], bounds[1:], zero))]
    while todo:
        bit, pairs = todo.pop()
        if len(pairs[0]) > PAIRS:
            half = len(pairs[0]) // 2
            todo += [(bit, tuple(x[half:] for x in pairs)), (bit, tuple(x[:half] for x in pairs))]
            continue
        al, ah, bl, bh, err = pairs
        done = ((ah - al == 1) & (bh - bl == 1)) if bit >= 0 else np.ones(len(al), bool)
        a, b = _cells(al[done], ah[done], bl[done], bh[done]) if bit < 0 else (al[done], bl[done])
        near = (a < b) & (np.bitwise_count(keys[a] ^ keys[b]) <= budget)
        yield a[near], b[near]
        al, ah, bl, bh, err = (x[~done] for x in pairs)
        if not len(al):
            continue
        zeros = np.concatenate([[0], np.cumsum(keys >> np.uint64(bit) & np.uint64(1) == 0)])
        am, bm = al + zeros[ah] - zeros[al], bl + zeros[bh] - zeros[bl]
        other = al != bl
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), tuple(x[other] for x in (am, ah, bl, bm, err + 1))]
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget) & ((nxt[0] != nxt[2]) | (nxt[1] - nxt[0] > 1))
        todo.append((bit - 1, tuple(x[keep] for x in nxt)))


def _cells(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (a, b) with a in [al, ah) and b in [bl, bh), for each pair of ranges."""
    wide = bh - bl
    n = (ah - al) * wide
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(wide, n)
    return np.repeat(al, n) + k // wide, np.repeat(bl, n) + k % wide


class Forest:
    """Smallest index reached over the links given so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root[:] = root[root]
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]


def _subtries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole (mask, top) groups from rows that come sorted by them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if len(rest) >= 1 << 14:
            mask, top = (rest.column(k).to_numpy() for k in ("mask", "top"))
            last = np.flatnonzero((mask != mask[-1]) | (top != top[-1]))
            if len(last):
                yield rest.slice(0, last[-1] + 1)
                rest = rest.slice(last[-1] + 1).combine_chunks()
    if rest is not None and len(rest):
        yield rest


def _join_subtries(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """For each group of rows with equal (mask, top): a star of links for each component."""
    for table in _subtries(batches):
        mask, top = (table.column(k).to_numpy() for k in ("mask", "top"))
        new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (top[1:] != top[:-1])])
        group = np.cumsum(new) - 1
        rows = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(rows):
            continue
        fp = table.column("fp").to_numpy().view(np.uint64)
        rows = rows[np.lexsort((table.column("node").to_numpy()[rows], fp[rows], group[rows]))]
        fp, group, node = fp[rows], group[rows], table.column("node").to_numpy()[rows]
        bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), [len(fp)]])
        forest = Forest(len(fp))
        for a, b in trie_links(fp, bounds, budget):
            for i in range(0, len(a), 1 << 15):
                forest.link(a[i : i + (1 << 15)], b[i : i + (1 << 15)])
        tied = np.flatnonzero(forest.root != np.arange(len(fp)))
        pairs = np.unique(np.stack([node[tied], node[forest.root[tied]]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def links(points: DataFrame, scratch: Scratch, budget: int) -> DataFrame:
    """Links (a, b) between nodes that connect the same nodes as all links do.

    points: distinct node and fp. A task hands on a star for each component that it sees, so at most a row a node and block.
    """
    spark, found = scratch.spark, None
    keyed = _keyed(points, _blocks(0, budget))
    while keyed is not None:
        hot = scratch.table(keyed.groupBy("mask", "top").count().where(F.col("count") > SUBTRIE).select("mask", "top"), "hot")
        # At most (budget + 1) ** level masks. One with an empty block can't be cut: any pair agrees there.
        cuts = {r.mask: _blocks(r.mask % (1 << BITS), budget) for r in hot.select("mask").distinct().toLocalIterator()}
        cuts = {m: x for m, x in cuts.items() if m % (1 << BITS) not in x}
        cold, deeper = keyed, None
        if cuts:
            side = small(hot.where(F.col("mask").isin(sorted(cuts))))
            cold = keyed.join(side, ["mask", "top"], "left_anti")
            subs = spark.createDataFrame([(m, [_signed(x) for x in subs]) for m, subs in sorted(cuts.items())], "mask long, subs array<long>")
            again = keyed.join(side, ["mask", "top"], "left_semi").join(F.broadcast(subs), "mask").select(F.explode("subs").alias("mask"), *points.columns)
            deeper = again.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("top"), *points.columns)
        part = scratch.table(cold.repartition("mask", "top").sortWithinPartitions("mask", "top").mapInArrow(lambda it: _join_subtries(it, budget), "a long, b long"), "links")
        found = part if found is None else found.unionAll(part)
        keyed = deeper
    return found


def _owners(points: DataFrame, tied: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component_id): the smallest ``least`` of the node's component."""
    roots = scratch.table(points.select("node", "least").join(tied, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return roots.select("node", "root").join(least, "root").select("node", "component_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, n: int = 3, budget: int = 2) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp (signed long), component_id.

    Fingerprints of ``n``-word shingles link at ``budget`` or fewer differing bits; component_id is
    the smallest doc_id that is reached, the own one included. Null and empty texts and texts of
    white space have fingerprint 0, which links like any other. Rows with a null doc_id get the
    component of their fingerprint, null if it has no other id. Repeated rows give repeated
    results; an empty table gives none. Exact copies meet as one fingerprint before any join.
    """
    scratch = Scratch(spark, "simhash")
    each = scratch.table(fingerprints(docs, n), "fingerprints")
    points = scratch.table(each.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")), "points")
    tied = components(links(points.select("node", F.col("node").alias("fp")), scratch, budget), scratch)
    return each.join(_owners(points, tied, scratch), each.fp == F.col("node")).select("doc_id", "fp", "component_id")


def fingerprint_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _node(shingle: np.ndarray) -> int:
    import xxhash

    return _signed(xxhash.xxh64_intdigest(shingle.tobytes(), seed=SEED))


def _banded(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """doc_id, node (a hash of the shingle set), number of shingles, fingerprint, bands."""
    release()
    for batch in batches:
        nodes, sizes, keys = [], [], np.empty((batch.num_rows, BANDS), np.int64)
        fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows).view(np.int64)
        for k, text in enumerate(batch.column("text")):
            some = shingles(text.as_py(), n)
            nodes.append(_node(some))
            sizes.append(len(some))
            keys[k] = bands(some)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fp), listed], ["doc_id", "node", "n", "fp", "keys"])


def _listed(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [flat[a:z] for a, z in zip(ends, ends[1:], strict=False)]


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            sets = [shingles(t.as_py(), n) for t in batch.column("text").slice(i, 512)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), _listed(sets)], ["node", "grams"])


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        ends = zip(_arrays(batch.column("x")), _arrays(batch.column("y")), strict=True)
        near = pa.array([jaccard(x, y) >= least for x, y in ends], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], ["a", "b"])


def _sets_of(needed: DataFrame, each: DataFrame, docs: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """node and grams (its shingle set) of the distinct nodes of ``needed``.

    Only their texts are read again, one a node where it has an id.
    """
    ids = each.join(needed, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("id")).select("id").distinct()
    texts = _slim(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = texts.mapInArrow(lambda it: _sets(it, n), "node long, grams array<long>").join(needed, "node", "left_semi").dropDuplicates(["node"])
    with batches_of(scratch.spark, WIDE_ROWS):
        return scratch.table(sets, "sets")


def _similar(pairs: DataFrame, sets: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a Jaccard similarity of ``least`` or more."""
    x = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    with batches_of(scratch.spark, WIDE_ROWS):
        return scratch.table(x.mapInArrow(lambda it: _verified(it, least), "a long, b long"), "similar")


def _ends(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")


def _prefix_pairs(loose: DataFrame, sets: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that may be similar; all that are, are among them.

    loose: node, n, root. Shingles stand in one order, the rarest first. Two sets of n and m shingles
    are similar if they have (n + m) * least / (1 + least) in common, so after the first of those
    each has as many left, which bounds the place where it can stand. The nodes of a shingle's most
    frequent root meet only those of other roots.
    """
    grams = sets.join(loose, "node").select("node", "n", "root", F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").count().where("count > 1")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("count", F.lit(1)), "gram"))
    left = grams.join(shared, "gram", "left").select("*", (F.col("n") - place + 1).alias("left")).where(F.col("count").isNotNull() & (F.col("left") >= F.col("n") * least - 1e-6))
    prefix = scratch.table(left.select("gram", "node", "n", "root", "left"), "prefix")
    roots = prefix.groupBy("gram", "root").count().groupBy("gram").agg(F.max(F.struct("count", "root")).alias("top"), F.count("*").alias("roots"))
    main = scratch.table(roots.where("roots > 1").select("gram", F.col("top.root").alias("main")), "main")
    x, y = prefix.join(main, "gram").where("root <> main"), prefix.join(main.select("gram"), "gram", "left_semi").toDF("gram", "b", "m", "other", "right")
    once = (F.col("other") == F.col("main")) | (F.col("node") < F.col("b"))
    enough = F.least("left", "right") >= (F.col("n") + F.col("m")) * (least / (1 + least)) - 1e-6
    met = x.join(y, "gram").where((F.col("root") != F.col("other")) & once & enough)
    return met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def similar_groups(spark: SparkSession, docs: DataFrame, n: int = 5, least: float = 0.8, budget: int = 2) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, component_id (smallest doc_id of its group).

    Texts are linked if their ``n``-word shingle sets have a Jaccard similarity of ``least`` or more,
    which is taken exactly for every candidate; groups are closed over links. First candidates are
    the links of a trie join of SimHash fingerprints within ``budget`` bits. What they leave apart
    are candidates where they share one of BANDS bands of min-hashes: first the nodes of a band meet
    its hub, the node that shares most bands with others, as an original does with its copies; then
    the other nodes of bands that are not in one group yet meet by a prefix filter, which loses no
    link. So a large group costs about a pair a node. Nulls, empty texts and repeats as in
    near_duplicates.
    """
    scratch = Scratch(spark, "similar")
    with batches_of(spark, WIDE_ROWS):
        each = scratch.table(_slim(docs).mapInArrow(lambda it: _banded(it, n), "doc_id long, node long, n long, fp long, keys array<long>"), "bands")
    marks = scratch.table(each.groupBy("node").agg(F.min("fp").alias("fp")), "marks")
    close = scratch.table(links(marks, scratch, budget).where("a <> b").distinct(), "close")
    sets = _sets_of(_ends(close, scratch), each, docs, n, scratch)
    near = _similar(close, sets, least, scratch)
    scratch.drop(sets)
    tied = scratch.table(components(near, scratch), "tied")
    points = each.select("node", "n", "keys").dropDuplicates(["node"]).join(tied, "node", "left").select("node", "n", F.coalesce("root", "node").alias("own"), F.posexplode("keys").alias("band", "key"))
    # A band whose nodes the trie join put in one group has nothing to tell.
    met = points.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("band", "key", "size")
    held = scratch.table(points.join(met, ["band", "key"]), "held")
    known = held.groupBy("node").agg(F.sum("size").alias("known"))
    hubs = scratch.table(held.join(known, "node").groupBy("band", "key").agg(F.max(F.struct("known", "node", "n", "own")).alias("hub")), "hubs")
    # Sets of sizes further apart can't be similar.
    fits = F.least("n", "hub.n") >= F.greatest("n", "hub.n") * (least - 1e-9)
    star = held.join(hubs, ["band", "key"]).where((F.col("node") != F.col("hub.node")) & (F.col("own") != F.col("hub.own")) & fits)
    star = scratch.table(star.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct(), "star")
    sets = _sets_of(_ends(star, scratch), each, docs, n, scratch)
    near = near.unionAll(_similar(star, sets, least, scratch))
    scratch.drop(sets)
    tied = scratch.table(components(near, scratch), "tied")
    # Hubs have met their bands.
    owned = held.join(hubs, ["band", "key"]).where(F.col("node") != F.col("hub.node")).join(tied, "node", "left").select("band", "key", "node", "n", F.coalesce("root", "node").alias("root"))
    open_ = owned.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "key")
    loose = scratch.table(owned.join(open_, ["band", "key"], "left_semi").select("node", "n", "root").distinct(), "loose")
    if not loose.isEmpty():
        sets = _sets_of(loose.select("node"), each, docs, n, scratch)
        rest = scratch.table(_prefix_pairs(loose, sets, least, scratch).join(star, ["a", "b"], "left_anti"), "rest")
        near = near.unionAll(_similar(rest, sets, least, scratch))
        tied = components(near, scratch)
        scratch.drop(sets)
    scratch.drop(held)
    owners = _owners(each.groupBy("node").agg(F.min("doc_id").alias("least")), tied, scratch)
    return each.select("doc_id", "node").join(owners, "node").select("doc_id", "component_id")


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is not the smallest of their similar group.

    Rows with a null doc_id stay. Rows that repeat a doc_id count as one document.
    """
    gone = similar_groups(spark, docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = Scratch(spark, "losers").table(gone, "gone")
    rows = packed(docs)
    return unpacked(rows.join(small(gone), F.col("_row.doc_id") == F.col("_gone"), "left_anti"), docs)
