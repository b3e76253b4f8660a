"""Embedding near-duplicates by NN-descent.

A graph of near neighbours starts from random projections and is refined by joins of neighbours'
neighbours until it hardly changes. A vector whose list holds only links is saturated: there may
be more, so its list is enlarged to all of its group and of every group whose ball may touch its
own; those are compared in blocks, of which only sums go out. Links are then counted for a sample
of vectors by brute force. While recall is too low there are more starts, and in the end all
vectors are compared in blocks. Exact copies are one vector from the start, and counts of links
are sums, so no pair of copies is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small
from .components import components
from .simhash import Forest

THRESHOLD = 0.95
#: Neighbours in a list, random projections that start it, rounds at most before the audit.
NEIGHBOURS, TREES, ROUNDS = 10, 4, 6
#: A round that improves fewer than this share of list places is the last.
STEADY = 0.002
#: Cosines of the descent are in single precision; nearer to the threshold they are taken again.
ROUNDING = 1e-4
#: Recall at which the audit is content, starts it may ask for before all is compared, and the
#: vectors it samples by a hash: so many at any size, a sum of whose links has a small error.
RECALL, STARTS, AUDIT = 0.98, 3, 2000
#: Vectors in a cell of a projection, and in one side of a block.
CELL, BLOCK = 256, 2048
#: Slack of cosines of centers, so that rounding leaves no pair of balls out.
SLACK = 1e-9

_PAIR = "a long, b long, s double"


def _unit(rows: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.float64) for r in rows]) if rows else np.zeros((0, 1))


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision as bytes, null for vectors that link with nothing."""
    for batch in batches:
        out = []
        for v in batch.column("embedding").to_pylist():
            unit = None
            if v and None not in v:
                x = np.array(v, np.float64)
                with np.errstate(all="ignore"):
                    top = np.abs(x).max()
                    if np.isfinite(x).all() and top > 0:
                        x = x / top
                        unit = (x / np.sqrt((x * x).sum())).tobytes()
            out.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "unit"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in single precision beside those in double."""
    for b in batches:
        v = [np.frombuffer(u).astype(np.float32).tobytes() for u in b.column("unit").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(v, pa.binary())], [*b.schema.names, "v"])


def _cells(batches: Iterator[pa.RecordBatch], trees: int, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(tree, cell, node, unit): a cell is the signs of ``bits`` random projections of a tree."""
    planes: dict = {}
    for batch in batches:
        units = batch.column("unit").to_pylist()
        for dim in sorted({len(u) for u in units}):
            rows = [k for k, u in enumerate(units) if len(u) == dim]
            x = _unit([units[k] for k in rows])
            for t in range(trees):
                key = (dim, t)
                if key not in planes:
                    planes[key] = np.random.default_rng([seed, t, dim]).normal(size=(x.shape[1], max(bits, 1)))
                code = ((x @ planes[key] > 0) << np.arange(max(bits, 1))).sum(1) if bits else np.zeros(len(x), np.int64)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(rows), pa.int32()), pa.array(code.astype(np.int64)), batch.column("node").take(take), batch.column("unit").take(take)], ["tree", "cell", "node", "unit"]
                )


def _top(ids: np.ndarray, units: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of some vectors, its k nearest among them."""
    k = min(k, len(ids) - 1)
    if k < 1:
        return
    s = units @ units.T
    np.fill_diagonal(s, -2)
    near = np.argpartition(-s, k - 1, 1)[:, :k]
    yield np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(s, near, 1).ravel()


def _batch(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "s"])


def _start(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Nearest neighbours within runs of at most CELL vectors of a cell; rows come sorted by cell."""
    ids: list[int] = []
    units: list[bytes] = []
    now = None

    def flush() -> Iterator[pa.RecordBatch]:
        if len(ids) > 1:
            for x in _top(np.array(ids), _unit(units), k):
                yield _batch(*x)
        ids.clear()
        units.clear()

    for batch in batches:
        for t, c, node, unit in zip(*(batch.column(k).to_pylist() for k in ("tree", "cell", "node", "unit")), strict=True):
            if (t, c, len(unit)) != now or len(ids) >= CELL:
                yield from flush()
                now = (t, c, len(unit))
            ids.append(node)
            units.append(unit)
    yield from flush()


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)
        s = [float(np.frombuffer(x) @ np.frombuffer(y)) if len(x) == len(y) else -2.0 for x, y in pairs]
        yield _batch(b.column("a").to_numpy(), b.column("b").to_numpy(), np.array(s))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k rows of the greatest s of each a; each task passes on k of a hub's rows at most."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("s").desc(), "b"))
    return pairs.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, s, fresh): the k best of each a; a pair that was there before is not fresh."""
    return _best(pairs.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh")), k)


def _exact(graph: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Links (a, b), a < b, of a graph; those near the threshold in double precision."""
    pairs = graph.where(F.col("s") >= least - ROUNDING).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("s").alias("s"))
    v = nodes.select("node", "unit")
    near = pairs.where(F.col("s") < least + ROUNDING).select("a", "b")
    x = near.join(v.withColumnsRenamed({"node": "na", "unit": "x"}), F.col("a") == F.col("na")).select("a", "b", "x")
    y = x.join(v.withColumnsRenamed({"node": "nb", "unit": "y"}), F.col("b") == F.col("nb")).select("a", "b", "x", "y")
    sure = pairs.where(F.col("s") >= least + ROUNDING)
    return sure.unionAll(y.mapInArrow(_dots, _PAIR).where(F.col("s") >= least)).select("a", "b")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by center: the members of a center meet, and pairs with a fresh one that
    would enter the list of either end go out."""
    rows: list = []
    now = None

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if len(rows) < 2:
            return
        size = max(len(r[3]) for r in rows)
        some = [r for r in rows if len(r[3]) == size]
        ids, fresh, kth = (np.array([r[i] for r in some]) for i in (0, 1, 2))
        x = np.frombuffer(b"".join(r[3] for r in some), np.float32).reshape(len(some), -1)
        s = x @ x.T
        enters = (s > kth[:, None]) & (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :])
        i, j = np.nonzero(enters)
        yield ids[i], ids[j], s[i, j].astype(float)

    out: list = []
    for batch in batches:
        for center, *row in zip(*(batch.column(c).to_pylist() for c in ("center", "member", "fresh", "kth", "v")), strict=True):
            if center != now:
                out += flush()
                rows.clear()
                now = center
            rows.append(row)
        if out:
            yield _batch(*map(np.concatenate, zip(*out, strict=True)))
            out = []
    out += flush()
    if out:
        yield _batch(*map(np.concatenate, zip(*out, strict=True)))


def descend(nodes: DataFrame, scratch: Scratch, graph: DataFrame, k: int, rounds: int) -> DataFrame:
    """Rounds of: let the neighbours of each node meet, keep each node's k best.

    graph: (a, b, s, fresh), at most k rows an a. A hub's reverse neighbours are its k best too;
    pairs that this leaves out are met from their other ends, and the audit counts what is
    missed. Only pairs with a neighbour that came in the last round are compared.
    """
    for _ in range(rounds):
        back = _best(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "s", "fresh"), k)
        around = graph.unionAll(back).groupBy("a", "b").agg(F.max("fresh").alias("fresh"))
        active = around.groupBy("a").agg(F.max("fresh").alias("any")).where("any").select("a")
        around = around.join(active, "a", "left_semi").select(F.col("a").alias("center"), F.col("b").alias("member"), "fresh")
        kth = graph.groupBy("a").agg(F.min("s").alias("kth"), F.count("*").alias("n")).select("a", F.when(F.col("n") >= k, F.col("kth")).otherwise(-2.0).alias("kth"))
        v = nodes.select("node", "v").join(kth, F.col("node") == F.col("a"), "left").select("node", "v", F.coalesce("kth", F.lit(-2.0)).alias("kth"))
        met = around.join(v, around.member == v.node).select("center", "member", "fresh", "kth", "v")
        pairs = met.repartition("center").sortWithinPartitions("center").mapInArrow(_meet, _PAIR)
        old = graph.select("a", "b", "s", F.lit(False).alias("fresh"))
        new = scratch.table(_lists(old.unionAll(pairs.select("a", "b", "s", F.lit(True).alias("fresh"))), k), "graph")
        gained, size = new.agg(F.count_if("fresh"), F.count("*")).first()
        scratch.drop(graph)
        graph = new
        if gained <= STEADY * size:
            break
    return graph


def _of_a_length(x: list[bytes], y: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and y of vectors of one length, and the vectors; for each length that both have."""
    for dim in sorted({len(u) for u in x} & {len(u) for u in y}):
        i, j = (np.flatnonzero([len(u) == dim for u in side]) for side in (x, y))
        yield i, j, _unit([x[k] for k in i]), _unit([y[k] for k in j])


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list, list]]:
    """Rows come sorted by (p, q, l, r, side): the key and both sides' (node, unit, weight)."""
    sides: tuple[list, list] = ([], [])
    now = None
    for batch in batches:
        names = ("p", "q", "l", "r", "side", "node", "unit", "weight")
        for p, q, left, right, side, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if (p, q, left, right) != now:
                if sides[0] and sides[1]:
                    yield now, *sides
                now, sides = (p, q, left, right), ([], [])
            sides[side].append(row)
    if sides[0] and sides[1]:
        yield now, *sides


_LINKED = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _linked(batches: Iterator[pa.RecordBatch], least: float, whole: bool) -> Iterator[pa.RecordBatch]:
    """Of every pair of blocks: (node, n), the weights of the other block's vectors that a vector
    links to; and links (a, b): one of the groups if they have any, or with ``whole`` a forest of nodes."""
    for (p, q, left, right), one, two in _block_pairs(batches):
        same = p == q and left == right
        for i, j, x, y in _of_a_length([r[1] for r in one], [r[1] for r in two]):
            a, b = (np.array([side[k][0] for k in at]) for side, at in ((one, i), (two, j)))
            wa, wb = (np.array([side[k][2] for k in at], np.int64) for side, at in ((one, i), (two, j)))
            back, forest = np.zeros(len(b), np.int64), Forest(len(a) + len(b))
            found = False
            for at in range(0, len(a), 512):
                link = (x[at : at + 512] @ y.T >= least) & (a[at : at + 512, None] != b)
                yield _counts(a[at : at + 512], link @ wb)
                back += wa[at : at + 512] @ link
                found = found or bool(link.any())
                if whole:
                    u, v = np.nonzero(link)
                    for k in range(0, len(u), 1 << 15):
                        forest.link(u[k : k + (1 << 15)] + at, v[k : k + (1 << 15)] + len(a))
            if not same:
                yield _counts(b, back)
            if whole:
                nodes = np.concatenate([a, b])
                tied = np.flatnonzero(forest.root != np.arange(len(nodes)))
                yield _ties(nodes[tied], nodes[forest.root[tied]])
            elif found and p != q:
                yield _ties(np.array([p]), np.array([q]))


def _counts(node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    keep = n > 0
    none = pa.nulls(int(keep.sum()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(node[keep], pa.int64()), pa.array(n[keep], pa.int64()), none, none], schema=_LINKED)


def _ties(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKED)


def _touching(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (p, q), p < q, of balls that may hold vectors within ``least`` of one another. A ball's
    node is its group, its weight the cosine to its farthest vector."""
    reach = np.arccos(least)
    for _, one, two in _block_pairs(batches):
        for i, j, x, y in _of_a_length([r[1] for r in one], [r[1] for r in two]):
            a, b = (np.array([side[k][0] for k in at]) for side, at in ((one, i), (two, j)))
            ra, rb = (np.arccos(np.clip([side[k][2] for k in at], -1, 1)) for side, at in ((one, i), (two, j)))
            for at in range(0, len(a), 512):
                far = np.minimum(ra[at : at + 512, None] + rb + reach, np.pi)
                u, v = np.nonzero((x[at : at + 512] @ y.T >= np.cos(far) - SLACK) & (a[at : at + 512, None] != b))
                low, high = np.minimum(a[at + u], b[v]), np.maximum(a[at + u], b[v])
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["p", "q"])


def _dealt(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows: g, node, unit, weight; pairs: (p, q) of groups, p <= q. Groups are dealt into blocks by
    hash, and each pair of blocks of a pair of groups is one key; of a group with itself, once."""
    size = rows.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    of = pairs.join(size.toDF("p", "np"), "p").join(size.toDF("q", "nq"), "q")
    x = rows.join(small(size), "g").select("g", "node", "unit", "weight", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("k"))
    same = F.col("p") == F.col("q")
    to = lambda least, most, make: F.explode(F.transform(F.sequence(least, most), make)).alias("o")
    end = lambda left, right, side: F.struct(left.alias("l"), right.alias("r"), F.lit(side).alias("side"))
    zero, k = F.lit(0), F.col("k")
    one = x.join(small(of), x.g == of.p).select("p", "q", "node", "unit", "weight", to(F.when(same, k).otherwise(zero), F.col("nq") - 1, lambda o: end(k, o, 0)))
    two = x.join(small(of), x.g == of.q).select("p", "q", "node", "unit", "weight", to(zero, F.when(same, k).otherwise(F.col("np") - 1), lambda o: end(o, k, 1)))
    keys = ("p", "q", "l", "r")
    return one.unionAll(two).select("p", "q", "o.l", "o.r", "o.side", "node", "unit", "weight").repartition(*keys).sortWithinPartitions(*keys, "side")


def _ball_pairs(members: DataFrame, scratch: Scratch, least: float) -> DataFrame:
    """(p, q), p <= q: every group with itself and with those whose balls may touch its own.

    members: g, node, unit, weight; g is one of the group's nodes, the center of its ball.
    """
    centers = members.where("node = g").select(F.col("g").alias("c"), F.col("unit").alias("x"))
    near = members.join(small(centers, F.length("x") + 8), members.g == F.col("c")).select(F.col("g").alias("a"), F.col("node").alias("b"), "x", F.col("unit").alias("y"))
    radius = near.mapInArrow(_dots, _PAIR).groupBy(F.col("a").alias("node")).agg(F.min("s").alias("weight"))
    balls = centers.join(radius, centers.c == radius.node).select(F.lit(0).cast("long").alias("g"), "node", F.col("x").alias("unit"), "weight")
    balls = scratch.table(balls, "balls")
    all_ = balls.select(F.col("g").alias("p"), F.col("g").alias("q")).distinct()
    touching = _dealt(balls, all_).mapInArrow(lambda it: _touching(it, least), "p long, q long").distinct()
    return scratch.table(touching.unionAll(balls.select(F.col("node").alias("p"), F.col("node").alias("q"))), "ball-pairs")


def _grown(graph: DataFrame, nodes: DataFrame, scratch: Scratch, least: float, k: int) -> DataFrame:
    """(node, root, n): component, and summed weights of the vectors that a node links to."""
    links = scratch.table(_exact(graph, nodes, least), "links")
    tied = scratch.table(components(links, scratch), "tied")
    roots = nodes.join(tied, "node", "left").select("node", "weight", "unit", F.coalesce("root", "node").alias("g"))
    full = graph.groupBy("a").agg(F.min("s").alias("s"), F.count("*").alias("n")).where((F.col("n") >= k) & (F.col("s") >= least - ROUNDING)).select(F.col("a").alias("node"))
    dense = roots.join(full, "node", "left_semi").select("g").distinct()
    members = scratch.table(roots.join(small(dense), "g", "left_semi").select("g", "node", "unit", "weight"), "members")
    pairs = _ball_pairs(members, scratch, least)
    met = scratch.table(_dealt(members, pairs).mapInArrow(lambda it: _linked(it, least, False), _MET), "met")
    grown = met.where("node is not null").groupBy("node").agg(F.sum("n").alias("n"))
    joined = scratch.table(components(met.where("a is not null").select("a", "b").distinct(), scratch), "joined").toDF("g", "final")
    # Links of a vector of no dense group are all in the graph; those of the others were counted anew.
    ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")
    counted = ends.join(nodes.select(F.col("node").alias("b"), "weight"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("m"))
    out = roots.select("node", "g").join(grown, "node", "left").join(counted, "node", "left").join(small(joined), "g", "left")
    return scratch.table(out.select("node", F.coalesce("final", "g").alias("root"), F.coalesce("n", "m", F.lit(0)).alias("n")), "grown")


def _compared(nodes: DataFrame, scratch: Scratch, least: float) -> DataFrame:
    """(node, root, n) by comparing all vectors in blocks."""
    rows = nodes.select(F.lit(0).cast("long").alias("g"), "node", "unit", "weight")
    one = rows.select(F.col("g").alias("p"), F.col("g").alias("q")).distinct()
    met = scratch.table(_dealt(rows, one).mapInArrow(lambda it: _linked(it, least, True), _MET), "met")
    tied = components(met.where("a is not null").select("a", "b"), scratch)
    n = met.where("node is not null").groupBy("node").agg(F.sum("n").alias("n"))
    out = nodes.select("node").join(tied, "node", "left").join(n, "node", "left")
    return scratch.table(out.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.lit(0)).alias("n")), "compared")


_MET = "node long, n long, a long, b long"


def audit(spark: SparkSession, nodes: DataFrame, counted: DataFrame, least: float) -> float:
    """Recall of links (node, n) of AUDIT nodes, chosen by hash, by brute force against all nodes."""
    some = nodes.orderBy(F.xxhash64(F.col("node") + 1), "node").limit(AUDIT).select("node", "unit").collect()
    if not some:
        return 1.0
    shared = spark.sparkContext.broadcast(([r.node for r in some], [bytes(r.unit) for r in some]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units = np.array(shared.value[0]), shared.value[1]
        for batch in batches:
            mine, weight, own = batch.column("node").to_numpy(), batch.column("weight").to_numpy(), batch.column("unit").to_pylist()
            for i, j, x, y in _of_a_length(units, own):
                link = (x @ y.T >= least) & (ids[i][:, None] != mine[j])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(link @ weight[j], pa.int64())], ["node", "want"])

    want = nodes.select("node", "unit", "weight").mapInArrow(find, "node long, want long").groupBy("node").agg(F.sum("want").alias("want"))
    r = want.join(counted, "node").agg(F.sum("want").alias("w"), F.sum(F.least("want", "n")).alias("h")).first()
    return 1.0 if not r.w else r.h / r.w


def _started(nodes: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """(a, b, s, fresh): neighbours within cells of TREES random projections of n vectors.

    A cell of many is dealt by hash, so it is no hot key; the descent joins its parts.
    """
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / CELL))))
    cells = nodes.mapInArrow(lambda it: _cells(it, TREES, bits, seed), "tree int, cell long, node long, unit binary")
    dealt = cells.withColumn("salt", F.pmod(F.xxhash64("node", "tree"), F.lit(4))).repartition("tree", "cell", "salt").sortWithinPartitions("tree", "cell", "salt", F.length("unit")).drop("salt")
    return _lists(dealt.mapInArrow(lambda it: _start(it, k), _PAIR).withColumn("fresh", F.lit(True)), k)


def near_duplicates(spark: SparkSession, vectors: DataFrame, least: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Cosines are taken in double precision. Null, zero and empty vectors, and those with null or
    non-finite components, link with nothing; neither do vectors of different lengths. n_links:
    other rows linked directly, exact copies included; component_id: smallest vec_id reached;
    kept: it is the own one. Rows that repeat a vec_id are copies of their own. A null vec_id has
    its component's id. Other columns are not read. An empty table gives no row.

    Links within a dense group, and between two of them, are complete. Others come from the
    refined graph, whose recall is measured on a sample; under RECALL after STARTS starts, all
    vectors are compared.
    """
    scratch = Scratch(spark, "vectors")
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    each = scratch.table(slim.mapInArrow(_normal, "vec_id long, unit binary"), "units")
    # One node for each different vector; its copies are its weight.
    nodes = each.where("unit is not null").groupBy("unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    nodes = scratch.table(nodes.select(F.xxhash64("unit").alias("node"), "least", "weight", "unit").mapInArrow(_single, "node long, least long, weight long, unit binary, v binary"), "nodes")
    n = nodes.count()
    graph = None
    for start in range(1, STARTS + 1):
        begun = _started(nodes, n, k, start)
        if graph is not None:
            begun = _lists(graph.select("a", "b", "s", F.lit(False).alias("fresh")).unionAll(begun), k)
        graph = descend(nodes, scratch, scratch.table(begun, "start"), k, ROUNDS)
        counted = _grown(graph, nodes, scratch, least, k)
        recall = audit(spark, nodes, counted, least)
        if recall >= RECALL:
            break
    else:
        counted = _compared(nodes, scratch, least)
    x = nodes.select("node", "least", "weight", "unit").join(counted, "node")
    least_of = x.groupBy("root").agg(F.min("least").alias("component_id"))
    per = x.join(least_of, "root").select(F.col("unit").alias("u"), (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    out = each.join(scratch.table(per, "result"), F.col("unit") == F.col("u"), "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"))
