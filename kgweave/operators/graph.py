"""Knowledge-graph views, binding joins, candidates and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import small

#: Keys over which the facts of a frequent value are dealt.
SALTS = 32


def _edge(df: DataFrame, pred: str, h: str, hp: str, t: str, tp: str) -> DataFrame:
    return df.select(F.lit(pred).alias("pred"), F.concat(F.lit(hp), F.col(h).cast("string")).alias("h"), F.concat(F.lit(tp), F.col(t).cast("string")).alias("t"))


#: Relation: table, head column and prefix, tail column and prefix, whether pairs repeat.
RELATIONS = {
    "custIn": ("customer", "c_custkey", "c:", "c_nationkey", "n:", False),
    "suppIn": ("supplier", "s_suppkey", "s:", "s_nationkey", "n:", False),
    "inRegion": ("nation", "n_nationkey", "n:", "n_regionkey", "r:", False),
    "placed": ("orders", "o_custkey", "c:", "o_orderkey", "o:", False),
    "contains": ("lineitem", "l_orderkey", "o:", "l_partkey", "p:", True),
    "supplies": ("lineitem", "l_suppkey", "s:", "l_partkey", "p:", True),
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(pred, h, t) of one relation of the star schema; keys get a prefix by kind."""
    table, h, hp, t, tp, repeats = RELATIONS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(h, t)
    return _edge(df.distinct() if repeats else df, name, h, hp, t, tp)


def graph(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    out = relation(spark, sf_dir, names[0])
    for name in names[1:]:
        out = out.unionByName(relation(spark, sf_dir, name))
    return out


def vocabulary(facts: DataFrame) -> DataFrame:
    """(name, kind): distinct constants and predicates."""
    return facts.select(F.explode(F.array("h", "t")).alias("name"), F.lit("constant").alias("kind")).union(facts.select("pred", F.lit("predicate"))).distinct()


def bindings(goals: DataFrame, facts: DataFrame, pattern: str) -> DataFrame:
    """(qid, h, t) of facts that unify with goals (qid, pred, h, t), by pattern of bound arguments:
    bb, bf, fb, ff, or same for p(X, X). Each is an equi-join; a fact equal to the goal is left out
    of bf and fb goals that carry ``own`` (struct h, t).

    A key of few values, as the nation of fb goals is, would leave whole products to one task each. So
    fb and ff facts are dealt over all tasks, and meet goals that go out by broadcast where they are
    few; where they aren't, the facts of a key are dealt over SALTS keys, with the goals at each.
    """
    f = facts.select(F.col("pred").alias("fp"), F.col("h").alias("fh"), F.col("t").alias("ft"))
    on = F.col("pred") == F.col("fp")
    if pattern in ("bb", "bf"):
        on = on & (F.col("h") == F.col("fh"))
    if pattern in ("bb", "fb"):
        on = on & (F.col("t") == F.col("ft"))
    if pattern in ("fb", "ff"):
        f, few = f.withColumn("_salt", F.pmod(F.xxhash64("fh", "ft"), F.lit(SALTS))), small(goals)
        if few is goals:
            out = goals.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(f, on & (F.col("_s") == F.col("_salt")))
        else:
            out = few.join(f.repartition(int(f.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fh", "ft"), on)
    else:
        out = goals.join(f, on)
    if pattern == "same":
        out = out.where("fh = ft")
    return out.select("qid", F.col("fh").alias("h"), F.col("ft").alias("t"))


def novel(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of (pred, h, t, ...) that aren't known."""
    return new.join(known.select("pred", "h", "t"), ["pred", "h", "t"], "left_anti")


def corrupt_all(queries: DataFrame, pool: DataFrame, side: str, known: DataFrame | None = None) -> DataFrame:
    """(qid, pred, h, t) with one side replaced by every other member of its pool, less known facts.

    queries: (qid, pred, h, t); pool: (pred, entity), so that candidates come by an equi-join on
    the relation whose domain they are.
    """
    x = queries.join(pool.withColumnRenamed("pred", "_p"), F.col("pred") == F.col("_p")).where(F.col("entity") != F.col(side))
    out = x.select("qid", "pred", *[(F.col("entity") if side == c else F.col(c)).alias(c) for c in ("h", "t")])
    return novel(out, known) if known is not None else out


def draw(key: Column, seed: int, size: Column) -> Column:
    """A number from 0 to size - 1 by an arithmetic hash that any engine gives alike."""
    return F.pmod((key * 7919 + seed * 104729) % 1000003, size)


def corrupt_sampled(queries: DataFrame, pool: DataFrame, n: int, seed: int = 17) -> DataFrame:
    """(qid, k, h, t): n tails drawn among the pool's other members, by shift past the true one.

    queries: (qid, h, t, place: the tail's place in the pool from 0); pool: (entity, place).
    """
    size = pool.agg(F.count("*").alias("size"))
    drawn = queries.crossJoin(F.broadcast(size)).select("qid", "h", "t", "place", "size", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    at = draw(F.col("qid") * n + F.col("k"), seed, F.col("size") - 1)
    drawn = drawn.withColumn("at", F.when(at >= F.col("place"), at + 1).otherwise(at))
    return drawn.join(pool.select("entity", F.col("place").alias("_place")), F.col("at") == F.col("_place")).select("qid", "k", "h", F.col("entity").alias("t"))


def bernoulli(facts: DataFrame) -> DataFrame:
    """pred, tph, hpt, p_head: chance to corrupt the head, from tails a head and heads a tail."""
    x = facts.groupBy("pred").agg(F.count("*").alias("n"), F.countDistinct("h").alias("nh"), F.countDistinct("t").alias("nt"))
    x = x.select("pred", (F.col("n") / F.col("nh")).alias("tph"), (F.col("n") / F.col("nt")).alias("hpt"))
    return x.select("pred", "tph", "hpt", F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("tph") / (F.col("tph") + F.col("hpt")))).alias("p_head"))


def reciprocal(facts: DataFrame) -> DataFrame:
    """Facts and their inverses, named ``pred__inv``."""
    return facts.select("pred", "h", "t").unionAll(facts.select(F.concat("pred", F.lit("__inv")), F.col("t"), F.col("h")))


def relation_domains(facts: DataFrame) -> DataFrame:
    """(pred, role, entity): what a relation has as heads and as tails."""
    return facts.select("pred", F.explode(F.array(F.struct(F.lit("head").alias("role"), F.col("h").alias("entity")), F.struct(F.lit("tail").alias("role"), F.col("t").alias("entity")))).alias("e")).select("pred", "e.role", "e.entity").distinct()


def filter_pairs(facts: DataFrame) -> DataFrame:
    """(pred, anchor, side, entity): the known answers of each (relation, anchor) on each side."""
    one = lambda side, anchor, entity: F.struct(F.lit(side).alias("side"), F.col(anchor).alias("anchor"), F.col(entity).alias("entity"))
    both = facts.select("pred", F.explode(F.array(one("tail", "h", "t"), one("head", "t", "h"))).alias("e"))
    return both.select("pred", "e.anchor", "e.side", "e.entity").distinct()


def filter_sizes(facts: DataFrame) -> DataFrame:
    """(pred, anchor, side, n): how many known answers each (relation, anchor) has on each side."""
    return filter_pairs(facts).groupBy("pred", "anchor", "side").agg(F.count("*").alias("n"))


def filter_sets(facts: DataFrame, chunk: int = 100_000) -> DataFrame:
    """(pred, anchor, side, part, entities): the known answers as sorted arrays.

    An anchor with many answers has several parts, dealt by hash into about ``chunk`` each, so no row
    holds an unbounded set; the others have part 0.
    """
    pairs = filter_pairs(facts)
    sizes = pairs.groupBy("pred", "anchor", "side").agg(F.ceil(F.count("*") / chunk).alias("parts")).where("parts > 1")
    x = pairs.join(sizes, ["pred", "anchor", "side"], "left")
    part = F.pmod(F.xxhash64("entity"), F.coalesce("parts", F.lit(1))).cast("int")
    return x.groupBy("pred", "anchor", "side", part.alias("part")).agg(F.sort_array(F.collect_list("entity")).alias("entities"))


def head_filter(queries: DataFrame, rules: DataFrame, limit: int | None = None, order: str = "line") -> DataFrame:
    """Queries (pred, ...) whose predicate heads a rule of ``rules`` (head, body); ``limit`` counts what
    is left, in order of ``order``."""
    out = queries.join(rules.select(F.col("head.p").alias("pred")).distinct(), "pred", "left_semi").select(*queries.columns)
    return out.orderBy(order).limit(limit) if limit is not None else out


def matching(goals: DataFrame, facts: DataFrame, limit: int | None = None) -> DataFrame:
    """(qid, h, t): facts that fit goals (qid, pred, h, t) whose arguments may be null for free.

    ``limit`` keeps the first so many of a goal in order of (h, t), before the shuffle. A goal bound on
    a side meets facts by that side; only goals with both free meet a whole relation.
    """
    parts = [(F.col("h").isNotNull() & F.col("t").isNotNull(), "bb"), (F.col("h").isNotNull() & F.col("t").isNull(), "bf"), (F.col("h").isNull() & F.col("t").isNotNull(), "fb"), (F.col("h").isNull() & F.col("t").isNull(), "ff")]
    out = None
    for some, pattern in parts:
        x = bindings(goals.where(some), facts, pattern)
        out = x if out is None else out.unionAll(x)
    if limit is not None:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy("h", "t"))).where(F.col("_r") <= limit).drop("_r")
    return out


def entities_at(facts: DataFrame, pred: str, position: str, other: str | None = None, limit: int | None = None) -> DataFrame:
    """(entity): distinct arguments of a relation at position h or t, sorted; with the other argument
    given, of its facts only."""
    x = facts.where(F.col("pred") == pred)
    if other is not None:
        x = x.where(F.col("t" if position == "h" else "h") == other)
    out = x.select(F.col(position).alias("entity")).distinct().orderBy("entity")
    return out.limit(limit) if limit is not None else out


def encode(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """(pred, h_id, t_id); raises on names without an id, with a few of them."""
    h = ids.select(F.col("name").alias("h"), F.col("id").alias("h_id"))
    t = ids.select(F.col("name").alias("t"), F.col("id").alias("t_id"))
    out = facts.join(h, "h", "left").join(t, "t", "left")
    missing = out.where("h_id is null or t_id is null").select("h", "t").limit(5).collect()
    if missing:
        raise ValueError(f"names without an id, among: {missing}")
    return out.select("pred", "h_id", "t_id")


def numbered(df: DataFrame, by: str, name: str, start: int = 0) -> DataFrame:
    """``df`` with places from ``start`` in order of ``by``; for pools, which are small."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(by)) - 1 + start)
