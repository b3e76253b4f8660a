"""Queries of triple scores over the vectors table, fused scores and soft facts.

Relation of label l is the mean vector of that label. A vector's first half is real, its second
imaginary, where a score needs complex numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import neural
from ..operators.links import best_links
from ..plans.scratch import small
from . import register

E_SQL = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
REL_SQL = f"SELECT label, list(m ORDER BY i) AS r FROM (SELECT label, i, avg(v[i]) AS m FROM ({E_SQL}), range(1, 65) t(i) GROUP BY label, i) GROUP BY label"
PAIR_SQL = f"e AS ({E_SQL}), rel AS ({REL_SQL}), p AS (SELECT a.vec_id AS h, b.vec_id AS t, a.label, a.v AS hv, r, b.v AS tv FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN rel ON a.label = rel.label)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def relations(v: DataFrame) -> DataFrame:
    """(label, r): mean vectors, by position."""
    m = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("r"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(h, t, label, hv, r, tv): each vector with the next one under its label's relation."""
    e = vectors(spark, sf_dir)
    t = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("t"), F.col("v").alias("tv"))
    return e.withColumnRenamed("v", "hv").join(t, "vec_id").join(small(relations(e)), "label").select(F.col("vec_id").alias("h"), "t", "label", "hv", "r", "tv")




@register(f"WITH {PAIR_SQL} SELECT h, t, round(-list_sum([abs(hv[i] + r[i] - tv[i]) FOR i IN range(1, 65)]), 4) AS l1, round(-sqrt(list_sum([(hv[i] + r[i] - tv[i]) ** 2 FOR i IN range(1, 65)])), 4) AS l2 FROM p")
def transe_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, r, t = (F.col(c) for c in ("hv", "r", "tv"))
    return pairs(spark, sf_dir).select("h", "t", F.round(S.transe(h, r, t, 1), 4).alias("l1"), F.round(S.transe(h, r, t, 2), 4).alias("l2"))


@register(f"WITH {PAIR_SQL} SELECT h, t, round(list_sum([hv[i] * r[i] * tv[i] FOR i IN range(1, 65)]), 6) AS score FROM p")
def distmult_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("h", "t", F.round(S.distmult(F.col("hv"), F.col("r"), F.col("tv")), 6).alias("score"))


@register(f"WITH {PAIR_SQL} SELECT h, t, round(list_sum([hv[i] * r[i] * tv[i] + hv[i + 32] * r[i] * tv[i + 32] + hv[i] * r[i + 32] * tv[i + 32] - hv[i + 32] * r[i + 32] * tv[i] FOR i IN range(1, 33)]), 6) AS score FROM p")
def complex_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [S.half(F.col(c), s) for c in ("hv", "r", "tv") for s in (False, True)]
    return pairs(spark, sf_dir).select("h", "t", F.round(S.complex_score(*parts), 6).alias("score"))


@register(f"WITH {PAIR_SQL} SELECT h, t, round(12.0 - list_sum([abs(hv[i] * cos(r[i]) - hv[i + 32] * sin(r[i]) - tv[i]) + abs(hv[i] * sin(r[i]) + hv[i + 32] * cos(r[i]) - tv[i + 32]) FOR i IN range(1, 33)]), 4) AS score FROM p")
def rotate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, r, t = (F.col(c) for c in ("hv", "r", "tv"))
    s = S.rotate(S.half(h, False), S.half(h, True), S.half(r, False), S.half(t, False), S.half(t, True))
    return pairs(spark, sf_dir).select("h", "t", F.round(s, 4).alias("score"))


FUSE = "SELECT doc_id, coalesce(quality, 0) / 2.0 + 0.25 AS kge, CAST(toxic = 1 AS BOOLEAN) AS success, doc_id % 7 / 7.0 AS lp, doc_id % 3 = 0 AS sym FROM labels"


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.coalesce("quality", F.lit(0)) / 2.0 + 0.25).alias("kge"), (F.col("toxic") == 1).alias("success"), (d % 7 / 7.0).alias("lp"), (d % 3 == 0).alias("sym"))


@register(f"SELECT doc_id, round(ln(greatest(kge, 1e-9)) + CASE WHEN success THEN 1.0 ELSE -100.0 END, 6) AS hybrid, round(lp - CASE WHEN success THEN 0.0 ELSE 100.0 END, 6) AS proof, round(2.0 * kge + 1.0 * lp, 6) AS weighted FROM ({FUSE})")
def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s, p = F.col("kge"), F.col("success"), F.col("lp")
    return fused(spark, sf_dir).select("doc_id", F.round(S.hybrid(k, s), 6).alias("hybrid"), F.round(S.proof_only(p, s), 6).alias("proof"), F.round(S.weighted(k, p, 2.0, 1.0), 6).alias("weighted"))


@register(f"WITH f AS ({FUSE}), a AS (SELECT *, 1 / (1 + exp(-0.5)) AS u, 1 / (1 + exp(1.0)) AS w FROM f) SELECT doc_id, round(u * lp + (1 - u) * kge, 6) AS linear, round(CASE WHEN success THEN u * lp + (1 - u) * kge ELSE w * lp + (1 - w) * kge END, 6) AS gated, round(1.5 * kge + CASE WHEN success THEN CASE WHEN sym THEN 0.5 ELSE 1.0 END ELSE -(CASE WHEN sym THEN 0.5 ELSE 1.0 END) * 10.0 END, 6) AS by_type FROM a")
def gated_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s, p = F.col("kge"), F.col("success"), F.col("lp")
    return fused(spark, sf_dir).select("doc_id", F.round(S.linear_bridge(p, k, 0.5), 6).alias("linear"), F.round(S.gated_bridge(p, k, s, 0.5, -1.0), 6).alias("gated"), F.round(S.type_bridge(k, s, F.col("sym"), 1.5, 0.5, 1.0, 10.0), 6).alias("by_type"))


def top_tails(v: DataFrame, k: int) -> DataFrame:
    """(label, h, t, score, rank): k best tails of every head and relation by DistMult."""
    return best_links(v, relations(v), k).select("label", F.col("anchor").alias("h"), F.col("entity").alias("t"), "score", "rank")


TOP_SQL = f"e AS ({E_SQL}), rel AS ({REL_SQL}), hr AS (SELECT vec_id AS h, rel.label, [v[i] * r[i] FOR i IN range(1, 65)] AS x FROM e, rel), s AS (SELECT hr.label, h, e.vec_id AS t, list_dot_product(x, v) AS score FROM hr JOIN e ON h <> e.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY label, h ORDER BY score DESC, t) AS rank FROM s QUALIFY rank <= 5)"


@register(f"WITH {TOP_SQL} SELECT label, h, t, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k")
def topk_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: five best tails of every vector under every relation."""
    return top_tails(vectors(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


@register(f"WITH {TOP_SQL} SELECT label, h, t, round(1 / (1 + exp(-score)), 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE t <> h + 1")
def soft_facts_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top tails that aren't known facts (v, v + 1); filtered after ranking, so ranks keep gaps."""
    e = vectors(spark, sf_dir)
    known = e.select(F.col("vec_id").alias("h"), (F.col("vec_id") + 1).alias("t"))
    return top_tails(e, 5).join(known, ["h", "t"], "left_anti").select("label", "h", "t", F.round(S.sigmoid(F.col("score")), 6).alias("score"), "rank")


@register("WITH c AS (SELECT count(DISTINCT vec_id) AS e, count(DISTINCT label) AS r FROM embeddings), k AS (SELECT e, r, CAST(least(10, 25, greatest(1, floor(512 * 1048576 / (e * r * 2 * 20.0)))) AS INTEGER) AS k FROM c), f AS (SELECT *, e * r * 2 * k * (1 - least(0.3, 1.0 / e * k)) AS facts FROM k) SELECT e, r, k, round(facts, 4) AS facts, round(facts * 50, 4) AS text_bytes, round(facts * 20, 4) AS parquet_bytes FROM f")
def soft_fact_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected number and size of soft facts, asked for 25 a head: k is 10 at most, and what 512 MB hold."""
    c = vectors(spark, sf_dir).agg(F.countDistinct("vec_id").alias("e"), F.countDistinct("label").alias("r"))
    c = c.withColumn("k", S.capped_k(F.lit(25), F.col("e"), F.col("r")))
    n = S.soft_facts_expected(F.col("e"), F.col("r"), F.col("k"), 1.0 / F.col("e"))
    return c.select("e", "r", "k", F.round(n, 4).alias("facts"), F.round(n * 50, 4).alias("text_bytes"), F.round(n * 20, 4).alias("parquet_bytes"))


@register(f"WITH {PAIR_SQL} SELECT h, [round(r[i] + hv[i] - tv[i], 4) FOR i IN [1, 2, 3]] AS atom, round(list_sum([hv[i] * tv[i] FOR i IN range(1, 65)]) / sqrt(list_sum([x * x FOR x IN hv]) * list_sum([x * x FOR x IN tv])), 4) AS cosine FROM p".replace("[round(r[i] + hv[i] - tv[i], 4) FOR i IN [1, 2, 3]] AS atom", "round(list_sum([r[i] + hv[i] - tv[i] FOR i IN range(1, 65)]), 4) AS atom_sum"))
def atom_embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the atom vector p + (h - t), and the cosine that action logits use."""
    h, r, t = (F.col(c) for c in ("hv", "r", "tv"))
    return pairs(spark, sf_dir).select("h", F.round(S.total(S.add(r, S.subtract(h, t))), 4).alias("atom_sum"), F.round(S.dot(h, t) / F.sqrt(S.dot(h, h) * S.dot(t, t)), 4).alias("cosine"))


BOTH_SQL = f"e AS ({E_SQL}), rel AS ({REL_SQL}), s AS (SELECT rel.label, a.vec_id AS anchor, b.vec_id AS entity, role, CASE role WHEN 'tail' THEN -sqrt(list_sum([(a.v[i] + r[i] - b.v[i]) ** 2 FOR i IN range(1, 65)])) ELSE -sqrt(list_sum([(b.v[i] + r[i] - a.v[i]) ** 2 FOR i IN range(1, 65)])) END AS transe, CASE role WHEN 'tail' THEN list_sum([a.v[i] * r[i] * b.v[i] + a.v[i + 32] * r[i] * b.v[i + 32] + a.v[i] * r[i + 32] * b.v[i + 32] - a.v[i + 32] * r[i + 32] * b.v[i] FOR i IN range(1, 33)]) ELSE list_sum([b.v[i] * r[i] * a.v[i] + b.v[i + 32] * r[i] * a.v[i + 32] + b.v[i] * r[i + 32] * a.v[i + 32] - b.v[i + 32] * r[i + 32] * a.v[i] FOR i IN range(1, 33)]) END AS complex FROM e a JOIN e b ON a.vec_id <> b.vec_id JOIN rel ON rel.label < 2, (SELECT unnest(['head', 'tail']) AS role) WHERE a.vec_id % 20 = 0)"


@register(f"WITH {BOTH_SQL} SELECT label, role, anchor, entity, round(transe, 6) AS score, CAST(row_number() OVER (PARTITION BY label, role, anchor ORDER BY transe DESC, entity) AS INTEGER) AS rank FROM s QUALIFY rank <= 3")
def topk_both_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report of heads and of tails by TransE, of every twentieth vector and two relations."""
    return _both(spark, sf_dir, "transe")


@register(f"WITH {BOTH_SQL} SELECT label, role, anchor, entity, round(complex, 6) AS score, CAST(row_number() OVER (PARTITION BY label, role, anchor ORDER BY complex DESC, entity) AS INTEGER) AS rank FROM s QUALIFY rank <= 3")
def all_entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by ComplEx."""
    return _both(spark, sf_dir, "complex")


def _both(spark: SparkSession, sf_dir: str, scorer: str) -> DataFrame:
    e = vectors(spark, sf_dir)
    found = best_links(e, relations(e).where("label < 2"), 3, ("head", "tail"), scorer)
    return found.where("anchor % 20 = 0").select("label", "role", "anchor", "entity", F.round("score", 6).alias("score"), "rank")


#: Weights of the learned scorers by a rule that SQL can repeat: sines of whole numbers.
def _sines(*shape: int) -> np.ndarray:
    return np.sin(np.arange(1, 1 + int(np.prod(shape)), dtype=float)).reshape(shape) / 4


def short_pairs(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    cut = lambda c: F.slice(c, F.lit(1), n).alias(c)
    return pairs(spark, sf_dir).select("h", "t", cut("hv"), cut("r"), cut("tv"))


@register(f"WITH {PAIR_SQL} SELECT h, t, round(list_sum([list_sum([list_sum([sin((i - 1) * 16 + (j - 1) * 4 + k) / 4 * tv[k] FOR k IN range(1, 5)]) * r[j] FOR j IN range(1, 5)]) * hv[i] FOR i IN range(1, 5)]), 6) AS score FROM p")
def tucker_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = neural.tucker(short_pairs(spark, sf_dir, 4), _sines(4, 4, 4), ["h", "t"])
    return x.select("h", "t", F.round("score", 6).alias("score"))


#: Image 4 x 2 of four numbers of head and relation, one filter 2 x 2, three places, four outputs.
CONV_SQL = (
    f"WITH {PAIR_SQL}, i AS (SELECT h, t, tv, [(x - 0.1) / sqrt(2.0 + 1e-5) * 1.5 + 0.2 FOR x IN list_concat(hv[1:4], r[1:4])] AS x FROM p), "
    "m AS (SELECT h, t, tv, [greatest(((x[y] * sin(1) + x[y + 1] * sin(2) + x[y + 2] * sin(3) + x[y + 3] * sin(4)) / 4 + 0.05) / sqrt(0.5 + 1e-5) * 0.8 - 0.01, 0) FOR y IN [1, 3, 5]] AS m FROM i) "
    "SELECT h, t, round(list_sum([tv[d] * greatest(0, (m[1] * sin(d) / 4 + m[2] * sin(4 + d) / 4 + m[3] * sin(8 + d) / 4 + 0.3 - 0.0) / sqrt(1.0 + 1e-5)) FOR d IN range(1, 5)]) + 0.7, 6) AS score FROM m"
)


@register(CONV_SQL)
def conv_e_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    norms = ([0.1], [2.0], [1.5], [0.2]), ([-0.05], [0.5], [0.8], [-0.01]), ([0.0] * 4, [1.0] * 4, [1.0] * 4, [0.0] * 4)
    x = neural.conv_e(short_pairs(spark, sf_dir, 4), _sines(1, 2, 2), _sines(3, 4), 2, ["h", "t"], norms, (np.full(4, 0.3), 0.7))
    return x.select("h", "t", F.round("score", 6).alias("score"))


@register(f"SELECT doc_id, round(list_sum([greatest(0, lp * sin(j) / 4 + kge * sin(3 + j) / 4 + sin(j) / 4) * sin(j) / 4 FOR j IN range(1, 4)]), 6) AS score FROM ({FUSE})")
def mlp_bridge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fused(spark, sf_dir).select("doc_id", F.col("lp").alias("proof"), "kge")
    return neural.mlp_bridge(x, _sines(2, 3), _sines(3), _sines(3), ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


@register(f"WITH f AS ({FUSE}), w AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 1.5 WHEN 1 THEN -0.5 WHEN 2 THEN 0.0 ELSE 0.5 END AS a FROM f) SELECT doc_id, round(lp / (1 + exp(-a)) + kge * (1 - 1 / (1 + exp(-a))), 6) AS score FROM w")
def predicate_bridge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge by a table of weights of three predicates; the fourth has the default."""
    w = spark.createDataFrame([(0, 1.5), (1, -0.5), (2, 0.0)], "pred long, alpha double")
    x = fused(spark, sf_dir).withColumn("pred", F.col("doc_id") % 4).join(small(w), "pred", "left")
    return x.select("doc_id", F.round(S.predicate_bridge(F.col("lp"), F.col("kge"), F.col("alpha")), 6).alias("score"))


@register(
    f"WITH {PAIR_SQL} SELECT h, round(list_sum([r[i] + hv[i] + tv[i] FOR i IN range(1, 65)]), 4) + 0.0 AS summed, round(list_sum([(hv[i] * r[i] - hv[i + 32] * r[i + 32]) * tv[i] + (hv[i] * r[i + 32] + hv[i + 32] * r[i]) * tv[i + 32] FOR i IN range(1, 33)]), 4) + 0.0 AS complex_real, "
    "round(list_sum([hv[i] * cos(r[i]) - hv[i + 32] * sin(r[i]) - tv[i] FOR i IN range(1, 33)]), 4) + 0.0 AS rotate_real, 192 AS concat_size, round(list_sum([(2 * r[i] + hv[i] - tv[i] + hv[i] + tv[i]) / 2 FOR i IN range(1, 65)]), 4) + 0.0 AS state_mean, round(list_sum([2 * r[i] + 2 * hv[i] FOR i IN range(1, 65)]), 4) + 0.0 AS state_sum, 128 AS state_concat_size FROM p"
)
def state_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms by four embedders, and states of the transe and the sum atom by mean, sum and concat."""
    h, r, t = (F.col(c) for c in ("hv", "r", "tv"))
    x = pairs(spark, sf_dir).select("h", *[S.atom_vector(k, h, r, t).alias(k) for k in ("transe", "sum", "complex", "rotate", "concat")])
    atoms = F.array("transe", "sum")
    first = lambda c: F.slice(c, F.lit(1), 32)
    return x.select(
        *("h", F.round(S.total(F.col("sum")), 4).alias("summed"), F.round(S.total(first("complex")), 4).alias("complex_real"), F.round(S.total(first("rotate")), 4).alias("rotate_real")),
        *(F.size("concat").alias("concat_size"), F.round(S.total(S.state_vector("mean", atoms, 64)), 4).alias("state_mean"), F.round(S.total(S.state_vector("sum", atoms, 64)), 4).alias("state_sum")),
        F.size(S.state_vector("concat", atoms, 64)).alias("state_concat_size"),
    )


@register("SELECT e.vec_id, round(list_sum([coalesce(n.embedding[i], e.embedding[i]) FOR i IN range(1, 65)]), 4) AS total FROM embeddings e LEFT JOIN embeddings n ON n.vec_id = e.vec_id * 2".replace("coalesce(n.embedding[i], e.embedding[i])", "CAST(coalesce(n.embedding[i], e.embedding[i]) AS DOUBLE)"))
def embedding_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors replaced by those of the matching name where there is one; others stay."""
    e = vectors(spark, sf_dir)
    n = e.select(F.col("vec_id").alias("k"), F.col("v").alias("nv"))
    return e.join(n, F.col("vec_id") * 2 == F.col("k"), "left").select("vec_id", F.round(S.total(F.coalesce("nv", "v")), 4).alias("total"))
