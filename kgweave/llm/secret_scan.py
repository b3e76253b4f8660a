"""Secret scans: candidates by pattern, false positives removed by a random forest.

All of a scan is DataFrame expressions. Every long run of characters that secrets are made of is a
candidate, with its offset and neighbours. Features are its length, kinds of character and
transitions between them, cover by the corpus' own frequent words, the path and the neighbouring
words. A forest grown on the driver from a bounded sample of labelled findings is compiled to one
SQL expression, which scores every candidate inside the scan.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .secret_samples import samples

#: A candidate: a run of these characters, of LEAST or more and any length.
LEAST = 8
RUN = r"[A-Za-z0-9+/_\-]{8,}"
#: Characters of the neighbouring words that are looked at on either side.
BEFORE, AFTER = 40, 24

# Words that speak for or against a secret beside them, or in a path.
KEYWORDS = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth|bearer|credential|private)"
DECOYS = r"(?i)(example|sample|dummy|fake|placeholder|changeme|your|xxxx|uuid|guid|sha\d*|md5|commit|checksum|version|phone|isbn|doi|https?)"
PATHS = r"(?i)(test|example|sample|doc|fixture|mock|demo)"

#: Frequent words that make up the dictionary; shorter ones are none.
DICTIONARY, WORD = 2000, 3
#: Labelled findings of each class a forest is grown from, at most, by a hash of their place; its size.
FIT_ROWS, TREES, DEPTH, LEAF, SEED = 6000, 16, 7, 3, 11

FEATURES = ("length", "digits", "upper", "lower", "symbols", "turns_lower_digit", "turns_upper_digit", "turns_case", "vowels", "turns_vowel", "hex_only", "digits_only", "covered", "assigned", "quoted", "keyword_near", "keyword_own", "decoy_near", "decoy_own", "path_decoy", "at_sign", "dots", "slashes")


def dictionary(docs: DataFrame) -> list[str]:
    """The DICTIONARY most frequent words of letters in all documents."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}]+")).alias("w")).where(F.length("w") >= WORD)
    return [r.w for r in words.groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(DICTIONARY).collect()]


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however often lambdas use it."""
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


def candidates(docs: DataFrame, known: list[str], path: str) -> DataFrame:
    """doc_id, start, value and FEATURES of every candidate in ``docs`` (doc_id, text, path).

    The text is cut at its candidates, so what stands between two is a piece; neighbouring words are
    the ends of pieces. start: characters of the text before it, summed over blocks of the pieces'
    lengths, so that a text with n candidates takes steps of n times the root of n.
    """
    text = F.col("text").cast("string")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), text.alias("text")).where(text.rlike(RUN))
    x = _once(x, "cut", F.struct(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)).alias("runs"), F.split("text", RUN, -1).alias("gaps")))
    x = x.select("doc_id", "path", F.col("cut.runs").alias("runs"), F.col("cut.gaps").alias("gaps"))
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, n: a + n)
    x = _once(x, "sizes", F.zip_with("gaps", "runs", lambda g, r: (F.length(g) + F.coalesce(F.length(r), F.lit(0))).cast("long")))
    width = F.ceil(F.sqrt(F.size("runs"))).cast("int")
    x = _once(x, "wide", width)
    x = _once(x, "blocks", F.transform(F.sequence(F.lit(0), F.floor((F.size("runs") - 1) / F.col("wide")).cast("int")), lambda b: total(F.slice("sizes", b * F.col("wide") + 1, F.col("wide")))))

    def at(name: str, i: Column) -> Column:
        return F.coalesce(F.get(name, i), F.lit(""))

    def one(run: Column, i: Column) -> Column:
        block = F.floor(i / F.col("wide")).cast("int")
        start = total(F.slice("blocks", F.lit(1), block)) + total(F.slice("sizes", block * F.col("wide") + 1, i - block * F.col("wide"))) + F.length(at("gaps", i))
        # A piece may be long, so its end is cut off before it is joined to others.
        before = F.concat(F.right(at("gaps", i - 1), F.lit(BEFORE)), F.right(at("runs", i - 1), F.lit(BEFORE)), F.right(at("gaps", i), F.lit(BEFORE)))
        after = F.concat(F.left(at("gaps", i + 1), F.lit(AFTER)), F.left(at("runs", i + 1), F.lit(AFTER)))
        return F.struct(start.alias("start"), run.alias("value"), F.right(before, F.lit(BEFORE)).alias("before"), F.left(after, F.lit(AFTER)).alias("after"))

    x = x.select("doc_id", "path", F.explode(F.transform("runs", one)).alias("c"))
    x = x.select("doc_id", "path", "c.start", "c.value", "c.before", "c.after")
    count = lambda pattern: F.regexp_count("value", F.lit(pattern)).cast("double")
    has = lambda name, pattern: F.col(name).rlike(pattern).cast("double")
    size = F.length("value").cast("double")
    parts = F.filter(F.split(F.lower("value"), r"[^a-z]+"), lambda w: (F.length(w) >= WORD) & (w.isin(*known) if known else F.lit(False)))
    features = {
        "length": size,
        "digits": count("[0-9]") / size,
        "upper": count("[A-Z]") / size,
        "lower": count("[a-z]") / size,
        "symbols": count(r"[+/_\-]") / size,
        "turns_lower_digit": count("[a-z](?=[0-9])|[0-9](?=[a-z])") / size,
        "turns_upper_digit": count("[A-Z](?=[0-9])|[0-9](?=[A-Z])") / size,
        "turns_case": count("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / size,
        "vowels": count("[aeiouAEIOU]") / size,
        "turns_vowel": count("[aeiouAEIOU](?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])") / size,
        "hex_only": has("value", "^([0-9a-f\\-]+|[0-9A-F\\-]+)$"),
        "digits_only": has("value", r"^[0-9+\-/]+$"),
        "covered": F.aggregate(parts, F.lit(0.0), lambda a, w: a + F.length(w)) / size,
        "assigned": has("before", "[=:][\\s\"'`]*$"),
        "quoted": has("before", "[\"'`]$"),
        "keyword_near": has("before", KEYWORDS),
        "keyword_own": has("value", KEYWORDS),
        "decoy_near": F.greatest(has("before", DECOYS), has("after", DECOYS)),
        "decoy_own": has("value", DECOYS),
        "path_decoy": has("path", PATHS),
        "at_sign": F.greatest(has("before", "@[A-Za-z0-9.]*$"), has("after", "^[A-Za-z0-9.]*@")),
        "dots": has("before", r"[A-Za-z0-9]\.$") + has("after", r"^\.[A-Za-z0-9]"),
        "slashes": F.regexp_count("value", F.lit("/")).cast("double"),
    }
    return x.select("doc_id", "start", "value", *[features[k].alias(k) for k in FEATURES])


def shipped_findings(spark: SparkSession) -> DataFrame:
    """Labelled findings that come with the library: text, path, start, label."""
    rows = [{"text": t, "path": p, "start": i, "label": y} for t, p, i, y in samples()]
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<text:string,path:string,start:bigint,label:int>>")).alias("r")).select("r.*")


def _gini(pos: float, n: float) -> float:
    p = pos / n
    return 2 * p * (1 - p) * n


def _grow(rows: list[tuple], labels: list[int], rng: random.Random, depth: int, weights: tuple[float, float]):
    """A tree: a share of label 1, or (feature, cut, below or equal, above). weights: of labels 0 and 1."""
    n, pos = len(rows), sum(labels)

    def weighed(ones: int, of: int) -> tuple[float, float]:
        return ones * weights[1], ones * weights[1] + (of - ones) * weights[0]

    share = (weighed(pos, n)[0] + 0.5) / (weighed(pos, n)[1] + 1)
    if depth == 0 or n < 2 * LEAF or pos in (0, n):
        return share
    best = None
    for f in rng.sample(range(len(FEATURES)), max(1, round(len(FEATURES) ** 0.5))):
        order = sorted(range(n), key=lambda i: rows[i][f])
        left = 0
        for k, i in enumerate(order[:-1], 1):
            left += labels[i]
            a, b = rows[i][f], rows[order[k]][f]
            if a < b and LEAF <= k <= n - LEAF:
                cost = _gini(*weighed(left, k)) + _gini(*weighed(pos - left, n - k))
                if best is None or cost < best[0]:
                    best = (cost, f, (a + b) / 2)
    if best is None:
        return share
    _, f, cut = best
    sides = [[i for i in range(n) if (rows[i][f] <= cut) == low] for low in (True, False)]
    return (f, cut, *(_grow([rows[i] for i in s], [labels[i] for i in s], rng, depth - 1, weights) for s in sides))


def grow_forest(rows: list[tuple], labels: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> list:
    """TREES trees on bootstrap samples, with a weight for either label; a forest without rows says a half."""
    rng = random.Random(SEED)
    if not rows:
        return [0.5]
    out = []
    for _ in range(TREES):
        pick = [rng.randrange(len(rows)) for _ in rows]
        out.append(_grow([rows[i] for i in pick], [labels[i] for i in pick], rng, DEPTH, weights))
    return out


def forest_score(forest: list) -> Column:
    """The forest as an expression over FEATURES: the mean of its trees."""

    def tree(t) -> Column:
        if isinstance(t, float):
            return F.lit(t)
        f, cut, low, high = t
        return F.when(F.col(FEATURES[f]) <= cut, tree(low)).otherwise(tree(high))

    total = tree(forest[0])
    for t in forest[1:]:
        total = total + tree(t)
    return total / len(forest)


def fitted(findings: DataFrame, known: list[str]) -> Column:
    """The score of a forest grown from ``findings`` (text, path, start, label).

    At most FIT_ROWS of each label, by a hash of their place, are read to the driver, and are
    weighed by how many there are of it.
    """
    place = F.xxhash64("text", "path", "start")
    rows = findings.select("text", "path", F.col("start").cast("long").alias("_at"), F.col("label").cast("int").alias("label"), place.alias("doc_id")).where(F.col("label").isin(0, 1))
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # Secrets are rare: each class is sampled by itself and weighs what it has in all.
    chosen = None
    for c in (0, 1):
        some = rows.where(F.col("label") == c).orderBy("doc_id", "_at").limit(FIT_ROWS)
        chosen = some if chosen is None else chosen.unionAll(some)
    x = candidates(chosen, known, "path").join(chosen.select("doc_id", F.col("_at").alias("start"), "label"), ["doc_id", "start"])
    sample = x.select("doc_id", "start", "label", *FEATURES).distinct().collect()
    sample.sort(key=lambda r: (r.doc_id, r.start, r.label))
    weights = tuple(max(1.0, totals.get(c, 0) / FIT_ROWS) for c in (0, 1))
    return forest_score(grow_forest([tuple(r[k] for k in FEATURES) for r in sample], [r.label for r in sample], weights))


def scan(spark: SparkSession, docs: DataFrame, findings: DataFrame | None = None, path: str = "source", least: float = 0.5) -> DataFrame:
    """Secrets in ``docs`` (doc_id, text, ``path``): doc_id, start, length, value_md5, score.

    Candidates with a forest's mean under ``least`` are false positives and are left out; 0 keeps
    every candidate. start and length are characters of the text; the value itself is not handed
    on. findings: labelled ones to learn from (text, path, start, label); by default the shipped
    ones. Null and empty texts have no finding. A null path is empty. Texts are scanned whole,
    whatever their length. Repeated rows give repeated findings. An empty table gives none. Other
    columns are not read. No shuffle but for the dictionary's counts, which are summed before it.
    """
    known = dictionary(docs)
    score = fitted(shipped_findings(spark) if findings is None else findings, known)
    found = candidates(docs, known, path)
    return found.select("doc_id", "start", F.length("value").cast("long").alias("length"), F.md5("value").alias("value_md5"), score.alias("score")).where(F.col("score") >= least)
