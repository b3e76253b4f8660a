"""Readers of knowledge-graph text, as column expressions over a frame of lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import numbered

ATOM = r"([^()]+)\(([^()]*)\)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of every line of the text files at ``path``; splits are read in parallel."""
    return spark.read.text(path)


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and ``value``: for rule, query and depth files, whose order counts.

    A file is read in splits; its lines are numbered by the split's place in it and their order in
    the split. Several files follow one another in order of their paths.
    """
    x = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return numbered(spark, x, ["_f", "_b", "_i"], "line").select("line", "value")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def query_file(spark: SparkSession, path: str, depths: set[int] | None = None, limit: int | None = None) -> DataFrame:
    """``queries`` of a file, or, where ``<file>_depths.txt`` is beside it, of that file in its place:
    a query that it does not list is gone."""
    beside = re.sub(r"\.[^./]*$", "", path) + "_depths.txt"
    return queries(read_numbered(spark, beside if exists(spark, beside) else path), depths, limit)


def _clean_args(inside: Column) -> Column:
    return F.transform(F.split(inside, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))


def parse_atom(value: Column) -> Column:
    """struct(pred, args) of ``pred(a, b).``; a line without parenthesis is a predicate without
    arguments; null for an unclosed atom or an empty predicate."""
    s = F.regexp_replace(F.trim(value), r"\.$", "")
    plain = F.when((F.instr(s, "(") == 0) & (s != ""), F.struct(F.trim(s).alias("pred"), F.array().cast("array<string>").alias("args")))
    pred, inside = F.trim(F.regexp_extract(s, r"^([^(]*)\((.*)\)$", 1)), F.regexp_extract(s, r"^([^(]*)\((.*)\)$", 2)
    return F.when(s.rlike(r"^[^(]*\(.*\)$") & (pred != ""), F.struct(pred.alias("pred"), _clean_args(inside).alias("args"))).otherwise(plain)


def _atom_lines(lines: DataFrame) -> DataFrame:
    """x: the atoms of lines that are facts of any number of arguments."""
    v = F.trim("value")
    skip = (v == "") | v.startswith("%") | v.startswith("one_step") | v.contains(":-") | v.contains("findall") | v.rlike(r"^\W+$")
    return lines.where(~skip).select(parse_atom(v).alias("x")).where("x is not null")


def facts(lines: DataFrame) -> DataFrame:
    """(pred, h, t) of the lines (value) that are binary facts.

    Blank lines, comments, directives, rules, helper clauses and what doesn't parse are skipped.
    """
    atom = _atom_lines(lines).where("size(x.args) = 2")
    return atom.select(F.col("x.pred").alias("pred"), F.col("x.args")[0].alias("h"), F.col("x.args")[1].alias("t"))


def _atoms(text: Column) -> Column:
    """array<struct<p,a,b>> of the binary atoms in a text."""
    return F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(r"\w+\([^()]*\)"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("p"), _clean_args(F.regexp_extract(x, r"\((.*)\)", 1)).alias("args"))),
        lambda x: F.size(x["args"]) == 2,
    )


def _upper(atoms: Column) -> Column:
    return F.transform(atoms, lambda x: F.struct(x["p"].alias("p"), F.upper(x["args"][0]).alias("a"), F.upper(x["args"][1]).alias("b")))


def rules(lines: DataFrame) -> DataFrame:
    """(head, body) of rule lines ``head :- body``, ``body -> head`` and bare facts.

    Arguments are upper-cased: in rules they are variables. A leading id and confidence are left
    out, as atoms are found by pattern. Lines with no binary head are skipped.
    """
    v = F.trim("value")
    parts = F.when(v.contains(":-"), F.struct(F.split(v, ":-")[0].alias("head"), F.split(v, ":-")[1].alias("body"))).when(v.contains("->"), F.struct(F.split(v, "->")[1].alias("head"), F.split(v, "->")[0].alias("body")))
    parts = F.coalesce(parts, F.struct(v.alias("head"), F.lit("").alias("body")))
    keep = [c for c in lines.columns if c != "value"]
    x = lines.where((v != "") & ~v.startswith("%")).select(*keep, _upper(_atoms(parts["head"])).alias("heads"), _upper(_atoms(parts["body"])).alias("body"))
    return x.where(F.size("heads") >= 1).select(*keep, F.col("heads")[0].alias("head"), "body")


def queries(lines: DataFrame, depths: set[int] | None = None, limit: int | None = None) -> DataFrame:
    """(line, pred, h, t, depth) of ``atom [depth]`` lines (line, value), in order of line.

    A last word that is no integer skips the line; no last word is depth -1. ``depths`` keeps some
    depths only; ``limit`` counts kept rows.
    """
    v = F.trim("value")
    atom = parse_atom(F.regexp_extract(v, r"^(.*?\))\.?\s*(\S*)$", 1))
    tail = F.regexp_extract(v, r"^(.*?\))\.?\s*(\S*)$", 2)
    x = lines.select("line", atom.alias("x"), F.when(tail == "", F.lit(-1)).otherwise(F.expr("try_cast(regexp_extract(trim(value), '^(.*?\\\\))\\\\.?\\\\s*(\\\\S*)$', 2) as int)")).alias("depth"))
    x = x.where("x is not null and size(x.args) = 2 and depth is not null")
    if depths is not None:
        x = x.where(F.col("depth").isin(*depths))
    out = x.select("line", F.col("x.pred").alias("pred"), F.col("x.args")[0].alias("h"), F.col("x.args")[1].alias("t"), "depth")
    return out.orderBy("line").limit(limit) if limit is not None else out


def depth_map(lines: DataFrame) -> DataFrame:
    """(pred, h, t, depth): of lines that repeat an atom the last one counts."""
    return queries(lines).groupBy("pred", "h", "t").agg(F.max_by("depth", "line").alias("depth"))


def soft_facts(lines: DataFrame, top_k: int | None = None, least: float | None = None) -> DataFrame:
    """(pred, h, t, score, rank) of ``atom score [rank]`` lines (line, value).

    ``#`` lines are comments; rows past ``top_k`` or under ``least`` go; of repeated atoms the
    first line counts.
    """
    pattern = r"^(.*\))\s+(\S+)(?:\s+(\d+))?\s*$"
    v = F.trim("value")
    x = lines.where(~v.startswith("#") & v.rlike(pattern)).select("line", parse_atom(F.regexp_extract(v, pattern, 1)).alias("x"), F.regexp_extract(v, pattern, 2).try_cast("double").alias("score"), F.regexp_extract(v, pattern, 3).try_cast("int").alias("rank"))
    x = x.where("x is not null and size(x.args) = 2 and score is not null")
    if top_k is not None:
        x = x.where(F.col("rank").isNull() | (F.col("rank") <= top_k))
    if least is not None:
        x = x.where(F.col("score") >= least)
    x = x.select("line", F.col("x.pred").alias("pred"), F.col("x.args")[0].alias("h"), F.col("x.args")[1].alias("t"), "score", "rank")
    return x.groupBy("pred", "h", "t").agg(F.min_by("score", "line").alias("score"), F.min_by("rank", "line").alias("rank"))


def domains(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(domain, entity) with an entity's last line counting, and (pred, head_domain, tail_domain)."""
    v = F.trim("value")
    of_preds = lines.where(v.rlike(r"^[^:\s]+:[^:\s]+:[^:\s]+$")).select(F.split(v, ":").alias("p")).select(F.col("p")[0].alias("pred"), F.col("p")[1].alias("head_domain"), F.col("p")[2].alias("tail_domain"))
    words = lines.where((v != "") & ~v.contains(":")).select("line", F.split(v, r"\s+").alias("w"))
    each = words.select("line", F.col("w")[0].alias("domain"), F.explode(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0)))).alias("entity"))
    return each.groupBy("entity").agg(F.max_by("domain", "line").alias("domain")).select("domain", "entity"), of_preds


def program(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts (pred, h, t) and rules (head, body) of one file (value) that holds both; directives and
    helper clauses are neither."""
    v = F.trim("value")
    clause = v.contains(":-") & ~v.startswith(":-") & ~v.startswith("one_step") & ~v.contains("findall")
    return facts(lines), rules(lines.where(clause))


def score_table(spark: SparkSession, path: str) -> DataFrame:
    """(pred, h, t, score) of a tab-separated file of atoms and scores, with a header ``atom score`` or
    none. What is no number or no binary atom is skipped; of lines that repeat an atom the last counts."""
    p = F.split("value", "\t")
    x = read_numbered(spark, path).select("line", parse_atom(F.get(p, F.lit(0))).alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("score"))
    x = x.where("x is not null and size(x.args) = 2 and score is not null")
    return x.groupBy(F.col("x.pred").alias("pred"), F.col("x.args")[0].alias("h"), F.col("x.args")[1].alias("t")).agg(F.max_by("score", "line").alias("score"))


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) of a JSON object of ids, as models are saved with."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("name", "id"))


def config(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON configuration: keys of nested objects joined by dots, values as text."""
    x = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    done = None
    while True:
        inner = F.col("value").startswith("{")
        flat = x.where(~F.coalesce(inner, F.lit(False)))
        done = flat if done is None else done.unionAll(flat)
        nested = x.where(inner)
        if nested.isEmpty():
            return done
        x = nested.select("key", F.explode(F.from_json("value", "map<string,string>")).alias("k", "value")).select(F.concat_ws(".", "key", "k").alias("key"), "value")


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(pred, h, t) of a file in the format that its first line that isn't blank shows: tab- or
    comma-separated head, relation, tail, or facts; facts that are not binary are an error."""
    lines = read_lines(spark, path).where(F.trim("value") != "")
    first = lines.first()
    sep = "\t" if first and first.value.count("\t") >= 2 else "," if first and first.value.count(",") >= 2 and "(" not in first.value else None
    if sep is None:
        odd = _atom_lines(lines).where("size(x.args) <> 2").select("x.pred").limit(5).collect()
        if odd:
            raise ValueError(f"predicates that are not binary, among: {[r.pred for r in odd]}")
        return facts(lines)
    p = F.transform(F.split("value", sep), lambda x: F.trim(x))
    return lines.select(p.alias("p")).where("size(p) >= 3").select(F.col("p")[1].alias("pred"), F.col("p")[0].alias("h"), F.col("p")[2].alias("t"))


def run_log(lines: DataFrame) -> DataFrame:
    """(line, label, key, value, text) of ``label;k:v;...`` lines (line, value).

    ``mean +/- std (n)`` gives three keys; value is null where the text is no number.
    """
    kv = lines.select("line", F.split("value", ";").alias("p")).select("line", F.trim(F.col("p")[0]).alias("label"), F.explode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).alias("kv")).where(F.col("kv").contains(":"))
    x = kv.select("line", "label", F.trim(F.regexp_extract("kv", "^([^:]*):(.*)$", 1)).alias("key"), F.trim(F.regexp_extract("kv", "^([^:]*):(.*)$", 2)).alias("text"))
    stat = r"^(-?[\d.eE+-]+)\s*\+/-\s*([\d.eE+-]+)\s*\((\d+)\)$"
    many = F.array(*[F.struct(F.concat("key", F.lit(s)).alias("key"), F.regexp_extract("text", stat, i).alias("text")) for s, i in (("_mean", 1), ("_std", 2), ("_count", 3))])
    one = F.array(F.struct("key", "text"))
    y = x.select("line", "label", F.explode(F.when(F.col("text").rlike(stat), many).otherwise(one)).alias("e"))
    return y.select("line", "label", F.col("e.key").alias("key"), F.col("e.text").try_cast("double").alias("value"), F.col("e.text").alias("text"))


def sorted_ids(names: DataFrame) -> DataFrame:
    """(name, id): ids from 1 in order of name; 0 is left for padding."""
    return numbered(names.sparkSession, names.select("name").distinct(), ["name"], "id", 1)


def appearance_ids(names: DataFrame) -> DataFrame:
    """(name, id): ids from 0 in order of first appearance (line, name)."""
    first = names.groupBy("name").agg(F.min("line").alias("line"))
    return numbered(names.sparkSession, first, ["line", "name"], "id").select("name", F.col("id").cast("int").alias("id"))
