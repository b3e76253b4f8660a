"""A corpus from raw documents to token ids, in five stages; counted as part of ``kgweave.llm``.

Every stage works on all rows that the one before it kept, and writes nothing but scratch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgweave.llm import decontam, mixing, simhash, token_codes, toxicity
from kgweave.llm.common import Scratch, read
from kgweave.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.5."""
    return toxicity.drop_toxic(spark, docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of texts with 0.8 of their 5-word shingles in common."""
    return simhash.keep_first(spark, docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ``benchmark``."""
    return decontam.drop_leaked(spark, docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix; a document that it takes twice is two rows."""
    return mixing.mix(spark, docs)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files; a row for each document with its place in them, read from the files."""
    return token_codes.round_trip(spark, docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_ids", to_token_ids),
]

#: A language model's scores, SimHash groups and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``: a row for each document that is left, with its place in the files.

    Each stage defines what nulls, empty and long texts, repeated rows and empty tables become; rows
    with a null doc_id pass all of them, and columns beside doc_id, text and source are not looked at.
    """
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
