"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as _registry
from .queries import episodes, graph, learning, negatives, proofs, ranking, scoring, text  # noqa: F401  they register

FLAGSHIP = "min_proof_depth"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_registry.SQL)
