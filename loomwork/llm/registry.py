"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import alignment, bpe, divergence, fingerprints, jaccard, language, mixing, quality, sharding, substrings, suffixes, topk, toxicity

_MODULES = (language, mixing, jaccard, bpe, topk, toxicity, substrings, suffixes, sharding, fingerprints, alignment, divergence, quality)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "SQL", {}).items()}
