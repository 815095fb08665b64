"""All registered queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dialoom.plans import analysis, answers, curation, evaluation, preference, records, runs

_PARTS = (curation, preference, evaluation, analysis, runs, answers, records)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for part in _PARTS for k, q in part.oracle_sql().items()}
