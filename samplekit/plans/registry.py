"""All queries of the library proper, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from samplekit.plans import compare, evaluation, features, files, sampling, stats
from samplekit.plans.bindings import full

Query = Callable[[SparkSession, str], DataFrame]
ALL = {k: v for part in (evaluation, sampling, stats, compare, features, files) for k, v in part.QUERIES.items()}


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: full(sql) for k, (_, sql) in ALL.items() if sql}
