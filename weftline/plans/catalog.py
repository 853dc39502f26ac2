"""All queries of the core by name, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import business, corpora, evaluation, matching, problems, scores, sourced, store, structures

REGISTRIES = (business.registry, store.registry, evaluation.registry, corpora.registry, structures.registry, matching.registry, scores.registry, sourced.registry)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return problems.QUERIES | {name: query for r in REGISTRIES for name, query in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return problems.SQL | {name: sql for r in REGISTRIES for name, sql in r.sql.items()}
