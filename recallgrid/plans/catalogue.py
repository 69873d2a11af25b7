"""All registered queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .. import registry

MODULES = (
    "operators.predicates", "operators.keyword", "operators.vector", "operators.ranking", "operators.routing", "operators.graph", "operators.entity", "operators.extraction", "operators.temporal", "operators.erasure", "operators.sketches",
    "operators.reports", "operators.lifecycle", "operators.documents", "operators.extras", "sources.transfer", "operators.stores", "streaming.jobs", "plans.search",
)


def _load() -> None:
    for m in MODULES:
        import_module(f"recallgrid.{m}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import entry as flagship

    return flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
