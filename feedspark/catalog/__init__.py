"""Registered queries: each operator over the given tables, with the equal SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedspark.catalog import editorial, feeds, posts, reports, stored, streams, usage
from feedspark.session import REQUIRED_CONF

_MODULES = (feeds, stored, editorial, usage, posts, reports, streams)


def _in_utc(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for key, value in REQUIRED_CONF.items():
            spark.conf.set(key, value)
        return build(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _in_utc(build) for module in _MODULES for name, (build, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
