"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortmill.plans.views import view, with_views
from cohortmill.session import importable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables and derived views by name: t.lineitem, t.v_vox."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        return view(self.spark, self.sf_dir, name) if name.startswith("v_") else table(self.spark, self.sf_dir, name)


def query(sql: str | None = None):
    """Register f(t) under its name; sql, with views expanded, is its oracle."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add
