"""Where the catalog modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Bound tables by name: `t.lineitem`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return load_table(self.spark, self.folder, name)

    @property
    def texts(self) -> DataFrame:
        """The documents, spread for work on their texts."""
        return spread(self.documents, "doc_id")


def query(name: str, sql: str | None = None):
    """Enter a function of `Tables` as a query; `sql` gives the same result in DuckDB."""

    def enter(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return enter
