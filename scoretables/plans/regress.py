"""Comparing recognition runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_latest(prev: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """Last row kept per key: those of `now`, and those of `prev` for keys this run did not touch."""
    return now.unionByName(prev.join(now.select(*key), key, "left_anti"))


def saved(used: Column, scratch: Column) -> Column:
    """Share of the work from scratch that was saved, in percent; 100 when there was none to do."""
    return F.when(scratch > 0, (1 - used / scratch) * 100).otherwise(F.lit(100.0))


def _met(base: DataFrame, now: DataFrame, key: str) -> DataFrame:
    n = now.select(key, F.col("used").alias("now_used"), F.col("scratch").alias("now_scratch"))
    return base.join(n, key, "left").withColumn("__in", F.col("now_used").isNotNull())


def compare_runs(base: DataFrame, now: DataFrame, key: str, class_: str) -> DataFrame:
    """Per class: work of both runs over the keys both have, saved shares, keys, and keys the new run lacks."""
    m = _met(base, now, key)
    both = lambda c: F.coalesce(F.sum(F.when(F.col("__in"), F.col(c))), F.lit(0.0))
    g = m.groupBy(class_).agg(
        both("used").alias("base_used"), both("scratch").alias("base_scratch"), both("now_used").alias("now_used"),
        both("now_scratch").alias("now_scratch"), F.count(F.lit(1)).alias("keys"), F.count_if(~F.col("__in")).alias("missing"))
    return g.select(
        "*", saved(F.col("base_used"), F.col("base_scratch")).alias("base_saved"), saved(F.col("now_used"), F.col("now_scratch")).alias("now_saved"),
        ((F.col("now_used") > F.col("base_used")) | (F.col("missing") > 0)).alias("worse"))


def worsened(base: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Keys that need more work than in the base run."""
    m = _met(base, now, key).filter(F.col("now_used") > F.col("used"))
    return m.select(key, F.col("used").alias("base_used"), "now_used", F.col("scratch").alias("base_scratch"))


def worst_k(base: DataFrame, now: DataFrame, key: str, k: int = 25) -> DataFrame:
    """The `k` keys that got worse by most."""
    return worsened(base, now, key).orderBy((F.col("now_used") - F.col("base_used")).desc(), key).limit(k)


def changed_since(prev: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Keys in both runs whose work differs; sort by `change` for the report."""
    n = now.select(key, F.col("used").alias("now_used"))
    m = prev.select(key, "used").join(n, key).filter(F.col("used") != F.col("now_used"))
    return m.withColumn("change", F.col("now_used") - F.col("used"))
