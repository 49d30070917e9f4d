"""Filters and content keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pitch import c, js_round
from ..functions.text import TOC_ENTRY


def match_any(text, names: str) -> Column:
    """True where the text holds any of the `|`-separated parts."""
    return reduce(lambda a, b: a | b, [c(text).contains(part) for part in names.split("|")])


def clip_range(df: DataFrame, pos: Column, start: Column, until: Column) -> DataFrame:
    return df.filter((pos >= start) & (pos < until))


def is_toc_page(line: Column, entry: str = TOC_ENTRY, least: int = 8, share: float = 0.5) -> Column:
    """Aggregate over the lines of a page."""
    n = F.count(F.lit(1))
    return (n >= least) & (F.count_if(line.rlike(entry)) >= n * share)


def is_index_page(line: Column, entry: str = TOC_ENTRY, tail: str = r"\d\s*$", least: int = 10, share: float = 0.6) -> Column:
    n = F.count(F.lit(1))
    return (n >= least) & (F.count_if(line.rlike(tail) & ~line.rlike(entry)) >= n * share)


def doubt_items(items: DataFrame, fixed: DataFrame, item: str) -> DataFrame:
    """Doubted items (verse NULL) and doubted verses not yet settled.

    `items`: item, edited, doubt, verses (doubted verses that have text); `fixed`: item, verse.
    """
    live = items.filter(~F.col("edited"))
    whole = live.filter("doubt").select(item, F.lit(None).cast("bigint").alias("verse"))
    verses = live.select(item, F.explode("verses").alias("verse")).join(fixed, [item, "verse"], "left_anti")
    return whole.unionByName(verses)


def shape_points(points, quant: int = 50) -> Column:
    """Outline x0,y0,x1,y1,... -> text of its points moved to the origin and scaled to `quant` units of height."""
    p = c(points)
    xs = F.filter(p, lambda v, i: i % 2 == 0)
    ys = F.filter(p, lambda v, i: i % 2 == 1)
    x0, y0 = F.array_min(xs), F.array_min(ys)
    h = F.array_max(ys) - y0
    h = F.when(h > 0, h).otherwise(F.lit(1.0))
    moved = F.transform(p, lambda v, i: js_round((v - F.when(i % 2 == 0, x0).otherwise(y0)) * quant / h).cast("string"))
    return F.array_join(moved, ",")


def shape_key(points, quant: int = 50) -> Column:
    """Hash under which equal shapes meet, wherever and however large they are drawn."""
    return F.xxhash64(shape_points(points, quant))
