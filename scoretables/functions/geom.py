"""Interval and rectangle measures.  A rectangle is four columns x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_x(a, b) -> Column:
    return overlap_1d(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"])


def overlap_ratio_x(a, b) -> Column:
    return overlap_x(a, b) / F.least(a["w"], b["w"])


def overlap_ratio_y(a, b) -> Column:
    return overlap_1d(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"]) / F.least(a["h"], b["h"])


def overlap_frac(a, b) -> Column:
    """Shared area over the area of `a` (area counted as at least 1)."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h / F.greatest(F.lit(1.0), a["w"] * a["h"])).otherwise(F.lit(0.0))


def union_rect(a, b) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return F.struct(
        x.alias("x"), y.alias("y"),
        (F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x).alias("w"),
        (F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y).alias("h"),
    )


def rect(x, y, w, h) -> dict[str, Column]:
    return {"x": x, "y": y, "w": w, "h": h}
