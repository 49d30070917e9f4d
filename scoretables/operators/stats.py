"""Exact order statistics and clusters.

Values are first counted per (group, value), so equal values travel once; the running count over the
distinct values then gives every quantile in one pass, also for a group that holds most of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pitch import js_round
from ..session import cut_lineage
from .scan import ALL, BLOCK, Ordered, lag, last_value, row_number, running_sum, total


def floor_index(p: float):
    """Index convention of page statistics: floor(n * p), at most n - 1."""
    return lambda n: F.least(n - 1, F.floor(n * F.lit(p)))


def round_index(q: float):
    """Index convention of book profiles: round((n - 1) * q)."""
    return lambda n: F.greatest(F.lit(0), F.least(n - 1, js_round((n - 1) * F.lit(q))))


def median_index(n: Column) -> Column:
    return F.floor(n / 2)


def _is_floating(df: DataFrame, value: str) -> bool:
    return dict(df.dtypes)[value] in ("double", "float")


def quantiles(df: DataFrame, keys: list[str], value: str, picks: dict) -> DataFrame:
    """One row per group with `n` and, per entry of `picks`, the value at index `pick(n)` of the sorted values.

    NULL and non-finite values do not count.  Groups without values have no row.
    """
    keys = list(keys)
    ok = F.col(value).isNotNull()
    if _is_floating(df, value):
        ok = ok & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))
    counts = df.filter(ok).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__m"))
    o = Ordered.of(counts, keys, [value], probe=df.select(*keys)).add(__cum=running_sum("__m"), __n=total("sum", "__m"))
    aggs = []
    for name, pick in picks.items():
        k = pick(F.col("__n"))
        aggs.append(F.min(F.when(F.col("__cum") > k, F.col(value))).alias(name))
    by = keys or [ALL]
    return o.df.groupBy(*by).agg(F.first("__n").alias("n"), *aggs).drop(ALL)


def quantile_table(df: DataFrame, keys: list[str], picks: dict) -> DataFrame:
    """Quantiles of several columns at once: `picks` maps a result name to (column, index convention).

    The columns become rows first, so all of them share one count, one shuffle and one sort.
    """
    keys = list(keys)
    cols = list(dict.fromkeys(src for src, _ in picks.values()))
    return _picked(_counted(df, keys, cols), keys, cols, picks)


def _counted(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys, __v, __x, __m): how often each value stands in each column (by its number)."""
    cells = F.array(*[F.struct(F.lit(i).alias("__v"), F.col(src).cast("double").alias("__x")) for i, src in enumerate(cols)])
    long = df.select(*keys, F.explode(cells).alias("__c")).select(*keys, "__c.*")
    long = long.filter(F.col("__x").isNotNull() & ~F.isnan("__x") & (F.abs("__x") != float("inf")))
    return long.groupBy(*keys, "__v", "__x").agg(F.count(F.lit(1)).alias("__m"))


def _picked(counts: DataFrame, keys: list[str], cols: list[str], picks: dict) -> DataFrame:
    rows = Ordered.of(counts, [*keys, "__v"], ["__x"]).add(__cum=running_sum("__m"), __n=total("sum", "__m")).done()
    aggs = []
    for name, (src, pick) in picks.items():
        hit = (F.col("__v") == cols.index(src)) & (F.col("__cum") > pick(F.col("__n")))
        aggs.append(F.min(F.when(hit, F.col("__x"))).alias(name))
    return rows.groupBy(*keys).agg(*aggs)


def attach(a: DataFrame, one: DataFrame) -> DataFrame:
    """Columns of a one-row frame on every row of `a` (NULL when it has no row)."""
    return a.withColumn("__row", one.select(F.struct(*one.columns)).scalar()).select(*a.columns, "__row.*")


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL; the key columns are those of `a`."""
    if not keys:
        return attach(a, b)
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"__j_{k}"), keys, b)
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__j_{k}")) for k in keys])
    return a.join(renamed, on, how).drop(*[f"__j_{k}" for k in keys])


def summarize(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, p25, p50, p75 and the median absolute deviation over the median."""
    base = quantiles(df, keys, value, {"p25": floor_index(0.25), "p50": floor_index(0.5), "p75": floor_index(0.75)})
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__w"))
    dev = null_safe_join(counts, base.select(*keys, "p50"), keys)
    dev = dev.select(*keys, F.abs(F.col(value) - F.col("p50")).alias("__dev"), "__w")
    dev = dev.filter(F.col("__dev").isNotNull() & ~F.isnan("__dev") & (F.abs("__dev") != float("inf")))
    dev = dev.groupBy(*keys, "__dev").agg(F.sum("__w").alias("__m"))
    o = Ordered.of(dev, keys, ["__dev"], probe=df.select(*keys)).add(__cum=running_sum("__m"), __n=total("sum", "__m"))
    mad = o.df.groupBy(*(keys or [ALL])).agg(F.min(F.when(F.col("__cum") > F.floor(F.col("__n") / 2), F.col("__dev"))).alias("mad"))
    out = null_safe_join(base, mad.drop(ALL), keys)
    ratio = F.when(F.col("p50") != 0, F.try_divide(F.col("mad"), F.abs("p50"))).otherwise(F.lit(0.0))
    return out.withColumn("mad_ratio", ratio).drop("mad")


def mean_finite(value: Column) -> Column:
    """Aggregate: mean of the numbers that are not NaN; NaN when there are none."""
    return F.coalesce(F.avg(F.when(~F.isnan(value), value)), F.lit(float("nan")))


def content_box(df: DataFrame, keys: list[str], x: str, y: str, w: str, h: str) -> DataFrame:
    """Box holding the middle 96 % of the objects, and the y bands above and below it (NULL when empty)."""
    d = df.select(*keys, F.col(x).alias("x0"), F.col(y).alias("y0"), (F.col(x) + F.col(w)).alias("x1"), (F.col(y) + F.col(h)).alias("y1"))
    cols = ["x0", "y0", "x1", "y1"]
    counts = _counted(d, keys, cols)
    box = _picked(counts, keys, cols, {"x0_q": ("x0", round_index(0.02)), "y0_q": ("y0", round_index(0.02)),
                                       "x1_q": ("x1", round_index(0.98)), "y1_q": ("y1", round_index(0.98))})
    # the counted tops tell the bands; the rows are not read again
    tops = null_safe_join(counts.filter(F.col("__v") == 1), box.select(*keys, "y0_q", "y1_q"), keys)
    band = F.when(F.col("__x") < F.col("y0_q"), 0).when(F.col("__x") > F.col("y1_q"), 1)
    tops = tops.select(*keys, band.alias("__v"), "__x", "__m").filter("__v IS NOT NULL")
    bands = _picked(tops, keys, ["head", "foot"], {"header_top": ("head", round_index(0.05)), "footer_bottom": ("foot", round_index(0.95))})
    box = null_safe_join(box, bands, keys, "left")
    return box.select(
        *keys, F.col("x0_q").alias("x"), F.col("y0_q").alias("y"), (F.col("x1_q") - F.col("x0_q")).alias("w"),
        (F.col("y1_q") - F.col("y0_q")).alias("h"), "header_top", "footer_bottom")


def gap_clusters(df: DataFrame, keys: list[str], value: str, tol, relative: bool = False, name: str = "cluster") -> DataFrame:
    """Distinct values per group with a cluster number: a new one where the step from the value before exceeds `tol`.

    `relative`: the step is measured against the value before.  `tol` may be a column of the row.
    Returns (keys, value, n, cluster); join back on (keys, value) to label rows.
    """
    extra = [F.first(tol).alias("__tol")] if isinstance(tol, Column) else []
    limit = F.col("__tol") if extra else F.lit(tol)
    vals = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *extra)
    o = Ordered.of(vals, keys, [value], probe=df.select(*keys)).add(__prev=lag(value))
    step = F.abs(F.col(value) - F.col("__prev"))
    if relative:
        step = step / F.greatest(F.col("__prev"), F.lit(0.01))
    o = o.with_column("__new", F.when(F.coalesce(step > limit, F.lit(False)), 1).otherwise(0)).add(**{name: running_sum("__new")})
    return o.done().drop("__prev", "__new", "__tol")


def _median_starts(tol: float):
    """Marks the rows that start a cluster; rows (value, n, first) come sorted, `first` at the start of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ends, size, at = [], [], 0, 0
        for b in batches:
            starts = []
            for v, n, first in zip(b.column("__x").to_pylist(), b.column("n").to_pylist(), b.column("__first").to_pylist(), strict=True):
                start = first
                if not first:
                    while ends[at] <= size // 2:  # the median only moves up
                        at += 1
                    start = abs(v - values[at]) / max(values[at], 0.01) > tol
                if start:
                    values, ends, size, at = [], [], 0, 0
                size += n
                values.append(v)
                ends.append(size)
                starts.append(int(start))
            yield b.append_column("__start", pa.array(starts, pa.int32()))

    return run


def _median_rounds(rows: DataFrame, by: list[str], tol: float, max_rows: int) -> DataFrame:
    """(by, __at) of the cluster starts of long stretches; rows: (by, __x, __at), __at being how many values come before.

    Each round finds the next start of every stretch: each value is held against the one half way back to the current
    start, which an ordered pass brings to it.  A cluster without a gap spans a factor of 1 + tol at least, so there are
    as many rounds as such factors in a stretch, however many values it has.
    """
    current = cut_lineage(rows.groupBy(*by).agg(F.lit(0).cast("long").alias("__s")))
    starts = [current]
    while not current.isEmpty():
        live = null_safe_join(rows, current, by).filter(F.col("__at") >= F.col("__s"))
        held = live.select(*by, F.col("__at").alias("__pos"), F.lit(0).alias("__kind"), "__at", "__x", F.col("__x").alias("__held"))
        asked = live.filter(F.col("__at") > F.col("__s")).select(
            *by, (F.col("__s") + F.floor((F.col("__at") - F.col("__s")) / 2)).alias("__pos"), F.lit(1).alias("__kind"), "__at", "__x", F.lit(None).cast("double").alias("__held"))
        o = Ordered.of(held.unionByName(asked), by, ["__pos", "__kind", "__at"], max_rows=max_rows).add(__mid=last_value("__held"))
        far = F.abs(F.col("__x") - F.col("__mid")) / F.greatest(F.col("__mid"), F.lit(0.01)) > tol
        current = cut_lineage(o.df.filter((F.col("__kind") == 1) & far).groupBy(*by).agg(F.min("__at").alias("__s")))
        starts.append(current)
    return reduce(lambda a, b: a.unionByName(b), starts).withColumnRenamed("__s", "__at")


def median_clusters(df: DataFrame, keys: list[str], value: str, tol: float, name: str = "cluster") -> DataFrame:
    """Distinct values per group with a cluster number: a new one where a value is further than `tol` from the median of
    the cluster so far, relative to that median (0.01 at least).

    In sorted order the median of a cluster is its value half way between its start and here.  A step of more than `tol`
    from the value before always starts a cluster, as the median is no larger than that value; so the stretches between
    such steps are walked on their own, in tasks that hold many of them, and long ones (`scoretables.maxGroupRows`
    distinct values) in rounds over all tasks.  Equal values never part.  NULL and NaN are left out.
    Returns (keys, value, n, cluster), clusters counted from 0; join back on (keys, value) to label rows.
    """
    x = F.col(value).cast("double")
    parts = gap_clusters(df.filter(x.isNotNull() & ~F.isnan(x)), keys, value, tol, relative=True, name="__part").withColumn("__x", x)
    by = [*keys, "__part"]
    o = Ordered.of(parts, by, [value], probe=None).add(__at=running_sum("n", before=True))
    rows = o.done().withColumn("__first", F.col("__at") == 0)
    long = None
    if o.blocked:
        rows = o.df.withColumn("__first", F.col("__at") == 0)
        long, rows = cut_lineage(rows.filter(F.col(BLOCK) >= 0).drop(BLOCK)), rows.filter(F.col(BLOCK) < 0).drop(BLOCK)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", __start int"
    walked = rows.repartition(*by).sortWithinPartitions(*by, value).mapInArrow(_median_starts(tol), ddl)
    if long is not None:
        starts = _median_rounds(long.select(*by, "__x", "__at"), by, tol, o.max_rows).withColumn("__start", F.lit(1))
        marked = null_safe_join(long, starts, [*by, "__at"], "left")
        walked = walked.unionByName(marked.withColumn("__start", F.coalesce("__start", F.lit(0))))
    walked = cut_lineage(walked.select(*keys, value, "n", "__start"))
    o = Ordered.of(walked, keys, [value]).add(**{name: running_sum("__start")})
    return o.with_column(name, F.col(name) - 1).done().select(*keys, value, "n", name)


def drop_noise(clusters: DataFrame, keys: list[str], share: float = 0.1, least: int = 8) -> DataFrame:
    """Keep groups (column `n`) of at least `least` members and `share` of all members under `keys`."""
    sums = clusters.groupBy(*keys).agg(F.sum("n").alias("__all"))
    rows = null_safe_join(clusters, sums, keys)
    return rows.filter(F.col("n") >= F.greatest(F.lit(least), F.col("__all") * share)).drop("__all")


def families(df: DataFrame, keys: list[str], size: str, width: str, y: str, tol: float = 0.06, share: float = 0.001) -> DataFrame:
    """Per size cluster: centre, range, count, median width and the y spread; noise clusters left out."""
    lab = median_clusters(df, keys, size, tol).drop("n")
    rows = null_safe_join(df, lab, [*keys, size])
    by = [*keys, "cluster"]
    span = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high"))
    mids = quantile_table(rows, by, {
        "center": (size, median_index), "mid_width": (width, round_index(0.5)), "y10": (y, round_index(0.1)),
        "y50": (y, round_index(0.5)), "y90": (y, round_index(0.9))})
    return drop_noise(null_safe_join(span, mids, by), keys, share)


def body_rows(df: DataFrame, keys: list[str], height: str, share: float = 0.72) -> DataFrame:
    """Rows at least `share` as tall as the body of their line (the median of the upper half of the heights)."""
    pos = df.filter(F.col(height) > 0)
    heights = pos.groupBy(*keys, height).agg(F.count(F.lit(1)).alias("__m"))
    half = floor_index(0.5)
    o = Ordered.of(heights, keys, [height]).add(__cum=running_sum("__m"), __n=total("sum", "__m"))
    o = o.add(__mid=total("min", F.when(F.col("__cum") > half(F.col("__n")), F.col(height))))
    upper = F.col(height) >= F.col("__mid")
    o = o.add(__nu=total("sum", F.when(upper, F.col("__m"))))
    at = F.col("__cum") - (F.col("__n") - F.col("__nu"))  # place among the upper heights
    body = F.min(F.when(upper & (at > half(F.col("__nu"))), F.col(height))).alias("body")
    top = o.done().groupBy(*keys).agg(body)
    return null_safe_join(pos, top, keys).filter(F.col(height) >= F.col("body") * share)


def two_class_split(df: DataFrame, keys: list[str], value: str, height: str, ratio: float = 2.5) -> DataFrame:
    """Boundary between small and large gaps of a group (one row per group).

    Gaps above 1 only.  Fewer than two: 0.3 x height.  No rise, or classes closer than `ratio`: infinity.
    `height` is constant in a group.
    """
    groups = df.groupBy(*keys).agg(F.max(height).alias("__h"))
    vals = df.filter(F.col(value) > 1).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__m"))
    vals = vals.withColumn("__ln", F.ln(value) * F.col("__m"))
    o = Ordered.of(vals, keys, [value], probe=df.select(*keys)).add(
        __i=running_sum("__m", before=True), __s=running_sum("__ln", before=True), __n=total("sum", "__m"), __t=total("sum", "__ln"),
        __prev=lag(value))
    i, s, n, t = (F.col(f"__{x}") for x in "isnt")
    m0, m1 = F.try_divide(s, i), F.try_divide(t - s, n - i)
    score = i * (n - i) * (m1 - m0) * (m1 - m0)
    rows = o.df.withColumn("__score", F.when(i > 0, F.round(score, 9)))
    best = rows.groupBy(*keys).agg(
        F.max("__n").alias("__n"),
        # the first of equal scores wins
        F.max_by(F.struct((m1 - m0).alias("d"), F.sqrt(F.col("__prev") * F.col(value)).alias("cut")),
                 F.when(F.col("__score") >= 0, F.struct(F.col("__score"), -F.col(value)))).alias("__b"))
    inf = F.lit(float("inf"))
    out = null_safe_join(groups, best, keys, "left")
    cut = F.when(F.coalesce(F.col("__n"), F.lit(0)) < 2, F.col("__h") * 0.3).when(
        F.col("__b").isNull() | (F.col("__b.d") < F.log(F.lit(ratio))), inf).otherwise(F.col("__b.cut"))
    return out.select(*keys, cut.alias("boundary"))


def otsu(df: DataFrame, keys: list[str], bin_: str) -> DataFrame:
    """Best threshold of a histogram of integer bins per group; the first maximum wins, 127 when there is none."""
    hist = df.groupBy(*keys, bin_).agg(F.count(F.lit(1)).alias("__c"))
    hist = hist.withColumn("__w", F.col(bin_).cast("double") * F.col("__c"))
    o = Ordered.of(hist, keys, [bin_], probe=df.select(*keys)).add(
        __wb=running_sum("__c"), __sb=running_sum("__w"), __n=total("sum", "__c"), __t=total("sum", "__w"))
    wb, sb, n, t = (F.col(f"__{x}") for x in ("wb", "sb", "n", "t"))
    wf = n - wb
    d = sb / wb - F.try_divide(t - sb, wf)
    between = F.when(wf > 0, wb * wf * d * d)
    rows = o.df.withColumn("__between", F.when(between > 0, F.round(between, 3)))
    return rows.groupBy(*(keys or [ALL])).agg(
        F.coalesce(F.max_by(bin_, F.when(F.col("__between").isNotNull(), F.struct("__between", -F.col(bin_)))), F.lit(127)).alias("threshold"),
        F.coalesce(F.max("__between"), F.lit(0.0)).alias("between")).drop(ALL)


def margins(df: DataFrame, keys: list[str], left: str, right: str, top: str, bottom: str, width: str) -> DataFrame:
    """Typical page margins of a book, rounded; defaults where a book has no readings."""
    low = floor_index(0.3)
    # Defaults for left, right, top, bottom and type width.
    spec = {left: ("left", median_index, 150.0), right: ("right", median_index, 150.0), top: ("top", median_index, 200.0),
            bottom: ("bottom", low, 200.0), width: ("type_w", median_index, 1100.0)}
    got = quantile_table(df, keys, {f"__{name}": (src, pick) for src, (name, pick, _) in spec.items()})
    out = null_safe_join(df.select(*keys).distinct(), got, keys, "left")
    cols = []
    for name, _, default in spec.values():
        q = F.coalesce(F.col(f"__{name}"), F.lit(default))
        if name == "bottom":
            q = F.when(q == 0, default).otherwise(q)
        cols.append(js_round(q).alias(name))
    return out.select(*keys, *cols)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """k-th row of a group in order, from 1."""
    return Ordered.of(df, keys, order).add(**{name: row_number()}).done()
