"""Ordered passes over groups that stay parallel when one group is huge.

A plain window sends a whole group to one task.  `Ordered` does the same work, but first asks
(one column-pruned count per key) whether any group is larger than `max_rows`.  If none is, the
pass is a plain window.  If some are, only those groups are cut into blocks of about `max_rows`
rows along their order; each block is a window of its own, and a table of block summaries carries
the running state from block to block, itself ordered by this class, so it may be of any size.

The order must be total (no two rows of a group equal on all order columns).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_ROWS_CONF = "scoretables.maxGroupRows"
MAX_ROWS = 2_000_000
TASK_ROWS = 1_000_000  # rows of one task where there are more than the cores would take at that number
LEAST_SUMMARIES = 1_000  # block summaries of a group are cut up only beyond this number, however small max_rows is
BLOCK = "__block"
ALL = "__all"
# Largest group, rows of the large groups and all rows, per plan and size of its inputs asked in this session.  They only
# choose between two ways to the same result, so a stale entry costs time, never rows.
_SIZES: dict[tuple, tuple[int, int, int]] = {}
MOST_SIZES = 1_000  # beyond these, the oldest answers are forgotten


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Pass:
    """One running value: what to compute and in which direction."""

    kind: str
    value: Column
    before: bool = False  # leave the current row out
    backward: bool = False


def running_sum(c, before=False, backward=False) -> Pass:
    return Pass("sum", col(c), before, backward)


def running_min(c, before=False, backward=False) -> Pass:
    return Pass("min", col(c), before, backward)


def running_max(c, before=False, backward=False) -> Pass:
    return Pass("max", col(c), before, backward)


def last_value(c, before=False) -> Pass:
    """Last non-null value up to here."""
    return Pass("last", col(c), before)


def next_value(c, before=False) -> Pass:
    """First non-null value from here on (`before`: strictly after)."""
    return Pass("last", col(c), before, backward=True)


def lag(c) -> Pass:
    return Pass("lag", F.struct(col(c).alias("v")), True)


def lead(c) -> Pass:
    return Pass("lag", F.struct(col(c).alias("v")), True, backward=True)


def row_number() -> Pass:
    return Pass("sum", F.lit(1).cast("long"))


def total(kind: str, c) -> Pass:
    """Whole-group sum, min or max on every row."""
    return Pass("total_" + kind, col(c))


AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    if kind == "min":
        return F.least(a, b)
    if kind == "max":
        return F.greatest(a, b)
    return F.coalesce(a, b)


def _max_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_ROWS_CONF, str(MAX_ROWS)))


def _sizes(df: DataFrame, keys: list[str], max_rows: int) -> tuple[DataFrame, int, int, int]:
    """Rows per key; the largest of these counts, the rows of keys with more than `max_rows`, and all rows."""
    asked = df.select(*keys)
    counts = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    size = int(asked._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    plan = (asked.sparkSession.sparkContext.applicationId, asked.semanticHash(), size, max_rows)
    if plan not in _SIZES:
        while len(_SIZES) >= MOST_SIZES:
            _SIZES.pop(next(iter(_SIZES)))
        got = counts.agg(F.max("__n").alias("top"), F.sum(F.when(F.col("__n") > max_rows, F.col("__n"))).alias("rows"), F.sum("__n").alias("all")).first()
        _SIZES[plan] = (got["top"] or 0, got["rows"] or 0, got["all"] or 0)
    return counts, *_SIZES[plan]


def _by_rows(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    if rows <= TASK_ROWS * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-rows // TASK_ROWS), *keys)


def deal(df: DataFrame, keys: list[str], probe: DataFrame) -> DataFrame:
    """Many rows in groups that fit a task, dealt by key, so that steps by these and more columns need no shuffle of their
    own; any others as they are.  `probe`: as for Ordered.of(), and the same one there, so the rows are counted once."""
    _, top, _, rows = _sizes(probe, keys, _max_rows(df))
    return _by_rows(df, keys, rows) if keys and top <= _max_rows(df) else df


class Ordered:
    """Rows grouped by `keys` and ordered by `order` (ascending), ready for passes."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], blocked: bool, max_rows: int):
        self.df, self.keys, self.order, self.blocked, self.max_rows = df, keys, order, blocked, max_rows

    @classmethod
    def of(cls, df: DataFrame, keys, order, probe: DataFrame | None = None, max_rows: int | None = None, placed: bool = False) -> "Ordered":
        """`probe`: a cheaper frame with the same keys whose groups are at least as large as those of `df`.

        Many rows are dealt by key to as many tasks as TASK_ROWS asks for: left to itself, adaptive execution joins
        partitions up to the number of cores, and a task's sorts grow with the input.  `placed`: `df` comes from a pass
        over these keys, so its rows stay where they are.
        """
        keys, order = list(keys), list(order)
        if not keys:
            df = df.withColumn(ALL, F.lit(0))
            keys, probe = [ALL], None
        if max_rows is None:
            max_rows = _max_rows(df)
        counts, top, rows, every = _sizes(df if probe is None else probe, keys, max_rows)
        if top <= max_rows:
            df = df if placed else _by_rows(df, keys, every)
            return cls(df, keys, order, False, max_rows)
        big = counts.filter(F.col("__n") > max_rows).select(*[F.col(k).alias(f"__k_{k}") for k in keys])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
        # Ranges over keys and order: a group's rows lie in neighbouring partitions, whose numbers are its blocks.  They
        # are written once, as the ranges come from a sample; the other groups' rows stay where they are.
        cut = df.join(big, same, "left_semi").repartitionByRange(rows // max_rows + 1, *keys, *order)
        cut = cut_lineage(cut.withColumn(BLOCK, F.spark_partition_id()))
        rest = df.join(big, same, "left_anti").withColumn(BLOCK, F.lit(-1))
        return cls(rest.unionByName(cut), keys, order, True, max_rows)

    # -- passes ---------------------------------------------------------------------------------

    def _window(self, backward: bool, blocked: bool):
        order = [F.col(o).desc() if backward else F.col(o).asc() for o in self.order]
        keys = self.keys + ([BLOCK] if blocked else [])
        return Window.partitionBy(*keys).orderBy(*order)

    def _local(self, p: Pass, blocked: bool) -> Column:
        if p.kind.startswith("total_"):
            w = Window.partitionBy(*self.keys, *([BLOCK] if blocked else []))
            return AGG[p.kind[6:]](p.value).over(w)
        w = self._window(p.backward, blocked)
        if p.kind == "lag":
            return F.lag(p.value).over(w)
        rows = w.rowsBetween(Window.unboundedPreceding, -1 if p.before else 0)
        if p.kind == "last":
            return F.last(p.value, ignorenulls=True).over(rows)
        out = AGG[p.kind](p.value).over(rows)
        return F.coalesce(out, F.lit(0)) if p.kind == "sum" else out

    def add(self, **passes: Pass) -> "Ordered":
        """Add one column per pass; all passes of a call share the same sort where they can."""
        df = self.df
        if not self.blocked:
            for name, p in passes.items():
                got = self._local(p, False)
                df = df.withColumn(name, got["v"] if p.kind == "lag" else got)
            return Ordered(df, self.keys, self.order, False, self.max_rows)
        at = F.struct(*[F.col(o) for o in self.order])
        aggs = []
        for name, p in passes.items():
            base = p.kind.removeprefix("total_")
            if base in AGG:
                aggs.append(AGG[base](p.value).alias(f"__s_{name}"))
            else:
                pick = F.min_by if p.backward else F.max_by
                aggs.append(pick(p.value, F.when(p.value.isNotNull(), at)).alias(f"__s_{name}"))
        blocks = df.filter(F.col(BLOCK) >= 0).groupBy(*self.keys, BLOCK).agg(*aggs)
        passed = Ordered.of(cut_lineage(blocks.withColumnRenamed(BLOCK, "__kb")), self.keys, ["__kb"], max_rows=max(self.max_rows, LEAST_SUMMARIES))
        passed = passed.add(**{f"__c_{name}": Pass(p.kind if p.kind != "lag" else "last", F.col(f"__s_{name}"), True, p.backward) for name, p in passes.items()})
        carry = passed.df.select(*[F.col(k).alias(f"__k_{k}") for k in self.keys], "__kb", *[f"__c_{name}" for name in passes])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in self.keys])
        out = df.select("*", *[self._local(p, True).alias(f"__l_{name}") for name, p in passes.items()])
        out = out.join(carry, same & (F.col(BLOCK) == F.col("__kb")), "left")
        for name, p in passes.items():
            here, there = F.col(f"__l_{name}"), F.col(f"__c_{name}")
            if p.kind.startswith("total_"):
                got = F.coalesce(there, here)
            elif p.kind == "lag":
                got = F.coalesce(here, there)["v"]
            else:
                got = _merge(p.kind, here, there)
            out = out.withColumn(name, got)
        drop = [f"__{x}_{name}" for x in "lc" for name in passes] + [f"__k_{k}" for k in self.keys] + ["__kb"]
        return Ordered(out.drop(*drop), self.keys, self.order, True, self.max_rows)

    def with_column(self, name: str, c: Column) -> "Ordered":
        return Ordered(self.df.withColumn(name, c), self.keys, self.order, self.blocked, self.max_rows)

    def filter(self, c: Column) -> "Ordered":
        return Ordered(self.df.filter(c), self.keys, self.order, self.blocked, self.max_rows)

    def done(self) -> DataFrame:
        return self.df.drop(BLOCK, ALL)
