"""Repeated stretches of a song, found without forming pairs of equal measures.

Stretches are ranked by doubling their length, neighbours in rank order give each position its best partner, and a
binary search over the ranks gives the length they share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import Ordered, lag, last_value, lead, next_value, row_number, running_sum, total

def _ranked(rows: DataFrame, song, by: list[str]) -> DataFrame:
    """(song, __pos, __rank): equal on `by` means equal rank."""
    now = F.struct(*by)
    o = Ordered.of(rows, song, [*by, "__pos"]).add(__was=lag(now))
    o = o.with_column("__new", F.when(F.col("__was").eqNullSafe(now), 0).otherwise(1)).add(__rank=running_sum("__new"))
    return o.done().select(*song, "__pos", "__rank")


def _starts(rows: DataFrame, song, longest: int) -> DataFrame:
    """(song, __pos, len): longest stretch from each position that recurs behind a different value on the left.

    `rows`: song, __pos (from 1), __txt, __left.
    """
    ranks = [cut_lineage(_ranked(rows, song, ["__txt"]))]
    while 2 ** (len(ranks) - 1) < longest:
        step = 2 ** (len(ranks) - 1)
        ahead = ranks[-1].select(*song, (F.col("__pos") - step).alias("__pos"), F.col("__rank").alias("__then"))
        both = ranks[-1].join(ahead, [*song, "__pos"], "left").fillna(0, ["__then"])
        ranks.append(cut_lineage(_ranked(both, song, ["__rank", "__then"])))
    order = rows.select(*song, "__pos", "__left").join(ranks[-1], [*song, "__pos"])
    o = Ordered.of(order, song, ["__rank"]).add(
        __pl=lag(F.struct("__left", "__pos")), __nl=lead(F.struct("__left", "__pos")))
    # the nearest neighbour on either side with another value on its left
    o = o.add(
        __p=last_value(F.when(F.col("__pl.__left") != F.col("__left"), F.col("__pl.__pos"))),
        __n=next_value(F.when(F.col("__nl.__left") != F.col("__left"), F.col("__nl.__pos"))))
    pairs = o.done().select(*song, "__pos", F.explode(F.array_compact(F.array("__p", "__n"))).alias("__mate"))
    pairs = cut_lineage(pairs.withColumn("__len", F.lit(0).cast("long")))
    for k in reversed(range(len(ranks))):
        a = ranks[k].select(*song, F.col("__pos").alias("__ia"), F.col("__rank").alias("__ra"))
        b = ranks[k].select(*song, F.col("__pos").alias("__ib"), F.col("__rank").alias("__rb"))
        step = pairs.withColumn("__ia", F.col("__pos") + F.col("__len")).withColumn("__ib", F.col("__mate") + F.col("__len"))
        step = step.join(a, [*song, "__ia"], "left").join(b, [*song, "__ib"], "left")
        longer = F.when(F.col("__ra") == F.col("__rb"), 2**k).otherwise(0)
        pairs = cut_lineage(step.select(*song, "__pos", "__mate", (F.col("__len") + longer).alias("__len")))
    return pairs.groupBy(*song, "__pos").agg(F.max("__len").alias("len"))


def repeat_segments(rows: DataFrame, song, order, value: str, least: int = 2) -> DataFrame:
    """Edges of repeated stretches: (song, edge, len) with the longest stretch that starts after or ends at the edge.

    Measures count from 0, edge -1 lies before the first.  NULL values match nothing; NaN equals NaN, and -0.0 equals
    0.0.  A NULL song is a song.
    """
    key = ["__song"]
    # a struct is equal to another with NULLs in the same places, so joins on it keep NULL songs
    rows = rows.withColumn("__song", F.struct(*song))
    same = F.col(value) + 0.0 if dict(rows.dtypes)[value] in ("double", "float") else F.col(value)
    o = Ordered.of(rows, key, list(order)).add(__pos=row_number(), __size=total("sum", F.lit(1).cast("long")))
    text = F.when(F.col(value).isNotNull(), F.concat(F.lit("="), F.to_json(F.struct(same.alias("v"))))).otherwise(
        F.concat(F.lit("#"), F.col("__pos").cast("string")))
    o = o.with_column("__txt", text).add(__l=lag("__txt"), __r=lead("__txt"))
    base = cut_lineage(o.done().select(
        *key, "__pos", "__size", "__txt", F.coalesce("__l", F.lit("<")).alias("__left"), F.coalesce("__r", F.lit(">")).alias("__right")))
    longest = base.agg(F.max("__size")).first()[0] or 0
    fwd = _starts(base.select(*key, "__pos", "__txt", "__left"), key, longest)
    back = base.select(*key, (F.col("__size") + 1 - F.col("__pos")).alias("__pos"), "__txt", F.col("__right").alias("__left"))
    bwd = _starts(back, key, longest).join(base.groupBy(*key).agg(F.first("__size").alias("__size")), key)
    out = fwd.select(*key, (F.col("__pos") - 2).alias("edge"), "len").unionByName(
        bwd.select(*key, (F.col("__size") - F.col("__pos")).alias("edge"), "len"))
    return out.filter(F.col("len") >= least).groupBy(*key, "edge").agg(F.max("len").alias("len")).select("__song.*", "edge", "len")
