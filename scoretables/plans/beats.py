"""Measure length check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import Ordered, lag, lead, row_number, running_sum, total
from ..operators.sequence import flag
from ..operators.stats import null_safe_join

EPS = 1e-6


def beat_check(measures: DataFrame, lengths: DataFrame, song: list[str], measure: str, voice: str, length: str, absolute: bool = False, pickup: bool = True, seen: str | None = None, probe: DataFrame | None = None) -> DataFrame:
    """(song, measure, kind, want, got) for measures of a wrong length.

    `measures`: song, measure, wants (array of allowed lengths in quarters), implicit; `lengths`: song, measure,
    voice, length.  The voice whose first element comes first in the measure (`seen`: its place) is the main one, without
    places the lowest.  Pardoned: empty and implicit measures, a pickup (first and
    last fill one, or the first alone short), and neighbours that are both short and fill one together.  Kind
    `voice`: another voice is not as long as the main one (`absolute`: longer only).  `probe`: as for Ordered.of(), else
    the measures.
    """
    main = lengths.groupBy(*song, measure).agg(F.min(F.struct(F.col(seen or voice).alias("s"), F.col(voice).alias("v"), F.col(length).alias("q"))).alias("__main"))
    m = null_safe_join(measures, main, [*song, measure], "left").withColumn("__got", F.coalesce("__main.q", F.lit(0.0)))
    o = Ordered.of(m, song, [measure], probe=measures.select(*song) if probe is None else probe).add(__r=row_number(), __n=total("sum", F.lit(1).cast("long")))
    here = F.struct(F.col("__got").alias("got"), F.col("wants").alias("wants"))
    o = o.add(__first=total("max", F.when(F.col("__r") == 1, here)), __last=total("max", F.when(F.col("__r") == F.col("__n"), here)))

    def short(x) -> Column:
        return F.exists(x["wants"], lambda w: x["got"] < w - EPS)

    def fills(x, y) -> Column:
        return F.exists(F.concat(x["wants"], y["wants"]), lambda w: F.abs(x["got"] + y["got"] - w) < EPS)

    own = {"got": F.col("__got"), "wants": F.col("wants")}
    free = (F.size("wants") == 0) | F.col("__main").isNull() | F.coalesce(F.col("implicit"), F.lit(False))
    o = o.with_column("__ok0", free | F.exists("wants", lambda w: F.abs(F.col("__got") - w) < EPS))
    first, last = F.col("__first"), F.col("__last")
    o = o.add(__bad1=total("max", flag(~F.col("__ok0") & (F.col("__r") == 1))))
    up = F.lit(pickup) & (F.col("__n") >= 2) & (F.col("__bad1") == 1) & short(first)
    both = up & short(last) & fills(first, last)
    ok1 = F.col("__ok0") | (up & (F.col("__r") == 1)) | (both & (F.col("__r") == F.col("__n")))
    o = o.with_column("__ok1", ok1).with_column("__imp", F.coalesce(F.col("implicit"), F.lit(False)))
    o = o.add(__nx=lead(F.struct(F.col("__got").alias("got"), F.col("wants").alias("wants"), F.col("__ok1").alias("ok"), F.col("__imp").alias("imp"))))
    nx = F.col("__nx")
    edge = ~F.col("__ok1") & (~nx["ok"] | nx["imp"]) & short(own) & short(nx) & fills(own, nx)
    # of a run of such pairs, the first, third, ... are taken: each measure belongs to one pair
    o = o.with_column("__edge", flag(edge)).add(__pe=lag("__edge"))
    o = o.with_column("__new", F.when((F.col("__edge") == 1) & (F.col("__pe") == 1), 0).otherwise(1)).add(__run=running_sum("__new"))
    o = o.add(__start=total_start())
    taken = (F.col("__edge") == 1) & ((F.col("__r") - F.col("__start")) % 2 == 0)
    o = o.with_column("__take", flag(taken)).add(__pt=lag("__take"))
    ok = F.col("__ok1") | (F.col("__take") == 1) | (F.coalesce(F.col("__pt"), F.lit(0)) == 1)
    rows = o.with_column("__ok", ok).done()
    nearest = F.array_min(F.transform("wants", lambda w, i: F.struct(F.round(F.abs(w - F.col("__got")), 9).alias("d"), i.alias("i"), w.alias("w"))))["w"]
    bad = rows.filter(~F.col("__ok")).select(*song, measure, F.lit("length").alias("kind"), nearest.alias("want"), F.col("__got").alias("got"))
    others = lengths.join(main, [*song, measure]).filter(F.col(voice) != F.col("__main.v"))
    diff = F.abs(F.col(length) - F.col("__main.q")) >= EPS
    if absolute:
        diff = diff & (F.col(length) > F.col("__main.q"))
    voices = others.filter(diff).select(*song, measure, F.lit("voice").alias("kind"), F.col("__main.q").alias("want"), F.col(length).alias("got"))
    return bad.unionByName(voices)


def total_start():
    """Row number at which the run of the current row began, carried along the run."""
    from ..operators.scan import last_value

    return last_value(F.when(F.col("__new") == 1, F.col("__r")))
