"""Note events: pairing, quantizing, trimming, bars and voices.  Times are in units of 48 per quarter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pitch import js_round
from .scan import Ordered, deal, lead, row_number, running_min, running_sum

# Ticks per quarter and the triplet grid.
QUARTER = 48
TRIPLET = 16


def pair_on_off(events: DataFrame, keys: list[str], order: list[str], at: str, on: Column, off: Column, *keep: str) -> DataFrame:
    """First note-on with first note-off, per key: (keys, k, t_on, t_off).

    A note-off with nothing open is ignored: it is one that takes the running balance to a new low below zero.
    Notes never closed have t_off NULL.  `keep` columns come from the note-on.
    """
    rows = events.filter(on | off).select(*dict.fromkeys([*keys, *order, at, *keep]), on.alias("__on"))
    o = Ordered.of(rows, keys, order).with_column("__d", F.when(F.col("__on"), 1).otherwise(-1)).add(__bal=running_sum("__d"))
    o = o.add(__low=running_min("__bal", before=True))
    orphan = ~F.col("__on") & (F.col("__bal") < F.least(F.lit(0), F.coalesce("__low", F.lit(0))))
    o = o.filter(~orphan).add(__ons=running_sum(F.when(F.col("__on"), 1).otherwise(0)), __offs=running_sum(F.when(F.col("__on"), 0).otherwise(1)))
    k = F.when(F.col("__on"), F.col("__ons")).otherwise(F.col("__offs"))
    d = o.df.withColumn("k", k)
    return d.groupBy(*keys, "k").agg(
        F.max(F.when(F.col("__on"), F.col(at))).alias("t_on"), F.max(F.when(~F.col("__on"), F.col(at))).alias("t_off"),
        *[F.max(F.when(F.col("__on"), F.col(c))).alias(c) for c in keep])


def snap(x: Column, grid: Column) -> Column:
    return F.floor(x / grid + 0.5) * grid


def triplet_beats(notes: DataFrame, keys: list[str], start: str, end: str, step: int, bars: DataFrame | None = None) -> DataFrame:
    """Beats (keys, beat) that fit the triplet grid: less than half the error of the straight one.

    `bars` (keys, bar_start, bar_end, beat_type; no holes) keeps beats in simple meters that end inside their bar.
    """
    off = lambda x, g: F.abs(x - snap(x, F.lit(float(g))))
    pts = notes.select(*keys, F.explode(F.array(F.col(start), F.col(end))).alias("__x"))
    per = pts.groupBy(*keys, F.floor(F.col("__x") / QUARTER).alias("beat")).agg(
        F.sum(off(F.col("__x"), step)).alias("straight"), F.sum(off(F.col("__x"), TRIPLET)).alias("triplet"))
    out = per.filter(F.col("triplet") < F.col("straight") * 0.5)
    if bars is not None:
        from .joins import asof_attr

        spans = bars.select(*keys, F.col("bar_start").alias("__b0"), F.col("bar_start").alias("__id"), F.col("bar_end").alias("__b1"), F.col("beat_type").alias("__bt"))
        out = asof_attr(out.withColumn("__p", F.col("beat") * QUARTER), spans, keys, "__p", "beat", "__b0", "__id", {"__b1": -1, "__bt": 0})
        out = out.filter((F.col("__b1") >= (F.col("beat") + 1) * QUARTER) & (F.col("__bt") <= 4)).drop("__p", "__b1", "__bt")
    return out


def quantize(notes: DataFrame, keys: list[str], start: str, end: str, step: int, beats: DataFrame) -> DataFrame:
    """Starts and ends on the grid of their beat (triplet where `beats` lists it); no note shorter than one step."""
    marks = beats.select(*keys, "beat", F.lit(True).alias("__t"))
    a = marks.withColumnRenamed("beat", "__sb").withColumnRenamed("__t", "__st")
    b = marks.withColumnRenamed("beat", "__eb").withColumnRenamed("__t", "__et")
    n = notes.withColumn("__sb", F.floor(F.col(start) / QUARTER)).withColumn("__eb", F.floor(F.col(end) / QUARTER))
    n = n.join(a, [*keys, "__sb"], "left").join(b, [*keys, "__eb"], "left")
    grid = lambda m: F.when(F.col(m), TRIPLET).otherwise(step)
    q0 = F.greatest(F.lit(0), snap(F.col(start), grid("__st")))
    n = n.withColumn("q_start", q0).withColumn("__qb", F.floor(F.col("q_start") / QUARTER))
    c = marks.withColumnRenamed("beat", "__qb").withColumnRenamed("__t", "__qt")
    n = n.join(c, [*keys, "__qb"], "left")
    q1 = F.greatest(F.greatest(F.lit(0), snap(F.col(end), grid("__et"))), F.col("q_start") + grid("__qt"))
    return n.withColumn("q_end", q1).drop("__sb", "__eb", "__st", "__et", "__qb", "__qt")


def trim_overlaps(notes: DataFrame, keys: list[str], start: str, end: str, pitch: str, id_: str, step: int, triplets: DataFrame) -> DataFrame:
    """Cut ends that run a little into the next note, and notes of one pitch that overlap; drop doubles.

    A small overrun is at most one grid step and a quarter of the note; the grid is that of the beat in which the next
    note starts (`triplets`: keys and beat of the triplet beats; `step` elsewhere).  Of several notes with one start and pitch
    the first stays.  Within a pitch an end is cut at the next later start of that pitch.
    """
    starts = notes.select(*keys, start).distinct()
    s = Ordered.of(starts, keys, [start], probe=notes.select(*keys)).add(__next=lead(start)).done()
    marks = triplets.select(*keys, F.col("beat").alias("__nb"), F.lit(TRIPLET).alias("__grid"))
    s = s.withColumn("__nb", F.floor(F.col("__next") / QUARTER)).join(marks, [*keys, "__nb"], "left")
    grid = F.coalesce("__grid", F.lit(step))
    n = notes.join(s, [*keys, start])
    over = F.col(end) - F.col("__next")
    small = (over > 0) & (over <= grid) & (over * 4 <= F.col(end) - F.col(start))
    n = n.withColumn(end, F.when(small, F.col("__next")).otherwise(F.col(end))).drop("__next", "__nb", "__grid")
    by = n.groupBy(*keys, pitch, start).agg(F.min(F.struct(F.col(id_).alias("i"), F.col(end).alias("e"))).alias("__f"))
    o = Ordered.of(by, [*keys, pitch], [start], probe=notes.select(*keys, pitch)).add(__later=lead(start))
    e = F.least(F.col("__f.e"), F.coalesce("__later", F.col("__f.e")))
    return o.done().select(*keys, pitch, start, e.alias(end), F.col("__f.i").alias(id_))


def bars_from_meters(meters: DataFrame, ends: DataFrame, keys: list[str], step: int = 12) -> DataFrame:
    """Bar grid (keys, bar_start, bar_end, beats, beat_type) of each file.

    `meters`: at, beats, beat_type; `ends`: until.  Every meter is tiled by its bar length; the next meter, moved to
    the 6-tick grid, cuts the bar it falls in.  4/4 before the first meter.
    """
    first = ends.select(*keys, F.lit(0).cast("bigint").alias("at"), F.lit(4).alias("beats"), F.lit(4).alias("beat_type"), F.lit(0).alias("__r"))
    m = meters.select(*keys, snap(F.col("at"), F.lit(6)).cast("bigint").alias("at"), "beats", "beat_type", F.lit(1).alias("__r")).unionByName(first)
    m = m.groupBy(*keys, "at").agg(F.max_by(F.struct("beats", "beat_type"), "__r").alias("__m"))
    o = Ordered.of(m, keys, ["at"], probe=meters.select(*keys)).add(__next=lead("at"))
    rows = o.done().join(ends, keys).select(*keys, "at", F.col("__m.beats").alias("beats"), F.col("__m.beat_type").alias("beat_type"), F.coalesce("__next", "until").alias("__to"))
    length = (F.lit(QUARTER * 4) * F.col("beats") / F.col("beat_type")).cast("bigint")
    rows = rows.filter(F.col("__to") > F.col("at")).withColumn("__len", length)
    rows = rows.withColumn("bar_start", F.explode(F.sequence(F.col("at"), F.col("__to") - 1, F.col("__len"))))
    return rows.select(*keys, "bar_start", F.least(F.col("bar_start") + F.col("__len"), F.col("__to")).alias("bar_end"), "beats", "beat_type")


def split_at_beats(notes: DataFrame, start: str, end: str, beat: float) -> DataFrame:
    """Notes cut at every beat line: `from_`, `to_` per piece, pieces numbered by `beat`."""
    last = F.greatest(F.floor(F.col(start) / beat), F.ceil(F.col(end) / beat) - 1)
    n = notes.withColumn("beat", F.explode(F.sequence(F.floor(F.col(start) / beat), last)))
    lo, hi = F.col("beat") * beat, (F.col("beat") + 1) * beat
    return n.withColumn("from_", F.greatest(F.col(start), lo)).withColumn("to_", F.least(F.col(end), hi))


def max_concurrency(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Voices a bar needs: the most spans (start, end counted once each) that sound at one time."""
    d = deal(spans.select(*keys, start, end), keys, spans).distinct()
    ev = d.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    ev = ev.groupBy(*keys, F.col("e.t").alias("t"), F.col("e.d").alias("d")).agg(F.sum("e.d").alias("s"))
    o = Ordered.of(ev, keys, ["t", "d"], probe=spans, placed=True).add(__open=running_sum("s"))
    return o.df.groupBy(*keys).agg(F.max("__open").cast("bigint").alias("voices"))


def stable_event_order(kind: Column) -> Column:
    """Rank of events at one tick: ends, then words, then starts."""
    return F.when(kind == "off", 0).when(kind == "lyric", 1).otherwise(2)


def rank_alternatives(df: DataFrame, keys: list[str], label: str, score: str, k: int) -> DataFrame:
    """The `k` best labels of each run by their best score, lower label first on a tie."""
    best = df.groupBy(*keys, label).agg(F.max(score).alias(score))
    o = Ordered.of(best.withColumn("__neg", -F.col(score)), keys, ["__neg", label], probe=df.select(*keys)).add(rank=row_number())
    return o.filter(F.col("rank") <= k).done().drop("__neg")


