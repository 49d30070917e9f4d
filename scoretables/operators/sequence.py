"""Sequence operators: carried values, runs, repeats and depths along the order of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import Ordered, lag, last_value, lead, next_value, row_number, running_min, running_sum, total
from .stats import gap_clusters, median_index, null_safe_join, quantiles


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0)


def carry_attr(df: DataFrame, keys, order, attrs: Column, left: Column, right: Column, default: Column, name="in_force", probe: DataFrame | None = None) -> DataFrame:
    """Value in force per measure: a change on the right barline acts from the next measure on; a change in the
    measure's own attributes beats one on its left barline, which beats the one left over from before.  `probe`: as for
    Ordered.of()."""
    o = Ordered.of(df, keys, order, probe=probe).add(__pending=lag(right))
    o = o.with_column("__now", F.coalesce(attrs, left, F.col("__pending"))).add(**{name: last_value("__now")})
    return o.with_column(name, F.coalesce(F.col(name), default)).done().drop("__pending", "__now")


def running_onset(measures: DataFrame, keys, order, length: Column, name="onset") -> DataFrame:
    """Time at the start of each measure."""
    return Ordered.of(measures, keys, order).add(**{name: running_sum(length, before=True)}).done()


def change_points(df: DataFrame, keys, order, *cols: str) -> DataFrame:
    """Rows whose values differ from the row before; the first row of a group always."""
    now = F.struct(*cols)
    o = Ordered.of(df, keys, order).add(__prev=lag(now))
    return o.filter(F.col("__prev").isNull() | ~F.col("__prev").eqNullSafe(now)).done().drop("__prev")


def accidental_carry(notes: DataFrame, measure_degree, order, offset: Column, name="sounding") -> DataFrame:
    """Offset a note sounds with: the last explicit sign on its degree in its measure, else 0."""
    o = Ordered.of(notes, measure_degree, order).add(**{name: last_value(offset)})
    return o.with_column(name, F.coalesce(F.col(name), F.lit(0))).done()


def accidental_marks(notes: DataFrame, measure_degree, order, offset: str, name="mark") -> DataFrame:
    """Offset to print where it differs from the one carried on the degree; NULL elsewhere."""
    o = Ordered.of(notes, measure_degree, order).add(__was=lag(offset))
    return o.with_column(name, F.when(F.col(offset) != F.coalesce("__was", F.lit(0)), F.col(offset))).done().drop("__was")


def add_depth(o: Ordered, starts: Column, ends: Column, name="depth") -> Ordered:
    """Open spans after each row; an end without a start counts for nothing."""
    o = o.with_column("__delta", starts - ends).add(__sum=running_sum("__delta"))
    o = o.add(__low=running_min("__sum"))
    o = o.with_column(name, F.col("__sum") - F.least(F.lit(0), F.col("__low")))
    return Ordered(o.df.drop("__delta", "__sum", "__low"), o.keys, o.order, o.blocked, o.max_rows)


def clamped_depth(df: DataFrame, keys, order, starts: Column, ends: Column, name="depth") -> DataFrame:
    return add_depth(Ordered.of(df, keys, order), starts, ends, name).done()


def merge_ties(notes: DataFrame, keys, order, t0: str, t1: str, tie_stop: Column, *keep: str, probe: DataFrame | None = None) -> DataFrame:
    """One row per sounding note: a tie stop joins the note before it on the same part and pitch when they touch.

    `keep` columns come from the note that starts it.
    """
    o = Ordered.of(notes, keys, order, probe=probe).add(__end=lag(t1))
    o = o.with_column("__new", 1 - flag(tie_stop & (F.abs(F.col("__end") - F.col(t0)) < 1e-6))).add(__isl=running_sum("__new"))
    # pieces follow each other in time, so the last one ends last; just one of them is the start
    return o.df.groupBy(*keys, "__isl").agg(
        F.min(t0).alias(t0), F.max(t1).alias(t1), F.count(F.lit(1)).alias("pieces"),
        *[F.max(F.when(F.col("__new") == 1, F.col(k))).alias(k) for k in keep]).drop("__isl")


def carried_lyric(notes: DataFrame, part, order, t0: str, t1: str, pass_: str, word: str, extend: str, starts: Column, ends: Column) -> DataFrame:
    """`lyric`: the word, `-` on notes that go on from a sung one, NULL elsewhere.

    A dash after the last word of its pass stays only inside a slur or after a word marked as extended.
    """
    o = add_depth(Ordered.of(notes, part, order), starts, ends, "__depth")
    o = o.add(__open=lag("__depth"), __end=lag(t1), __was=lag(pass_))
    goes_on = (F.col("__was") == F.col(pass_)) & (F.abs(F.col("__end") - F.col(t0)) < 1e-6)
    o = o.with_column("__head", F.when(F.col(word).isNotNull() | ~F.coalesce(goes_on, F.lit(False)), F.struct(word, extend)))
    o = o.add(__sung=last_value("__head"))
    rows = o.done()
    last = rows.filter(F.col(word).isNotNull()).groupBy(*part, pass_).agg(F.max(t0).alias("__last"))
    rows = rows.join(last, [*part, pass_], "left")
    dash = F.col(f"__sung.{word}").isNotNull()
    keep = F.coalesce(F.col(f"__sung.{extend}"), F.lit(False)) | (F.coalesce("__open", F.lit(0)) > 0) | (F.col(t0) <= F.col("__last"))
    lyric = F.coalesce(F.col(word), F.when(dash & keep, F.lit("-")))
    return rows.withColumn("lyric", lyric).drop("__depth", "__open", "__end", "__was", "__head", "__sung", "__last")


def row_pitch_tol(df: DataFrame, keys, y: str) -> DataFrame:
    """Per group the distance within which heights belong to one row."""
    d = df.select(*keys, y).distinct()
    o = Ordered.of(d, keys, [y], probe=df.select(*keys)).add(__prev=lag(y))
    gaps = o.done().select(*keys, (F.col(y) - F.col("__prev")).alias("__gap")).filter(F.col("__gap") > 2)
    med = quantiles(gaps, keys, "__gap", {"pitch": median_index}).drop("n")
    # 12 without gaps, at least 3, 0.45 of the median gap.
    tol = F.greatest(F.lit(3.0), F.when(F.coalesce("pitch", F.lit(0)) != 0, F.col("pitch")).otherwise(12) * 0.45)
    return null_safe_join(df.select(*keys).distinct(), med, keys, "left").select(*keys, tol.alias("tol"))


def row_clusters(df: DataFrame, keys, y: str) -> DataFrame:
    """Rows of a page: heights that follow each other within the page's own tolerance."""
    tol = row_pitch_tol(df, keys, y)
    return gap_clusters(df.join(tol, keys), keys, y, F.col("tol"), name="row_no")


def step_gaps(df: DataFrame, page, y: str, least: float) -> DataFrame:
    """Differences above `least` between neighbours of a page; one row each."""
    o = Ordered.of(df.select(*page, y, "__id") if "__id" in df.columns else df.select(*page, y), page, [y]).add(__prev=lag(y))
    return o.done().select(*page, (F.col(y) - F.col("__prev")).alias("gap")).filter(F.col("gap") > least)


def run_collapse(df: DataFrame, keys, order, label: str, blank) -> DataFrame:
    """Runs of one label: (keys, label, first_pos, end_pos) with end exclusive; positions count from 0."""
    o = Ordered.of(df, keys, order).add(__pos=row_number(), __was=lag(F.struct(label)))
    o = o.with_column("__new", 1 - flag(F.col("__was").eqNullSafe(F.struct(label)))).add(__run=running_sum("__new"))
    runs = o.df.groupBy(*keys, "__run").agg(
        F.first(label).alias(label), (F.min("__pos") - 1).alias("first_pos"), F.max("__pos").alias("end_pos"))
    return runs.filter(F.col(label) != blank).drop("__run")


def islands(o: Ordered, member: Column, name: str) -> Ordered:
    """Number the stretches of consecutive members: rows that are none get numbers of their own."""
    o = o.with_column("__m", flag(member)).add(__wasm=lag("__m"))
    o = o.with_column("__new", F.when((F.col("__m") == 1) & (F.col("__wasm") == 1), 0).otherwise(1)).add(**{name: running_sum("__new")})
    return Ordered(o.df.drop("__wasm", "__new"), o.keys, o.order, o.blocked, o.max_rows)


def grow_region(pages: DataFrame, book, order, seed: Column, eligible: Column, name="grown") -> DataFrame:
    """Pages reached from a seed through eligible neighbours: a stretch of either kind that holds a seed."""
    o = islands(Ordered.of(pages, book, order), seed | eligible, "__isl")
    rows = o.with_column("__seed", seed).done()
    have = rows.groupBy(*book, "__isl").agg(F.max("__seed").alias("__has"))
    return rows.join(have, [*book, "__isl"]).withColumn(name, (F.col("__m") == 1) & F.col("__has")).drop("__isl", "__m", "__seed", "__has")


def segment_by_title(bands: DataFrame, book, order, is_title: Column, name="segment") -> DataFrame:
    """Each band with the number of the last title at or above it; 0 before the first."""
    return Ordered.of(bands, book, order).add(**{name: running_sum(flag(is_title))}).done()


def bars_per_line(measures: DataFrame, page, order, length: str, n: int, name="line") -> DataFrame:
    """Fixed number of bars per line; a pickup bar (shorter than the next) is not counted."""
    o = Ordered.of(measures, page, order).add(__r=row_number(), __next=lead(length))
    o = o.with_column("__p", F.when((F.col("__r") == 1) & (F.col(length) < F.col("__next")), 1).otherwise(0))
    o = o.add(__pickup=total("max", "__p"))
    line = F.greatest(F.lit(0), F.floor((F.col("__r") - 1 - F.col("__pickup")) / n))
    return o.with_column(name, line).done().drop("__r", "__next", "__p", "__pickup")


def multi_rest_runs(rows: DataFrame, song, measure: str, declared: Column, rest: Column, changed: Column) -> DataFrame:
    """Declared runs of n >= 2 rest measures that may be drawn as one: every part rests through all of them and
    nothing changes inside.  `rows`: one per part and measure; measures are numbered without holes."""
    per = rows.groupBy(*song, measure).agg(
        F.max(F.coalesce(declared, F.lit(0))).alias("n"), F.min(rest).alias("__rest"), F.max(changed).alias("__chg"))
    o = Ordered.of(per, song, [measure], probe=rows.select(*song)).add(
        __bad=running_sum(flag(~F.col("__rest"))), __chgs=running_sum(flag(F.col("__chg") | (F.col("n") > 0))))
    o = o.with_column("__bad0", F.col("__bad") - flag(~F.col("__rest")))
    m = o.done()
    end = m.select(*song, F.col(measure).alias("__last"), F.col("__bad").alias("__bad1"), F.col("__chgs").alias("__chgs1"))
    runs = m.filter("n >= 2").withColumn("__last", F.col(measure) + F.col("n") - 1).join(end, [*song, "__last"])
    ok = (F.col("__bad1") == F.col("__bad0")) & (F.col("__chgs1") == F.col("__chgs"))
    return runs.filter(ok).select(*song, measure, "n")


def head_fingerprint(keys: Column, rests: Column, n: int = 8) -> Column:
    """First `n` keys of a line after its leading rests, joined; empty when there are fewer."""
    start = F.array_position(rests, False)
    head = F.slice(keys, F.when(start > 0, start).otherwise(1).cast("int"), n)
    return F.when((start > 0) & (F.size(head) == n), F.array_join(head, ",")).otherwise("")


def parallel_lines(lines: DataFrame, fingerprint: str, *line_id: str) -> DataFrame:
    """Lines that start alike, each with the first of its kind and how many there are; no pairs are formed."""
    full = cut_lineage(lines.filter(F.col(fingerprint) != ""))  # the texts are read and matched once
    group = full.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("n_parallel"), F.min(F.struct(*line_id)).alias("first_line"))
    return full.join(group.filter("n_parallel > 1"), fingerprint)


def system_gaps(bands: DataFrame, song, order, y0: str, y1: str, music: Column, flat: Column, title: Column, char_h: float) -> DataFrame:
    """Blank above each system of a song but the first one under a title.

    Flat bands right above a music band (closer than 0.8 of a character) belong to its system.
    """
    o = Ordered.of(bands, song, order).add(__i=row_number())
    o = o.with_column("__flat", flat).add(__next=next_value(F.when(~F.col("__flat"), F.struct(F.col(y0).alias("y"), music.alias("m"))), before=True))
    close = F.col("__flat") & F.col("__next.m") & (F.col("__next.y") - F.col(y1) < char_h * 0.8) & (F.col("__i") > 1)
    # a music band takes the flat ones above it, so a group ends at each band that is not absorbed
    o = o.with_column("__own", 1 - flag(close)).add(__sys=running_sum("__own", before=True))
    sys = o.df.groupBy(*song, "__sys").agg(
        F.min(y0).alias("top"), F.max_by(F.struct(F.col(y1).alias("bottom"), (music & ~F.col("__flat")).alias("music"), title.alias("title"), F.col("__i").alias("i")), "__i").alias("__b"))
    s = Ordered.of(sys, song, ["__sys"], probe=bands.select(*song), placed=True).add(__above=lag("__b"))
    rows = s.done().filter(F.col("__b.music") & F.col("__above").isNotNull())
    rows = rows.filter(~((F.col("__above.i") == 1) & F.col("__above.title")))
    return rows.select(*song, F.col("__b.i").alias("band"), (F.col("top") - F.col("__above.bottom")).alias("gap"))


def beam_groups(elements: DataFrame, voice, order, dur: Column, level: Column, group_len: Column, onset: Column | None = None) -> DataFrame:
    """(element, level, beam) for runs of beamable notes inside one beat.

    An element stands where the one before it ends, or at its own `onset` where it has one, and the next ones follow it.

    `level` is the number of beams a note takes (0: none).  A note alone in its run has none.
    """
    o = Ordered.of(elements, voice, order).add(__at=running_sum(dur, before=True))
    if onset is not None:
        o = o.add(__shift=last_value(F.when(onset.isNotNull(), onset - F.col("__at"))))
        o = o.with_column("__at", F.col("__at") + F.coalesce("__shift", F.lit(0)))
    o = o.with_column("__lv", level).with_column("__g", F.floor(F.col("__at") / group_len))
    o = o.add(__was=lag(F.struct("__lv", "__g")), __nxt=lead(F.struct("__lv", "__g")))
    linked = lambda side: (F.col("__lv") > 0) & (F.col(f"{side}.__lv") > 0) & (F.col(f"{side}.__g") == F.col("__g"))
    before = F.when(F.coalesce(linked("__was"), F.lit(False)), F.col("__was.__lv")).otherwise(0)
    after = F.when(F.coalesce(linked("__nxt"), F.lit(False)), F.col("__nxt.__lv")).otherwise(0)
    rows = o.done().withColumn("__b", before).withColumn("__a", after).filter("__lv > 0 and __b + __a > 0")
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(1), F.col("__lv").cast("int"))))
    prev, nxt = F.col("__b") >= F.col("level"), F.col("__a") >= F.col("level")
    beam = (F.when(prev & nxt, "continue").when(prev, "end").when(nxt, "begin").when(F.col("__b") == 0, "forward hook")
            .otherwise("backward hook"))
    return rows.withColumn("beam", beam).drop("__at", "__shift", "__lv", "__g", "__was", "__nxt", "__b", "__a")


def beat_clicks(measures: DataFrame, song, order, length: str, beats: str, beat_type: str) -> DataFrame:
    """One row per click: time and whether it is a downbeat.  A short first measure starts late in its bar."""
    o = Ordered.of(measures, song, order).add(__pos=running_sum(length, before=True), __r=row_number())
    compound = (F.col(beat_type) == 8) & (F.col(beats) % 3 == 0) & (F.col(beats) > 3)
    beat = F.lit(4.0) / F.col(beat_type) * F.when(compound, 3).otherwise(1)
    full = F.col(beats) * 4.0 / F.col(beat_type)
    shift = F.when((F.col("__r") == 1) & (F.col(length) < full - 1e-9), full - F.col(length)).otherwise(0.0)
    m = o.done().withColumn("__beat", beat).withColumn("__shift", shift)
    first = F.ceil(F.col("__shift") / F.col("__beat") - 1e-9)
    last = F.ceil((F.col("__shift") + F.col(length) - 1e-9) / F.col("__beat")) - 1
    m = m.withColumn("__k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return m.select(*song, *order, (F.col("__pos") + F.col("__k") * F.col("__beat") - F.col("__shift")).alias("t"), (F.col("__k") == 0).alias("down"))


def occurrence(df: DataFrame, keys, order, name="k") -> DataFrame:
    """Which occurrence of its key a row is, from 1."""
    return Ordered.of(df, keys, order).add(**{name: row_number()}).done()
