"""Play order and note timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import Ordered, deal, lag, last_value, lead, row_number, running_sum
from ..operators.sequence import flag, merge_ties
from ..session import cut_lineage

# Fixed value: velocity of notes without one.
DEFAULT_VELOCITY = 100


def expand_passes(passes: DataFrame, measures: DataFrame, song: list[str]) -> DataFrame:
    """One row per played measure.  `passes`: pass_ix, mid, end_mid (half open), pass, offset, until;
    `measures`: measure, len.  Play order is (pass_ix, measure).

    A pass meets the blocks of measures it covers, so neither a long song nor many passes form pairs that don't play.
    The passes' rows for blocks may be many more than Spark's estimate says, so they are not to be broadcast.
    """
    block = 64
    p = passes.filter(F.col("end_mid") > F.col("mid")).withColumn("__bk", F.explode(F.sequence(F.floor(F.col("mid") / block), F.floor((F.col("end_mid") - 1) / block))))
    met = p.hint("merge").join(measures.withColumn("__bk", F.floor(F.col("measure") / block)), [*song, "__bk"]).drop("__bk")
    return met.filter((F.col("measure") >= F.col("mid")) & (F.col("measure") < F.col("end_mid")))


def played_measures(passes: DataFrame, measures: DataFrame, song: list[str]) -> DataFrame:
    """Played measures with their start time `onset` and the part of them that sounds (`cut_from`, `cut_to`)."""
    rows = expand_passes(passes, measures, song)
    rows = rows.withColumn("cut_from", F.when(F.col("measure") == F.col("mid"), F.coalesce("offset", F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("cut_to", F.when(F.col("measure") == F.col("end_mid") - 1, F.col("until")))
    rows = rows.withColumn("sounds", F.least("len", F.coalesce("cut_to", "len")) - F.col("cut_from"))
    rows = cut_lineage(rows)  # counted, then passed
    o = Ordered.of(rows, song, ["pass_ix", "measure"]).add(onset=running_sum("sounds", before=True))
    return o.done()


def build_timeline(passes: DataFrame, measures: DataFrame, notes: DataFrame, song: list[str]) -> DataFrame:
    """Sounding notes: song, part, pitch, t0, t1, velocity, pieces, pass.

    `notes`: measure, note_ix, part, pos, dur, pitch, tie_stop, velocity.  Notes before an entry point or after a
    limit are cut; a tie stop that touches the note before it on its part and pitch prolongs that note.
    """
    played = played_measures(passes, measures, song).select(*song, "pass_ix", "pass", "measure", "onset", "cut_from", "cut_to")
    n = notes.join(played, [*song, "measure"])
    n = n.filter((F.col("pos") >= F.col("cut_from")) & (F.col("cut_to").isNull() | (F.col("pos") < F.col("cut_to"))))
    t0 = F.col("onset") + F.col("pos") - F.col("cut_from")
    n = n.select(*song, "part", "pitch", t0.alias("t0"), (t0 + F.col("dur")).alias("t1"), "pass_ix", "measure", "note_ix", "pass",
                 F.coalesce("velocity", F.lit(float(DEFAULT_VELOCITY))).alias("velocity"), "tie_stop")
    n = cut_lineage(n)  # counted, then passed
    return merge_ties(n, [*song, "part", "pitch"], ["t0", "pass_ix", "measure", "note_ix"], "t0", "t1", F.col("tie_stop"), "velocity", "pass")


def repeat_passes(measures: DataFrame, song: list[str], order: str, fwd: Column, bwd: Column, endings: str) -> DataFrame:
    """Play order from repeat signs and numbered endings: (song, section, pass, measure), played in that order.

    A section starts at a forward sign, after a backward sign, and after its last ending; endings behind a backward
    sign still belong to it.  It is played as often as its highest ending says, twice if it has only a backward sign.
    """
    o = Ordered.of(measures, song, [order]).with_column("__fwd", fwd).with_column("__bwd", bwd)
    o = o.add(__was=lag(F.struct(F.col("__bwd").alias("b"), F.col(endings).isNotNull().alias("e"))))
    plain = F.col(endings).isNull()
    new = F.col("__fwd") | (plain & (F.coalesce(F.col("__was.b"), F.lit(False)) | F.coalesce(F.col("__was.e"), F.lit(False))))
    o = o.with_column("__new", flag(new)).add(section=running_sum("__new"))
    rows = o.done()
    times = rows.groupBy(*song, "section").agg(
        F.max(F.array_max(endings)).alias("__top"), F.max("__bwd").alias("__rep"))
    rows = rows.join(times, [*song, "section"])
    n = F.when(F.col("__top").isNotNull(), F.col("__top")).when(F.col("__rep"), 2).otherwise(1)
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(1), n.cast("int"))))
    rows = rows.filter(plain | F.array_contains(F.col(endings), F.col("pass")))
    return rows.select(*song, "section", "pass", F.col(order).alias("measure"))


def section_order(sequence: DataFrame, sections: DataFrame, song: list[str]) -> DataFrame:
    """Sections in the order asked for: (song, place, name, first_pass, passes).

    `sequence`: song, pos, name; `sections`: song, name, passes.  Verse numbers go on each time a section returns;
    unknown names are skipped; measures before the first label (name '') are played once, first.
    """
    lead = sections.filter("name = ''").select(*song, F.lit(-1).cast("bigint").alias("pos"), "name")
    known = sequence.select(*song, F.col("pos").cast("bigint").alias("pos"), "name").filter("name <> ''")
    some = known.join(sections.select(*song, "name"), [*song, "name"], "left_semi").select(*song).distinct()
    asked = known.unionByName(lead.join(some, song, "left_semi")).join(sections.select(*song, "name", "passes"), [*song, "name"])
    o = Ordered.of(asked, [*song, "name"], ["pos"]).add(__used=running_sum("passes", before=True))
    return o.done().select(*song, "pos", "name", (F.col("__used") + 1).alias("first_pass"), "passes")


def section_runs(members: DataFrame, song: list[str], name: str, measure: str) -> DataFrame:
    """Runs of consecutive measures of a section: (song, name, run_from, run_end), end exclusive."""
    o = Ordered.of(members, [*song, name], [measure]).add(__prev=lag(measure))
    o = o.with_column("__new", 1 - flag(F.col("__prev") == F.col(measure) - 1)).add(__run=running_sum("__new"))
    return o.df.groupBy(*song, name, "__run").agg(F.min(measure).alias("run_from"), (F.max(measure) + 1).alias("run_end")).drop("__run")


def sing_order(items: DataFrame, members: DataFrame, song: list[str], measure: str = "measure") -> DataFrame:
    """Play items of an explicit list of section and verse: (song, pos, name, run_from, run_end, pass)."""
    runs = section_runs(members, song, "name", measure)
    return items.join(runs, [*song, "name"]).select(*song, "pos", "name", "run_from", "run_end", F.coalesce("verse", F.lit(1)).cast("bigint").alias("pass"))


def verses_fallback(songs: DataFrame, song: list[str], measures: str, verses: str) -> DataFrame:
    """No repeat signs: the whole song once per verse."""
    n = F.greatest(F.lit(1), F.col(verses)).cast("bigint")
    return songs.select(*song, F.lit(0).cast("bigint").alias("mid"), F.col(measures).alias("end_mid"), F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("pass"))


def unplayed(measures: DataFrame, passes: DataFrame, song: list[str]) -> DataFrame:
    """Measures no pass reaches."""
    played = expand_passes(passes, measures, song).select(*song, "measure").distinct()
    return measures.join(played, [*song, "measure"], "left_anti")


def distinct_verses(lyrics: DataFrame, note: list[str], order: str, verse: str) -> DataFrame:
    """On one note a verse number that is taken moves to one above the highest so far.

    The lyrics of a note are folded in order; a note carries a handful of them.
    """
    g = lyrics.groupBy(*note).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(verse).cast("bigint").alias("v")))).alias("__l"))
    start = F.struct(F.lit(0).cast("bigint").alias("top"), F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<o:bigint,v:bigint>>").alias("out"))

    def put(s, x):
        v = F.when(F.array_contains(s["used"], x["v"]), s["top"] + 1).otherwise(x["v"])
        return F.struct(F.greatest(s["top"], v).alias("top"), F.array_append(s["used"], v).alias("used"),
                        F.array_append(s["out"], F.struct(x["o"].cast("bigint").alias("o"), v.alias("v"))).alias("out"))

    return g.select(*note, F.explode(F.aggregate("__l", start, put, lambda s: s["out"])).alias("e")).select(*note, F.col("e.o").alias(order), F.col("e.v").alias(verse))


def axis_slots(measures: DataFrame, song: list[str], part: str, order: list[str], system: str) -> DataFrame:
    """Slot of each measure on the common axis of a song's parts.

    Systems are laid out one after the other, each as long as its longest part.  With one part, or where some
    part's first measure names no system, the slot is the plain index.
    """
    o = Ordered.of(measures, [*song, part], order).add(__sys=last_value(system), __ix=row_number())
    rows = o.done()
    per = rows.groupBy(*song, part).agg(F.max((F.col("__ix") == 1) & F.col("__sys").isNotNull()).alias("__ok"))
    grouped = per.groupBy(*song).agg((F.min("__ok") & (F.count(F.lit(1)) > 1)).alias("__grouped"))
    first = rows.groupBy(*song, part, "__sys").agg(F.min("__ix").alias("__ix0"), F.count(F.lit(1)).alias("__n"))
    size = first.groupBy(*song, "__sys").agg(F.max("__n").alias("__size"))
    s = Ordered.of(size, song, ["__sys"], probe=measures.select(*song)).add(__start=running_sum("__size", before=True)).done()
    rows = rows.join(first.drop("__n"), [*song, part, "__sys"], "left").join(s.drop("__size"), [*song, "__sys"], "left").join(grouped, song)
    slot = F.when(F.col("__grouped"), F.col("__start") + F.col("__ix") - F.col("__ix0")).otherwise(F.col("__ix") - 1)
    return rows.withColumn("slot", slot).drop("__sys", "__ix", "__ix0", "__start", "__grouped")


def endings_from_passes(played: DataFrame, song: list[str]) -> DataFrame:
    """Numbered endings implied by which passes play which measures: (song, run_from, run_end, passes).

    `played`: song, measure, pass.  Neighbouring measures with equal passes form a segment.  Segments after one
    that split its passes among them - none twice, all covered, at least two - are its endings.
    """
    per = deal(played.select(*song, "measure", "pass"), song, played).groupBy(*song, "measure").agg(F.sort_array(F.collect_set("pass")).alias("set"))
    o = Ordered.of(per, song, ["measure"], probe=played, placed=True).add(__was=lag(F.struct("measure", "set")), __nx=lead("set"))
    same = (F.col("__was.measure") == F.col("measure") - 1) & (F.col("__was.set") == F.col("set"))
    o = o.with_column("__new", 1 - flag(same)).add(seg=running_sum("__new"))
    segs = o.df.groupBy(*song, "seg").agg(F.min("measure").alias("run_from"), (F.max("measure") + 1).alias("run_end"), F.first("set").alias("set"),
        F.max_by("__nx", "measure").alias("__nx"))
    # a segment's endings number at most as many as its passes, so it looks that many segments ahead
    segs = cut_lineage(segs)  # read three times below
    starts = (F.size("__nx") < F.size("set")) & (F.size(F.array_except("__nx", "set")) == 0)
    segs, heads = segs.drop("__nx"), segs.filter(starts)
    ahead = heads.select(
        *song, F.col("seg").alias("head"), F.col("set").alias("all"), F.posexplode(F.sequence(F.col("seg") + 1, F.col("seg") + F.size("set"))).alias("k", "seg"))
    ahead = ahead.join(segs.select(*song, "seg", "set"), [*song, "seg"])
    heads = ahead.groupBy(*song, "head").agg(F.first("all").alias("all"), F.sort_array(F.collect_list(F.struct("k", "set"))).alias("next"))
    start = F.struct(F.array().cast("array<bigint>").alias("acc"), F.lit(0).alias("n"), F.lit(0).alias("stop"))

    def take(s, x):
        go = (s["stop"] == 0) & (x["k"] == s["n"]) & (F.size(F.array_intersect(s["acc"], x["set"])) == 0)
        acc = F.when(go, F.concat(s["acc"], x["set"])).otherwise(s["acc"])
        full = F.sort_array(acc) == F.col("all")
        return F.struct(acc.alias("acc"), (s["n"] + F.when(go, 1).otherwise(0)).alias("n"), F.when(~go | full, 1).otherwise(s["stop"]).alias("stop"))

    heads = heads.withColumn("got", F.aggregate("next", start, take))
    ok = (F.sort_array("got.acc") == F.col("all")) & (F.col("got.n") >= 2)
    heads = heads.filter(ok).select(*song, "head", (F.col("head") + F.col("got.n")).alias("last"))
    # a head that is the last ending of a group before it does not count; along a chain of such, every second one does
    h = Ordered.of(heads, song, ["head"], probe=played.select(*song)).add(__pl=lag("last"))
    h = h.with_column("__link", flag(F.col("__pl") == F.col("head"))).with_column("__new", 1 - F.col("__link"))
    h = h.add(__run=running_sum("__new"), __row=row_number())
    rows = h.done()
    base = rows.groupBy(*song, "__run").agg(F.min("__row").alias("__first"))
    rows = rows.join(base, [*song, "__run"]).filter((F.col("__row") - F.col("__first")) % 2 == 0)
    group = rows.select(*song, F.explode(F.sequence(F.col("head") + 1, F.col("last"))).alias("seg"))
    return segs.join(group, [*song, "seg"]).select(*song, "run_from", "run_end", F.array_join(F.transform("set", lambda x: x.cast("string")), ",").alias("passes"))
