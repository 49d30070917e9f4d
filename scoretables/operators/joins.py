"""Joins Spark has no operator for, built from equi-joins and ordered passes.

Ranges meet through buckets or a merged order, never through a cross join; dictionary lookups are keyed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import Ordered, deal, last_value, lead, next_value
from .stats import attach


def resolve_marks(marks: DataFrame, elements: DataFrame, doc: list[str], start: str, end: str, element: str, pos: str) -> DataFrame:
    """Spans given by element ids -> spans given by positions; spans with an unknown end are dropped."""
    at = elements.select(*doc, F.col(element).alias("__id"), F.col(pos).alias("__p"))
    first = at.withColumnRenamed("__id", start).withColumnRenamed("__p", "from_pos")
    last = at.withColumnRenamed("__id", end).withColumnRenamed("__p", "to_pos")
    return marks.join(first, [*doc, start]).join(last, [*doc, end])


def buckets(lo: Column, hi: Column, width) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def _level(length: Column, width) -> Column:
    """0 for lengths up to `width`, one more for each doubling: an interval touches two buckets of its level's size, or
    a third by its end."""
    return F.when(length > width, F.ceil(F.log2(length / width))).otherwise(0).cast("int")


def _levels(*columns: tuple[DataFrame, Column]) -> list[int]:
    """The levels that occur, a few dozen at most whatever the lengths."""
    found = set()
    for df, level in columns:
        found |= set(df.agg(F.collect_set(level).alias("l")).first()["l"])
    return sorted(found) or [0]


def _spread(df: DataFrame, lo: Column, hi: Column, width, levels: Column) -> DataFrame:
    """Rows once for each bucket (`__lv`, `__bk`) that [lo, hi] touches at the given levels.

    Spark's estimate of a side's size doesn't count what explode() makes of it, so it would send far more than it means
    to through the driver: joins of spread rows are hinted as merge joins.
    """
    rows = df.withColumn("__lv", F.explode(levels))
    size = F.lit(width) * F.pow(F.lit(2.0), F.col("__lv"))
    return rows.withColumn("__bk", F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))))


def overlap_join(notes: DataFrame, bars: DataFrame, keys: list[str], note: tuple[str, str], bar: tuple[str, str], width) -> DataFrame:
    """Every note with every bar it overlaps, clipped to the bar (`from_`, `to_`); ranges are half open.

    Buckets start at `width` (about a bar) and double by level.  A range enters the buckets of its own level and of the
    longer levels that occur, so one very long range costs a few rows.  A pair meets at the longer one's level, in the
    first bucket they share.
    """
    n_level, b_level = _level(F.col(note[1]) - F.col(note[0]), width), _level(F.col(bar[1]) - F.col(bar[0]), width)
    levels = F.array(*[F.lit(x) for x in _levels((notes, n_level), (bars, b_level))])
    n = notes.withColumn("__nl", n_level)
    n = _spread(n, F.col(note[0]), F.col(note[1]), width, F.filter(levels, lambda x: x >= F.col("__nl")))
    b = bars.withColumn("__bl", b_level)
    b = _spread(b, F.col(bar[0]), F.col(bar[1]), width, F.filter(levels, lambda x: x >= F.col("__bl")))
    size = F.lit(width) * F.pow(F.lit(2.0), F.col("__lv"))
    first = F.greatest(F.floor(F.col(note[0]) / size), F.floor(F.col(bar[0]) / size))
    met = n.join(b.hint("merge"), [*keys, "__lv", "__bk"]).filter(
        (F.col("__lv") == F.greatest("__nl", "__bl")) & (F.col("__bk") == first) & (F.col(note[1]) > F.col(bar[0])) & (F.col(note[0]) < F.col(bar[1])))
    return met.withColumn("from_", F.greatest(note[0], bar[0])).withColumn("to_", F.least(note[1], bar[1])).drop("__bk", "__lv", "__nl", "__bl")


def asof_attr(rows: DataFrame, changes: DataFrame, keys: list[str], pos: str, id_: str, at: str, change_id: str, values: dict, tol=0) -> DataFrame:
    """Each row with the last change at or before `pos` + `tol`; `values` maps change columns to their defaults.

    Several changes at one place: the one with the largest `change_id` holds.
    """
    names = list(values)
    fields = F.struct(*names)
    left = rows.withColumn("__at", F.col(pos) + F.lit(tol)).withColumn("__kind", F.lit(1)).withColumn("__tie", F.col(id_))
    right = changes.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__kind"), F.col(change_id).alias("__tie"), fields.alias("__val"))
    both = left.unionByName(right, allowMissingColumns=True)
    o = Ordered.of(both, keys, ["__at", "__kind", "__tie"]).add(__in=last_value("__val")).filter(F.col("__kind") == 1)
    out = o.done()
    for n, default in values.items():
        out = out.withColumn(n, F.coalesce(F.col(f"__in.{n}"), F.lit(default)))
    return out.drop("__at", "__kind", "__tie", "__val", "__in")


def prev_next_neighbor(heads: DataFrame, entries: DataFrame, page: list[str], y: str) -> DataFrame:
    """Each head with the nearest entry strictly above and strictly below it on its page."""
    seen = heads.select(*page, y, F.lit(False).alias("__e")).unionByName(entries.select(*page, y, F.lit(True).alias("__e")))
    spots = seen.groupBy(*page, y).agg(F.max("__e").alias("__e"))
    entry = F.when(F.col("__e"), F.col(y))
    o = Ordered.of(spots, page, [y], probe=seen.select(*page)).add(above=last_value(entry, before=True), below=next_value(entry, before=True))
    return heads.join(o.done().drop("__e"), [*page, y])


def point_in_range(points: DataFrame, spans: DataFrame, keys: list[str], pos: str, lo: str, hi: str, always: Column, order: str, *keep: str) -> DataFrame:
    """Each point with the first span (by `order`) that holds it; spans marked `always` hold every point.

    Positions may be fractions.  A span enters the two or three buckets of its length's level, a position one bucket of
    each level that occurs.
    """
    s = spans.select(*keys, F.struct(order, *keep).alias("__s"), always.alias("__a"), F.col(lo).alias("__lo"), F.coalesce(hi, lo).alias("__hi"))
    bound = s.filter(~F.col("__a") & (F.col("__hi") >= F.col("__lo")))
    level = _level(F.col("__hi") - F.col("__lo"), 1)
    levels = F.array(*[F.lit(x) for x in _levels((bound, level))])
    bound = _spread(bound, F.col("__lo"), F.col("__hi"), 1, F.array(level))
    spots = _spread(points.select(*keys, pos).distinct(), F.col(pos), F.col(pos), 1, levels)
    fixed = spots.join(bound.hint("merge"), [*keys, "__lv", "__bk"]).filter(F.col(pos).between(F.col("__lo"), F.col("__hi")))
    fixed = fixed.groupBy(*keys, pos).agg(F.min_by("__s", f"__s.{order}").alias("__f"))
    free = s.filter("__a").groupBy(*keys).agg(F.min_by("__s", f"__s.{order}").alias("__r"))
    met = points.join(fixed, [*keys, pos], "left").join(free, keys, "left")
    take_free = F.col("__f").isNull() | (F.col(f"__r.{order}") < F.col(f"__f.{order}"))
    best = F.when(F.coalesce(take_free, F.lit(False)), F.col("__r")).otherwise(F.col("__f"))
    return met.withColumn("__b", best).filter("__b is not null").select(*points.columns, "__b.*")


def containment_join(frames: DataFrame, lines: DataFrame, page: list[str], frame: list[str], line: list[str], tol: float, cell: float) -> DataFrame:
    """Lines that lie inside a frame (within `tol`).  `frame` and `line` name x, y, w, h.

    Frames are spread over the few cells of a grid whose cells are as large as they are (`cell` at least, doubling); a
    line looks in the cell of its own corner in each grid that occurs.
    """
    fx, fy, fw, fh = map(F.col, frame)
    lx, ly, lw, lh = map(F.col, line)
    level = _level(F.greatest(fw, fh) + 2 * tol, cell)
    levels = F.array(*[F.lit(x) for x in _levels((frames, level))])
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("__lv"))
    f = _spread(frames, fx - tol, fx + fw + tol, cell, F.array(level)).withColumnRenamed("__bk", "__cx")
    f = f.withColumn("__cy", F.explode(F.sequence(F.floor((fy - tol) / size), F.floor((fy + fh + tol) / size))))
    ln = lines.withColumn("__lv", F.explode(levels))
    ln = ln.withColumn("__cx", F.floor(lx / size)).withColumn("__cy", F.floor(ly / size))
    inside = (lx >= fx - tol) & (ly >= fy - tol) & (lx + lw <= fx + fw + tol) & (ly + lh <= fy + fh + tol)
    return f.join(ln.hint("merge"), [*page, "__lv", "__cx", "__cy"]).filter(inside).drop("__lv", "__cx", "__cy")


def rule_fix(df: DataFrame, text: str, rules: DataFrame, *keep: str) -> DataFrame:
    """(keep, pos, ch, fixed): the characters to replace, each by the first rule its context fits.

    `rules`: rule_no, ch, prev2, prev, next, at_end, fixed; NULL in a condition means any.  Rules are keyed by
    their character and carried as one short array per character, so other characters drop out at the join.  They are
    written by hand and go to every task: dealt by character, the texts' rows would gather in one task for each.
    """
    by_ch = rules.groupBy("ch").agg(
        F.sort_array(F.collect_list(F.struct("rule_no", "prev2", "prev", "next", "at_end", "fixed"))).alias("__rules"))
    # each character takes its neighbours along, not its line
    chars = F.split(F.col(text), "")

    def near(ch, i):
        at = lambda k: F.get(F.col("__chars"), i + k)
        return F.struct(i.alias("pos"), ch.alias("ch"), at(-2).alias("p2"), at(-1).alias("p1"), at(1).alias("nx"), (i == F.size("__chars") - 1).alias("end"))

    rows = df.select(*keep, chars.alias("__chars")).select(*keep, F.explode(F.transform("__chars", near)).alias("__c"))
    rows = rows.select(*keep, "__c.*").join(F.broadcast(by_ch), "ch")
    fits = F.filter("__rules", lambda r: reduce(lambda a, b: a & b, [
        r[c].isNull() | F.coalesce(r[c] == F.col(v), F.lit(False)) for c, v in (("prev2", "p2"), ("prev", "p1"), ("next", "nx"), ("at_end", "end"))]))
    rows = rows.select(*keep, "pos", "ch", F.get(fits, F.lit(0))["fixed"].alias("fixed"))
    return rows.filter("fixed <> ch")


def cascade(rules: DataFrame, contexts: DataFrame, conditions: list[str], order: str, props: list[str]) -> DataFrame:
    """Style of each distinct context: a rule applies where all its non-null conditions equal; per property the
    rule latest in `order` wins.

    Rules that state the same conditions with the same values are one before they meet a context: per property the
    latest of them.  Each is posted under one of its conditions, the one that fewest contexts meet; contexts look up all
    their values among the postings in one equi-join, and the other conditions are checked there.  So the work doesn't
    depend on how many sets of conditions there may be.  A rule without conditions meets all contexts.
    """
    ctx = contexts.select(*conditions).distinct()
    names = [f"__{p}" for p in props]
    last = [F.max(F.when(F.col(p).isNotNull(), F.struct(F.col(order).alias("o"), F.col(p).alias("v")))).alias(f"__{p}") for p in props]
    stated = F.filter(F.array(*[F.struct(F.lit(i).alias("at"), F.col(c).cast("string").alias("is")) for i, c in enumerate(conditions)]), lambda x: x["is"].isNotNull())
    one = rules.groupBy(*conditions).agg(*last).withColumn("__stated", stated)

    values = ctx.select(*conditions, F.explode(stated).alias("__e")).select(*conditions, "__e.*")
    met_by = values.groupBy("at", "is").agg(F.count(F.lit(1)).alias("__n"))
    rule = F.struct(*conditions).alias("__rule")
    each = one.filter(F.size("__stated") > 0).select(rule, *names, F.explode("__stated").alias("__e")).select("__rule", *names, "__e.*")
    each = each.join(met_by, ["at", "is"], "left")
    # a value that no context has leaves the rule out
    posted = each.groupBy("__rule").agg(F.min_by(F.struct("at", "is"), F.struct(F.coalesce("__n", F.lit(0)), "at")).alias("__post"), F.count_if(F.col("__n").isNull()).alias("__unmet"),
                                        *[F.first(n).alias(n) for n in names]).filter("__unmet = 0")
    posted = posted.select("__rule", *names, "__post.*")
    fits = reduce(lambda a, b: a & b, [F.col(f"__rule.{c}").isNull() | F.coalesce(F.col(f"__rule.{c}") == F.col(c), F.lit(False)) for c in conditions])
    met = values.join(posted, ["at", "is"]).filter(fits).select(*conditions, *names)
    free = attach(ctx, one.filter(F.size("__stated") == 0).agg(*[F.max(n).alias(n) for n in names]))
    best = met.unionByName(free).groupBy(*conditions).agg(*[F.max(n).alias(n) for n in names])
    return best.select(*conditions, *[F.col(f"__{p}.v").alias(p) for p in props])


def capability_loss(used: DataFrame, caps: DataFrame, target: str, feature: str) -> DataFrame:
    """Features in use that the target format cannot hold."""
    return used.join(caps, [target, feature], "left_anti")


def align_axis(rows: DataFrame, song: list[str], part: str, slot: str, *values: str) -> DataFrame:
    """Every (slot, part) of a song; parts silent at a slot stay NULL."""
    slots = rows.select(*song, slot).distinct()
    parts = rows.select(*song, part).distinct()
    return slots.join(parts, song).join(rows.select(*song, slot, part, *values), [*song, slot, part], "left")


def refrain_or_verse(lyrics: DataFrame, note: list[str], verse: str, text: Column, refrain: Column, order: str, pass_: Column, ended: Column) -> DataFrame:
    """(note, word) sung in a pass: the verse of the pass, else the refrain, else - once that verse has ended - the
    lowest verse that has words.  `text` is the word without its verse number."""
    has = F.length(F.coalesce(text, F.lit(""))) > 0
    d = lyrics.select(*note, F.col(verse).alias("__v"), F.col(order).alias("__o"), F.coalesce(text, F.lit("")).alias("__t"),
                      refrain.alias("__r"), pass_.alias("__p"), ended.alias("__e"), has.alias("__h"))
    g = d.groupBy(*note).agg(
        F.min_by("__t", F.when(F.col("__v") == F.col("__p"), F.col("__o"))).alias("own"),
        F.min_by("__t", F.when(F.col("__r"), F.col("__o"))).alias("ref"),
        F.min_by("__t", F.when(F.col("__h"), F.struct("__v", "__o"))).alias("low"), F.max("__e").alias("ended"))
    first = F.coalesce("own", "ref")
    borrowed = F.when(F.col("ended") & (F.coalesce(first, F.lit("")) == ""), F.coalesce("low", first)).otherwise(first)
    return g.select(*note, F.when(borrowed != "", borrowed).alias("word"))


def misaligned_onsets(onsets: DataFrame, peers: DataFrame, keys: list[str], x: str, t: str, dx: float) -> DataFrame:
    """Onsets with a peer nearer than `dx` that starts at another time; the rows of `onsets` that are so.

    Peers in order of x: the next one on each side, or the next with another time behind it, settles each onset,
    so no pairs are formed.
    """
    p = peers.select(*keys, x, t).withColumn("__kind", F.lit(0))
    q = onsets.select(*keys, x, t).withColumn("__kind", F.lit(1))
    raw = peers.select(*keys).unionByName(onsets.select(*keys))
    both = deal(p.unionByName(q), keys, raw).distinct()
    spot = F.when(F.col("__kind") == 0, F.struct(F.col(x).alias("x"), F.col(t).alias("t")))
    o = Ordered.of(both, keys, [x, "__kind", t], probe=raw, placed=True).with_column("__spot", spot)
    o = o.add(__lp=last_value("__spot", before=True), __np=next_value("__spot", before=True))
    # on a peer: the nearest peer of another time on either side, carried along runs of one time
    o = o.with_column("__lo", F.when((F.col("__kind") == 0) & (F.col("__lp.t") != F.col(t)), F.col("__lp.x")))
    o = o.with_column("__no", F.when((F.col("__kind") == 0) & (F.col("__np.t") != F.col(t)), F.col("__np.x")))
    o = o.add(__ld=last_value("__lo"), __nd=next_value("__no"))
    left = F.when(F.col("__lp.t") != F.col(t), F.col("__lp.x")).otherwise(F.col("__ld"))
    right = F.when(F.col("__np.t") != F.col(t), F.col("__np.x")).otherwise(F.col("__nd"))
    hit = F.coalesce(F.col(x) - left < dx, F.lit(False)) | F.coalesce(right - F.col(x) < dx, F.lit(False))
    bad = o.filter((F.col("__kind") == 1) & hit).done().select(*keys, x, t)
    return onsets.join(bad, [*keys, x, t], "left_semi")


def tuplet_ratio(marks: DataFrame, elements: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, element_id, actual, normal): ratios of all tuplets around a timed element, multiplied.

    `marks`: start_id, end_id, tuplet_actual, tuplet_normal (may be NULL); `elements`: element_id, pos, voice, timed.
    """
    from ..functions.pitch import tuplet_normal

    m = resolve_marks(marks, elements, doc, "start_id", "end_id", "element_id", "pos").filter("to_pos >= from_pos")
    heads = elements.select(*doc, F.col("pos").alias("from_pos"), F.col("voice").alias("__voice"))
    m = m.join(heads, [*doc, "from_pos"]).withColumn("pos", F.explode(F.sequence("from_pos", "to_pos")))
    inside = m.join(elements.filter("timed").select(*doc, "pos", "element_id", "voice"), [*doc, "pos"]).filter("voice = __voice")
    mark = [*doc, "start_id", "end_id"]
    size = inside.groupBy(*mark).agg(F.count(F.lit(1)).alias("__n"))
    inside = inside.join(size, mark)
    actual = F.coalesce("tuplet_actual", "__n")
    inside = inside.withColumn("__a", actual).withColumn("__b", F.coalesce("tuplet_normal", tuplet_normal(actual)))
    return inside.groupBy(*doc, "element_id").agg(
        F.product("__a").cast("bigint").alias("actual"), F.product("__b").cast("bigint").alias("normal"))


def toc_reconcile(found: DataFrame, toc: DataFrame, book: str, number: str, page: str) -> DataFrame:
    """(book, kind, number, want_page, page): contents entries against songs found.

    missing: in 1..largest entry but not found; extra: found but not listed (in books that list any); duplicate:
    found more than once; page: listed on another page than found.
    """
    top = toc.groupBy(book).agg(F.max(number).cast("bigint").alias("__top"))
    have = found.groupBy(book, number).agg(F.count(F.lit(1)).alias("__n"))
    none = F.lit(None).cast("bigint")
    want = toc.groupBy(book, number).agg(F.min(page).alias("__want"))
    # holes lie between neighbouring found numbers, 0 and the number after the last listed one
    marks = have.select(book, F.col(number).cast("bigint").alias("__at")).join(top, book).filter((F.col("__at") > 0) & (F.col("__at") <= F.col("__top")))
    ends = top.select(book, F.explode(F.array(F.lit(0).cast("bigint"), F.col("__top") + 1)).alias("__at"))
    o = Ordered.of(marks.select(book, "__at").unionByName(ends).distinct(), [book], ["__at"]).add(__next=lead("__at"))
    holes = o.done().filter(F.col("__next") > F.col("__at") + 1)
    piece = 1000  # numbers of a hole made from one row
    holes = holes.withColumn("__lo", F.explode(F.sequence(F.col("__at") + 1, F.col("__next") - 1, F.lit(piece))))
    missing = holes.select(book, F.explode(F.sequence("__lo", F.least(F.col("__lo") + piece - 1, F.col("__next") - 1))).alias(number))
    missing = missing.join(want, [book, number], "left").select(
        book, F.lit("missing").alias("kind"), number, F.col("__want").alias("want_page"), none.alias("page"))
    extra = have.join(top.select(book), book, "left_semi").join(want, [book, number], "left_anti").select(
        book, F.lit("extra").alias("kind"), number, none.alias("want_page"), none.alias("page"))
    twice = have.filter("__n > 1").select(book, F.lit("duplicate").alias("kind"), number, none.alias("want_page"), none.alias("page"))
    off = found.join(want, [book, number]).filter(F.col("__want") != F.col(page)).select(
        book, F.lit("page").alias("kind"), number, F.col("__want").alias("want_page"), F.col(page).alias("page"))
    return missing.unionByName(extra).unionByName(twice).unionByName(off)

