"""Votes and per-group picks.  All are partial aggregates; ties are settled by explicit columns, never by row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import null_safe_join, quantiles, median_index


def mode_vote(df: DataFrame, keys: list[str], value: str, ties: dict[str, Column] | None = None) -> DataFrame:
    """Most frequent non-null value per group, with its votes.

    `ties`: aggregates over the votes of a value; equal counts are settled by the smallest of them in turn,
    then by the smaller value.
    """
    ties = ties or {}
    votes = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("votes"), *[agg.alias(f"__t_{n}") for n, agg in ties.items()])
    order = F.struct(-F.col("votes"), *[F.col(f"__t_{n}") for n in ties], F.col(value))
    return votes.groupBy(*keys).agg(F.min_by(F.struct(F.col(value), F.col("votes")), order).alias("__w")).select(*keys, "__w.*")


def clear_mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value per group, only where no other value has as many votes."""
    votes = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"))
    same = votes.groupBy(*keys, "votes").agg(F.count(F.lit(1)).alias("__k"), F.min(value).alias(value))
    top = same.groupBy(*keys).agg(F.max_by(F.struct(F.col(value), F.col("votes"), F.col("__k")), "votes").alias("__w"))
    return top.select(*keys, "__w.*").filter("__k = 1").drop("__k")


def agree_key(df: DataFrame, keys: list[str], fifths: str, sure: str, order: str) -> DataFrame:
    """Write the winning key signature on every row of its group: count, then sure rows, then more accidentals."""
    won = mode_vote(df, keys, fifths, {
        "sure": -F.sum(F.col(sure).cast("int")), "far": -F.max(F.abs(F.col(fifths))), "first": F.min(order)})
    backed = df.filter(F.col(sure)).select(*keys, F.col(fifths).alias("__f")).distinct()
    won = won.join(backed, [*keys], "left").groupBy(*keys).agg(
        F.first(fifths).alias("agreed"), F.max(F.coalesce(F.col("__f") == F.col(fifths), F.lit(False))).alias("agreed_sure"))
    return null_safe_join(df, won, keys, "left")


def agree_time(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Write the winning value on every row of its group; a tie leaves the rows as they are."""
    won = clear_mode(df, keys, value).select(*keys, F.col(value).alias("__won"), "votes")
    rows = null_safe_join(df, won, keys, "left")
    return rows.withColumn("agreed", F.coalesce("__won", value)).drop("__won")


def slot_profile(df: DataFrame, keys: list[str], clef: str, first: str, brace: Column, lyric: Column, pitch: str) -> DataFrame:
    """Per slot: commonest clef, brace (strict majority), lyrics (at least half) and median pitch."""
    clefs = mode_vote(df, keys, clef, {"first": F.min(first)}).drop("votes").withColumnRenamed(clef, "clef")
    n = F.count(F.lit(1))
    flags = df.groupBy(*keys).agg((F.count_if(brace) * 2 > n).alias("brace"), (F.count_if(lyric) * 2 >= n).alias("lyric"))
    mid = quantiles(df, keys, pitch, {"pitch": median_index}).drop("n")
    return flags.join(clefs, keys, "left").join(mid, keys, "left")


def region_offset(pages: DataFrame, book: str, index: str, printed: str, titles: str, least: int = 3) -> DataFrame:
    """Per book the commonest difference between page index and printed number (first seen wins) and the pages it
    spans; with fewer than `least` votes, from the first titled page to the end and no offset."""
    d = pages.withColumn("__off", F.col(index) - F.col(printed))
    vote = mode_vote(d, [book], "__off", {"first": F.min(index)}).filter(F.col("votes") >= least)
    hits = d.join(vote, [book, "__off"], "left_semi")
    span = hits.groupBy(book).agg(F.min(index).alias("__lo"), F.max(index).alias("__hi"), F.min("__off").alias("offset"))
    base = pages.groupBy(book).agg(
        F.coalesce(F.min(F.when(F.col(titles) > 0, F.col(index))), F.lit(0)).alias("__first"), F.max(index).alias("__last"))
    out = base.join(span, book, "left")
    return out.select(book, F.coalesce("__lo", "__first").alias("first"), F.coalesce("__hi", "__last").alias("last"), "offset")


def toc_vote(entries: DataFrame, book: str, number: str, page: str, max_page: str | None = None) -> DataFrame:
    """Per book and song number the page with most votes, the smaller on a tie.

    Entries without a page count (page NULL) only in books where no entry has one.
    """
    paged = entries.groupBy(book).agg(F.max(F.col(page).isNotNull()).alias("__paged"))
    e = entries.filter(F.col(number) >= 1).join(paged, book)
    fits = F.col(page) >= 1
    if max_page is not None:
        fits = fits & (F.col(page) <= F.coalesce(F.col(max_page), F.col(page)))
    e = e.filter(F.when(F.col("__paged"), fits).otherwise(True))
    votes = e.groupBy(book, number, page).agg(F.count(F.lit(1)).alias("votes"))
    top = votes.groupBy(book, number).agg(F.min_by(F.struct(page, "votes"), F.struct(-F.col("votes"), F.col(page))).alias("__w"))
    return top.select(book, number, "__w.*")


def dict_build(objs: DataFrame, key: str, order: str, *first: str) -> DataFrame:
    """One row per shape key: how often it occurs and the first object's attributes."""
    return objs.groupBy(key).agg(
        F.count(F.lit(1)).alias("cnt"), F.min_by(F.struct(order, *first), order).alias("__f")).select(key, "cnt", "__f.*")


def features_used(df: DataFrame, doc: str, features: dict[str, Column]) -> DataFrame:
    """(doc, feature) for every feature some row of the document shows; one scan for all features."""
    flags = F.array(*[F.when(cond, F.lit(name)) for name, cond in features.items()])
    return df.select(doc, F.explode(F.array_compact(flags)).alias("feature")).distinct()


def measure_quarters(elements: DataFrame, keys: list[str], voice: str, dur: Column, grace: Column, actual: Column, normal: Column) -> DataFrame:
    """Length per measure and voice: durations scaled by their tuplet, grace notes left out."""
    d = F.when(actual.isNotNull(), dur * normal / actual).otherwise(dur)
    return elements.filter(~grace).groupBy(*keys, voice).agg(F.sum(d).alias("quarters"))


def measure_extent(elements: DataFrame, keys: list[str], voice: str, onset: Column, dur: Column, grace: Column) -> DataFrame:
    """The same for measures with absolute positions: the latest end."""
    return elements.filter(~grace).groupBy(*keys, voice).agg(F.max(onset + dur).alias("extent"))


def measure_duration(elements: DataFrame, keys: list[str], voice: str, dur: Column) -> DataFrame:
    """Longest voice of each measure."""
    per = elements.groupBy(*keys, voice).agg(F.sum(dur).alias("__d"))
    return per.groupBy(*keys).agg(F.max("__d").alias("duration"))


def verse_count(lyrics: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    return lyrics.groupBy(*keys).agg(F.coalesce(F.max(F.coalesce(last, first)), F.lit(0)).alias("verses"))


def melody_lane(elements: DataFrame, keys: list[str], staff: str, voice: str) -> DataFrame:
    """Rows of the topmost staff's lowest voice in each measure."""
    lane = elements.groupBy(*keys).agg(F.min(F.struct(staff, voice)).alias("__lane"))
    rows = null_safe_join(elements, lane, keys)
    return rows.filter((F.col(staff) == F.col(f"__lane.{staff}")) & (F.col(voice) == F.col(f"__lane.{voice}"))).drop("__lane")


def top_note(notes: DataFrame, keys: list[str], cue: Column, height: Column, order: list[str], *keep: str) -> DataFrame:
    """Highest note of each chord; cue-size ones only in chords of nothing else; the first of equals."""
    first = F.struct(cue.cast("int"), -height, *[F.col(o) for o in order])
    return notes.groupBy(*keys).agg(F.min_by(F.struct(*keep), first).alias("__n")).select(*keys, "__n.*")


def cells_target(notes: DataFrame, keys: list[str], measure: str, beats: Column, cells: float, dash: float = 0.7) -> DataFrame:
    """Measures per line that give about `cells` note cells, held in 3..12; a held beat counts `dash`."""
    cell = 1 + F.greatest(F.lit(0), F.floor(beats) - 1) * dash
    per = notes.groupBy(*keys, measure).agg(F.sum(cell).alias("__c"))
    tot = per.groupBy(*keys).agg(F.sum("__c").alias("__c"), F.count(F.lit(1)).alias("__m"))
    avg = F.greatest(F.lit(0.5), F.round(F.col("__c") / F.col("__m"), 9))
    return tot.select(*keys, F.greatest(F.lit(3), F.least(F.lit(12), F.floor(F.lit(float(cells)) / avg + 0.5))).alias("target"))


def staff_rows(items: DataFrame, page: str, y: Column) -> DataFrame:
    """One row: distinct note baselines, counted page by page, and the most note cells on one of them."""
    per = items.groupBy(page, F.floor(y + 0.5).alias("__y")).agg(F.count(F.lit(1)).alias("__n"))
    return per.agg(F.count(F.lit(1)).alias("staff_rows"), F.max("__n").alias("max_row_cells"))


def match_f1(pairs_tokens: DataFrame, ref_tokens: DataFrame, item: str, ref: str, token: str, least: float = 0.5) -> DataFrame:
    """Agreement of each item with its reference text: 2 x shared tokens over all tokens of both.

    `pairs_tokens` (item, ref, token) holds the tokens of the items, `ref_tokens` (ref, token) those of the
    references; an item or reference without any has one row with a NULL token.  Each item is met with its own
    reference only.  Below `least`, and where one side has no token, the text is a different one.
    """
    b = ref_tokens.groupBy(ref, token).agg(F.count(token).alias("__b"))
    # tokens that the reference doesn't have are counted as one, before anything is shuffled where the references are few
    shared = F.when(F.col("__b").isNotNull(), F.col(token)).alias("__shared")
    a = pairs_tokens.join(b, [ref, token], "left").groupBy(item, ref, shared).agg(F.count(token).alias("__a"), F.max("__b").alias("__b"))
    met = a.groupBy(item, ref).agg(
        F.sum("__a").alias("len_a"), F.sum(F.least("__a", F.coalesce("__b", F.lit(0)))).alias("matched"))
    size = ref_tokens.groupBy(ref).agg(F.count(token).alias("len_b"))
    met = met.join(size, ref, "left").withColumn("len_b", F.coalesce("len_b", F.lit(0)))
    f1 = F.coalesce(F.try_divide(F.col("matched") * 2, F.col("len_a") + F.col("len_b")), F.lit(0.0))
    return met.select(item, ref, "len_a", "len_b", "matched", f1.alias("f1"), ((f1 >= least) & (F.col("matched") > 0)).alias("is_match"))
