"""Corpus edits: splitting and merging parts, copying lyrics, transposing and rewriting in another key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pitch as P
from ..operators.scan import Ordered, last_value
from ..operators.stats import null_safe_join


def split_by_voice(elements: DataFrame, part: list[str], measure: str, voice: str, element: str) -> DataFrame:
    """Every voice above the first becomes a part of its own: (part, sub, measure, element, is_rest).

    `sub` is 0 for what stays.  Measures in which a part has nothing get a rest (element NULL).
    """
    e = elements.select(*part, measure, element, (F.greatest(F.lit(1), F.col(voice)) - 1).alias("sub"))
    kept = e.select(*part, "sub", measure, element, F.lit(False).alias("is_rest"))
    subs = e.select(*part, "sub").distinct().filter("sub > 0")
    subs = subs.unionByName(subs.select(*part, F.lit(0).cast(dict(subs.dtypes)["sub"]).alias("sub")).distinct())
    slots = e.select(*part, measure).distinct().join(subs, part)
    have = e.select(*part, "sub", measure).distinct()
    rests = slots.join(have, [*part, "sub", measure], "left_anti")
    return kept.unionByName(rests.select(*part, "sub", measure, F.lit(None).cast(dict(e.dtypes)[element]).alias(element), F.lit(True).alias("is_rest")))


def split_by_chord(notes: DataFrame, chord: list[str], pitch: str, order: str) -> DataFrame:
    """Notes with `sub` 1 for the lowest note of each chord of several notes, 0 for the rest."""
    low = notes.groupBy(*chord).agg(F.min(F.struct(pitch, order)).alias("__low"), F.count(F.lit(1)).alias("__n"))
    rows = null_safe_join(notes, low, chord)
    is_low = (F.col("__n") > 1) & (F.col(f"__low.{order}") == F.col(order))
    return rows.withColumn("sub", F.when(is_low, 1).otherwise(0)).drop("__low", "__n")


def merge_parts(elements: DataFrame, song: list[str], part: str, into: str, other: str, measure: str, voice: str, whole_rest: Column) -> DataFrame:
    """Elements with part `other` moved into `into`, its voices numbered after those there.

    Songs whose two parts differ in length stay as they are.  A measure of `other` that is one whole-measure rest
    is not moved.
    """
    per = elements.filter(F.col(part).isin(into, other)).groupBy(*song).agg(
        F.count_distinct(F.when(F.col(part) == into, F.col(measure))).alias("__a"), F.count_distinct(F.when(F.col(part) == other, F.col(measure))).alias("__b"),
        F.max(F.when(F.col(part) == into, F.col(voice))).alias("__v"))
    alone = elements.filter(F.col(part) == other).groupBy(*song, measure).agg(F.count(F.lit(1)).alias("__k"))
    rows = elements.join(per, song, "left").join(alone, [*song, measure], "left")
    merge = F.coalesce((F.col("__a") == F.col("__b")) & (F.col("__a") > 0), F.lit(False))
    moved = merge & (F.col(part) == other)
    rows = rows.filter(~(moved & whole_rest & (F.col("__k") == 1)))
    rows = rows.withColumn(voice, F.when(moved, F.greatest(F.lit(1), F.col("__v")) + F.col(voice)).otherwise(F.col(voice)))
    return rows.withColumn(part, F.when(moved, F.lit(into)).otherwise(F.col(part))).drop("__a", "__b", "__v", "__k")


def copy_lyrics(source: DataFrame, target: DataFrame, lyrics: DataFrame, song: list[str], chord: str) -> DataFrame:
    """Lyrics to add to a part: (song, chord, verse, text), from the chord at the same onset of another part.

    `source`, `target`: song, measure, onset, chord; the first chord of the target at an onset takes them.  A verse
    it already has is left alone.  `lyrics`: song, chord, verse, text.
    """
    at = target.groupBy(*song, "measure", "onset").agg(F.min(chord).alias("__to"))
    moved = lyrics.join(source, [*song, chord]).join(at, [*song, "measure", "onset"])
    moved = moved.groupBy(*song, "__to", "verse").agg(F.min_by("text", chord).alias("text")).withColumnRenamed("__to", chord)
    return moved.join(lyrics.select(*song, chord, "verse"), [*song, chord, "verse"], "left_anti").select(*song, chord, "verse", "text")


def split_staves(elements: DataFrame, part: list[str], staff: str) -> DataFrame:
    """Each staff of a part as a part: `staff_part` numbers them within the part, `staff_of` is 0 on the first."""
    return elements.withColumn("staff_part", F.col(staff) - 1).withColumn("staff_of", F.when(F.col(staff) > 1, 0))


def marks_on_one_staff(marks: DataFrame, elements: DataFrame, doc: list[str], element: str, staff: str) -> DataFrame:
    """Marks whose both ends lie on one staff, with that staff; the others are lost when staves part."""
    at = elements.select(*doc, F.col(element).alias("__id"), F.col(staff).alias("__s"))
    a = at.withColumnRenamed("__id", "start_id").withColumnRenamed("__s", "staff")
    b = at.withColumnRenamed("__id", "end_id").withColumnRenamed("__s", "__end")
    return marks.join(a, [*doc, "start_id"]).join(b, [*doc, "end_id"]).filter("staff = __end").drop("__end")


def merge_staves(elements: DataFrame, staff_part: str = "staff_part") -> DataFrame:
    """Back to one part: the staff is the place among the parts again."""
    return elements.withColumn("staff", F.col(staff_part) + 1).drop(staff_part, "staff_of")


def with_key(notes: DataFrame, song: list[str], order: list[str], change: Column, name: str = "fifths") -> DataFrame:
    """Key in force on each note (0 before any)."""
    o = Ordered.of(notes, song, order).add(**{name: last_value(change)})
    return o.with_column(name, F.coalesce(F.col(name), F.lit(0))).done()


def transpose_corpus(notes: DataFrame, song: list[str], order: list[str], key_change: Column, midi: str, n: int) -> DataFrame:
    """Notes moved by `n` semitones: new_fifths and new_pitch (step, alter, octave) spelled in the new key."""
    rows = with_key(notes, song, order, key_change).withColumn("new_fifths", P.transpose_fifths("fifths", n))
    sign = F.when(F.col("new_fifths") > 0, 1).when(F.col("new_fifths") < 0, -1).otherwise((n > 0) - (n < 0))
    return rows.withColumn("new_pitch", P.spell_transposed(F.col(midi) + n, "new_fifths", sign))


def rewrite_in_key(notes: DataFrame, song: list[str], order: list[str], key_change: Column, step: str, alter: str, octave: str, fifths: int, spelling: str = "keep") -> DataFrame:
    """The same sounds written in one key: new_pitch and its degree.

    Notes outside the key lean the way they were written (`keep`), or to the key's side, or always sharp or flat.
    """
    to = max(-7, min(7, int(fifths)))
    rows = with_key(notes, song, order, key_change, "__from")
    own = F.lit((to > 0) - (to < 0) or 1)
    if spelling == "sharp":
        sign = F.lit(1)
    elif spelling == "flat":
        sign = F.lit(-1)
    elif spelling == "keep":
        off = F.col(alter) - P.key_alter(step, "__from")
        sign = F.when(off != 0, F.signum(off)).when(F.col("__from") != to, F.signum(F.col("__from") - to)).otherwise(own).cast("int")
    else:
        sign = own
    rows = rows.withColumn("new_pitch", P.spell_in_key(P.midi_number(step, alter, octave), F.lit(to), sign))
    deg = P.pitch_to_degree(F.col("new_pitch.step"), F.col("new_pitch.octave"), F.lit(to))
    return rows.withColumn("new_degree", deg).drop("__from")


def script_direction(texts: DataFrame, group: list[str], text: str, variants: str, standard: str) -> DataFrame:
    """Per group: does any text change when variants are folded?  Then conversion goes that way."""
    changed = F.translate(F.col(text), variants, standard) != F.col(text)
    return texts.groupBy(*group).agg(F.max(changed).alias("fold"))
