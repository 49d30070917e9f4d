"""Pitch, key and duration functions on line items: each row stands for a note."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..functions import pitch as P
from .registry import query

L = "bigint"


def tally(df: DataFrame, *cols) -> DataFrame:
    """Inputs and results with how many rows have them."""
    picked = df.select(*cols)
    return picked.groupBy(*picked.columns).agg(F.count(F.lit(1)).alias("n"))


def note_rows(t):
    """step, fifths, octave, alter, midi, degree from the keys of a line."""
    return t.lineitem.select(
        F.pmod("l_partkey", F.lit(7)).alias("step"),
        (F.pmod("l_suppkey", F.lit(15)) - 7).alias("fifths"),
        F.col("l_linenumber").cast(L).alias("octave"),
        (F.pmod("l_orderkey", F.lit(3)) - 1).alias("alter"),
        (F.pmod("l_partkey", F.lit(60)) + 36).alias("midi"),
        (F.pmod("l_partkey", F.lit(7)) + 1).alias("degree"),
        (F.pmod("l_orderkey", F.lit(25)) - 12).alias("chromatic"),
    )


NOTE = """WITH note AS (SELECT l_partkey % 7 AS step, l_suppkey % 15 - 7 AS fifths, l_linenumber::BIGINT AS octave,
  l_orderkey % 3 - 1 AS alter, l_partkey % 60 + 36 AS midi, l_partkey % 7 + 1 AS degree, l_orderkey % 25 - 12 AS chromatic
  FROM lineitem)"""
SEMI = "[0,2,4,5,7,9,11]"
ALTER = """CASE WHEN {f} > 0 AND list_position([3,0,4,1,5,2,6], {s}::INT) <= {f} THEN 1
  WHEN {f} < 0 AND list_position([6,2,5,1,4,0,3], {s}::INT) <= -({f}) THEN -1 ELSE 0 END"""
TONIC = "((4*{f}+28) % 7 + 7) % 7"


def alter_sql(s, f):
    return ALTER.format(s=s, f=f)


def tonic_sql(f):
    return TONIC.format(f=f)


@query("P1_tonic_step", f"""{NOTE} SELECT fifths, {tonic_sql('fifths')} AS tonic, count(*) AS n FROM note GROUP BY ALL""")
def _(t):
    return tally(note_rows(t), "fifths", P.tonic_step("fifths").alias("tonic"))


@query("P2_key_alter", f"""{NOTE} SELECT step, fifths, ({alter_sql('step', 'fifths')})::BIGINT AS key_alter, count(*) AS n
FROM note GROUP BY ALL""")
def _(t):
    return tally(note_rows(t), "step", "fifths", P.key_alter("step", "fifths").cast(L).alias("key_alter"))


@query("P3_degree_to_pitch", f"""{NOTE}, a AS (SELECT degree, octave, fifths, {tonic_sql('fifths')} AS tonic FROM note),
b AS (SELECT *, (tonic + degree - 1) % 7 AS step, (tonic + degree - 1) // 7 AS up FROM a)
SELECT degree, octave, fifths, step, ({alter_sql('step', 'fifths')})::BIGINT AS alter,
  4 + octave + up - (CASE WHEN tonic = 6 THEN 1 ELSE 0 END) AS pitch_octave, count(*) AS n FROM b GROUP BY ALL""")
def _(t):
    p = P.degree_to_pitch("degree", "octave", "fifths")
    return tally(note_rows(t), "degree", "octave", "fifths", p["step"].cast(L).alias("step"), p["alter"].cast(L).alias("alter"),
                 p["octave"].cast(L).alias("pitch_octave"))


@query("P4_pitch_to_degree", f"""{NOTE}, a AS (SELECT step, octave, fifths, step + octave*7 - {tonic_sql('fifths')} AS d,
  CASE WHEN {tonic_sql('fifths')} = 6 THEN 1 ELSE 0 END AS low FROM note)
SELECT step, octave, fifths, ((d % 7) + 7) % 7 + 1 AS degree, floor(d / 7.0)::BIGINT - 4 + low AS octave_shift, count(*) AS n
FROM a GROUP BY ALL""")
def _(t):
    d = P.pitch_to_degree("step", "octave", "fifths")
    return tally(note_rows(t), "step", "octave", "fifths", d["degree"].cast(L).alias("degree"),
                 d["octave_shift"].cast(L).alias("octave_shift"))


@query("P5_midi_number", f"""{NOTE} SELECT step, alter, octave, (octave+1)*12 + {SEMI}[step+1] + alter AS midi_number,
count(*) AS n FROM note GROUP BY ALL""")
def _(t):
    return tally(note_rows(t), "step", "alter", "octave", P.midi_number("step", "alter", "octave").cast(L).alias("midi_number"))


SPELL = """{note}, pair AS (SELECT midi, fifths, {extra} count(*) AS n FROM note GROUP BY ALL),
steps AS (SELECT unnest(range(7)) AS step), cand AS (SELECT p.*, s.step, {rank} AS rank, {alter} AS alter
 FROM pair p, steps s, {shifts}),
ok AS (SELECT *, row_number() OVER (PARTITION BY midi, fifths {part} ORDER BY rank, step) AS rn FROM cand
 WHERE ((({semi}[step+1] + alter - midi) % 12) + 12) % 12 = 0 {also})
SELECT midi, fifths, {extra2} step::BIGINT AS step, alter::BIGINT AS alter,
 floor((midi - {semi}[step+1] - alter)/12.0)::BIGINT - 1 AS octave, n FROM ok WHERE rn = 1"""


@query("P6_spell_midi", SPELL.format(
    note=NOTE, extra="", extra2="", part="", semi=SEMI, also="",
    rank="k", alter=f"({alter_sql('s.step', 'p.fifths')}) + CASE k WHEN 0 THEN 0 WHEN 1 THEN (CASE WHEN p.fifths < 0 THEN -1 ELSE 1 END) ELSE (CASE WHEN p.fifths < 0 THEN 1 ELSE -1 END) END",
    shifts="(SELECT unnest(range(3)) AS k) ks"))
def _(t):
    rows = tally(note_rows(t), "midi", "fifths")
    p = P.spell_midi("midi", "fifths")
    return rows.select("midi", "fifths", p["step"].cast(L).alias("step"), p["alter"].cast(L).alias("alter"),
                       p["octave"].cast(L).alias("octave"), "n")


@query("P7_transpose_fifths", f"""{NOTE} SELECT fifths, chromatic,
  ([0,-5,2,-3,4,-1,6,1,-4,3,-2,5][(((fifths*7+chromatic) % 12)+12) % 12 + 1])::BIGINT AS new_fifths, count(*) AS n
FROM note GROUP BY ALL""")
def _(t):
    return tally(note_rows(t), "fifths", "chromatic", P.transpose_fifths("fifths", "chromatic").cast(L).alias("new_fifths"))


def wrap_sql(x, low=-7, high=7):
    down = f"(({x}) - greatest(ceil((({x}) - {high})/12.0), 0)*12)"
    return f"(({down}) + greatest(ceil(({low} - ({down}))/12.0), 0)*12)::BIGINT"


@query("P8_sounding_fifths", f"""{NOTE} SELECT fifths, chromatic, {wrap_sql('fifths + 7*chromatic')} AS sounding, count(*) AS n
FROM note GROUP BY ALL""")
def _(t):
    return tally(note_rows(t), "fifths", "chromatic", P.sounding_fifths("fifths", "chromatic").cast(L).alias("sounding"))


@query("P9_degree_of_key", f"""WITH k AS (SELECT p_partkey % 15 - 7 AS home, (p_size % 15 - 7)::BIGINT AS fifths, count(*) AS n
  FROM part GROUP BY ALL), d AS (SELECT *, {wrap_sql('fifths - home', -8, 12)} AS d FROM k),
s AS (SELECT *, CASE WHEN d >= 6 THEN '#' WHEN d <= -2 THEN 'b' ELSE '' END AS sign FROM d),
g AS (SELECT *, sign || list_position([0,2,4,-1,1,3,5], (CASE sign WHEN '#' THEN d-7 WHEN 'b' THEN d+7 ELSE d END)::INT)::VARCHAR AS degree FROM s)
SELECT home, fifths, degree, {wrap_sql("home + [0,2,4,-1,1,3,5][right(degree,1)::INT] + CASE left(degree,1) WHEN '#' THEN 7 WHEN 'b' THEN -7 ELSE 0 END")} AS back, n FROM g""")
def _(t):
    rows = t.part.select((F.pmod("p_partkey", F.lit(15)) - 7).alias("home"), (F.pmod("p_size", F.lit(15)) - 7).cast(L).alias("fifths"))
    rows = tally(rows, "home", "fifths").withColumn("degree", P.degree_of_key("home", "fifths"))
    return rows.select("home", "fifths", "degree", P.key_of_degree("home", "degree").cast(L).alias("back"), "n")


TYPES = "['whole','half','quarter','eighth','16th','32nd']"


@query("P10_nominal_quarters", f"""WITH e AS (SELECT {TYPES}[l_linenumber] AS dur_type, l_suppkey % 3 AS dots,
  l_quantity AS dur_div, l_partkey % 4 = 0 AS is_rest, l_partkey % 5 = 0 AS hidden,
  CASE WHEN l_orderkey % 4 = 0 THEN 3 END AS tm FROM lineitem),
q AS (SELECT *, CASE WHEN dur_type IS NULL OR (is_rest AND tm IS NULL AND (dur_type = 'whole' OR hidden)) THEN NULL
   ELSE power(0.5, list_position({TYPES}, dur_type) - 3) END AS base FROM e)
SELECT dur_type, dots, dur_div, is_rest, hidden, tm::BIGINT AS tm,
  round(CASE WHEN base IS NOT NULL THEN base * (2 - power(0.5, dots)) WHEN tm IS NULL THEN dur_div/48 ELSE dur_div/48*3/2 END, 6) AS quarters,
  count(*) AS n FROM q GROUP BY ALL""")
def _(t):
    types = F.array(*[F.lit(x) for x in ("whole", "half", "quarter", "eighth", "16th", "32nd")])
    e = t.lineitem.select(
        F.get(types, F.col("l_linenumber") - 1).alias("dur_type"), F.pmod("l_suppkey", F.lit(3)).alias("dots"),
        F.col("l_quantity").alias("dur_div"), (F.pmod("l_partkey", F.lit(4)) == 0).alias("is_rest"),
        (F.pmod("l_partkey", F.lit(5)) == 0).alias("hidden"),
        F.when(F.pmod("l_orderkey", F.lit(4)) == 0, F.lit(3)).cast(L).alias("tm"), F.lit(2).alias("normal"))
    q = P.nominal_quarters("dur_type", "dots", "dur_div", F.lit(48.0), "tm", "normal", "is_rest", "hidden")
    return tally(e, "dur_type", "dots", "dur_div", "is_rest", "hidden", "tm", F.round(q, 6).alias("quarters"))


@query("P11_duration_shape", """WITH q AS (SELECT l_quantity/16 AS q, count(*) AS n FROM lineitem GROUP BY ALL),
l AS (SELECT *, greatest(0, floor(q+1e-9)-1) AS sus,
  log2(1/q) AS b0, log2(1.5/q) AS b1, log2(1.75/q) AS b2 FROM q)
SELECT round(q,6) AS q, CASE WHEN q>=1 THEN 0 WHEN abs(b0-floor(b0+0.5))<1e-6 THEN floor(b0+0.5) WHEN abs(b1-floor(b1+0.5))<1e-6 THEN floor(b1+0.5)
   WHEN abs(b2-floor(b2+0.5))<1e-6 THEN floor(b2+0.5) ELSE greatest(1, floor(b0+0.5)) END::BIGINT AS beams,
 CASE WHEN q>=1 THEN CASE WHEN q-sus>=1.75-1e-9 THEN 2 WHEN q-sus>=1.5-1e-9 THEN 1 ELSE 0 END
   WHEN abs(b0-floor(b0+0.5))<1e-6 THEN 0 WHEN abs(b1-floor(b1+0.5))<1e-6 THEN 1 WHEN abs(b2-floor(b2+0.5))<1e-6 THEN 2 ELSE 0 END::BIGINT AS dots,
 CASE WHEN q>=1 THEN sus ELSE 0 END::BIGINT AS sustains, n FROM l""")
def _(t):
    rows = tally(t.lineitem, (F.col("l_quantity") / 16).alias("q"))
    s = P.duration_shape("q")
    return rows.select(F.round("q", 6).alias("q"), s["beams"].cast(L).alias("beams"), s["dots"].cast(L).alias("dots"),
                       s["sustains"].cast(L).alias("sustains"), "n")


def beat_text_sql(q):
    out = "CASE "
    for d in P.BEAT_DENOMINATORS:
        n = f"floor({q}*{d}+0.5)"
        if d == 1:
            text = f"{n}::BIGINT::VARCHAR"
        else:
            rest = f"({n} - floor({n}/{d})*{d})::BIGINT::VARCHAR || '/{d}'"
            text = f"CASE WHEN floor({n}/{d}) <> 0 THEN floor({n}/{d})::BIGINT::VARCHAR || ' ' || {rest} ELSE {rest} END"
        out += f"WHEN abs({n}/{d} - {q}) <= 1e-6 THEN {text} "
    return out + f"ELSE printf('%.2f', {q}) END"


@query("P12_beat_text", f"""WITH q AS (SELECT l_quantity / l_linenumber AS q, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT round(q, 6) AS q, {beat_text_sql('q')} AS txt, n FROM q""")
def _(t):
    rows = tally(t.lineitem, (F.col("l_quantity") / F.col("l_linenumber")).alias("q"))
    return rows.select(F.round("q", 6).alias("q"), P.beat_text("q").alias("txt"), "n")


@query("P13_tuplet_normal", """WITH q AS (SELECT l_quantity::BIGINT AS tuplet, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT tuplet, CASE WHEN tuplet IN (2,4) THEN 3 ELSE power(2, floor(log2(greatest(1, tuplet-1)) + 1e-12)) END::BIGINT AS normal, n FROM q""")
def _(t):
    return tally(t.lineitem, F.col("l_quantity").cast(L).alias("tuplet"), P.tuplet_normal(F.col("l_quantity").cast(L)).alias("normal"))


@query("P14_play_tempo", """SELECT event_id, round((CASE WHEN event_type = 'view' THEN 90 WHEN value > 0 THEN value ELSE 90 END)
  * greatest(0.25, least(3, coalesce((json_extract(props,'$.k')::INT - 20)/20.0, 1))), 6) AS tempo FROM events""")
def _(t):
    speed = (F.get_json_object("props", "$.k").cast("int") - 20) / F.lit(20.0)
    tempo = F.when(F.col("event_type") != "view", F.col("value"))
    return t.events.select("event_id", F.round(P.play_tempo(tempo, speed), 6).alias("tempo"))


def li_rects():
    a = geom.rect(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.lit(10.0), F.lit(4.0))
    b = geom.rect(F.pmod("l_partkey", F.lit(50)).cast("double"), F.pmod("l_suppkey", F.lit(7)).cast("double"),
                  F.lit(6.0) + F.col("l_linenumber"), F.lit(5.0))
    return a, b


@query("P15_overlaps", """WITH r AS (SELECT l_quantity AS ax, l_linenumber::DOUBLE AS ay, 10.0 AS aw, 4.0 AS ah,
  (l_partkey % 50)::DOUBLE AS bx, (l_suppkey % 7)::DOUBLE AS by_, 6.0 + l_linenumber AS bw, 5.0 AS bh FROM lineitem),
o AS (SELECT *, greatest(0, least(ax+aw, bx+bw) - greatest(ax, bx)) AS ox, greatest(0, least(ay+ah, by_+bh) - greatest(ay, by_)) AS oy FROM r)
SELECT ax, ay, bx, by_, ox::DOUBLE AS overlap, round(ox / least(aw, bw), 6) AS ratio_x, round(oy / least(ah, bh), 6) AS ratio_y,
  round(CASE WHEN ox > 0 AND oy > 0 THEN ox*oy/40 ELSE 0 END, 6) AS frac,
  (greatest(ax+aw, bx+bw) - least(ax, bx))::DOUBLE AS union_w, (greatest(ay+ah, by_+bh) - least(ay, by_))::DOUBLE AS union_h, count(*) AS n
FROM o GROUP BY ALL""")
def _(t):
    a, b = li_rects()
    u = geom.union_rect(a, b)
    return tally(
        t.lineitem, a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by_"),
        geom.overlap_x(a, b).alias("overlap"), F.round(geom.overlap_ratio_x(a, b), 6).alias("ratio_x"),
        F.round(geom.overlap_ratio_y(a, b), 6).alias("ratio_y"), F.round(geom.overlap_frac(a, b), 6).alias("frac"),
        u["w"].alias("union_w"), u["h"].alias("union_h"))


@query("P16_accidental_offset", """WITH a AS (SELECT ['double-flat','flat','natural','sharp','double-sharp'][p_size % 5 + 1] AS accidental FROM part)
SELECT accidental, list_position(['double-flat','flat','natural','sharp','double-sharp'], accidental)::BIGINT - 3 AS offset_,
  accidental AS back, count(*) AS n FROM a GROUP BY ALL""")
def _(t):
    names = F.array(*[F.lit(k) for k in P.ACCIDENTALS])
    a = t.part.select(F.get(names, F.pmod("p_size", F.lit(5))).alias("accidental"))
    off = P.accidental_offset("accidental")
    return tally(a, "accidental", off.cast(L).alias("offset_"), P.accidental_name(off).alias("back"))
