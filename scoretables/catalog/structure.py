"""Corpus edits on events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import parts as PT
from .pitch import L, SEMI, alter_sql
from .registry import query
from .text import ACCENTED, FOLDED
from .votes import EV, ORDER, ev

VOICES = "e AS (SELECT user_id, k // 10 AS measure, event_id, CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE 1 END AS voice FROM ev)"


def voice_rows(t):
    v = F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "error", 3).otherwise(1)
    return ev(t).select("user_id", F.floor(F.col("k") / 10).alias("measure"), "event_id", v.cast(L).alias("voice"))


@query("X12_split_by_voice", f"""{EV}, {VOICES}, s AS (SELECT DISTINCT user_id, voice - 1 AS sub FROM e WHERE voice > 1), s2 AS (SELECT * FROM s UNION SELECT DISTINCT user_id, 0 FROM s),
sl AS (SELECT DISTINCT e.user_id, e.measure, s2.sub FROM e JOIN s2 USING (user_id))
SELECT user_id, (voice - 1)::BIGINT AS sub, measure, event_id, false AS is_rest FROM e UNION ALL
SELECT user_id, sub::BIGINT, measure, NULL, true FROM sl WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = sl.user_id AND e.measure = sl.measure AND e.voice - 1 = sl.sub)""")
def _(t):
    return PT.split_by_voice(voice_rows(t), ["user_id"], "measure", "voice", "event_id")


@query("X12_split_by_chord", f"""{EV}, w AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_id // 500 ORDER BY k, event_id) AS r, count(*) OVER (PARTITION BY user_id, event_id // 500) AS n FROM ev)
SELECT event_id, (n > 1 AND r = 1)::BIGINT AS sub FROM w""")
def _(t):
    e = ev(t).select("event_id", "user_id", F.floor(F.col("event_id") / 500).alias("chord"), "k")
    return PT.split_by_chord(e, ["user_id", "chord"], "k", "event_id").select("event_id", F.col("sub").cast(L).alias("sub"))


@query("X12_merge_parts", f"""{EV}, e AS (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'A' WHEN event_type = 'error' THEN 'B' ELSE 'C' END AS part, k // 40 AS measure, event_id, k % 2 + 1 AS voice, value > 3 AS rest FROM ev),
p AS (SELECT user_id, count(DISTINCT measure) FILTER (part = 'A') AS a, count(DISTINCT measure) FILTER (part = 'B') AS b, max(voice) FILTER (part = 'A') AS v FROM e GROUP BY ALL),
o AS (SELECT user_id, measure, count(*) AS kk FROM e WHERE part = 'B' GROUP BY ALL), j AS (SELECT e.*, v, a = b AND a > 0 AND part = 'B' AS mv, kk FROM e JOIN p USING (user_id) LEFT JOIN o USING (user_id, measure))
SELECT event_id, CASE WHEN mv THEN 'A' ELSE part END AS part, (CASE WHEN mv THEN v + voice ELSE voice END)::BIGINT AS voice FROM j WHERE NOT (mv AND rest AND kk = 1)""")
def _(t):
    part = F.when(F.col("event_type").isin("click", "view"), "A").when(F.col("event_type") == "error", "B").otherwise("C")
    e = ev(t).select("user_id", part.alias("part"), F.floor(F.col("k") / 40).alias("measure"), "event_id", (F.pmod("k", F.lit(2)) + 1).alias("voice"), (F.col("value") > 3).alias("rest"))
    return PT.merge_parts(e, ["user_id"], "part", "A", "B", "measure", "voice", F.col("rest")).select("event_id", "part", "voice")


@query("X12_copy_lyrics", f"""{EV}, s AS (SELECT user_id, k // 20 AS measure, k % 20 AS onset, event_id AS chord FROM ev WHERE event_type = 'click'), g AS (SELECT user_id, k // 20 AS measure, k % 20 AS onset, event_id AS chord FROM ev WHERE event_type = 'view'),
l AS (SELECT user_id, event_id AS chord, k % 3 + 1 AS verse, event_id::VARCHAR AS txt FROM ev WHERE event_type IN ('click', 'view') AND value > 2), a AS (SELECT user_id, measure, onset, min(chord) AS c FROM g GROUP BY ALL),
m AS (SELECT l.user_id, a.c AS chord, verse, arg_min(txt, l.chord) AS txt FROM l JOIN s ON s.user_id = l.user_id AND s.chord = l.chord JOIN a ON a.user_id = s.user_id AND a.measure = s.measure AND a.onset = s.onset GROUP BY ALL)
SELECT user_id, chord, verse, txt FROM m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = m.user_id AND l.chord = m.chord AND l.verse = m.verse)""")
def _(t):
    e = ev(t)
    side = lambda kind: e.filter(F.col("event_type") == kind).select("user_id", F.floor(F.col("k") / 20).alias("measure"), F.pmod("k", F.lit(20)).alias("onset"), F.col("event_id").alias("chord"))
    lyr = e.filter("event_type in ('click', 'view') and value > 2").select("user_id", F.col("event_id").alias("chord"), (F.pmod("k", F.lit(3)) + 1).alias("verse"), F.col("event_id").cast("string").alias("text"))
    return PT.copy_lyrics(side("click"), side("view"), lyr, ["user_id"], "chord").withColumnRenamed("text", "txt")


KEYED = f"""kn AS (SELECT l_orderkey, l_partkey, l_linenumber, coalesce(last_value(CASE WHEN l_suppkey % 5 = 0 THEN l_suppkey % 15 - 7 END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS f FROM lineitem)"""


def key_change():
    return F.when(F.pmod("l_suppkey", F.lit(5)) == 0, F.pmod("l_suppkey", F.lit(15)) - 7)


@query("X13_transpose_corpus", f"""WITH {KEYED}, n3 AS (SELECT f AS fifths, l_partkey % 60 + 36 AS midi, count(*) AS n FROM kn GROUP BY ALL),
nf AS (SELECT *, ([0,-5,2,-3,4,-1,6,1,-4,3,-2,5][(((fifths*7+3) % 12)+12) % 12 + 1])::BIGINT AS nf FROM n3), sg AS (SELECT *, CASE WHEN nf > 0 THEN 1 WHEN nf < 0 THEN -1 ELSE 1 END AS sg, midi + 3 AS m FROM nf),
c AS (SELECT sg.*, s.step, a.a AS alter, CASE WHEN a.a = ({alter_sql('s.step', 'sg.nf')}) THEN 0 WHEN a.a = 0 THEN 1 WHEN a.a = sg THEN 2 ELSE 3 END AS rk FROM sg, (SELECT unnest(range(7)) AS step) s, (SELECT unnest([-1,0,1]) AS a) a),
o AS (SELECT *, row_number() OVER (PARTITION BY fifths, midi ORDER BY rk, step) AS rn FROM c WHERE ((({SEMI}[step+1] + alter - m) % 12) + 12) % 12 = 0)
SELECT fifths, midi, nf AS new_fifths, step::BIGINT AS step, alter::BIGINT AS alter, floor((m - {SEMI}[step+1] - alter)/12.0)::BIGINT - 1 AS octave, n FROM o WHERE rn = 1""")
def _(t):
    rows = t.lineitem.withColumn("midi", F.pmod("l_partkey", F.lit(60)) + 36)
    r = PT.transpose_corpus(rows, ["l_orderkey"], ORDER, key_change(), "midi", 3)
    p = "new_pitch."
    return r.groupBy("fifths", "midi", F.col("new_fifths").cast(L).alias("new_fifths"), F.col(p + "step").cast(L).alias("step"), F.col(p + "alter").cast(L).alias("alter"),
                     F.col(p + "octave").cast(L).alias("octave")).agg(F.count(F.lit(1)).alias("n"))


@query("X14_rewrite_in_key", f"""WITH {KEYED}, s AS (SELECT f, l_partkey % 7 AS st, l_orderkey % 3 - 1 AS al, l_linenumber::BIGINT AS oc, count(*) AS n FROM kn GROUP BY ALL),
g AS (SELECT *, al - ({alter_sql('st', 'f')}) AS off, (oc + 1)*12 + {SEMI}[st+1] + al AS m FROM s),
h AS (SELECT *, CASE WHEN off <> 0 THEN sign(off) WHEN f <> -2 THEN sign(f + 2) ELSE -1 END AS sg FROM g),
c AS (SELECT h.*, q.step, ({alter_sql('q.step', '-2')}) + o.o * sg AS alter, o.o FROM h, (SELECT unnest(range(7)) AS step) q, (SELECT unnest([0,1]) AS o) o),
r AS (SELECT *, row_number() OVER (PARTITION BY f, st, al, oc ORDER BY o, step) AS rn FROM c WHERE ((({SEMI}[step+1] + alter - m) % 12) + 12) % 12 = 0),
z AS (SELECT h.f, h.st, h.al, h.oc, h.n, r.step, r.alter, (h.m - {SEMI}[r.step+1] - r.alter) // 12 - 1 AS octave FROM h LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (f, st, al, oc))
SELECT f, st, al, oc, step::BIGINT AS step, alter::BIGINT AS alter, octave::BIGINT AS octave, (((step + octave*7 - 6) % 7 + 7) % 7 + 1)::BIGINT AS degree, n FROM z""")
def _(t):
    rows = t.lineitem.withColumn("st", F.pmod("l_partkey", F.lit(7))).withColumn("al", F.pmod("l_orderkey", F.lit(3)) - 1).withColumn("oc", F.col("l_linenumber").cast(L))
    rows = PT.with_key(rows, ["l_orderkey"], ORDER, key_change(), "f").select("l_orderkey", *ORDER, "st", "al", "oc", "f")
    r = PT.rewrite_in_key(rows, ["l_orderkey"], ORDER, F.col("f"), "st", "al", "oc", -2)
    return r.groupBy("f", "st", "al", "oc", F.col("new_pitch.step").cast(L).alias("step"), F.col("new_pitch.alter").cast(L).alias("alter"),
                     F.col("new_pitch.octave").cast(L).alias("octave"), F.col("new_degree.degree").cast(L).alias("degree")).agg(F.count(F.lit(1)).alias("n"))


@query("X15_script_direction", f"SELECT source, bool_or(translate(text, '{ACCENTED}', '{FOLDED}') <> text) AS fold FROM documents GROUP BY ALL")
def _(t):
    return PT.script_direction(t.texts, ["source"], "text", ACCENTED, FOLDED)


@query("X17_split_staves", f"""{EV}, e AS (SELECT user_id, event_id, k % 3 + 1 AS staff FROM ev) SELECT event_id, staff - 1 AS staff_part, CASE WHEN staff > 1 THEN 0 END::BIGINT AS staff_of, staff AS back FROM e""")
def _(t):
    e = ev(t).select("event_id", "user_id", (F.pmod("k", F.lit(3)) + 1).alias("staff"))
    s = PT.split_staves(e, ["user_id"], "staff")
    m = PT.merge_staves(s.drop("staff")).select("event_id", F.col("staff").alias("back"))
    return s.select("event_id", "staff_part", F.col("staff_of").cast(L).alias("staff_of")).join(m, "event_id")


@query("X17_marks_on_one_staff", f"""{EV}, e AS (SELECT user_id, event_id, k % 3 + 1 AS staff, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM ev)
SELECT a.event_id AS start_id, a.nx AS end_id, a.staff FROM e a JOIN e b ON b.event_id = a.nx AND b.user_id = a.user_id WHERE a.staff = b.staff""")
def _(t):
    from ..operators.scan import Ordered, lead

    e = ev(t).select("event_id", "user_id", (F.pmod("k", F.lit(3)) + 1).alias("staff"))
    marks = Ordered.of(e, ["user_id"], ["event_id"]).add(end_id=lead("event_id")).done().filter("end_id is not null").select("user_id", F.col("event_id").alias("start_id"), "end_id")
    return PT.marks_on_one_staff(marks, e, ["user_id"], "event_id", "staff").select("start_id", "end_id", "staff")


