"""Note events on the event table and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import notes as N
from .pitch import L
from .registry import query
from .votes import EV, ev, with_k

# A user's events as notes of a file: start from the event number, length from the value in the properties.
NOTES = "n AS (SELECT user_id % 20 AS part, event_id AS id, event_id * 7 AS s, event_id * 7 + 5 + k AS e, 60 + k % 4 AS pitch, k FROM ev)"


def ev_notes(t):
    return ev(t).select(F.pmod("user_id", F.lit(20)).alias("part"), F.col("event_id").alias("id"), (F.col("event_id") * 7).alias("s"),
                        (F.col("event_id") * 7 + 5 + F.col("k")).alias("e"), (F.pmod("k", F.lit(4)) + 60).alias("pitch"), "k")


PAIRS = f"""{EV}, a AS (SELECT user_id, k % 2 AS pitch, event_id, ts, event_type = 'click' AS on_, row_number() OVER (PARTITION BY user_id, k % 2 ORDER BY ts, event_id) AS r FROM ev WHERE event_type IN ('click', 'view')),
b AS (SELECT *, sum(CASE WHEN on_ THEN 1 ELSE -1 END) OVER (PARTITION BY user_id, pitch ORDER BY r) AS bal FROM a),
c AS (SELECT *, min(bal) OVER (PARTITION BY user_id, pitch ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, pitch, on_ ORDER BY r) AS k FROM c WHERE on_ OR NOT (bal < least(0, coalesce(low, 0))))
SELECT user_id, pitch, k, max(event_id) FILTER (on_) AS t_on, max(event_id) FILTER (NOT on_) AS t_off FROM d GROUP BY ALL"""


@query("W24_pair_on_off", PAIRS)
def _(t):
    e = ev(t).withColumn("pitch", F.pmod("k", F.lit(2)))
    return N.pair_on_off(e, ["user_id", "pitch"], ["ts", "event_id"], "event_id", F.col("event_type") == "click", F.col("event_type") == "view")


@query("W24_pair_on_off_stream", PAIRS)
def _(t):
    from ..streaming.ordered import pair_table

    kind = F.col("event_type")
    return pair_table(t.spark, f"{t.folder}/events.parquet", lambda e: with_k(e).withColumn("pitch", F.pmod("k", F.lit(2))), ["user_id", "pitch"], "ts", "event_id", "event_id", kind == "click", kind == "view")


METERS = "mt AS (SELECT user_id % 20 AS part, event_id * 7 AS ats, 2 + k % 5 AS beats, [2, 4, 8][k % 3 + 1] AS bt FROM ev WHERE k > 97), en AS (SELECT part, max(e) + 1 AS until FROM n GROUP BY ALL)"
GRID = f"""{METERS}, m0 AS (SELECT part, (floor(ats/6.0 + 0.5)*6)::BIGINT AS ats, beats, bt, 1 AS r FROM mt UNION ALL SELECT part, 0, 4, 4, 0 FROM en),
m1 AS (SELECT part, ats, arg_max(beats, r) AS beats, arg_max(bt, r) AS bt FROM m0 GROUP BY ALL),
m2 AS (SELECT m1.*, coalesce(lead(ats) OVER (PARTITION BY m1.part ORDER BY ats), until) AS nxt, (192 * beats // bt)::BIGINT AS len FROM m1 JOIN en USING (part)),
br AS (SELECT part, b0 AS bar_start, least(b0 + len, nxt) AS bar_end, beats, bt FROM (SELECT *, unnest(range(ats, nxt, len)) AS b0 FROM m2 WHERE nxt > ats))"""


def grid(t):
    e = ev(t)
    m = e.filter("k > 97").select(F.pmod("user_id", F.lit(20)).alias("part"), (F.col("event_id") * 7).alias("at"), (F.pmod("k", F.lit(5)) + 2).alias("beats"),
                                  F.get(F.array(F.lit(2), F.lit(4), F.lit(8)), F.pmod("k", F.lit(3)).cast("int")).cast(L).alias("beat_type"))
    ends = ev_notes(t).groupBy("part").agg((F.max("e") + 1).alias("until"))
    return N.bars_from_meters(m, ends, ["part"])


@query("W25_bars_from_meters", f"{EV}, {NOTES}, {GRID} SELECT part, bar_start, bar_end, beats::BIGINT AS beats, bt::BIGINT AS beat_type FROM br")
def _(t):
    return grid(t).select("part", "bar_start", "bar_end", F.col("beats").cast(L).alias("beats"), F.col("beat_type").cast(L).alias("beat_type"))


TRIP = """pt AS (SELECT part, unnest([s, e]) AS x FROM n), er AS (SELECT part, floor(x/48.0)::BIGINT AS beat, sum(abs(x - floor(x/12.0 + 0.5)*12)) AS st, sum(abs(x - floor(x/16.0 + 0.5)*16)) AS tr FROM pt GROUP BY ALL),
tb AS (SELECT part, beat FROM er WHERE tr < st * 0.5)"""


@query("W21_triplet_beats", f"{EV}, {NOTES}, {GRID}, {TRIP} SELECT tb.part, beat FROM tb JOIN br ON br.part = tb.part AND bar_start <= beat*48 AND beat*48 < bar_end WHERE bt <= 4 AND bar_end >= (beat + 1)*48")
def _(t):
    bars = grid(t)
    return N.triplet_beats(ev_notes(t), ["part"], "s", "e", 12, bars).select("part", "beat")


QUANT = """g AS (SELECT n.*, CASE WHEN a.beat IS NULL THEN 12 ELSE 16 END AS gs, CASE WHEN b.beat IS NULL THEN 12 ELSE 16 END AS ge FROM n LEFT JOIN tb a ON a.part = n.part AND a.beat = floor(s/48.0) LEFT JOIN tb b ON b.part = n.part AND b.beat = floor(e/48.0)),
q AS (SELECT *, (floor(s::DOUBLE/gs + 0.5)*gs)::BIGINT AS qs, (floor(e::DOUBLE/ge + 0.5)*ge)::BIGINT AS qe FROM g),
qq AS (SELECT q.part, q.id, q.pitch, qs AS q_start, greatest(qe, qs + CASE WHEN tb.beat IS NULL THEN 12 ELSE 16 END) AS q_end FROM q LEFT JOIN tb ON tb.part = q.part AND tb.beat = floor(qs/48.0))"""


def quantized(t):
    n = ev_notes(t)
    return N.quantize(n, ["part"], "s", "e", 12, N.triplet_beats(n, ["part"], "s", "e", 12))


@query("W22_quantize", f"{EV}, {NOTES}, {TRIP}, {QUANT} SELECT id, q_start, q_end FROM qq")
def _(t):
    return quantized(t).select("id", F.col("q_start").cast(L).alias("q_start"), F.col("q_end").cast(L).alias("q_end"))


@query("W23_trim_overlaps", f"""{EV}, {NOTES}, {TRIP}, {QUANT}, st AS (SELECT s.part, q_start, nx, CASE WHEN tb.beat IS NULL THEN 12 ELSE 16 END AS grid FROM (SELECT part, q_start, lead(q_start) OVER (PARTITION BY part ORDER BY q_start) AS nx FROM (SELECT DISTINCT part, q_start FROM qq)) s
 LEFT JOIN tb ON tb.part = s.part AND tb.beat = floor(nx/48.0)),
t1 AS (SELECT qq.part, id, pitch, qq.q_start, CASE WHEN q_end - nx > 0 AND q_end - nx <= grid AND (q_end - nx)*4 <= q_end - qq.q_start THEN nx ELSE q_end END AS q_end FROM qq JOIN st USING (part, q_start)),
t2 AS (SELECT part, pitch, q_start, min(id) AS id, arg_min(q_end, id) AS q_end FROM t1 GROUP BY ALL)
SELECT part, pitch, q_start, least(q_end, coalesce(lead(q_start) OVER (PARTITION BY part, pitch ORDER BY q_start), q_end))::BIGINT AS q_end, id FROM t2""")
def _(t):
    q = quantized(t).select("part", "id", "pitch", F.col("q_start").cast(L).alias("q_start"), F.col("q_end").cast(L).alias("q_end"))
    n = ev_notes(t)
    return N.trim_overlaps(q, ["part"], "q_start", "q_end", "pitch", "id", 12, N.triplet_beats(n, ["part"], "s", "e", 12)).select("part", "pitch", "q_start", "q_end", "id")


@query("W26_split_at_beats", """WITH n AS (SELECT l_quantity AS s, l_quantity + l_linenumber * 1.5 AS e, count(*) AS n FROM lineitem GROUP BY ALL),
b AS (SELECT *, unnest(range(floor(s/4)::BIGINT, greatest(floor(s/4), ceil(e/4) - 1)::BIGINT + 1)) AS beat FROM n)
SELECT s, e::DOUBLE AS e, beat, greatest(s, beat*4)::DOUBLE AS from_, least(e, (beat + 1)*4)::DOUBLE AS to_, n FROM b""")
def _(t):
    n = t.lineitem.groupBy(F.col("l_quantity").alias("s"), (F.col("l_quantity") + F.col("l_linenumber") * 1.5).alias("e")).agg(F.count(F.lit(1)).alias("n"))
    return N.split_at_beats(n, "s", "e", 4.0)


@query("W27_max_concurrency", """WITH d AS (SELECT DISTINCT l_orderkey, l_quantity AS s, l_quantity + l_linenumber AS e FROM lineitem), v AS (SELECT l_orderkey, s AS t, 1 AS d FROM d UNION ALL SELECT l_orderkey, e, -1 FROM d),
g AS (SELECT l_orderkey, t, d, sum(d) AS s FROM v GROUP BY ALL) SELECT l_orderkey, max(o)::BIGINT AS voices FROM (SELECT l_orderkey, sum(s) OVER (PARTITION BY l_orderkey ORDER BY t, d) AS o FROM g) GROUP BY ALL""")
def _(t):
    return N.max_concurrency(t.lineitem.withColumn("e", F.col("l_quantity") + F.col("l_linenumber")), ["l_orderkey"], "l_quantity", "e")


@query("O2_rank_alternatives", f"""{EV}, b AS (SELECT user_id, event_type, max(value) AS value FROM ev GROUP BY ALL)
SELECT user_id, event_type, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type) AS rank FROM b) WHERE rank <= 3""")
def _(t):
    return N.rank_alternatives(t.events, ["user_id"], "event_type", "value", 3)


@query("O3_stable_event_order", """WITH e AS (SELECT event_id, event_id // 5 AS tick, CASE event_type WHEN 'view' THEN 'off' WHEN 'error' THEN 'lyric' ELSE 'on' END AS kind, user_id % 7 AS part FROM events)
SELECT event_id, row_number() OVER (PARTITION BY part ORDER BY tick, CASE kind WHEN 'off' THEN 0 WHEN 'lyric' THEN 1 ELSE 2 END, event_id) AS place FROM e""")
def _(t):
    from ..operators.stats import numbered

    kind = F.when(F.col("event_type") == "view", "off").when(F.col("event_type") == "error", "lyric").otherwise("on")
    e = t.events.select("event_id", F.floor(F.col("event_id") / 5).alias("tick"), N.stable_event_order(kind).alias("rank"), F.pmod("user_id", F.lit(7)).alias("part"))
    return numbered(e, ["part"], ["tick", "rank", "event_id"], "place").select("event_id", "place")


@query("O4_lead_first_order", """WITH e AS (SELECT event_id, event_id // 5 AS t, user_id % 4 AS part, event_type FROM events)
SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY t, part <> 2, part, event_id) AS place FROM e""")
def _(t):
    from ..operators.stats import numbered

    part = F.pmod("user_id", F.lit(4))
    e = t.events.select("event_id", F.floor(F.col("event_id") / 5).alias("t"), (part != 2).alias("follows"), part.alias("part"), "event_type")
    return numbered(e, ["event_type"], ["t", "follows", "part", "event_id"], "place").select("event_id", "place")
