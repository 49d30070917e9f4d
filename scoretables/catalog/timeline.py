"""Play order and timelines: orders are songs, their lines measures and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as Q
from ..operators.stats import numbered
from ..plans import timeline as TL
from .joins import LI_RN
from .pitch import L
from .registry import query
from .votes import ORDER

SONG = ["l_orderkey"]


def measures(t):
    m = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("ln")).agg(F.max("l_quantity").alias("len"))
    return m.select("l_orderkey", (F.col("ln") - 1).cast(L).alias("measure"), "len")


def passes(t):
    """Every order once; odd ones again from a later measure, with an entry point and a limit for some."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None).cast("double")
    one = t.orders.select(k.alias("l_orderkey"), F.lit(0).alias("pass_ix"), F.lit(0).cast(L).alias("mid"), F.lit(7).cast(L).alias("end_mid"), F.lit(1).cast(L).alias("pass"), none.alias("offset"), none.alias("until"))
    two = t.orders.filter(F.pmod(k, F.lit(2)) == 1).select(
        k.alias("l_orderkey"), F.lit(1).alias("pass_ix"), F.pmod(cust, F.lit(3)).alias("mid"), (F.lit(5) + F.pmod(cust, F.lit(2))).cast(L).alias("end_mid"), F.lit(2).cast(L).alias("pass"),
        F.when(F.pmod(cust, F.lit(4)) == 0, 1.5).alias("offset"), F.when(F.pmod(cust, F.lit(5)) == 0, 6.0).alias("until"))
    return one.unionByName(two)


PASSES = """m AS (SELECT l_orderkey, l_linenumber::BIGINT - 1 AS measure, max(l_quantity) AS len FROM lineitem GROUP BY ALL),
ps AS (SELECT o_orderkey AS l_orderkey, 0 AS pass_ix, 0 AS mid, 7 AS end_mid, 1 AS pass, NULL AS off, NULL AS until FROM orders UNION ALL
 SELECT o_orderkey, 1, o_custkey % 3, 5 + o_custkey % 2, 2, CASE WHEN o_custkey % 4 = 0 THEN 1.5 END, CASE WHEN o_custkey % 5 = 0 THEN 6.0 END FROM orders WHERE o_orderkey % 2 = 1),
ex AS (SELECT * FROM ps JOIN m USING (l_orderkey) WHERE measure >= mid AND measure < end_mid),
cu AS (SELECT *, CASE WHEN measure = mid THEN coalesce(off, 0) ELSE 0 END AS cf, CASE WHEN measure = end_mid - 1 THEN until END AS ct FROM ex),
pl AS (SELECT *, coalesce(sum(least(len, coalesce(ct, len)) - cf) OVER (PARTITION BY l_orderkey ORDER BY pass_ix, measure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS onset FROM cu)"""


@query("X1_expand_passes", f"WITH {PASSES} SELECT l_orderkey, pass_ix::BIGINT AS pass_ix, pass::BIGINT AS pass, measure FROM ex")
def _(t):
    return TL.expand_passes(passes(t), measures(t), SONG).select("l_orderkey", F.col("pass_ix").cast(L).alias("pass_ix"), "pass", "measure")


def notes(t):
    n = numbered(t.lineitem, SONG, ORDER, "note_ix")
    return n.select(
        "l_orderkey", (F.col("l_linenumber") - 1).cast(L).alias("measure"), "note_ix", F.pmod("l_suppkey", F.lit(2)).alias("part"),
        F.pmod("l_partkey", F.lit(16)).cast("double").alias("pos"), (F.pmod("l_suppkey", F.lit(8)) + 1).cast("double").alias("dur"),
        (F.pmod("l_partkey", F.lit(5)) + 60).alias("pitch"), (F.col("l_returnflag") == "A").alias("tie_stop"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("velocity"))


@query("X2_build_timeline", f"""WITH {PASSES}, n AS (SELECT l_orderkey, l_linenumber::BIGINT - 1 AS measure, {LI_RN} AS note_ix, l_suppkey % 2 AS part, l_partkey % 16 AS pos, l_suppkey % 8 + 1 AS dur,
  l_partkey % 5 + 60 AS pitch, l_returnflag = 'A' AS tie, CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 100 END AS velocity FROM lineitem),
j AS (SELECT n.*, pl.pass_ix, pl.pass, onset + pos - cf AS t0, onset + pos - cf + dur AS t1 FROM n JOIN pl ON pl.l_orderkey = n.l_orderkey AND pl.measure = n.measure WHERE pos >= cf AND (ct IS NULL OR pos < ct)),
f AS (SELECT *, CASE WHEN tie AND abs(lag(t1) OVER w - t0) < 1e-6 THEN 0 ELSE 1 END AS new FROM j WINDOW w AS (PARTITION BY l_orderkey, part, pitch ORDER BY t0, pass_ix, measure, note_ix)),
i AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey, part, pitch ORDER BY t0, pass_ix, measure, note_ix) AS isl, row_number() OVER (PARTITION BY l_orderkey, part, pitch ORDER BY t0, pass_ix, measure, note_ix) AS r FROM f)
SELECT l_orderkey, part, pitch, min(t0)::DOUBLE AS t0, arg_max(t1, r)::DOUBLE AS t1, arg_min(velocity, r)::DOUBLE AS velocity, arg_min(pass, r)::BIGINT AS pass, count(*) AS pieces FROM i GROUP BY l_orderkey, part, pitch, isl""")
def _(t):
    tl = TL.build_timeline(passes(t), measures(t), notes(t), SONG)
    return tl.select("l_orderkey", "part", "pitch", "t0", "t1", "velocity", "pass", "pieces")


@query("X3_repeat_passes", """WITH m AS (SELECT l_orderkey, l_linenumber::BIGINT AS measure, bool_or(l_suppkey % 9 = 0) AS fwd, bool_or(l_suppkey % 4 = 1) AS bwd,
  CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 3 THEN [1, 2] WHEN l_orderkey % 3 = 0 AND l_linenumber = 4 THEN [3] WHEN l_orderkey % 3 = 1 AND l_linenumber = 5 THEN [1] WHEN l_orderkey % 3 = 1 AND l_linenumber = 6 THEN [2] END AS e
  FROM lineitem GROUP BY ALL), w AS (SELECT *, coalesce(lag(bwd) OVER o, false) AS pb, coalesce(lag(e IS NOT NULL) OVER o, false) AS pe FROM m WINDOW o AS (PARTITION BY l_orderkey ORDER BY measure)),
s AS (SELECT *, (sum(CASE WHEN fwd OR (e IS NULL AND (pb OR pe)) THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY measure))::BIGINT AS section FROM w),
k AS (SELECT l_orderkey, section, max(list_max(e)) AS top, bool_or(bwd) AS rep FROM s GROUP BY ALL),
x AS (SELECT s.*, unnest(range(1, CASE WHEN top IS NOT NULL THEN top WHEN rep THEN 2 ELSE 1 END + 1)) AS pass FROM s JOIN k USING (l_orderkey, section))
SELECT l_orderkey, section, pass::BIGINT AS pass, measure FROM x WHERE e IS NULL OR list_contains(e, pass)""")
def _(t):
    o, ln = F.pmod("l_orderkey", F.lit(3)), F.col("measure")
    nums = lambda *v: F.array(*[F.lit(x) for x in v])
    m = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").cast(L).alias("measure")).agg(
        F.max(F.pmod("l_suppkey", F.lit(9)) == 0).alias("fwd"), F.max(F.pmod("l_suppkey", F.lit(4)) == 1).alias("bwd"))
    e = F.when((o == 0) & (ln == 3), nums(1, 2)).when((o == 0) & (ln == 4), nums(3)).when((o == 1) & (ln == 5), nums(1)).when((o == 1) & (ln == 6), nums(2))
    r = TL.repeat_passes(m.withColumn("e", e), SONG, "measure", F.col("fwd"), F.col("bwd"), "e")
    return r.select("l_orderkey", "section", F.col("pass").cast(L).alias("pass"), "measure")


SECTIONS = "s AS (SELECT conv_id, CASE WHEN role = 'system' THEN '' ELSE role END AS name, (count(*) % 3 + 1)::BIGINT AS passes FROM conversations GROUP BY ALL)"


@query("X4_section_order", f"""WITH {SECTIONS}, q AS (SELECT DISTINCT conv_id, unnest(['user','assistant','chorus','user','user']) AS name, unnest(range(5)) AS pos FROM conversations),
a AS (SELECT q.conv_id, q.pos, s.name, passes FROM q JOIN s USING (conv_id, name) UNION ALL SELECT conv_id, -1, name, passes FROM s WHERE name = '' AND conv_id IN (SELECT conv_id FROM s WHERE name <> ''))
SELECT conv_id, pos, name, (coalesce(sum(passes) OVER (PARTITION BY conv_id, name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS first_pass, passes FROM a""")
def _(t):
    name = F.when(F.col("role") == "system", "").otherwise(F.col("role"))
    s = t.conversations.groupBy("conv_id", name.alias("name")).agg((F.count(F.lit(1)) % 3 + 1).alias("passes"))
    seq = t.conversations.select("conv_id").distinct().select(
        "conv_id", F.posexplode(F.array(*[F.lit(x) for x in ("user", "assistant", "chorus", "user", "user")])).alias("pos", "name"))
    return TL.section_order(seq, s, ["conv_id"]).select("conv_id", "pos", "name", "first_pass", "passes")


@query("X5_sing_order", """WITH m AS (SELECT conv_id, turn AS measure, CASE WHEN turn // 2 % 2 = 0 THEN 'A' ELSE 'B' END AS name FROM conversations WHERE role <> 'system'),
r AS (SELECT *, measure - row_number() OVER (PARTITION BY conv_id, name ORDER BY measure) AS isl FROM m), g AS (SELECT conv_id, name, min(measure) AS run_from, max(measure) + 1 AS run_end FROM r GROUP BY conv_id, name, isl),
i AS (SELECT DISTINCT conv_id, unnest(['A','B','A']) AS name, unnest([1, NULL, 2]) AS verse, unnest(range(3)) AS pos FROM conversations)
SELECT conv_id, pos, name, run_from, run_end, coalesce(verse, 1)::BIGINT AS pass FROM i JOIN g USING (conv_id, name)""")
def _(t):
    m = t.conversations.filter("role <> 'system'").select("conv_id", F.col("turn").alias("measure"), F.when(F.floor(F.col("turn") / 2) % 2 == 0, "A").otherwise("B").alias("name"))
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).cast("int").alias("verse")) for n, v in (("A", 1), ("B", None), ("A", 2))])
    i = t.conversations.select("conv_id").distinct().select("conv_id", F.posexplode(items).alias("pos", "x")).select("conv_id", F.col("pos").cast(L).alias("pos"), "x.name", "x.verse")
    return TL.sing_order(i, m, ["conv_id"])


@query("X6_verses_fallback", """WITH s AS (SELECT conv_id, count(*) AS end_mid, greatest(1, max(CASE WHEN role = 'user' THEN turn END)) AS v FROM conversations GROUP BY ALL)
SELECT conv_id, 0::BIGINT AS mid, end_mid, unnest(range(1, coalesce(v, 1) + 1)) AS pass FROM s""")
def _(t):
    s = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.when(F.col("role") == "user", F.col("turn"))), F.lit(1)).alias("v"))
    return TL.verses_fallback(s, ["conv_id"], "n", "v")


@query("X7_unplayed", f"WITH {PASSES}, p2 AS (SELECT * FROM ps WHERE pass_ix = 1) SELECT m.l_orderkey, m.measure FROM m WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.l_orderkey = m.l_orderkey AND m.measure >= mid AND m.measure < end_mid)")
def _(t):
    return TL.unplayed(measures(t), passes(t).filter("pass_ix = 1"), SONG).select("l_orderkey", "measure")


@query("X9_distinct_verses", """WITH RECURSIVE l AS (SELECT conv_id, turn // 4 AS note, turn, length(text) % 3 + 1 AS v, row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) AS r FROM conversations),
f AS (SELECT conv_id, note, turn, r, v, [v] AS used, v AS top FROM l WHERE r = 1 UNION ALL
 SELECT l.conv_id, l.note, l.turn, l.r, CASE WHEN list_contains(used, l.v) THEN top + 1 ELSE l.v END, list_append(used, CASE WHEN list_contains(used, l.v) THEN top + 1 ELSE l.v END), greatest(top, CASE WHEN list_contains(used, l.v) THEN top + 1 ELSE l.v END)
 FROM f JOIN l ON l.conv_id = f.conv_id AND l.note = f.note AND l.r = f.r + 1)
SELECT conv_id, note, turn, v::BIGINT AS verse FROM f""")
def _(t):
    l = t.conversations.select("conv_id", F.floor(F.col("turn") / 4).alias("note"), "turn", (F.length("text") % 3 + 1).alias("verse"))
    return TL.distinct_verses(l, ["conv_id", "note"], "turn", "verse")


LI_ORDER = ", ".join(ORDER)


@query("X10_axis_slots", f"""WITH a AS (SELECT *, CASE WHEN l_suppkey % 3 = 0 OR (l_orderkey % 2 = 0 AND row_number() OVER w = 1) THEN l_linenumber END AS sys FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_returnflag ORDER BY {LI_ORDER})),
c AS (SELECT *, last_value(sys IGNORE NULLS) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {LI_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {LI_ORDER}) AS ix FROM a),
g AS (SELECT l_orderkey, bool_and(s IS NOT NULL) AND count(*) > 1 AS grouped FROM c WHERE ix = 1 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, s ORDER BY {LI_ORDER}) - 1 AS k FROM c), z AS (SELECT l_orderkey, s, max(k) + 1 AS size FROM k GROUP BY ALL),
st AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY l_orderkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM z)
SELECT k.l_orderkey, l_returnflag, ix::BIGINT AS ix, (CASE WHEN grouped THEN start + k ELSE ix - 1 END)::BIGINT AS slot FROM k JOIN g USING (l_orderkey) LEFT JOIN st ON st.l_orderkey = k.l_orderkey AND st.s IS NOT DISTINCT FROM k.s""")
def _(t):
    rows = numbered(t.lineitem, ["l_orderkey", "l_returnflag"], ORDER, "ix")
    named = (F.pmod("l_suppkey", F.lit(3)) == 0) | ((F.pmod("l_orderkey", F.lit(2)) == 0) & (F.col("ix") == 1))
    rows = rows.select("l_orderkey", "l_returnflag", "ix", F.when(named, F.col("l_linenumber")).alias("sys"))
    return TL.axis_slots(rows, SONG, "l_returnflag", ["ix"], "sys").select("l_orderkey", "l_returnflag", "ix", F.col("slot").cast(L).alias("slot"))


RANGES = [(1, 0, 4, None), (2, 0, 2, None), (2, 4, 6, None), (1, 6, 7, None), (2, 6, 7, "o_custkey % 3 > 0"), (3, 0, 2, "o_custkey % 4 = 0"), (3, 5, 6, "o_custkey % 4 = 0"), (2, 2, 3, "o_custkey % 5 = 0")]
RANGE_SQL = " UNION ALL ".join(f"SELECT o_orderkey AS song, {p} AS pass, unnest(range({a}, {b})) AS measure FROM orders" + (f" WHERE {c}" if c else "") for p, a, b, c in RANGES)


@query("X16_endings_from_passes", f"""WITH pl AS (SELECT DISTINCT song, pass, measure FROM ({RANGE_SQL})), s AS (SELECT song, measure, list_sort(list(pass)) AS st FROM pl GROUP BY ALL),
f AS (SELECT *, CASE WHEN lag(measure) OVER w = measure - 1 AND lag(st) OVER w = st THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY song ORDER BY measure)), i AS (SELECT *, sum(new) OVER (PARTITION BY song ORDER BY measure) AS seg FROM f),
g AS (SELECT song, seg, min(measure) AS lo, max(measure) + 1 AS hi, any_value(st) AS st FROM i GROUP BY ALL),
two AS (SELECT a.song, a.seg, 2 AS n FROM g a JOIN g b ON b.song = a.song AND b.seg = a.seg + 1 JOIN g c ON c.song = a.song AND c.seg = a.seg + 2 WHERE list_sort(list_concat(b.st, c.st)) = a.st),
three AS (SELECT a.song, a.seg, 3 AS n FROM g a JOIN g b ON b.song = a.song AND b.seg = a.seg + 1 JOIN g c ON c.song = a.song AND c.seg = a.seg + 2 JOIN g d ON d.song = a.song AND d.seg = a.seg + 3 WHERE list_sort(list_concat(list_concat(b.st, c.st), d.st)) = a.st),
h AS (SELECT * FROM two UNION ALL SELECT * FROM three)
SELECT DISTINCT g.song, g.lo AS run_from, g.hi AS run_end, array_to_string(g.st, ',') AS passes FROM g JOIN h ON h.song = g.song AND g.seg > h.seg AND g.seg <= h.seg + h.n""")
def _(t):
    spans = F.array_compact(F.array(*[F.when(F.expr(c or "true"), F.struct(F.lit(p).cast(L).alias("pass"), F.lit(a).alias("a"), F.lit(b).alias("b"))) for p, a, b, c in RANGES]))
    rows = t.orders.select(F.col("o_orderkey").alias("song"), F.explode(spans).alias("r"))
    rows = rows.select("song", "r.pass", F.explode(F.sequence(F.col("r.a").cast(L), (F.col("r.b") - 1).cast(L))).alias("measure"))
    return TL.endings_from_passes(rows, ["song"])
