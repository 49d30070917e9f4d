"""Measure length check on line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as Q
from ..plans.beats import beat_check
from .pitch import L
from .registry import query

LENGTHS = "ln AS (SELECT l_orderkey, l_linenumber::BIGINT AS measure, l_suppkey % 2 AS voice, sum(l_partkey % 4 + 1)::DOUBLE AS q, min(l_partkey) AS seen FROM lineitem GROUP BY ALL)"
MEASURES = """mc AS (SELECT l_orderkey, l_linenumber::BIGINT AS measure, bool_or(l_partkey % 17 = 0) AS implicit, max(CASE WHEN l_suppkey % 5 = 0 THEN 3.0 WHEN l_suppkey % 5 = 1 THEN 4.0 END) AS chg FROM lineitem GROUP BY ALL),
ms AS (SELECT *, coalesce(last_value(chg IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4.0) AS w FROM mc)"""


@query("W17_beat_check", f"""WITH {LENGTHS}, {MEASURES}, mv AS (SELECT l_orderkey, measure, arg_min(voice, seen * 2 + voice) AS v, arg_min(q, seen * 2 + voice) AS got FROM ln GROUP BY ALL),
a AS (SELECT *, row_number() OVER o AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM ms JOIN mv USING (l_orderkey, measure) WINDOW o AS (PARTITION BY l_orderkey ORDER BY measure)),
b AS (SELECT *, implicit OR abs(got - w) < 1e-6 AS ok0, got < w - 1e-6 AS sh, first_value(got) OVER z AS g1, first_value(w) OVER z AS w1, last_value(got) OVER z AS gn, last_value(w) OVER z AS wn
  FROM a WINDOW z AS (PARTITION BY l_orderkey ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, n >= 2 AND NOT (max(CASE WHEN r = 1 THEN ok0::INT END) OVER (PARTITION BY l_orderkey))::BOOLEAN AND g1 < w1 - 1e-6 AS up FROM b),
d AS (SELECT *, ok0 OR (up AND r = 1) OR (up AND r = n AND gn < wn - 1e-6 AND (abs(g1 + gn - w1) < 1e-6 OR abs(g1 + gn - wn) < 1e-6)) AS ok1 FROM c),
e AS (SELECT *, lead(ok1) OVER o AS nok, lead(implicit) OVER o AS nim, lead(sh) OVER o AS nsh, lead(got) OVER o AS ng, lead(w) OVER o AS nw FROM d WINDOW o AS (PARTITION BY l_orderkey ORDER BY measure)),
f AS (SELECT *, coalesce(NOT ok1 AND (NOT nok OR nim) AND sh AND nsh AND (abs(got + ng - w) < 1e-6 OR abs(got + ng - nw) < 1e-6), false) AS edge FROM e),
g AS (SELECT *, r - row_number() OVER (PARTITION BY l_orderkey, edge ORDER BY measure) AS isl FROM f),
h AS (SELECT *, edge AND (r - min(r) OVER (PARTITION BY l_orderkey, edge, isl)) % 2 = 0 AS take FROM g),
k AS (SELECT *, ok1 OR take OR coalesce(lag(take) OVER (PARTITION BY l_orderkey ORDER BY measure), false) AS ok FROM h)
SELECT l_orderkey, measure, 'length' AS kind, w::DOUBLE AS want, got FROM k WHERE NOT ok UNION ALL
SELECT ln.l_orderkey, ln.measure, 'voice', mv.got, ln.q FROM ln JOIN mv USING (l_orderkey, measure) WHERE voice <> v AND abs(q - mv.got) >= 1e-6""")
def _(t):
    ln = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").cast(L).alias("measure"), F.pmod("l_suppkey", F.lit(2)).alias("voice")).agg(
        F.sum((F.pmod("l_partkey", F.lit(4)) + 1).cast("double")).alias("q"), F.min("l_partkey").alias("seen"))
    s = F.pmod("l_suppkey", F.lit(5))
    m = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").cast(L).alias("measure")).agg(
        F.max(F.pmod("l_partkey", F.lit(17)) == 0).alias("implicit"), F.max(F.when(s == 0, 3.0).when(s == 1, 4.0)).alias("chg"))
    none = F.lit(None).cast("double")
    lines = t.lineitem.select("l_orderkey")  # an order has a line at least for each measure, so these are counted, once
    m = Q.carry_attr(m, ["l_orderkey"], ["measure"], F.col("chg"), none, none, F.lit(4.0), "w", probe=lines)
    m = m.select("l_orderkey", "measure", "implicit", F.array("w").alias("wants"))
    return beat_check(m, ln, ["l_orderkey"], "measure", "voice", "q", seen="seen", probe=lines)
