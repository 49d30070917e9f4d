"""Order statistics, clusters and boxes on line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import sequence as Q
from ..operators import stats as S
from .pitch import L
from .registry import query
from .text import END, LINES, MID, QUOTES, doc_lines


def q_sql(value, index, src="v", by="g"):
    """SQL: value at 0-based `index` (in terms of n) of the sorted values per group."""
    return (f"(SELECT {by}, {value} AS q FROM (SELECT {by}, {value}, row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS rk_, "
            f"count(*) OVER (PARTITION BY {by}) AS n FROM {src}) WHERE rk_ = {index})")


@query("A4_quantile_floor", f"""WITH v AS (SELECT l_suppkey AS g, l_extendedprice AS x FROM lineitem)
SELECT a.g AS l_suppkey, a.q AS p10, b.q AS p50, c.q AS p90, m.q AS med FROM {q_sql('x', 'least(n-1, floor(n*0.1))')} a
JOIN {q_sql('x', 'least(n-1, floor(n*0.5))')} b USING (g) JOIN {q_sql('x', 'least(n-1, floor(n*0.9))')} c USING (g)
JOIN {q_sql('x', 'n // 2')} m USING (g)""")
def _(t):
    picks = {"p10": S.floor_index(0.1), "p50": S.floor_index(0.5), "p90": S.floor_index(0.9), "med": S.median_index}
    return S.quantiles(t.lineitem, ["l_suppkey"], "l_extendedprice", picks).drop("n")


@query("A5_summarize", f"""WITH v AS (SELECT l_returnflag || l_linestatus AS g, l_extendedprice AS x FROM lineitem),
p AS (SELECT a.g, a.q AS p25, b.q AS p50, c.q AS p75 FROM {q_sql('x', 'floor(n*0.25)')} a JOIN {q_sql('x', 'floor(n*0.5)')} b USING (g)
  JOIN {q_sql('x', 'floor(n*0.75)')} c USING (g)), dv AS (SELECT v.g, abs(x - p50) AS d FROM v JOIN p USING (g))
SELECT p.g AS grp, (SELECT count(*) FROM v WHERE v.g = p.g) AS n, p25, p50, p75, round(m.q / abs(p50), 6) AS mad_ratio
FROM p JOIN {q_sql('d', 'n // 2', 'dv')} m USING (g)""")
def _(t):
    d = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("grp"), "l_extendedprice")
    return S.summarize(d, ["grp"], "l_extendedprice").withColumn("mad_ratio", F.round("mad_ratio", 6))


@query("A6_quantile_round", f"""WITH v AS (SELECT l_suppkey AS g, l_extendedprice AS x FROM lineitem)
SELECT a.g AS l_suppkey, a.q AS q10, b.q AS q50, c.q AS q90 FROM {q_sql('x', 'floor((n-1)*0.1+0.5)')} a
JOIN {q_sql('x', 'floor((n-1)*0.5+0.5)')} b USING (g) JOIN {q_sql('x', 'floor((n-1)*0.9+0.5)')} c USING (g)""")
def _(t):
    picks = {"q10": S.round_index(0.1), "q50": S.round_index(0.5), "q90": S.round_index(0.9)}
    return S.quantiles(t.lineitem, ["l_suppkey"], "l_extendedprice", picks).drop("n")


@query("A7_mean_finite", """SELECT user_id, round(coalesce(avg(CASE WHEN event_type <> 'error' THEN value END), -1), 6) AS mean FROM events GROUP BY ALL""")
def _(t):
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    m = t.events.groupBy("user_id").agg(S.mean_finite(v).alias("mean"))
    return m.select("user_id", F.round(F.nanvl("mean", F.lit(-1.0)), 6).alias("mean"))


BOX = "x AS x0, y AS y0, x + w AS x1, y + h AS y1"
LI_BOX = "SELECT l_returnflag AS g, l_quantity AS x, (l_partkey % 800)::DOUBLE AS y, l_linenumber::DOUBLE AS w, (l_suppkey % 20 + 1)::DOUBLE AS h FROM lineitem"


def li_boxes(t):
    return t.lineitem.select(
        F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.pmod("l_partkey", F.lit(800)).cast("double").alias("y"),
        F.col("l_linenumber").cast("double").alias("w"), (F.pmod("l_suppkey", F.lit(20)) + 1).cast("double").alias("h"))


@query("A8_content_box", f"""WITH r AS ({LI_BOX}), v AS (SELECT g, {BOX} FROM r),
b AS (SELECT a.g, a.q AS x, b.q AS y, c.q AS x1, d.q AS y1 FROM {q_sql('x0', 'floor((n-1)*0.02+0.5)')} a JOIN {q_sql('y0', 'floor((n-1)*0.02+0.5)')} b USING (g)
  JOIN {q_sql('x1', 'floor((n-1)*0.98+0.5)')} c USING (g) JOIN {q_sql('y1', 'floor((n-1)*0.98+0.5)')} d USING (g)),
hd AS (SELECT v.g, y0 FROM v JOIN b USING (g) WHERE y0 < y), ft AS (SELECT v.g, y0 FROM v JOIN b USING (g) WHERE y0 > b.y1)
SELECT b.g, b.x, b.y, x1 - x AS w, b.y1 - b.y AS h, h.q AS header_top, f.q AS footer_bottom FROM b
LEFT JOIN {q_sql('y0', 'floor((n-1)*0.05+0.5)', 'hd')} h USING (g) LEFT JOIN {q_sql('y0', 'floor((n-1)*0.95+0.5)', 'ft')} f USING (g)""")
def _(t):
    return S.content_box(li_boxes(t), ["g"], "x", "y", "w", "h")


# sizes with gaps of more than 6 %, so that clusters arise
SIZE_SQL = "(CASE WHEN l_quantity < 12 THEN 5 WHEN l_quantity < 35 THEN 8 ELSE 14 END * (1 + (l_partkey % 10) / 250.0))"
FAM = f"WITH r AS (SELECT l_returnflag AS g, round({SIZE_SQL}, 4) AS s, l_linenumber::DOUBLE AS w, (l_partkey % 800)::DOUBLE AS y FROM lineitem)"
CLUSTER = """vals AS (SELECT g, s, count(*) AS n FROM r GROUP BY ALL),
fl AS (SELECT *, CASE WHEN (s - lag(s) OVER (PARTITION BY g ORDER BY s)) / greatest(lag(s) OVER (PARTITION BY g ORDER BY s), 0.01) > 0.06 THEN 1 ELSE 0 END AS f FROM vals),
cl AS (SELECT g, s, n, (sum(f) OVER (PARTITION BY g ORDER BY s))::BIGINT AS cluster FROM fl)"""


def li_sizes(t):
    q = F.col("l_quantity")
    base = F.when(q < 12, 5).when(q < 35, 8).otherwise(14)
    return t.lineitem.select(
        F.col("l_returnflag").alias("g"), F.round(base * (1 + F.pmod("l_partkey", F.lit(10)) / 250.0), 4).alias("s"),
        F.col("l_linenumber").cast("double").alias("w"), F.pmod("l_partkey", F.lit(800)).cast("double").alias("y"))


# sizes that rise in small steps, so that only the running median parts them
DRIFT_SQL = "WITH RECURSIVE v AS (SELECT l_returnflag AS g, round(5 * pow(1.015, l_partkey % 90) * (1 + (l_suppkey % 5) / 400.0) + CASE WHEN l_partkey % 90 > 60 THEN 4 ELSE 0 END, 4) AS s FROM lineitem)"


@query("W10_gap_cluster_rel", f"""{DRIFT_SQL}, a AS (SELECT g, list(s ORDER BY s) AS xs FROM v GROUP BY g),
p AS (SELECT g, list(i ORDER BY i) AS firsts FROM (SELECT g, s, min(r) - 1 AS i FROM (SELECT g, s, row_number() OVER (PARTITION BY g ORDER BY s) AS r FROM v) GROUP BY g, s) GROUP BY g),
st(g, xs, firsts, s0) AS (SELECT g, xs, firsts, 0::BIGINT FROM a JOIN p USING (g) UNION ALL SELECT g, xs, firsts, nx FROM (
  SELECT g, xs, firsts, list_min(list_filter(firsts, lambda i: i > s0 AND abs(xs[i + 1] - xs[s0 + (i - s0) // 2 + 1]) / greatest(xs[s0 + (i - s0) // 2 + 1], 0.01) > 0.06)) AS nx FROM st) WHERE nx IS NOT NULL),
e AS (SELECT g, xs, s0, row_number() OVER (PARTITION BY g ORDER BY s0) - 1 AS cluster, coalesce(lead(s0) OVER (PARTITION BY g ORDER BY s0), len(xs)) AS until FROM st)
SELECT g, cluster, xs[s0 + 1] AS low, xs[until] AS high, until - s0 AS n FROM e""")
def _(t):
    k = F.pmod("l_partkey", F.lit(90))
    size = 5 * F.pow(F.lit(1.015), k) * (1 + F.pmod("l_suppkey", F.lit(5)) / 400.0) + F.when(k > 60, 4).otherwise(0)
    sizes = t.lineitem.select(F.col("l_returnflag").alias("g"), F.round(size, 4).alias("s"))
    return S.median_clusters(sizes, ["g"], "s", 0.06).groupBy("g", "cluster").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.sum("n").alias("n"))


@query("F5_drop_noise_groups", f"""{FAM}, {CLUSTER}, k AS (SELECT g, cluster, sum(n) AS n FROM cl GROUP BY ALL)
SELECT g, cluster, n::BIGINT AS n FROM (SELECT *, sum(n) OVER (PARTITION BY g) AS a FROM k) WHERE n >= greatest(8, 0.25 * a)""")
def _(t):
    c = S.median_clusters(li_sizes(t), ["g"], "s", 0.06).groupBy("g", "cluster").agg(F.sum("n").alias("n"))
    return S.drop_noise(c, ["g"], 0.25)


@query("A9_profile_families", f"""{FAM}, {CLUSTER}, v AS (SELECT r.g || ':' || cluster::VARCHAR AS g, r.s, w, y FROM r JOIN cl USING (g, s))
SELECT a.g AS family, c.low, c.high, c.n, a.q AS center, b.q AS mid_width, d.q AS y10, e.q AS y50, f.q AS y90
FROM (SELECT g, min(s) AS low, max(s) AS high, count(*) AS n FROM v GROUP BY ALL) c JOIN {q_sql('s', 'n//2')} a USING (g)
JOIN {q_sql('w', 'floor((n-1)*0.5+0.5)')} b USING (g) JOIN {q_sql('y', 'floor((n-1)*0.1+0.5)')} d USING (g)
JOIN {q_sql('y', 'floor((n-1)*0.5+0.5)')} e USING (g) JOIN {q_sql('y', 'floor((n-1)*0.9+0.5)')} f USING (g)""")
def _(t):
    f = S.families(li_sizes(t), ["g"], "s", "w", "y")
    return f.select(F.concat_ws(":", "g", F.col("cluster").cast("string")).alias("family"), "low", "high", "n", "center", "mid_width",
                    "y10", "y50", "y90")


@query("F3_body_height", f"""WITH v AS (SELECT l_orderkey AS g, l_quantity AS h FROM lineitem WHERE l_quantity > 0),
m AS {q_sql('h', 'floor(n*0.5)')}, u AS (SELECT v.g, h FROM v JOIN m USING (g) WHERE h >= q), b AS {q_sql('h', 'floor(n*0.5)', 'u')}
SELECT v.g AS l_orderkey, v.h AS l_quantity, b.q AS body, count(*) AS n FROM v JOIN b USING (g) WHERE v.h >= b.q * 0.72 GROUP BY ALL""")
def _(t):
    rows = S.body_rows(t.lineitem.select("l_orderkey", "l_quantity"), ["l_orderkey"], "l_quantity")
    return rows.groupBy("l_orderkey", "l_quantity", "body").agg(F.count(F.lit(1)).alias("n"))


@query("A22_two_class_split", """WITH a AS (SELECT l_orderkey AS g, l_quantity AS x FROM lineitem), g AS (SELECT g, 20.0 AS h FROM a GROUP BY ALL),
v AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) AS r, count(*) OVER (PARTITION BY g) AS n, ln(x) AS lx,
  lag(x) OVER (PARTITION BY g ORDER BY x) AS px, sum(ln(x)) OVER (PARTITION BY g) AS t FROM a WHERE x > 1),
s AS (SELECT *, coalesce(sum(lx) OVER (PARTITION BY g ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM v),
b AS (SELECT *, (t - s0)/(n - r + 1) - s0/(r-1) AS d FROM s WHERE r > 1 AND x > px),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round((r-1)*(n-r+1)*d*d, 9) DESC, x) AS rk FROM b),
c AS (SELECT g, count(*) AS n FROM a WHERE x > 1 GROUP BY ALL)
SELECT g.g AS l_orderkey, round(CASE WHEN coalesce(c.n,0) < 2 THEN h*0.3 WHEN k.g IS NULL OR d < ln(2.5) THEN 1e9 ELSE sqrt(px*x) END, 6)::DOUBLE AS boundary
FROM g LEFT JOIN c USING (g) LEFT JOIN (SELECT * FROM k WHERE rk = 1) k USING (g)""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_quantity", F.lit(20.0).alias("h"))
    b = S.two_class_split(d, ["l_orderkey"], "l_quantity", "h")
    return b.select("l_orderkey", F.round(F.when(F.col("boundary") == float("inf"), 1e9).otherwise(F.col("boundary")), 6).alias("boundary"))


@query("A23_otsu", """WITH h AS (SELECT l_suppkey AS g, (l_extendedprice/450)::BIGINT AS b0, count(*) AS c0 FROM lineitem GROUP BY ALL),
hist AS (SELECT g, least(255, greatest(0, floor(b0)))::BIGINT AS b, sum(c0) AS c FROM h GROUP BY ALL),
k AS (SELECT *, sum(c) OVER w AS wb, sum(b*c) OVER w AS sb, sum(c) OVER (PARTITION BY g) AS n, sum(b*c) OVER (PARTITION BY g) AS t
  FROM hist WINDOW w AS (PARTITION BY g ORDER BY b)),
z AS (SELECT *, CASE WHEN n > wb THEN round(wb::DOUBLE*(n-wb)*(sb/wb - (t-sb)/(n-wb))*(sb/wb - (t-sb)/(n-wb)), 3) END AS bt FROM k)
SELECT g AS l_suppkey, b AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY bt DESC NULLS LAST, b) AS r FROM z) WHERE r = 1""")
def _(t):
    # DuckDB casts by rounding half to even; rint does the same
    gray = F.greatest(F.lit(0), F.least(F.lit(255), F.rint(F.col("l_extendedprice") / 450))).cast(L)
    return S.otsu(t.lineitem.select("l_suppkey", gray.alias("gray")), ["l_suppkey"], "gray").select("l_suppkey", "threshold")


@query("A24_margins", f"""WITH v AS (SELECT l_returnflag AS g, l_quantity AS x, (l_partkey % 300)::DOUBLE AS r, l_extendedprice/100 AS t, l_tax*1000 AS b, l_quantity*20 AS w FROM lineitem)
SELECT a.g, floor(a.q+0.5)::BIGINT AS left_, floor(b.q+0.5)::BIGINT AS right_, floor(c.q+0.5)::BIGINT AS top_,
 floor(CASE WHEN d.q = 0 THEN 200 ELSE d.q END + 0.5)::BIGINT AS bottom_, floor(e.q+0.5)::BIGINT AS type_w
FROM {q_sql('x', 'n//2')} a JOIN {q_sql('r', 'n//2')} b USING (g) JOIN {q_sql('t', 'n//2')} c USING (g) JOIN {q_sql('b', 'least(n-1, floor(n*0.3))')} d USING (g)
JOIN {q_sql('w', 'n//2')} e USING (g)""")
def _(t):
    q = F.col("l_quantity")
    d = t.lineitem.select(F.col("l_returnflag").alias("g"), q.alias("x"), F.pmod("l_partkey", F.lit(300)).cast("double").alias("r"),
                          (F.col("l_extendedprice") / 100).alias("t"), (F.col("l_tax") * 1000).alias("b"), (q * 20).alias("w"))
    m = S.margins(d, ["g"], "x", "r", "t", "b", "w")
    return m.select("g", F.col("left").alias("left_"), F.col("right").alias("right_"), F.col("top").alias("top_"),
                    F.col("bottom").alias("bottom_"), "type_w")


@query("A25_union_box", """SELECT l_orderkey, min(l_quantity) AS x, min(l_partkey)::DOUBLE AS y, max(l_quantity + l_linenumber) - min(l_quantity) AS w,
 (max(l_partkey + l_suppkey) - min(l_partkey))::DOUBLE AS h FROM lineitem GROUP BY ALL""")
def _(t):
    d = t.lineitem.select("l_orderkey", F.col("l_quantity").alias("x"), F.col("l_partkey").cast("double").alias("y"),
                          F.col("l_linenumber").cast("double").alias("w"), F.col("l_suppkey").cast("double").alias("h"))
    return d.groupBy("l_orderkey").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"),
        (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))


@query("A19_punct_median", f"""WITH {LINES}, p AS (SELECT doc_id AS g, CASE WHEN regexp_matches(b, '[.!?;]$') THEN 6 WHEN regexp_matches(b, '[,:]$') THEN 4 ELSE 0 END AS x,
   regexp_matches(b, '[.!?;]$') AS e FROM (SELECT doc_id, regexp_replace(line, '["'')\\]]+$', '') AS b FROM lines WHERE line <> '')),
v AS (SELECT g, x FROM p)
SELECT a.g AS doc_id, a.q::BIGINT AS score, c.e AS sentence_end FROM {q_sql('x', 'n//2')} a JOIN (SELECT g, count(*) FILTER (e) * 2 > count(*) AS e FROM p GROUP BY ALL) c USING (g)""")
def _(t):
    rows = doc_lines(t).filter("line <> ''").select(
        "doc_id", X.punct_score("line", END, MID, QUOTES).cast(L).alias("x"), X.is_sentence_end("line", END, QUOTES).alias("e"))
    med = S.quantiles(rows, ["doc_id"], "x", {"score": S.median_index}).drop("n")
    end = rows.groupBy("doc_id").agg((F.count_if("e") * 2 > F.count(F.lit(1))).alias("sentence_end"))
    return med.join(end, "doc_id")


@query("W8_occurrence_no", """WITH n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)
SELECT p_partkey, k, p_name || CASE WHEN k > 1 THEN '(' || k::VARCHAR || ')' ELSE '' END AS name FROM n""")
def _(t):
    n = Q.occurrence(t.part.select("p_partkey", "p_name"), ["p_name"], ["p_partkey"])
    suffix = F.when(F.col("k") > 1, F.concat(F.lit("("), F.col("k").cast("string"), F.lit(")"))).otherwise("")
    return n.select("p_partkey", "k", F.concat("p_name", suffix).alias("name"))
