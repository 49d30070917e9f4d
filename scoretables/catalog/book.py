"""Book plans: contents lists, titles and lyric lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import votes as V
from ..plans import book as B
from .pitch import L
from .registry import query

VOTES = """e AS (SELECT o_custkey % 60 AS book, o_orderkey % 40 AS number, o_orderkey % 40 * 2 + (o_custkey * 7) % 11 AS page FROM orders),
v AS (SELECT book, number, page, count(*) AS votes FROM e WHERE number >= 1 AND page >= 1 GROUP BY ALL),
c AS (SELECT book, number, page FROM (SELECT *, row_number() OVER (PARTITION BY book, number ORDER BY votes DESC, page) AS r FROM v) WHERE r = 1)"""


def contents(t):
    number = F.pmod("o_orderkey", F.lit(40))
    e = t.orders.select(F.pmod("o_custkey", F.lit(60)).alias("book"), number.alias("number"), (number * 2 + F.pmod(F.col("o_custkey") * 7, F.lit(11))).alias("page"))
    return V.toc_vote(e, "book", "number", "page").select("book", "number", "page")


@query("W29_monotone_keep", f"""WITH RECURSIVE {VOTES}, a AS (SELECT book, list(page ORDER BY number) AS xs FROM c GROUP BY ALL),
f AS (SELECT book, xs, 1 AS i, [1] AS lens FROM a UNION ALL SELECT book, xs, i + 1, list_append(lens, 1 + coalesce(list_max(list_transform(range(1, i + 1), lambda j: CASE WHEN xs[j] <= xs[i + 1] THEN lens[j] ELSE 0 END)), 0)::INT) FROM f WHERE i < len(xs))
SELECT book, list_max(lens)::BIGINT AS kept, len(xs)::BIGINT AS entries, true AS rising FROM f WHERE i = len(xs)""")
def _(t):
    m = B.monotone_keep(contents(t), "book", "number", "page")
    kept = F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("number", "page"))))  # at most 39 numbers a book
    g = m.groupBy("book").agg(F.count_if("keep").alias("kept"), F.count(F.lit(1)).alias("entries"), kept.alias("k"))
    pages = F.transform("k", lambda x: x["page"])
    return g.select("book", "kept", "entries", (F.array_sort(pages) == pages).alias("rising"))


TITLES = """tt AS (SELECT book, page, k, (arg_min({'r': rd}, o_orderkey)).r AS rd FROM (SELECT o_custkey % 300 AS book, o_orderkey % 25 AS page, o_orderkey // 25 % 2 AS k, o_orderkey,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderkey % 25 * 2 + o_orderkey // 25 % 2 + o_custkey % 3 ELSE NULL END AS rd FROM orders) GROUP BY ALL)"""


@query("W30_number_titles", f"""WITH RECURSIVE {TITLES}, ord AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page, k) AS r, row_number() OVER (PARTITION BY book, page ORDER BY k) AS pr, count(*) OVER (PARTITION BY book, page) AS pc FROM tt),
toc AS (SELECT b AS book, n AS number, n // 2 + (n * b) % 2 AS pg FROM (SELECT DISTINCT book AS b FROM tt), range(1, 50, 1) z(n) WHERE (n + b) % 4 > 0),
ex AS (SELECT book, pg, list(number ORDER BY number) AS ns FROM toc GROUP BY ALL),
j AS (SELECT ord.*, coalesce(ex.ns, []) AS ns, t2.pg AS tp FROM ord LEFT JOIN ex ON ex.book = ord.book AND ex.pg = ord.page LEFT JOIN toc t2 ON t2.book = ord.book AND t2.number = ord.rd),
f AS (SELECT book, 0::BIGINT AS r, 0::BIGINT AS prev, []::BIGINT[] AS lft, NULL::BIGINT AS page, NULL::BIGINT AS k, NULL::VARCHAR AS how FROM (SELECT DISTINCT book FROM tt) UNION ALL
 SELECT book, r, n, list_filter(l, lambda x: x <> n), page, k, how FROM (SELECT s.*, CASE how WHEN 'read' THEN rd WHEN 'place' THEN ns[pr] WHEN 'free' THEN list_min(list_filter(l, lambda x: x > prev)) ELSE prev + 1 END AS n FROM (
  SELECT q.*, CASE WHEN rd IS NOT NULL AND (list_contains(l, rd) OR (rd > prev AND rd <= prev + 6 AND (tp IS NULL OR abs(tp - page) <= 1))) THEN 'read' WHEN len(ns) = pc AND ns[pr] > prev THEN 'place'
   WHEN len(list_filter(l, lambda x: x > prev)) > 0 THEN 'free' ELSE 'next' END AS how FROM (
   SELECT j.book, j.r, j.page, j.k, j.rd, j.ns, j.pr, j.pc, j.tp, f.prev, CASE WHEN j.pr = 1 THEN j.ns ELSE f.lft END AS l FROM f JOIN j ON j.book = f.book AND j.r = f.r + 1) q) s))
SELECT book, page, k, prev AS number, CASE how WHEN 'place' THEN 'listed' WHEN 'free' THEN 'listed' ELSE how END AS how FROM f WHERE r > 0""")
def _(t):
    k = F.pmod(F.floor(F.col("o_orderkey") / 25), F.lit(2))
    read = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.pmod("o_orderkey", F.lit(25)) * 2 + k + F.pmod("o_custkey", F.lit(3)))
    rows = t.orders.select(F.pmod("o_custkey", F.lit(300)).alias("book"), F.pmod("o_orderkey", F.lit(25)).alias("page"), k.alias("k"), "o_orderkey", read.alias("rd"))
    titles = rows.groupBy("book", "page", "k").agg(F.min_by("rd", "o_orderkey").alias("read"))  # at most 50 titles a book
    books = titles.select("book").distinct()
    n = F.col("number")
    toc = books.select("book", F.explode(F.sequence(F.lit(1).cast(L), F.lit(49).cast(L))).alias("number")).filter((n + F.col("book")) % 4 > 0)
    toc = toc.withColumn("at", F.floor(n / 2) + (n * F.col("book")) % 2)
    return B.number_titles(titles, books.withColumn("offset", F.lit(0)), toc, "book")


@query("W31_order_align", """WITH RECURSIVE e AS (SELECT vec_id, list_sort(list_transform(embedding[1:20 + vec_id % 25], lambda x: x::DOUBLE)) AS sx, list_sort(list_transform(embedding[21 + vec_id % 25:], lambda x: x::DOUBLE)) AS nx FROM embeddings),
f AS (SELECT vec_id, sx, nx, 0 AS k, 0 AS nxt, NULL::INT AS j FROM e UNION ALL SELECT vec_id, sx, nx, k + 1, CASE WHEN nxt >= len(nx) THEN nxt ELSE jj + 1 END, CASE WHEN nxt >= len(nx) THEN len(nx) - 1 ELSE jj END FROM (
 SELECT *, list_position(list_transform(nx, lambda v, i: CASE WHEN i - 1 >= nxt AND i - 1 < greatest(nxt + 1, len(nx) - (len(sx) - k - 1)) THEN abs(v - sx[k + 1]) END),
   list_min(list_transform(nx, lambda v, i: CASE WHEN i - 1 >= nxt AND i - 1 < greatest(nxt + 1, len(nx) - (len(sx) - k - 1)) THEN abs(v - sx[k + 1]) END)))::INT - 1 AS jj FROM f WHERE k < len(sx)))
SELECT vec_id, k::BIGINT AS syllable, j::BIGINT AS note FROM f WHERE k > 0""")
def _(t):
    d = F.col("embedding").cast("array<double>")
    cut = (F.pmod("vec_id", F.lit(25)) + 20).cast("int")  # the values before it are syllables, the others notes
    e = t.embeddings.select("vec_id", F.array_sort(F.slice(d, F.lit(1), cut)).alias("sx"), F.array_sort(F.slice(d, cut + 1, F.size(d))).alias("nx"))
    r = e.select("vec_id", F.posexplode(B.order_align(F.col("sx"), F.col("nx"))).alias("k", "note"))
    return r.select("vec_id", (F.col("k") + 1).cast(L).alias("syllable"), F.col("note").cast(L).alias("note"))
