"""Votes, aggregates and filters on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import votes as V
from ..operators.keys import doubt_items, is_index_page, is_toc_page, match_any, clip_range, shape_points
from .pitch import L
from .registry import query
from .stats import q_sql
from .text import LINES, doc_lines

K = "json_extract(props, '$.k')::BIGINT"


def with_k(events):
    """Events with the number in their properties."""
    return events.withColumn("k", F.get_json_object("props", "$.k").cast(L)).drop("props")


def ev(t):
    return with_k(t.events)


EV = f"WITH ev AS (SELECT event_id, ts, user_id, event_type, value, {K} AS k FROM events)"


@query("A1_measure_quarters", """WITH e AS (SELECT l_orderkey, l_linenumber AS voice, l_quantity AS d, l_suppkey % 10 = 0 AS grace, l_partkey % 4 = 0 AS tup, (l_partkey % 16)::DOUBLE AS onset FROM lineitem)
SELECT l_orderkey, voice::BIGINT AS voice, round(sum(CASE WHEN tup THEN d*2/3 ELSE d END), 6) AS quarters, max(onset + d) AS extent FROM e WHERE NOT grace GROUP BY ALL""")
def _(t):
    e = t.lineitem.withColumn("voice", F.col("l_linenumber").cast(L))
    dur, grace = F.col("l_quantity"), F.pmod("l_suppkey", F.lit(10)) == 0
    tup = F.pmod("l_partkey", F.lit(4)) == 0
    q = V.measure_quarters(e, ["l_orderkey"], "voice", dur, grace, F.when(tup, 3), F.when(tup, 2))
    x = V.measure_extent(e, ["l_orderkey"], "voice", F.pmod("l_partkey", F.lit(16)).cast("double"), dur, grace)
    return q.join(x, ["l_orderkey", "voice"]).withColumn("quarters", F.round("quarters", 6))


@query("A2_measure_duration", """SELECT l_orderkey, max(d) AS duration FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS d FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def _(t):
    return V.measure_duration(t.lineitem, ["l_orderkey"], "l_linenumber", F.col("l_quantity"))


@query("A3_verse_count", """SELECT conv_id, coalesce(max(CASE WHEN turn % 3 = 0 THEN turn + 2 ELSE turn END), 0) AS verses FROM conversations GROUP BY ALL""")
def _(t):
    rows = t.conversations.withColumn("upto", F.when(F.pmod("turn", F.lit(3)) == 0, F.col("turn") + 2))
    return V.verse_count(rows, ["conv_id"], "turn", "upto")


@query("A10_mode_vote", """WITH v AS (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS first_id FROM events GROUP BY ALL)
SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first_id) AS r FROM v) WHERE r = 1""")
def _(t):
    return V.mode_vote(t.events, ["user_id"], "event_type", {"first": F.min("event_id")})


@query("A11_agree_within", f"""{EV}, d AS (SELECT event_id, (event_id // 700)::VARCHAR || ':' || (user_id % 40)::VARCHAR AS sys, k % 15 - 7 AS fifths, value > 10 AS sure, event_type FROM ev),
kv AS (SELECT sys, fifths, count(*) AS n, sum(sure::INT) AS s, min(event_id) AS f FROM d GROUP BY ALL),
kw AS (SELECT sys, fifths AS agreed, s > 0 AS agreed_sure FROM (SELECT *, row_number() OVER (PARTITION BY sys ORDER BY n DESC, s DESC, abs(fifths) DESC, f) AS r FROM kv) WHERE r = 1),
tv AS (SELECT sys, event_type, count(*) AS n FROM d GROUP BY ALL), tm AS (SELECT sys, max(n) AS m FROM tv GROUP BY ALL),
tw AS (SELECT sys, min(event_type) AS w, any_value(m) AS votes FROM tv JOIN tm USING (sys) WHERE n = m GROUP BY sys HAVING count(*) = 1)
SELECT event_id, agreed AS agreed_key, agreed_sure, coalesce(w, event_type) AS agreed_time, votes FROM d JOIN kw USING (sys) LEFT JOIN tw USING (sys)""")
def _(t):
    d = ev(t).select("event_id", F.concat_ws(":", F.floor(F.col("event_id") / 700).cast("string"), F.pmod("user_id", F.lit(40)).cast("string")).alias("sys"),
                     (F.pmod("k", F.lit(15)) - 7).alias("fifths"), (F.col("value") > 10).alias("sure"), "event_type")
    rows = V.agree_key(d, ["sys"], "fifths", "sure", "event_id").withColumnRenamed("agreed", "agreed_key")
    rows = V.agree_time(rows, ["sys"], "event_type").withColumnRenamed("agreed", "agreed_time")
    return rows.select("event_id", "agreed_key", "agreed_sure", "agreed_time", "votes")


BOOK = """WITH bp AS (SELECT o_custkey % 50 AS book, o_orderkey AS index, CASE WHEN o_orderpriority = '5-LOW' THEN NULL
  WHEN o_orderstatus = 'F' THEN o_orderkey - 3 ELSE o_orderkey - o_custkey % 7 END AS printed, (o_orderpriority = '1-URGENT')::INT AS titles FROM orders)"""


def book_pages(t):
    return t.orders.select(
        F.pmod("o_custkey", F.lit(50)).alias("book"), F.col("o_orderkey").alias("index"),
        F.when(F.col("o_orderpriority") == "5-LOW", None).when(F.col("o_orderstatus") == "F", F.col("o_orderkey") - 3)
        .otherwise(F.col("o_orderkey") - F.pmod("o_custkey", F.lit(7))).alias("printed"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("titles"))


@query("A12_region_offset", f"""{BOOK}, v AS (SELECT book, index - printed AS o, count(*) AS n, min(index) AS f FROM bp WHERE printed IS NOT NULL GROUP BY ALL),
w AS (SELECT book, o FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, f) AS r FROM v) WHERE r = 1 AND n >= 3),
s AS (SELECT bp.book, min(index) AS lo, max(index) AS hi, any_value(o) AS o FROM bp JOIN w ON bp.book = w.book AND index - printed = o GROUP BY ALL),
b AS (SELECT book, coalesce(min(index) FILTER (titles > 0), 0) AS f, max(index) AS l FROM bp GROUP BY ALL)
SELECT b.book, coalesce(lo, f) AS "first", coalesce(hi, l) AS "last", o AS "offset" FROM b LEFT JOIN s USING (book)""")
def _(t):
    return V.region_offset(book_pages(t), "book", "index", "printed", "titles")


@query("A13_toc_vote", """WITH e AS (SELECT o_custkey % 60 AS book, o_orderkey % 40 AS number, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_orderpriority = '5-LOW' THEN NULL
   ELSE o_orderkey % 40 * 2 + length(o_orderpriority) % 4 END AS page FROM orders),
p AS (SELECT book, bool_or(page IS NOT NULL) AS paged FROM e GROUP BY ALL),
v AS (SELECT book, number, page, count(*) AS votes FROM e JOIN p USING (book) WHERE number >= 1 AND (NOT paged OR (page >= 1 AND page <= 70)) GROUP BY ALL)
SELECT book, number, page, votes FROM (SELECT *, row_number() OVER (PARTITION BY book, number ORDER BY votes DESC, page) AS r FROM v) WHERE r = 1""")
def _(t):
    number = F.pmod("o_orderkey", F.lit(40))
    page = F.when((F.pmod("o_custkey", F.lit(3)) != 0) & (F.col("o_orderpriority") != "5-LOW"), number * 2 + F.pmod(F.length("o_orderpriority"), F.lit(4)))
    e = t.orders.select(F.pmod("o_custkey", F.lit(60)).alias("book"), number.alias("number"), page.alias("page"), F.lit(70).alias("last"))
    return V.toc_vote(e, "book", "number", "page", "last")


@query("A14_dict_build", """SELECT md5(text) AS key, count(*) AS cnt, min(doc_id) AS doc_id, min_by(n_chars, doc_id) AS n_chars FROM documents GROUP BY ALL""")
def _(t):
    return V.dict_build(t.texts.select(F.md5("text").alias("key"), "doc_id", "n_chars"), "key", "doc_id", "n_chars")


@query("A15_shape_key", """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT vec_id, list_transform(range(32), lambda i: e[2*i+1]) AS xs, list_transform(range(32), lambda i: e[2*i+2]) AS ys FROM p),
b AS (SELECT *, list_min(xs) AS x0, list_min(ys) AS y0, CASE WHEN list_max(ys) > list_min(ys) THEN list_max(ys) - list_min(ys) ELSE 1 END AS h FROM s)
SELECT vec_id, md5(array_to_string(list_transform(range(32), lambda i: floor((xs[i+1]-x0)*50/h+0.5)::BIGINT::VARCHAR || ',' || floor((ys[i+1]-y0)*50/h+0.5)::BIGINT::VARCHAR), ',')) AS key FROM b""")
def _(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("p"))
    return e.select("vec_id", F.md5(shape_points("p")).alias("key"))


@query("A16_page_stats", """SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
 count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view,
 round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def _(t):
    kinds = ["click", "error", "purchase", "signup", "view"]
    counts = [F.count_if(F.col("event_type") == k).alias(k) for k in kinds]
    return t.events.groupBy("user_id").agg(*counts, F.round(F.sum("value"), 4).alias("total"))


@query("A17_clef_by_register", f"""{EV} SELECT user_id, event_type, CASE WHEN avg(k) < 55 THEN 'F' ELSE 'G' END AS clef FROM ev GROUP BY ALL""")
def _(t):
    return ev(t).groupBy("user_id", "event_type").agg(F.when(F.avg("k") < 55, "F").otherwise("G").alias("clef"))


FEATURES = {"large": "p_size > 40", "small": "p_size < 5", "cheap": "p_retailprice < 950", "metal": "p_type LIKE '%STEEL%' OR p_type LIKE '%E%'",
            "ring": "p_name LIKE '%ring%'", "never": "p_size > 1000"}


@query("A18_features_used", "WITH f AS (" + " UNION ALL ".join(f"SELECT p_brand, '{k}' AS feature FROM part WHERE {c}" for k, c in FEATURES.items())
       + ") SELECT DISTINCT p_brand, feature FROM f")
def _(t):
    return V.features_used(t.part, "p_brand", {k: F.expr(c) for k, c in FEATURES.items()})


@query("A20_cells_target", """WITH m AS (SELECT l_orderkey, l_linenumber, sum(1 + greatest(0, floor(l_quantity/12) - 1)*0.7) AS c FROM lineitem GROUP BY ALL),
a AS (SELECT l_orderkey, greatest(0.5, round(sum(c)/count(*), 9)) AS a FROM m GROUP BY ALL)
SELECT l_orderkey, greatest(3, least(12, floor(24.0/a + 0.5)))::BIGINT AS target FROM a""")
def _(t):
    return V.cells_target(t.lineitem, ["l_orderkey"], "l_linenumber", F.col("l_quantity") / 12, 24)


WORDS_SQL = "unnest(regexp_extract_all(lower(text), '[a-z]+'))"


@query("A21_match_f1", f"""WITH k AS (SELECT count(*) AS n FROM benchmark), d AS (SELECT doc_id, doc_id % n AS item_id, text FROM documents, k),
a AS (SELECT doc_id, item_id, tok, count(*) AS a FROM (SELECT doc_id, item_id, {WORDS_SQL} AS tok FROM d) GROUP BY ALL),
b AS (SELECT item_id, tok, count(*) AS b FROM (SELECT item_id, {WORDS_SQL} AS tok FROM benchmark) GROUP BY ALL),
m AS (SELECT doc_id, sum(a) AS la, sum(least(a, coalesce(b, 0))) AS mt FROM a LEFT JOIN b USING (item_id, tok) GROUP BY ALL),
s AS (SELECT item_id, sum(b) AS lb FROM b GROUP BY ALL),
x AS (SELECT d.doc_id, d.item_id, coalesce(la, 0) AS la, coalesce(lb, 0) AS lb, coalesce(mt, 0) AS mt FROM d LEFT JOIN m USING (doc_id) LEFT JOIN s ON s.item_id = d.item_id)
SELECT doc_id, item_id, la::BIGINT AS len_a, lb::BIGINT AS len_b, mt::BIGINT AS matched, CASE WHEN la + lb > 0 THEN round(2*mt/(la+lb), 6) ELSE 0 END::DOUBLE AS f1, mt > 0 AND 2*mt/(la+lb) >= 0.5 AS is_match FROM x""")
def _(t):
    words = lambda c: F.explode_outer(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1)).alias("token")
    n = t.benchmark.agg(F.count(F.lit(1))).scalar()
    d = t.texts.withColumn("item_id", F.pmod("doc_id", n)).select("doc_id", "item_id", words("text"))
    m = V.match_f1(d, t.benchmark.select("item_id", words("text")), "doc_id", "item_id", "token")
    return m.withColumn("f1", F.round("f1", 6))


@query("A26_slot_profile", f"""{EV}, v AS (SELECT user_id AS g, k FROM ev), c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM ev GROUP BY ALL),
w AS (SELECT user_id, event_type AS clef FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1)
SELECT user_id, clef, count(*) FILTER (k > 50)*2 > count(*) AS brace, count(*) FILTER (k >= 50)*2 >= count(*) AS lyric, any_value(q.q) AS pitch
FROM ev JOIN w USING (user_id) JOIN {q_sql('k', 'n//2')} q ON q.g = user_id GROUP BY user_id, clef""")
def _(t):
    return V.slot_profile(ev(t), ["user_id"], "event_type", "event_id", F.col("k") > 50, F.col("k") >= 50, "k")


@query("A27_melody_lane", """WITH e AS (SELECT *, l_suppkey % 3 AS staff, l_partkey % 4 AS voice FROM lineitem),
m AS (SELECT l_orderkey, min(staff*10+voice) AS lane FROM e GROUP BY ALL)
SELECT l_orderkey, staff, voice, count(*) AS n, sum(l_quantity) AS qty FROM e JOIN m USING (l_orderkey) WHERE staff*10+voice = lane GROUP BY ALL""")
def _(t):
    e = t.lineitem.withColumn("staff", F.pmod("l_suppkey", F.lit(3))).withColumn("voice", F.pmod("l_partkey", F.lit(4)))
    e = e.select("l_orderkey", "staff", "voice", "l_quantity")
    return V.melody_lane(e, ["l_orderkey"], "staff", "voice").groupBy("l_orderkey", "staff", "voice").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


@query("A28_top_note", f"""SELECT l_orderkey, l_quantity, l_returnflag, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
 ORDER BY (l_returnflag = 'R')::INT, l_quantity DESC, {', '.join(ORDER)}) AS r FROM lineitem) WHERE r = 1""")
def _(t):
    return V.top_note(t.lineitem, ["l_orderkey"], F.col("l_returnflag") == "R", F.col("l_quantity"), ORDER, "l_quantity", "l_returnflag", "l_partkey")


@query("A29_staff_rows", """WITH y AS (SELECT l_suppkey, floor(l_extendedprice/500 + 0.5) AS y, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
r AS (SELECT l_suppkey, count(*) AS rows_, max(n) AS mx FROM y GROUP BY ALL) SELECT sum(rows_)::BIGINT AS staff_rows, max(mx) AS max_row_cells FROM r""")
def _(t):
    items = t.lineitem.filter("l_returnflag <> 'R'")
    y = F.col("l_extendedprice") / 500
    return V.staff_rows(items, "l_suppkey", y)


@query("F1_match_any", """SELECT o_orderpriority, count(*) AS n FROM orders WHERE contains(o_orderpriority, 'URG') OR contains(o_orderpriority, 'LOW') GROUP BY ALL""")
def _(t):
    return t.orders.filter(match_any("o_orderpriority", "URG|LOW")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("F2_clip_range", f"""{EV} SELECT event_id, k FROM ev WHERE k >= 20 AND k < (CASE WHEN event_type = 'view' THEN 60 ELSE 90 END)""")
def _(t):
    return clip_range(ev(t), F.col("k"), F.lit(20), F.when(F.col("event_type") == "view", 60).otherwise(90)).select("event_id", "k")


@query("F4_toc_pages", f"""WITH {LINES}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '^[A-Z].*[.!?]$')) AS toc,
  count(*) FILTER (regexp_matches(line, '[.!?]$') AND NOT regexp_matches(line, '^[A-Z].*[.!?]$')) AS idx FROM lines GROUP BY ALL)
SELECT doc_id, n >= 8 AND toc >= n*0.5 AS is_toc, n >= 10 AND idx >= n*0.6 AS is_index FROM c""")
def _(t):
    entry, tail = r"^[A-Z].*[.!?]$", "[.!?]$"
    return doc_lines(t).groupBy("doc_id").agg(
        is_toc_page(F.col("line"), entry).alias("is_toc"), is_index_page(F.col("line"), entry, tail).alias("is_index"))


@query("F6_doubt_items", f"""{EV}, v AS (SELECT event_id, k, event_type, unnest([k % 5, k % 7]) AS verse FROM ev WHERE event_type <> 'purchase'),
fx AS (SELECT DISTINCT event_id, k % 5 AS verse FROM ev WHERE event_type = 'click')
SELECT event_id, NULL::BIGINT AS verse FROM ev WHERE event_type <> 'purchase' AND value > 15 UNION ALL
SELECT DISTINCT event_id, verse FROM v WHERE verse <> 0 AND (event_id, verse) NOT IN (SELECT event_id, verse FROM fx)""")
def _(t):
    e = ev(t)
    verses = F.array_distinct(F.array(F.pmod("k", F.lit(5)), F.pmod("k", F.lit(7))))
    items = e.select("event_id", (F.col("event_type") == "purchase").alias("edited"), (F.col("value") > 15).alias("doubt"),
                     F.filter(verses, lambda v: v != 0).alias("verses"))
    fixed = e.filter("event_type = 'click'").select("event_id", F.pmod("k", F.lit(5)).alias("verse"))
    return doubt_items(items, fixed, "event_id")
