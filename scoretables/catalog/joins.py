"""Joins, reconciliation and run comparison on the bound tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import sequence as Q
from ..operators import shapes as H
from ..operators.stats import numbered
from ..plans import regress as R
from ..session import shared_folder
from ..sources.store import Store
from .pitch import L
from .registry import query
from .text import doc_lines, LINES
from .votes import EV, FEATURES, ORDER, ev

LI_ORDER = ", ".join(ORDER)
LI_RN = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {LI_ORDER})"


def li_elements(t):
    """Line items as elements: id = order * 100 + place, pos = place."""
    e = numbered(t.lineitem, ["l_orderkey"], ORDER, "pos")
    return e.withColumn("element_id", F.col("l_orderkey") * 100 + F.col("pos"))


ELEMENTS = f"el AS (SELECT *, l_orderkey*100 + pos AS element_id FROM (SELECT *, {LI_RN} AS pos FROM lineitem))"


@query("J1_resolve_marks", f"""WITH {ELEMENTS}, mk AS (SELECT o_orderkey, o_orderkey*100 + 1 AS s, o_orderkey*100 + 1 + o_custkey % 4 AS e FROM orders)
SELECT o_orderkey, s AS start_id, e AS end_id, a.l_linenumber::BIGINT AS from_pos, b.l_linenumber::BIGINT AS to_pos FROM mk JOIN el a ON a.element_id = s JOIN el b ON b.element_id = e""")
def _(t):
    marks = t.orders.select("o_orderkey", (F.col("o_orderkey") * 100 + 1).alias("start_id"),
                            (F.col("o_orderkey") * 100 + 1 + F.pmod("o_custkey", F.lit(4))).alias("end_id"))
    e = li_elements(t).select(F.col("l_orderkey").alias("o_orderkey"), "element_id", F.col("l_linenumber").cast(L).alias("at"))
    return J.resolve_marks(marks, e, ["o_orderkey"], "start_id", "end_id", "element_id", "at").select("o_orderkey", "start_id", "end_id", "from_pos", "to_pos")


@query("J2_exact_then_fuzzy", """WITH d AS (SELECT vec_id, list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i+1] > 0 THEN 1::BIGINT << i::BIGINT ELSE 0 END))::BIGINT AS lo,
  list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i+33] > 0 THEN 1::BIGINT << i::BIGINT ELSE 0 END))::BIGINT AS hi FROM embeddings),
f AS (SELECT vec_id, list_transform(range(vec_id % 6), lambda j: (vec_id*7 + 13*j) % 64) AS fl FROM embeddings),
m AS (SELECT vec_id, coalesce(list_sum(list_transform(list_filter(fl, lambda b: b < 32), lambda b: 1::BIGINT << b::BIGINT)), 0)::BIGINT AS ml,
  coalesce(list_sum(list_transform(list_filter(fl, lambda b: b >= 32), lambda b: 1::BIGINT << (b - 32)::BIGINT)), 0)::BIGINT AS mh FROM f),
o AS (SELECT vec_id, xor(lo, ml) AS lo, xor(hi, mh) AS hi FROM d JOIN m USING (vec_id)),
p AS (SELECT o.vec_id, d.vec_id AS label, bit_count(xor(o.lo, d.lo)) + bit_count(xor(o.hi, d.hi)) AS dist FROM o, d)
SELECT vec_id, label, dist::BIGINT AS dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) AS r FROM p WHERE dist <= 3) WHERE r = 1""")
def _(t):
    def word(bits):
        return F.aggregate(bits, F.lit(0).cast(L), lambda a, b: a.bitwiseXOR(b))

    def power(i):
        return F.when(i == 63, F.lit(-(2**63))).otherwise(F.pow(F.lit(2.0), i).cast(L))

    signs = F.transform("embedding", lambda x, i: F.when(x > 0, power(i)).otherwise(F.lit(0).cast(L)))
    k = F.pmod("vec_id", F.lit(6)).cast("int")
    flips = F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda j: j < k), lambda j: power(F.pmod(F.col("vec_id") * 7 + j * 13, F.lit(64)).cast("int")))
    sig = F.array(word(signs))
    d = t.embeddings.select(F.col("vec_id").alias("label"), sig.alias("sig"))
    o = t.embeddings.select("vec_id", F.array(word(signs).bitwiseXOR(word(flips))).alias("sig"))
    key = F.xxhash64("sig")
    out = H.exact_then_fuzzy(o.withColumn("key", key), d.withColumn("key", key), "vec_id", "key", "sig", "label", 3, 16)
    return out.select("vec_id", "label", F.col("dist").cast(L).alias("dist"))


@query("J3_asof_attr", f"""{EV}, r AS (SELECT user_id, event_id, event_id AS pos FROM ev WHERE event_type = 'click'), c AS (SELECT user_id, event_id, event_id + k % 30 AS at, k FROM ev WHERE event_type = 'view')
SELECT r.event_id, coalesce(arg_max(c.k, c.at*100000 + c.event_id), 4) AS beats FROM r LEFT JOIN c ON r.user_id = c.user_id AND c.at <= r.pos + 20 GROUP BY r.event_id""")
def _(t):
    e = ev(t)
    rows = e.filter("event_type = 'click'").select("user_id", "event_id", F.col("event_id").alias("pos"))
    ch = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("cid"), (F.col("event_id") + F.pmod("k", F.lit(30))).alias("at"), F.col("k").alias("beats"))
    return J.asof_attr(rows, ch, ["user_id"], "pos", "event_id", "at", "cid", {"beats": 4}, 20).select("event_id", "beats")


@query("J4_prev_next_neighbor", f"""{EV} SELECT h.event_id, max(e.k) FILTER (e.k < h.k) AS above, min(e.k) FILTER (e.k > h.k) AS below
FROM ev h LEFT JOIN ev e ON h.user_id = e.user_id AND e.event_type = 'click' WHERE h.event_type = 'purchase' GROUP BY h.event_id""")
def _(t):
    e = ev(t)
    heads = e.filter("event_type = 'purchase'").select("user_id", "event_id", "k")
    return J.prev_next_neighbor(heads, e.filter("event_type = 'click'"), ["user_id"], "k").select("event_id", "above", "below")


BARS = "br AS (SELECT o_orderkey, unnest(range(0, 60, (4 + o_custkey % 5)::BIGINT)) AS b0, 4 + o_custkey % 5 AS len FROM orders)"


@query("J5_overlap_join", f"""WITH {BARS}, n AS (SELECT l_orderkey, l_quantity AS t0, l_quantity + l_linenumber AS t1 FROM lineitem)
SELECT l_orderkey, b0, count(*) AS notes, sum(least(t1, b0 + len) - greatest(t0, b0))::DOUBLE AS len FROM n JOIN br ON l_orderkey = o_orderkey AND t1 > b0 AND t0 < b0 + len GROUP BY ALL""")
def _(t):
    length = 4 + F.pmod("o_custkey", F.lit(5))
    bars = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(0).cast(L), F.lit(59).cast(L), length)).alias("b0"), length.alias("len"))
    bars = bars.select("l_orderkey", "b0", (F.col("b0") + F.col("len")).alias("b1"))
    notes = t.lineitem.select("l_orderkey", F.col("l_quantity").alias("t0"), (F.col("l_quantity") + F.col("l_linenumber")).alias("t1"))
    m = J.overlap_join(notes, bars, ["l_orderkey"], ("t0", "t1"), ("b0", "b1"), 8)
    return m.groupBy("l_orderkey", "b0").agg(F.count(F.lit(1)).alias("notes"), F.sum(F.col("to_") - F.col("from_")).cast("double").alias("len"))


@query("J6_point_in_range", """WITH s AS (SELECT conv_id, turn, turn AS lo, CASE WHEN length(text) % 3 > 0 THEN turn + length(text) % 3 END AS hi, role = 'system' AS ref FROM conversations),
p AS (SELECT DISTINCT conv_id, v FROM conversations, range(1, 11) r(v))
SELECT conv_id, v, turn FROM (SELECT p.conv_id, v, turn, row_number() OVER (PARTITION BY p.conv_id, v ORDER BY turn) AS r FROM p JOIN s ON p.conv_id = s.conv_id
  AND (ref OR v BETWEEN lo AND coalesce(hi, lo))) WHERE r = 1""")
def _(t):
    n = F.pmod(F.length("text"), F.lit(3))
    spans = t.conversations.select("conv_id", "turn", F.col("turn").alias("lo"), F.when(n > 0, F.col("turn") + n).alias("hi"), "role")
    points = t.conversations.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(1).cast(L), F.lit(10).cast(L))).alias("v"))
    return J.point_in_range(points, spans, ["conv_id"], "v", "lo", "hi", F.col("role") == "system", "turn")


RECTS = f"""rc AS (SELECT l_orderkey*100 + {LI_RN} AS id, l_suppkey AS page, l_returnflag AS kind, l_quantity*8 AS x, (l_partkey % 800)::DOUBLE AS y, l_linenumber::DOUBLE AS w, 1.0 AS h FROM lineitem)"""


def li_rects(t):
    return li_elements(t).select(
        F.col("element_id").alias("id"), F.col("l_suppkey").alias("page"), F.col("l_returnflag").alias("kind"), (F.col("l_quantity") * 8).alias("x"),
        F.pmod("l_partkey", F.lit(800)).cast("double").alias("y"), F.col("l_linenumber").cast("double").alias("w"), F.lit(1.0).alias("h"))


@query("J7_containment_join", f"""WITH {RECTS}, f AS (SELECT id AS fid, page, x AS fx, y AS fy, 60.0 AS fw, 40.0 AS fh FROM rc WHERE kind = 'R')
SELECT fid, count(*) AS lines, min(id) AS first_line FROM f JOIN rc USING (page) WHERE kind <> 'R' AND x >= fx - 1 AND y >= fy - 1 AND x + w <= fx + fw + 1 AND y + h <= fy + fh + 1 GROUP BY ALL""")
def _(t):
    r = li_rects(t)
    f = r.filter("kind = 'R'").select("page", F.col("id").alias("fid"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.lit(60.0).alias("fw"), F.lit(40.0).alias("fh"))
    m = J.containment_join(f, r.filter("kind <> 'R'"), ["page"], ["fx", "fy", "fw", "fh"], ["x", "y", "w", "h"], 1.0, 40.0)
    return m.groupBy("fid").agg(F.count(F.lit(1)).alias("lines"), F.min("id").alias("first_line"))


@query("J8_near_pairs", f"""WITH {RECTS} SELECT page, count(*) AS near FROM rc a WHERE EXISTS (SELECT 1 FROM rc b WHERE a.page = b.page AND a.id <> b.id
 AND a.x - 4 <= b.x + b.w AND b.x - 4 <= a.x + a.w AND a.y - 4 <= b.y + b.h AND b.y - 4 <= a.y + a.h) GROUP BY ALL""")
def _(t):
    links = H.near_links(li_rects(t), ["page"], "id", "x", "y", "w", "h", 4.0)
    ends = links.select("page", F.explode(F.array("a", "b")).alias("id")).distinct()
    return ends.groupBy("page").agg(F.count(F.lit(1)).alias("near"))


@query("X11_connected_frames", f"""WITH RECURSIVE {RECTS}, pr AS (SELECT a.id AS a, b.id AS b FROM rc a JOIN rc b ON a.page = b.page AND a.id <> b.id
 AND a.x - 4 <= b.x + b.w AND b.x - 4 <= a.x + a.w AND a.y - 4 <= b.y + b.h AND b.y - 4 <= a.y + a.h),
re AS (SELECT DISTINCT a AS id, a AS r FROM pr UNION SELECT pr.b, re.r FROM re JOIN pr ON pr.a = re.id), cp AS (SELECT id, min(r) AS root FROM re GROUP BY ALL)
SELECT page, root, count(*) AS n, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM rc JOIN cp USING (id) GROUP BY page, root
HAVING count(*) >= 3 AND max(x + w) - min(x) >= 6 AND max(y + h) - min(y) >= 3""")
def _(t):
    return H.connected_frames(li_rects(t), ["page"], "id", ["x", "y", "w", "h"], 4.0, 3, 6.0, 3.0)


FOUND = "SELECT o_custkey % 50 AS book, o_orderkey % 400 AS number, o_custkey % 90 AS page FROM orders WHERE o_orderstatus <> 'F'"
TOC = "SELECT o_custkey % 50 AS book, o_orderkey % 390 AS number, o_custkey % 90 AS page FROM orders WHERE o_orderstatus = 'F'"


@query("J9_toc_reconcile", f"""WITH f AS ({FOUND}), t AS ({TOC}), w AS (SELECT book, number, min(page) AS want FROM t GROUP BY ALL),
tp AS (SELECT book, max(number) AS top FROM t GROUP BY ALL), h AS (SELECT book, number, count(*) AS n FROM f GROUP BY ALL), a AS (SELECT book, unnest(range(1, top + 1)) AS number FROM tp)
SELECT a.book, 'missing' AS kind, a.number, w.want AS want_page, NULL::BIGINT AS page FROM a LEFT JOIN h USING (book, number) LEFT JOIN w USING (book, number) WHERE h.n IS NULL
UNION ALL SELECT h.book, 'extra', h.number, NULL, NULL FROM h JOIN tp USING (book) LEFT JOIN w USING (book, number) WHERE w.want IS NULL
UNION ALL SELECT book, 'duplicate', number, NULL, NULL FROM h WHERE n > 1
UNION ALL SELECT f.book, 'page', f.number, want, f.page FROM f JOIN w USING (book, number) WHERE want <> f.page""")
def _(t):
    book, page = F.pmod("o_custkey", F.lit(50)).alias("book"), F.pmod("o_custkey", F.lit(90)).alias("page")
    found = t.orders.filter("o_orderstatus <> 'F'").select(book, F.pmod("o_orderkey", F.lit(400)).alias("number"), page)
    toc = t.orders.filter("o_orderstatus = 'F'").select(book, F.pmod("o_orderkey", F.lit(390)).alias("number"), page)
    return J.toc_reconcile(found, toc, "book", "number", "page")


@query("J10_align_axis", """WITH r AS (SELECT l_orderkey, l_linenumber::BIGINT AS slot, l_returnflag AS part, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL)
SELECT s.l_orderkey, s.slot, p.part, r.qty FROM (SELECT DISTINCT l_orderkey, slot FROM r) s JOIN (SELECT DISTINCT l_orderkey, part FROM r) p USING (l_orderkey)
LEFT JOIN r ON r.l_orderkey = s.l_orderkey AND r.slot = s.slot AND r.part = p.part""")
def _(t):
    r = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").cast(L).alias("slot"), F.col("l_returnflag").alias("part")).agg(F.sum("l_quantity").alias("qty"))
    return J.align_axis(r, ["l_orderkey"], "part", "slot", "qty")


USED = "u AS (" + " UNION ".join(f"SELECT p_brand AS target, '{k}' AS feature FROM part WHERE {c}" for k, c in FEATURES.items()) + ")"


@query("J11_capability_loss", f"""WITH {USED}, c AS (SELECT DISTINCT p_brand AS target, CASE WHEN p_size % 2 = 0 THEN 'large' WHEN p_size % 3 = 0 THEN 'ring' ELSE 'cheap' END AS feature FROM part)
SELECT u.target, u.feature FROM u LEFT JOIN c USING (target, feature) WHERE c.target IS NULL""")
def _(t):
    used, caps = used_and_caps(t)
    return J.capability_loss(used, caps, "target", "feature")


def used_and_caps(t):
    from ..operators.votes import features_used

    used = features_used(t.part, "p_brand", {k: F.expr(c) for k, c in FEATURES.items()}).withColumnRenamed("p_brand", "target")
    caps = t.part.select(F.col("p_brand").alias("target"), F.when(F.pmod("p_size", F.lit(2)) == 0, "large").when(
        F.pmod("p_size", F.lit(3)) == 0, "ring").otherwise("cheap").alias("feature")).distinct()
    return used, caps


@query("X8_feature_difference", f"""WITH {USED}, c AS (SELECT DISTINCT p_brand AS target, CASE WHEN p_size % 2 = 0 THEN 'large' WHEN p_size % 3 = 0 THEN 'ring' ELSE 'cheap' END AS feature FROM part)
SELECT target, feature FROM u EXCEPT SELECT target, feature FROM c""")
def _(t):
    used, caps = used_and_caps(t)
    return used.select("target", "feature").subtract(caps.select("target", "feature"))


RULES = [(1, "t", None, None, "h", None, "T"), (2, "e", None, "h", None, None, "E"), (3, "e", None, None, None, True, "#"), (4, "s", "i", None, None, None, "S"),
         (5, ".", None, None, None, True, "!"), (6, "e", None, None, "r", None, "3"), (7, "t", None, None, None, None, "7")]
RULES_SQL = ",".join("(" + ",".join("NULL" if v is None else str(v) if not isinstance(v, str) else f"'{v}'" for v in r) + ")" for r in RULES)


@query("J12_rule_fix", f"""WITH {LINES}, c AS (SELECT doc_id, line_no, unnest(string_split(line, '')) AS ch, unnest(range(length(line))) AS pos, length(line) AS n FROM lines WHERE line <> ''),
x AS (SELECT *, lag(ch, 2) OVER w AS p2, lag(ch) OVER w AS p1, lead(ch) OVER w AS nx, pos = n - 1 AS e FROM c WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos)),
r AS (SELECT * FROM (VALUES {RULES_SQL}) v(no, ch, prev2, prev, next, at_end, fixed)),
m AS (SELECT doc_id, x.ch, arg_min(fixed, no) AS fixed FROM x JOIN r ON x.ch = r.ch AND (prev2 IS NULL OR prev2 = p2) AND (prev IS NULL OR prev = p1) AND (next IS NULL OR next = nx) AND (at_end IS NULL OR at_end = e)
  GROUP BY doc_id, line_no, pos, x.ch)
SELECT doc_id, ch, fixed, count(*) AS n FROM m GROUP BY ALL""")
def _(t):
    rules = t.spark.createDataFrame(RULES, "rule_no int, ch string, prev2 string, prev string, next string, at_end boolean, fixed string")
    fixed = J.rule_fix(doc_lines(t), "line", rules, "doc_id")
    return fixed.groupBy("doc_id", "ch", "fixed").agg(F.count(F.lit(1)).alias("n"))


STYLE = """ru AS (SELECT p_partkey AS no, CASE WHEN p_size % 3 > 0 THEN p_brand END AS brand, CASE WHEN p_size % 2 > 0 THEN p_type END AS type, CASE WHEN p_size % 5 > 0 THEN p_size::BIGINT END AS size,
  CASE WHEN p_size % 7 > 2 THEN p_name END AS font FROM part)"""


@query("J13_cascade", f"""WITH {STYLE}, cx AS (SELECT DISTINCT p_brand AS brand, p_type AS type FROM part)
SELECT cx.brand, cx.type, arg_max(size, no) FILTER (size IS NOT NULL) AS size, arg_max(font, no) FILTER (font IS NOT NULL) AS font FROM cx JOIN ru ON (ru.brand IS NULL OR ru.brand = cx.brand) AND (ru.type IS NULL OR ru.type = cx.type) GROUP BY ALL""")
def _(t):
    m = lambda k: F.pmod("p_size", F.lit(k))
    rules = t.part.select(
        F.col("p_partkey").alias("no"), F.when(m(3) > 0, F.col("p_brand")).alias("brand"), F.when(m(2) > 0, F.col("p_type")).alias("type"),
        F.when(m(5) > 0, F.col("p_size").cast(L)).alias("size"), F.when(m(7) > 2, F.col("p_name")).alias("font"))
    ctx = t.part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return J.cascade(rules, ctx, ["brand", "type"], "no", ["size", "font"])


BASE = "b AS (SELECT o_orderkey AS key, o_orderstatus AS class, o_totalprice AS used, o_totalprice * 2 AS scratch FROM orders)"
NOW = "n AS (SELECT o_orderkey AS key, o_orderstatus AS class, o_totalprice + (o_custkey % 7 - 3) * 100 AS used, o_totalprice * 2 AS scratch FROM orders WHERE o_orderkey % 10 <> 0)"


def runs(t):
    price = F.col("o_totalprice")
    base = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("class"), price.alias("used"), (price * 2).alias("scratch"))
    now = t.orders.filter(F.pmod("o_orderkey", F.lit(10)) != 0).select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("class"), (price + (F.pmod("o_custkey", F.lit(7)) - 3) * 100).alias("used"), (price * 2).alias("scratch"))
    return base, now


@query("J14_compare_runs", f"""WITH {BASE}, {NOW}, j AS (SELECT b.class, b.used, b.scratch, n.used AS nu, n.scratch AS ns, n.key IS NOT NULL AS i FROM b LEFT JOIN n USING (key)),
g AS (SELECT class, sum(used) FILTER (i) AS bu, sum(scratch) FILTER (i) AS bs, sum(nu) AS nu, sum(ns) AS ns, count(*) AS keys, count(*) FILTER (NOT i) AS missing FROM j GROUP BY ALL)
SELECT class, round(bu, 2) AS base_used, round(nu, 2) AS now_used, keys, missing, round((1 - bu/bs)*100, 6) AS base_saved, round((1 - nu/ns)*100, 6) AS now_saved, nu > bu OR missing > 0 AS worse FROM g""")
def _(t):
    c = R.compare_runs(*runs(t), "key", "class")
    return c.select("class", F.round("base_used", 2).alias("base_used"), F.round("now_used", 2).alias("now_used"), "keys", "missing",
                    F.round("base_saved", 6).alias("base_saved"), F.round("now_saved", 6).alias("now_saved"), "worse")


@query("J15_changed_since", f"""WITH {BASE}, {NOW} SELECT key, b.used, n.used AS now_used, round(n.used - b.used, 2) AS change FROM b JOIN n USING (key) WHERE b.used <> n.used""")
def _(t):
    return R.changed_since(*runs(t), "key").withColumn("change", F.round("change", 2))


@query("O1_worst_k", f"""WITH {BASE}, {NOW} SELECT key, b.used AS base_used, n.used AS now_used, b.scratch AS base_scratch FROM b JOIN n USING (key) WHERE n.used > b.used ORDER BY n.used - b.used DESC, key LIMIT 25""")
def _(t):
    return R.worst_k(*runs(t), "key")


@query("S8_upsert_latest", f"""WITH {BASE}, {NOW}, p AS (SELECT * FROM n WHERE key % 3 = 0) SELECT key, class, used, scratch FROM p UNION ALL SELECT key, class, used, scratch FROM b WHERE key NOT IN (SELECT key FROM p)""")
def _(t):
    base, now = runs(t)
    store = Store(t.spark, f"{shared_folder(t.spark)}/report-{uuid.uuid4().hex}", ["key"])
    store.upsert(base)
    store.upsert(now.filter(F.pmod("key", F.lit(3)) == 0))
    return store.read()


@query("J16_refrain_or_verse", """WITH l AS (SELECT conv_id, turn // 2 AS note, turn, turn % 3 AS verse, CASE WHEN length(text) % 4 = 0 THEN '' ELSE text END AS txt, role = 'system' AS ref, conv_id % 3 AS pass FROM conversations),
last AS (SELECT conv_id, verse, max(note) AS m FROM l WHERE txt <> '' GROUP BY ALL),
e AS (SELECT l.*, last.m IS NULL OR l.note > last.m AS ended FROM l LEFT JOIN last ON last.conv_id = l.conv_id AND last.verse = l.pass),
g AS (SELECT conv_id, note, arg_min(txt, turn) FILTER (verse = pass) AS own, arg_min(txt, turn) FILTER (ref) AS rf, arg_min(txt, verse*100 + turn) FILTER (txt <> '') AS low, bool_or(ended) AS ended FROM e GROUP BY ALL),
w AS (SELECT conv_id, note, CASE WHEN ended AND coalesce(own, rf, '') = '' THEN coalesce(low, own, rf) ELSE coalesce(own, rf) END AS word FROM g)
SELECT conv_id, note, nullif(word, '') AS word FROM w""")
def _(t):
    n = F.length("text")
    l = t.conversations.select("conv_id", F.floor(F.col("turn") / 2).alias("note"), "turn", F.pmod("turn", F.lit(3)).alias("verse"),
                               F.when(n % 4 == 0, "").otherwise(F.col("text")).alias("txt"), (F.col("role") == "system").alias("ref"),
                               F.pmod("conv_id", F.lit(3)).alias("pass"))
    last = l.filter("txt <> ''").groupBy("conv_id", F.col("verse").alias("pass")).agg(F.max("note").alias("m"))
    e = l.join(last, ["conv_id", "pass"], "left").withColumn("ended", F.col("m").isNull() | (F.col("note") > F.col("m")))
    return J.refrain_or_verse(e, ["conv_id", "note"], "verse", F.col("txt"), F.col("ref"), "turn", F.col("pass"), F.col("ended"))


@query("J17_misaligned_onsets", """WITH o AS (SELECT l_suppkey AS page, l_extendedprice AS x, l_linenumber AS t FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT l_suppkey AS page, l_extendedprice AS x, l_linenumber AS t FROM lineitem WHERE l_returnflag <> 'R')
SELECT page, count(*) AS n FROM o WHERE EXISTS (SELECT 1 FROM p WHERE p.page = o.page AND abs(o.x - p.x) < 20 AND p.t <> o.t) GROUP BY ALL""")
def _(t):
    d = t.lineitem.select(F.col("l_suppkey").alias("page"), F.col("l_extendedprice").alias("x"), F.col("l_linenumber").alias("t"), "l_returnflag")
    m = J.misaligned_onsets(d.filter("l_returnflag = 'R'"), d.filter("l_returnflag <> 'R'"), ["page"], "x", "t", 20.0)
    return m.groupBy("page").agg(F.count(F.lit(1)).alias("n"))


@query("J18_tuplet_ratio", f"""WITH {ELEMENTS}, e AS (SELECT l_orderkey AS doc, element_id, pos, l_suppkey % 2 AS voice, l_partkey % 6 <> 0 AS timed FROM el),
mk AS (SELECT o_orderkey AS doc, o_orderkey*100 + 1 AS s, o_orderkey*100 + 1 + o_custkey % 4 AS t, CASE WHEN o_custkey % 5 = 0 THEN 3 END AS a, CASE WHEN o_custkey % 5 = 0 THEN 2 END AS b FROM orders
 UNION ALL SELECT o_orderkey, o_orderkey*100 + 2, o_orderkey*100 + 4, 5, 4 FROM orders WHERE o_custkey % 3 = 0),
m AS (SELECT mk.*, x.pos AS p0, y.pos AS p1, x.voice AS v FROM mk JOIN e x ON x.element_id = s JOIN e y ON y.element_id = t),
i AS (SELECT m.*, e.element_id, count(*) OVER (PARTITION BY m.doc, s, t) AS n FROM m JOIN e ON e.doc = m.doc AND e.pos BETWEEN p0 AND p1 AND e.voice = v AND timed),
r AS (SELECT *, coalesce(a, n) AS ra, coalesce(b, CASE WHEN coalesce(a, n) IN (2, 4) THEN 3 ELSE power(2, floor(log2(greatest(1, coalesce(a, n) - 1)) + 1e-12)) END) AS rb FROM i)
SELECT doc, element_id, round(product(ra))::BIGINT AS actual, round(product(rb))::BIGINT AS normal FROM r GROUP BY ALL""")
def _(t):
    e = li_elements(t).select(F.col("l_orderkey").alias("doc"), "element_id", "pos", F.pmod("l_suppkey", F.lit(2)).alias("voice"), (F.pmod("l_partkey", F.lit(6)) != 0).alias("timed"))
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    five = F.pmod(cust, F.lit(5)) == 0
    a = t.orders.select(k.alias("doc"), (k * 100 + 1).alias("start_id"), (k * 100 + 1 + F.pmod(cust, F.lit(4))).alias("end_id"),
                        F.when(five, 3).cast(L).alias("tuplet_actual"), F.when(five, 2).cast(L).alias("tuplet_normal"))
    b = t.orders.filter(F.pmod(cust, F.lit(3)) == 0).select(k.alias("doc"), (k * 100 + 2).alias("start_id"), (k * 100 + 4).alias("end_id"),
                                                           F.lit(5).cast(L).alias("tuplet_actual"), F.lit(4).cast(L).alias("tuplet_normal"))
    return J.tuplet_ratio(a.unionByName(b), e, ["doc"])
