"""Sequence operators on events, line items, conversations and document lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequence as Q
from ..operators import stats as S
from ..operators.repeats import repeat_segments
from ..operators.stats import numbered
from .pitch import L
from .registry import query
from .stats import q_sql
from .text import LINES, doc_lines
from .votes import BOOK, EV, ORDER, book_pages, ev

TS = ["ts", "event_id"]
OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
LI_ORDER = ", ".join(ORDER)
LI_OVER = f"OVER (PARTITION BY l_orderkey ORDER BY {LI_ORDER}"


def when(kind, value="k"):
    return F.when(F.col("event_type") == kind, F.col(value))


@query("W1_carry_attr", f"""{EV}, a AS (SELECT *, coalesce(CASE WHEN event_type = 'click' THEN k END, CASE WHEN event_type = 'view' THEN k END,
  lag(CASE WHEN event_type = 'error' THEN k END) {OVER})) AS now FROM ev)
SELECT event_id, coalesce(last_value(now IGNORE NULLS) {OVER} {UP}, 4) AS in_force FROM a""")
def _(t):
    r = Q.carry_attr(ev(t), ["user_id"], TS, when("click"), when("view"), when("error"), F.lit(4).cast(L))
    return r.select("event_id", "in_force")


def song_measures(t):
    """Measures of a song (order key): longest part, or the signature length when no part sounds."""
    m = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.coalesce(F.max(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))), F.lit(4.0)).alias("len"))
    return m.withColumn("measure", F.col("l_linenumber").cast(L)).drop("l_linenumber")


SONG = """m AS (SELECT l_orderkey, l_linenumber::BIGINT AS measure, coalesce(max(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), 4.0) AS len
  FROM lineitem GROUP BY ALL)"""


@query("W2_running_onset", f"""WITH {SONG} SELECT l_orderkey, measure, len,
 coalesce(sum(len) OVER (PARTITION BY l_orderkey ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS onset FROM m""")
def _(t):
    return Q.running_onset(song_measures(t), ["l_orderkey"], ["measure"], F.col("len"))


@query("W3_change_points", f"""{EV}, a AS (SELECT *, lag(event_type) {OVER}) AS pt, lag(k > 50) {OVER}) AS ph, row_number() {OVER}) AS r FROM ev)
SELECT event_id, event_type FROM a WHERE r = 1 OR pt IS DISTINCT FROM event_type OR ph IS DISTINCT FROM (k > 50)""")
def _(t):
    return Q.change_points(ev(t).withColumn("high", F.col("k") > 50), ["user_id"], TS, "event_type", "high").select("event_id", "event_type")


ACC = "CASE l_suppkey % 5 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 1 END"
DEG = f"OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY {LI_ORDER}"


def li_notes(t):
    s = F.pmod("l_suppkey", F.lit(5))
    return t.lineitem.withColumn("degree", F.pmod("l_partkey", F.lit(3))).withColumn(
        "accidental", F.when(s == 0, -1).when(s == 1, 0).when(s == 2, 1))


@query("W4_accidental_carry", f"""WITH a AS (SELECT l_orderkey, l_partkey % 3 AS degree, coalesce(last_value({ACC} IGNORE NULLS) {DEG} {UP}, 0) AS s FROM lineitem)
SELECT l_orderkey, degree, s::BIGINT AS sounding, count(*) AS n FROM a GROUP BY ALL""")
def _(t):
    r = Q.accidental_carry(li_notes(t), ["l_orderkey", "degree"], ORDER, F.col("accidental"))
    return r.groupBy("l_orderkey", "degree", F.col("sounding").cast(L).alias("sounding")).agg(F.count(F.lit(1)).alias("n"))


@query("W5_accidental_marks", f"""WITH a AS (SELECT l_orderkey, l_partkey % 3 AS degree, coalesce({ACC}, 0) AS o, lag(coalesce({ACC}, 0), 1, 0) {DEG}) AS w FROM lineitem)
SELECT l_orderkey, degree, (CASE WHEN o <> w THEN o END)::BIGINT AS mark, count(*) AS n FROM a GROUP BY ALL""")
def _(t):
    notes = li_notes(t).withColumn("offset", F.coalesce("accidental", F.lit(0)))
    r = Q.accidental_marks(notes, ["l_orderkey", "degree"], ORDER, "offset")
    return r.groupBy("l_orderkey", "degree", F.col("mark").cast(L).alias("mark")).agg(F.count(F.lit(1)).alias("n"))


DEPTH = f"""d AS (SELECT *, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) {OVER} {UP} AS s FROM ev),
dd AS (SELECT *, s - least(0, min(s) {OVER} {UP}) AS depth FROM d)"""


def starts_ends():
    return F.when(F.col("event_type") == "signup", 1).otherwise(0), F.when(F.col("event_type") == "error", 1).otherwise(0)


@query("W6_clamped_depth", f"{EV}, {DEPTH} SELECT event_id, depth::BIGINT AS depth FROM dd")
def _(t):
    r = Q.clamped_depth(t.events, ["user_id"], TS, *starts_ends())
    return r.select("event_id", F.col("depth").cast(L).alias("depth"))


TIE = "n AS (SELECT user_id % 3 AS part, event_type AS pitch, event_id AS t0, event_id + 10 + k % 10 AS t1, value > 4 AS tie FROM ev)"


def ev_notes(t):
    return ev(t).select(F.pmod("user_id", F.lit(3)).alias("part"), F.col("event_type").alias("pitch"), F.col("event_id").alias("t0"),
                        (F.col("event_id") + 10 + F.pmod("k", F.lit(10))).alias("t1"), (F.col("value") > 4).alias("tie"))


@query("W7_merge_ties", f"""{EV}, {TIE}, f AS (SELECT *, CASE WHEN tie AND lag(t1) OVER w = t0 THEN 0 ELSE 1 END AS new FROM n WINDOW w AS (PARTITION BY part, pitch ORDER BY t0)),
i AS (SELECT *, sum(new) OVER (PARTITION BY part, pitch ORDER BY t0) AS isl FROM f)
SELECT part, pitch, min(t0) AS t0, max_by(t1, t0) AS t1, count(*) AS pieces FROM i GROUP BY part, pitch, isl""")
def _(t):
    return Q.merge_ties(ev_notes(t), ["part", "pitch"], ["t0"], "t0", "t1", F.col("tie")).select("part", "pitch", "t0", "t1", "pieces")


@query("W9_carried_lyric", """WITH c AS (SELECT conv_id, turn, turn::DOUBLE AS t0, turn + CASE WHEN length(text) % 5 = 0 THEN 0.5 ELSE 1 END AS t1, turn // 4 AS pass,
  CASE WHEN role = 'user' THEN text END AS word, length(text) % 3 = 0 AS ext, (length(text) % 4 = 0)::INT AS st, (length(text) % 4 = 1)::INT AS en FROM conversations),
d AS (SELECT *, sum(st - en) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM c), e AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY conv_id ORDER BY turn)) AS depth FROM d),
f AS (SELECT *, coalesce(lag(depth) OVER w, 0) AS open_, CASE WHEN word IS NOT NULL OR NOT coalesce(lag(pass) OVER w = pass AND abs(lag(t1) OVER w - t0) < 1e-6, false) THEN 1 ELSE 0 END AS head
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(head) OVER (PARTITION BY conv_id ORDER BY turn) AS isl, max(CASE WHEN word IS NOT NULL THEN t0 END) OVER (PARTITION BY conv_id, pass) AS lw FROM f),
h AS (SELECT *, first_value(word) OVER (PARTITION BY conv_id, isl ORDER BY turn) AS hw, first_value(ext) OVER (PARTITION BY conv_id, isl ORDER BY turn) AS hx FROM g)
SELECT conv_id, turn, coalesce(word, CASE WHEN hw IS NOT NULL AND (hx OR open_ > 0 OR t0 <= lw) THEN '-' END) AS lyric FROM h""")
def _(t):
    n = F.length("text")
    notes = t.conversations.select(
        "conv_id", "turn", F.col("turn").cast("double").alias("t0"), (F.col("turn") + F.when(n % 5 == 0, 0.5).otherwise(1.0)).alias("t1"),
        F.floor(F.col("turn") / 4).alias("pass"), F.when(F.col("role") == "user", F.col("text")).alias("word"),
        (n % 3 == 0).alias("ext"), F.when(n % 4 == 0, 1).otherwise(0).alias("st"), F.when(n % 4 == 1, 1).otherwise(0).alias("en"))
    r = Q.carried_lyric(notes, ["conv_id"], ["turn"], "t0", "t1", "pass", "word", "ext", F.col("st"), F.col("en"))
    return r.select("conv_id", "turn", "lyric")


PAGE = "user_id::VARCHAR || ':' || event_type"
ROWS = f"""r AS (SELECT DISTINCT {PAGE} AS g, k FROM ev), gp AS (SELECT g, k - lag(k) OVER (PARTITION BY g ORDER BY k) AS gap FROM r), v AS (SELECT g, gap FROM gp WHERE gap > 2),
tol AS (SELECT DISTINCT r.g, greatest(3.0, coalesce(nullif(m.q, 0), 12)*0.45)::DOUBLE AS tol FROM r LEFT JOIN {q_sql('gap', 'n//2')} m USING (g))"""


def ev_page(t):
    return ev(t).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("g"), "k")


@query("W12_row_pitch_tol", f"{EV}, {ROWS} SELECT g, round(tol, 6) AS tol FROM tol")
def _(t):
    return Q.row_pitch_tol(ev_page(t), ["g"], "k").withColumn("tol", F.round("tol", 6))


@query("W11_gap_cluster_abs", f"""{EV}, {ROWS}, f AS (SELECT g, k, CASE WHEN k - lag(k) OVER (PARTITION BY g ORDER BY k) > tol THEN 1 ELSE 0 END AS f FROM r JOIN tol USING (g))
SELECT g, k, (sum(f) OVER (PARTITION BY g ORDER BY k))::BIGINT AS row_no FROM f""")
def _(t):
    return Q.row_clusters(ev_page(t), ["g"], "k").select("g", "k", "row_no")


@query("W13_step_gaps", f"""{EV}, r AS (SELECT user_id, event_type AS g, k - lag(k) OVER (PARTITION BY user_id, event_type ORDER BY k, event_id) AS gap FROM ev),
v AS (SELECT g, gap FROM r WHERE gap > 4) SELECT a.g AS event_type, a.q AS pitch, (SELECT count(*) FROM v WHERE v.g = a.g) AS n FROM {q_sql('gap', 'least(n-1, floor(n*0.5))')} a""")
def _(t):
    e = ev(t).withColumn("__id", F.col("event_id"))
    gaps = Q.step_gaps(e, ["user_id", "event_type"], "k", 4)
    return S.quantiles(gaps, ["event_type"], "gap", {"pitch": S.floor_index(0.5)})


@query("W14_run_collapse", f"""{EV}, f AS (SELECT *, row_number() {OVER}) AS pos, CASE WHEN lag(event_type) {OVER}) = event_type THEN 0 ELSE 1 END AS new FROM ev),
i AS (SELECT *, sum(new) {OVER}) AS run FROM f)
SELECT user_id, any_value(event_type) AS event_type, min(pos)-1 AS first_pos, max(pos) AS end_pos FROM i GROUP BY user_id, run HAVING any_value(event_type) <> 'view'""")
def _(t):
    return Q.run_collapse(t.events, ["user_id"], TS, "event_type", "view")


@query("W15_segment_by_title", """SELECT conv_id, turn, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS segment FROM conversations""")
def _(t):
    return Q.segment_by_title(t.conversations, ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "segment")


# readings of a page: what was read first, two less, and what the running number might be
CHAIN = """WITH RECURSIVE bp AS (SELECT o_custkey % 50 AS book, o_orderkey AS idx, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS r, CASE WHEN o_orderpriority = '5-LOW' THEN NULL
  WHEN o_orderstatus = 'F' THEN o_orderkey - 3 ELSE o_orderkey - o_custkey % 7 END AS printed FROM orders),
c AS (SELECT *, [printed, printed - 2, CASE WHEN idx % 3 > 0 THEN r + 40 END, CASE WHEN idx % 2 > 0 THEN lag(printed) OVER (PARTITION BY book ORDER BY idx) + 1 END] AS cands FROM bp),
f(book, r, idx, page, last) AS (SELECT book, r, idx, printed, printed FROM c WHERE r = 1 UNION ALL
  SELECT book, r, idx, page, coalesce(page, l + 1) FROM (SELECT c.book, c.r, c.idx, f.last AS l, CASE WHEN coalesce(list_contains(c.cands, f.last + 1), false) THEN f.last + 1 ELSE c.printed END AS page FROM f JOIN c ON c.book = f.book AND c.r = f.r + 1))"""


@query("W16_expected_next", f"""{CHAIN} SELECT idx AS "index", page FROM f""")
def _(t):
    from ..plans.book import expected_pages

    by = Window.partitionBy("book").orderBy("index")
    r, was = F.row_number().over(by), F.lag("printed").over(by)
    i = F.col("index")
    cands = F.array("printed", F.col("printed") - 2, F.when(i % 3 > 0, r + 40), F.when(i % 2 > 0, was + 1))
    pages = book_pages(t).withColumn("cands", cands)
    return expected_pages(pages, "book", "index", "printed", "cands").select("index", "page")


WORDS = "regexp_extract_all(line, '[A-Za-z]+')"


@query("W18_head_fingerprint", f"""WITH {LINES}, w AS (SELECT doc_id, line_no, {WORDS} AS w FROM lines),
h AS (SELECT doc_id, line_no, w, list_position(list_transform(w, lambda x: length(x) > 2), true) AS s FROM w),
f AS (SELECT doc_id, line_no, lower(array_to_string(w[s:s+7], ',')) AS fp FROM h WHERE s > 0 AND len(w) >= s+7),
g AS (SELECT fp, count(*) AS n_parallel, min(doc_id) AS first_doc FROM f GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, line_no, md5(fp) AS fp, n_parallel, first_doc FROM f JOIN g USING (fp)""")
def _(t):
    words = F.regexp_extract_all("line", F.lit("([A-Za-z]+)"), 1)
    rests = F.transform(words, lambda w: F.length(w) <= 2)
    rows = doc_lines(t).select("doc_id", F.col("line_no").cast(L).alias("line_no"), F.lower(Q.head_fingerprint(words, rests)).alias("fp"))
    p = Q.parallel_lines(rows, "fp", "doc_id", "line_no")
    return p.select("doc_id", "line_no", F.md5("fp").alias("fp"), "n_parallel", F.col("first_line.doc_id").alias("first_doc"))


@query("W19_repeat_segments", """WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, role AS fp FROM conversations),
pr AS (SELECT a.conv_id, a.p AS i, b.p - a.p AS d FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.fp = b.fp AND a.p < b.p),
il AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, d ORDER BY i) AS isl FROM pr),
rn AS (SELECT conv_id, d, min(i) AS lo, max(i) AS hi, count(*) AS len FROM il GROUP BY conv_id, d, isl HAVING count(*) >= 2),
e AS (SELECT conv_id, unnest([lo-2, hi-1, lo+d-2, hi+d-1]) AS edge, len FROM rn)
SELECT conv_id, edge, max(len) AS len FROM e GROUP BY ALL""")
def _(t):
    return repeat_segments(t.conversations, ["conv_id"], ["turn"], "role").select("conv_id", "edge", "len")


@query("W20_bars_per_line", f"""WITH r AS (SELECT *, row_number() {LI_OVER}) AS r, lead(l_quantity) {LI_OVER}) AS nx FROM lineitem),
p AS (SELECT *, max(CASE WHEN r = 1 AND l_quantity < nx THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS pk FROM r)
SELECT l_orderkey, greatest(0, floor((r - 1 - pk)/3.0))::BIGINT AS line, count(*) AS n, sum(l_quantity) AS qty FROM p GROUP BY ALL""")
def _(t):
    r = Q.bars_per_line(t.lineitem, ["l_orderkey"], ORDER, "l_quantity", 3)
    return r.groupBy("l_orderkey", "line").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("W28_multi_rest_runs", f"""{EV}, r AS (SELECT *, row_number() {OVER}) - 1 AS i FROM ev),
m AS (SELECT user_id, i // 2 AS m, max(CASE WHEN event_type = 'view' THEN k % 4 ELSE 0 END) AS n, bool_and(k < 92) AS rest, bool_or(event_type = 'signup' AND k < 20) AS chg FROM r GROUP BY ALL)
SELECT a.user_id, a.m AS measure, a.n FROM m a JOIN m b ON a.user_id = b.user_id AND b.m BETWEEN a.m AND a.m + a.n - 1 WHERE a.n >= 2
GROUP BY a.user_id, a.m, a.n HAVING count(*) = a.n AND bool_and(b.rest) AND NOT bool_or(b.m > a.m AND (b.chg OR b.n > 0))""")
def _(t):
    e = numbered(ev(t), ["user_id"], TS, "r").withColumn("measure", F.floor((F.col("r") - 1) / 2))
    declared = F.when(F.col("event_type") == "view", F.pmod("k", F.lit(4)))
    return Q.multi_rest_runs(e, ["user_id"], "measure", declared, F.col("k") < 92, (F.col("event_type") == "signup") & (F.col("k") < 20))


@query("W32_system_gaps", f"""WITH b AS (SELECT l_orderkey, row_number() {LI_OVER}) AS i, l_returnflag = 'R' AS flat, l_linestatus = 'F' AND l_returnflag <> 'R' AS music, l_suppkey % 2 = 0 AS title,
  l_partkey % 5 AS a, l_suppkey % 3 AS c FROM lineitem), y AS (SELECT *, 10.0*i + a AS y0, 10.0*i + a + 4 + c AS y1 FROM b),
k AS (SELECT m.l_orderkey, m.i, m.y0, max(q.i) AS top FROM y m JOIN y q ON m.l_orderkey = q.l_orderkey AND q.i < m.i AND m.music
  AND (NOT q.flat OR q.i = 1 OR m.y0 - q.y1 >= 6.4 OR EXISTS (SELECT 1 FROM y z WHERE z.l_orderkey = m.l_orderkey AND z.i > q.i AND z.i < m.i AND NOT z.flat)) GROUP BY ALL)
SELECT k.l_orderkey, k.i AS band, round(t.y0 - q.y1, 6)::DOUBLE AS gap FROM k JOIN y q ON q.l_orderkey = k.l_orderkey AND q.i = k.top JOIN y t ON t.l_orderkey = k.l_orderkey AND t.i = k.top + 1
WHERE NOT (q.i = 1 AND q.title)""")
def _(t):
    b = numbered(t.lineitem, ["l_orderkey"], ORDER, "i").withColumn("y0", F.col("i") * 10.0 + F.pmod("l_partkey", F.lit(5)))
    b = b.withColumn("y1", F.col("y0") + 4 + F.pmod("l_suppkey", F.lit(3)))
    flat = F.col("l_returnflag") == "R"
    g = Q.system_gaps(b, ["l_orderkey"], ["i"], "y0", "y1", (F.col("l_linestatus") == "F") & ~flat, flat, F.pmod("l_suppkey", F.lit(2)) == 0, 8.0)
    return g.withColumn("gap", F.round("gap", 6))


CLICK_SIG = "CASE l_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 3 END AS beats, CASE l_orderkey % 3 WHEN 1 THEN 8 ELSE 4 END AS bt"


@query("W33_beats_clicks", f"""WITH {SONG}, s AS (SELECT *, len/8 AS l, {CLICK_SIG} FROM m),
p AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY l_orderkey ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY measure) AS r FROM s),
q AS (SELECT *, 4.0/bt * CASE WHEN bt = 8 AND beats % 3 = 0 AND beats > 3 THEN 3 ELSE 1 END AS beat, CASE WHEN r = 1 AND l < beats*4.0/bt - 1e-9 THEN beats*4.0/bt - l ELSE 0 END AS sh FROM p),
c AS (SELECT *, unnest(range(ceil(sh/beat - 1e-9)::BIGINT, ceil((sh + l - 1e-9)/beat)::BIGINT)) AS k FROM q)
SELECT l_orderkey, measure, round(pos + k*beat - sh, 6)::DOUBLE AS t, k = 0 AS down FROM c""")
def _(t):
    o = F.pmod("l_orderkey", F.lit(3))
    m = song_measures(t).withColumn("len", F.col("len") / 8).withColumn("beats", F.when(o == 0, 4).when(o == 1, 6).otherwise(3))
    m = m.withColumn("bt", F.when(o == 1, 8).otherwise(4))
    return Q.beat_clicks(m, ["l_orderkey"], ["measure"], "len", "beats", "bt").withColumn("t", F.round("t", 6))


@query("W34_beam_groups", f"""WITH e AS (SELECT *, row_number() {LI_OVER}) AS i, l_partkey % 4 AS lv, [48,24,12,6][l_partkey % 4 + 1] AS d FROM lineitem),
s AS (SELECT *, coalesce(sum(d) {LI_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e),
a AS (SELECT *, floor((s + coalesce(last_value(CASE WHEN l_partkey % 7 = 0 THEN l_linenumber * 24 - s END IGNORE NULLS) {LI_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)) / CASE WHEN l_orderkey % 2 = 0 THEN 72 ELSE 48 END) AS g FROM s),
n AS (SELECT *, CASE WHEN lv > 0 AND lag(lv) {LI_OVER}) > 0 AND lag(g) {LI_OVER}) = g THEN lag(lv) {LI_OVER}) ELSE 0 END AS pb, CASE WHEN lv > 0 AND lead(lv) {LI_OVER}) > 0 AND lead(g) {LI_OVER}) = g THEN lead(lv) {LI_OVER}) ELSE 0 END AS nx FROM a),
x AS (SELECT *, unnest(range(1, lv+1)) AS level FROM n WHERE lv > 0 AND pb + nx > 0)
SELECT l_orderkey, i, level::BIGINT AS level, CASE WHEN pb >= level AND nx >= level THEN 'continue' WHEN pb >= level THEN 'end' WHEN nx >= level THEN 'begin' WHEN pb = 0 THEN 'forward hook' ELSE 'backward hook' END AS beam FROM x""")
def _(t):
    lv = F.pmod("l_partkey", F.lit(4))
    e = numbered(t.lineitem, ["l_orderkey"], ORDER, "i").withColumn("lv", lv)
    dur = F.get(F.array(*[F.lit(x) for x in (48, 24, 12, 6)]), F.col("lv").cast("int"))
    group = F.when(F.pmod("l_orderkey", F.lit(2)) == 0, 72).otherwise(48)
    onset = F.when(F.pmod("l_partkey", F.lit(7)) == 0, F.col("l_linenumber") * 24)
    r = Q.beam_groups(e, ["l_orderkey"], ["i"], dur, F.col("lv"), group, onset)
    return r.select("l_orderkey", "i", F.col("level").cast(L).alias("level"), "beam")


@query("W35_grow_region", f"""{EV}, f AS (SELECT *, (event_type = 'signup' OR k < 60) AS m FROM ev), g AS (SELECT *, CASE WHEN m AND lag(m) {OVER}) THEN 0 ELSE 1 END AS new FROM f),
i AS (SELECT *, sum(new) {OVER}) AS isl FROM g)
SELECT event_id, m AND bool_or(event_type = 'signup') OVER (PARTITION BY user_id, isl) AS grown FROM i""")
def _(t):
    r = Q.grow_region(ev(t), ["user_id"], TS, F.col("event_type") == "signup", F.col("k") < 60)
    return r.select("event_id", "grown")


