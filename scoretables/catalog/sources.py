"""Sources and sinks on the bound tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..session import shared_folder
from ..sources import files as S
from ..sources.musicxml import musicxml_measures, musicxml_notes
from ..sources.store import Store
from ..sources.tables import BOUND, dealt, load_tables
from .pitch import L
from .registry import query


@query("S1_load_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in BOUND))
def _(t):
    parts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")).select("name", "n") for n, df in load_tables(t.spark, t.folder).items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


#: Bytes of the part table whose scores make one partition: some 40,000 rows, forty times as large as texts.
PART_PIECE = 256 << 10


def scores(t):
    """A small score per part row, its notes taken from the columns."""
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    text = F.concat(
        F.lit('<score-partwise><part id="P1"><measure number="1"><attributes><divisions>8</divisions><key><fifths>'), s(F.pmod("p_partkey", F.lit(5)) - 2),
        F.lit("</fifths></key><time><beats>"), s(F.pmod("p_size", F.lit(4)) + 2), F.lit("</beats><beat-type>4</beat-type></time></attributes><note><pitch><step>"),
        F.get(F.array(*[F.lit(x) for x in "CDEFGAB"]), F.pmod("p_partkey", F.lit(7)).cast("int")), F.lit("</step><octave>4</octave></pitch><duration>"), s("p_size"),
        F.lit("</duration><voice>1</voice><type>half</type></note><note><chord/><pitch><step>G</step><alter>1</alter><octave>5</octave></pitch><duration>"), s("p_size"),
        F.lit("</duration></note><backup><duration>"), s(F.floor(F.col("p_size") / 2)), F.lit("</duration></backup><note><rest/><duration>3</duration><voice>2</voice></note></measure><measure number=\"2\"><forward><duration>"),
        s(F.pmod("p_partkey", F.lit(9))), F.lit('</duration></forward><note><grace/><pitch><step>A</step><octave>3</octave></pitch></note><note><pitch><step>B</step><octave>3</octave></pitch><duration>4</duration>'
                                               '<tie type="stop"/></note></measure></part></score-partwise>'))
    return dealt(t.part, PART_PIECE).select("p_partkey", text.alias("text"))


@query("S2_ingest_musicxml", """WITH n AS (SELECT p_partkey, 0 AS measure_ix, 0 AS item_ix, substr('CDEFGAB', (p_partkey % 7 + 1)::INT, 1) AS step, 0 AS alter, 4 AS octave, p_size AS dur, 1 AS voice, 0 AS onset, false AS is_rest, false AS tie FROM part UNION ALL
 SELECT p_partkey, 0, 1, 'G', 1, 5, p_size, 1, 0, false, false FROM part UNION ALL SELECT p_partkey, 0, 3, NULL, 0, NULL, 3, 2, p_size - p_size // 2, true, false FROM part UNION ALL
 SELECT p_partkey, 1, 1, 'A', 0, 3, 0, 1, p_partkey % 9, false, false FROM part UNION ALL SELECT p_partkey, 1, 2, 'B', 0, 3, 4, 1, p_partkey % 9, false, true FROM part)
SELECT p_partkey, measure_ix::BIGINT AS measure_ix, item_ix::BIGINT AS item_ix, step, alter::BIGINT AS alter, octave::BIGINT AS octave, dur::BIGINT AS dur, voice::BIGINT AS voice, onset::BIGINT AS onset, is_rest, tie AS tie_stop FROM n""")
def _(t):
    n = musicxml_notes(scores(t), "p_partkey", "text")
    i = lambda c, a: F.col(c).cast(L).alias(a)
    return n.select("p_partkey", i("measure_ix", "measure_ix"), i("item_ix", "item_ix"), "step", i("alter", "alter"), i("octave", "octave"), i("dur_div", "dur"),
                    i("voice", "voice"), i("onset_div", "onset"), "is_rest", "tie_stop")


@query("S2_musicxml_measures", """SELECT p_partkey, unnest([0, 1])::BIGINT AS measure_ix, unnest([8, NULL])::BIGINT AS divisions, unnest([p_partkey % 5 - 2, NULL])::BIGINT AS fifths,
  unnest([p_size % 4 + 2, NULL])::BIGINT AS beats FROM part""")
def _(t):
    m = musicxml_measures(scores(t), "p_partkey", "text")
    return m.select("p_partkey", *[F.col(c).cast(L).alias(c) for c in ("measure_ix", "divisions", "fifths", "beats")])


@query("S3_header_fields", """WITH l AS (SELECT p_partkey, unnest([0, 1, 2, 3])::BIGINT AS line_no, unnest(['X', 'T', 'C', 'K']) AS field, unnest([p_partkey::VARCHAR, p_name, p_brand, p_type]) AS value FROM part)
SELECT p_partkey, CASE WHEN field = 'K' THEN 5 ELSE line_no END AS line_no, field, value FROM l""")
def _(t):
    text = F.concat(F.lit("X:"), F.col("p_partkey").cast("string"), F.lit("\r\nT: "), F.col("p_name"), F.lit("  % a title\nC:"), F.col("p_brand"),
                    F.lit("\n% whole line\nnotes A B c\n K: "), F.col("p_type"), F.lit("\n"))
    h = S.header_fields(t.part.select("p_partkey", text.alias("text")), "p_partkey", "text")
    return h.select("p_partkey", F.col("line_no").cast(L).alias("line_no"), "field", "value")


NATURAL = """(WITH RECURSIVE s AS (SELECT p_partkey, name, regexp_extract_all(name, '[0-9]+|[^0-9]+') AS ps FROM nm)
SELECT p_partkey, name, array_to_string(list_transform(ps, lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(length(ltrim(p, '0'))::VARCHAR, 6, '0') || ltrim(p, '0') || lpad(length(p)::VARCHAR, 6, '0') ELSE p END), '') AS key FROM s)"""


@query("S5_natural_key", f"WITH nm AS (SELECT p_partkey, p_name || ' ' || p_brand || '-' || (p_partkey % 120)::VARCHAR AS name FROM part) SELECT p_partkey, name, key FROM {NATURAL}")
def _(t):
    n = t.part.select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit("-"), F.pmod("p_partkey", F.lit(120)).cast("string")).alias("name"))
    return n.withColumn("key", natural_key("name"))


@query("O5_natural_order", """SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY regexp_extract(p_brand, '[0-9]+')::INT, p_partkey) AS place FROM part""")
def _(t):
    from ..operators.stats import numbered

    rows = t.part.select("p_partkey", "p_brand", "p_type", natural_key("p_brand").alias("key"))
    return S.natural_order(numbered(rows, ["p_type"], ["key", "p_partkey"], "place").select("p_partkey", "p_brand", "place"), "p_brand", "p_partkey")


@query("S6_write_results", """WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE json_extract(props, '$.k')::BIGINT END AS k FROM events)
SELECT event_id, k, CASE WHEN k IS NULL THEN 'not readable' END AS error FROM e""")
def _(t):
    raw = F.when(F.col("event_type") == "error", F.lit("broken")).otherwise(F.get_json_object("props", "$.k"))
    rows = S.result_rows(t.events.withColumn("raw", raw), "event_id", F.col("raw").try_cast("bigint"), "k")
    path = f"{shared_folder(t.spark)}/results-{uuid.uuid4().hex}"
    S.write_results(rows, path)
    return t.spark.read.schema("file bigint, k bigint, error string").json(path).withColumnRenamed("file", "event_id")


@query("S7_incremental_apply", """WITH d AS (SELECT DISTINCT text FROM documents), c AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0)
SELECT md5(d.text) AS digest, length(d.text)::BIGINT AS size, c.text IS NOT NULL AS cached FROM d LEFT JOIN c USING (text)""")
def _(t):
    docs = t.texts.select(S.content_key("v1", F.col("text")).alias("key"), "text", "doc_id")

    def work(df, cached=False):
        return df.select("key", F.md5("text").alias("digest"), F.length("text").cast(L).alias("size"), F.lit(cached).alias("cached"))

    store = Store(t.spark, f"{shared_folder(t.spark)}/cache-{uuid.uuid4().hex}", ["key"])
    store.upsert(work(docs.filter("doc_id % 2 = 0").dropDuplicates(["key"]), True))
    return store.apply(docs, work).select("digest", "size", "cached")
