import datetime
import os
import tempfile
import uuid

from pyspark.sql import functions as F

from scoretables.sources import files as S
from scoretables.sources.musicxml import ingest_musicxml, musicxml_measures, musicxml_notes
from scoretables.streaming.pairing import pair_stream


def folder():
    return tempfile.mkdtemp(prefix="scoretables-test-")


def test_inputs_in_natural_order(spark):
    d = folder()
    for name in ("h10.pdf", "h2.pdf", "h1.txt", "a1.PNG"):
        open(f"{d}/{name}", "w").write("x")
    got = [r.path.rsplit("/", 1)[1] for r in S.list_inputs(spark, [d]).collect()]
    assert got == ["a1.PNG", "h2.pdf", "h10.pdf"]


def test_results_and_versions(spark):
    d = folder()
    rows = S.result_rows(spark.createDataFrame([("a", "1"), ("b", "x")], "f string, v string"), "f", F.col("v").try_cast("int"), "n")
    S.write_results(rows, f"{d}/out")
    got = {(r.file, r.n, r.error) for r in spark.read.schema("file string, n int, error string").json(f"{d}/out").collect()}
    assert got == {("a", 1, None), ("b", None, "not readable")}
    path = S.write_version(rows, d)
    assert spark.read.parquet(path).count() == 2


def test_only_unseen_keys_are_computed(spark):
    new = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3)], "key string, x int")
    cache = spark.createDataFrame([("a", 100), ("z", 5)], "key string, y int")
    got = sorted(tuple(r) for r in S.incremental_apply(new, cache, "key", lambda d: d.select("key", (F.col("x") * 10).alias("y"))).collect())
    assert got == [("a", 100), ("b", 20), ("c", 30)]


def test_musicxml_files(spark):
    d = folder()
    note = "<note>{c}<pitch><step>{s}</step><octave>4</octave></pitch><duration>{n}</duration><voice>{v}</voice></note>"
    body = note.format(c="", s="C", n=4, v=1) + note.format(c="<chord/>", s="E", n=4, v=1) + note.format(c="", s="D", n=4, v=1)
    body += "<backup><duration>8</duration></backup><forward><duration>2</duration></forward>" + note.format(c="", s="G", n=6, v=2)
    open(f"{d}/a.musicxml", "w").write(f'<score-partwise><part-list/>\n<part id="P1">\n<measure number="1">{body}</measure></part></score-partwise>')
    got = [(r.step, r.onset_div, r.voice) for r in ingest_musicxml(spark, d).orderBy("item_ix").collect()]
    assert got == [("C", 0, 1), ("E", 0, 1), ("D", 4, 1), ("G", 2, 2)]


def test_musicxml_is_read_as_xml(spark):
    """Comments, CDATA, entities, single quotes and empty tags; no shuffle; rows of one id stay apart."""
    one = """<?xml version='1.0' encoding='UTF-16'?><!DOCTYPE score-partwise SYSTEM 'partwise.dtd'>
<score-partwise><part-list><score-part id='P1'/></part-list><part id='P1'><!-- <measure><note/></measure> -->
<measure number='1'><attributes><divisions> 4 </divisions><key><fifths>-2</fifths></key><time><beats>3</beats><beat-type>4</beat-type></time></attributes>
<note><!-- <chord/> <duration>9</duration> --><pitch><step><![CDATA[C]]></step><alter>0.5</alter><octave>5</octave></pitch><duration>2</duration><tie type = 'stop'/><type>eighth</type></note>
<note><chord/><pitch><step>&#69;</step><octave>5</octave></pitch><duration>2</duration><lyric><text>&lt;rest</text></lyric></note>
<note/><direction><offset>7</offset></direction><backup foot='1'><duration>2</duration></backup>
<note><rest/><duration>99999999999</duration><staff>2</staff></note></measure>
<measure number='2'><note><grace/><pitch><step>A</step><octave>3</octave></pitch><duration>5</duration></note><note><rest/><duration>1</duration></note></measure></part>
<part><measure/></part></score-partwise>"""
    two = "<score-partwise><part id='a'><measure><note><duration>1</duration></note></measure><measure><note><rest/>"
    df = spark.createDataFrame([(7, one, "x"), (7, two, "y"), (8, None, "z"), (None, "", "z"), (9, "plain", "z"), (10, two, "z")], "id int, text string, notes string")
    notes = musicxml_notes(df, "id", "text")
    got = [(r.part_ix, r.measure_ix, r.item_ix, r.step, r.alter, r.octave, r.dur_div, r.onset_div, r.staff, r.is_rest, r.is_chord, r.is_grace, r.tie_stop) for r in notes.filter("id = 7").collect()]
    first = [(0, 0, 0, "C", 0, 5, 2, 0, 1, False, False, False, True), (0, 0, 1, "E", 0, 5, 2, 0, 1, False, True, False, False), (0, 0, 2, None, 0, None, 0, 2, 1, False, False, False, False),
             (0, 0, 4, None, 0, None, 0, 0, 2, True, False, False, False), (0, 1, 0, "A", 0, 3, 0, 0, 1, False, False, True, False), (0, 1, 1, None, 0, None, 1, 0, 1, True, False, False, False)]
    cut = [(0, 0, 0, None, 0, None, 1, 0, 1, False, False, False, False)]
    assert sorted(map(str, got)) == sorted(map(str, first + cut))
    assert notes.filter("id IS NULL OR id > 7").count() == 1
    assert "Exchange" not in notes._jdf.queryExecution().executedPlan().toString()
    signs = musicxml_measures(df, "id", "text").filter("id = 7").collect()
    assert sorted(((r.part_ix, r.measure_ix, r.divisions, r.fifths, r.beats, r.beat_type) for r in signs), key=str) == sorted(
        [(0, 0, 4, -2, 3, 4), (0, 1, None, None, None, None), (1, 0, None, None, None, None), (0, 0, None, None, None, None)], key=str)
    assert musicxml_notes(df.limit(0), "id", "text").count() == 0


def test_stream_pairs_like_the_batch(spark):
    d = folder()
    schema = "file string, track int, seq int, tick bigint, type string, channel int, pitch int"
    rows = [("f", 0, 0, 0, "noteOff", 0, 60), ("f", 0, 1, 1, "noteOn", 0, 60), ("f", 0, 2, 2, "noteOn", 0, 60), ("f", 0, 3, 3, "noteOn", 9, 60)]
    more = [("f", 0, 4, 5, "noteOff", 0, 60), ("f", 0, 5, 7, "noteOff", 0, 60), ("f", 0, 6, 8, "noteOff", 0, 60)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/in/1")
    name = "pairs_" + uuid.uuid4().hex
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/in")
    q = pair_stream(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{d}/cp").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame(more, schema).coalesce(1).write.parquet(f"{d}/in/2")
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.t_on, r.t_off) for r in spark.table(name).collect()) == [(1, 5), (2, 7)]


def test_stream_forgets_keys_past_their_time(spark):
    d = folder()
    schema = "file string, track int, seq int, tick bigint, type string, channel int, pitch int, ts timestamp"
    at = lambda m: datetime.datetime(2024, 1, 1, m // 60, m % 60)
    batches = [[("f", 0, 0, 1, "noteOn", 0, 60, at(0)), ("f", 0, 1, 2, "noteOn", 0, 61, at(0))], [("g", 0, 0, 1, "noteOn", 0, 60, at(600))],
               [("g", 0, 1, 2, "noteOff", 0, 60, at(601))], [("f", 0, 2, 9, "noteOff", 0, 60, at(602))]]
    name = "kept_" + uuid.uuid4().hex
    os.makedirs(f"{d}/in")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/in")
    q = pair_stream(stream, "ts", 60).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{d}/cp").start()
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/in/{i}")
            q.processAllAvailable()
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        q.stop()
    assert [(r.file, r.t_on, r.t_off) for r in spark.table(name).collect()] == [("g", 1, 2)] and left == 0


def test_scores_of_one_small_file_are_read_by_many_tasks(spark, tmp_path):
    """Parts of a single row group: the texts made of them are dealt, and their measures leave a task together."""
    from scoretables.catalog import QUERIES

    spark.range(3000).selectExpr("IF(id % 10 = 9, NULL, id) AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "CAST(id % 50 AS INT) AS p_size", "1.0D AS p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name, per in (("S2_ingest_musicxml", 5), ("S2_musicxml_measures", 2)):
        got = QUERIES[name](spark, str(tmp_path))
        sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 2
        assert got.filter("p_partkey = 7").count() == per
        assert sum(sizes) == 2700 * per
