"""Range joins and lookups with one outsized range, number or key."""

import random

from pyspark.sql import functions as F

from scoretables.operators import joins as J
from scoretables.operators import shapes as H
from scoretables.plans.timeline import expand_passes


def test_overlaps_with_one_very_long_note(spark):
    rnd = random.Random(3)
    notes = [(i, s := rnd.uniform(0, 4000), s + rnd.choice([0.5, 3, 90])) for i in range(300)] + [(999, 0.0, 5e8)]
    bars = [(i, i * 4.0, i * 4.0 + 4) for i in range(1000)]
    n, b = spark.createDataFrame(notes, "n int, t0 double, t1 double"), spark.createDataFrame(bars, "b int, lo double, hi double")
    got = J.overlap_join(n.withColumn("s", F.lit(1)), b.withColumn("s", F.lit(1)), ["s"], ("t0", "t1"), ("lo", "hi"), 4.0).select("n", "b").collect()
    want = [(i, k) for i, x, y in notes for k, lo, hi in bars if y > lo and x < hi]
    assert sorted(map(tuple, got)) == sorted(want)


def test_points_at_fractions_and_a_huge_span(spark):
    points = spark.createDataFrame([(1, 0.5), (1, 2.25), (1, 7.0), (1, 10.0**11)], "s int, pos double")
    spans = spark.createDataFrame([(1, 2.0, 3.0, 5, False), (1, 0.0, 1.0e12, 9, False), (1, 7.0, None, 7, False), (1, None, None, 8, True)], "s int, lo double, hi double, o int, a boolean")
    got = J.point_in_range(points, spans, ["s"], "pos", "lo", "hi", F.col("a"), "o").orderBy("pos").collect()
    assert [(r.pos, r.o) for r in got] == [(0.5, 8), (2.25, 5), (7.0, 7), (10.0**11, 8)]


def test_lines_in_a_huge_frame(spark):
    frames = spark.createDataFrame([(1, 1, 0.0, 0.0, 5e7, 5e7), (1, 2, 10.0, 10.0, 6.0, 6.0)], "page int, f int, x double, y double, w double, h double")
    lines = spark.createDataFrame([(1, 1, 11.0, 11.0, 2.0, 2.0), (1, 2, 4e6, 1.0, 9.0, 1.0), (1, 3, -9.0, 0.0, 1.0, 1.0)], "page int, l int, lx double, ly double, lw double, lh double")
    got = J.containment_join(frames, lines, ["page"], ["x", "y", "w", "h"], ["lx", "ly", "lw", "lh"], 0.5, 4.0).select("f", "l").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (2, 1)]


def test_contents_list_with_a_misread_number(spark):
    toc = spark.createDataFrame([(1, 1, 5), (1, 30_000, 9), (2, 2, 4)], "book int, number bigint, page bigint")
    found = spark.createDataFrame([(1, 1, 5), (2, 3, 4)], "book int, number bigint, page bigint")
    out = J.toc_reconcile(found, toc, "book", "number", "page").cache()
    assert out.filter("kind = 'missing' AND book = 1").count() == 29_999
    assert sorted(tuple(r) for r in out.filter("book = 2").collect()) == [(2, "extra", 3, None, None), (2, "missing", 1, None, None), (2, "missing", 2, 4, None)]


def test_signatures_that_share_a_blank_piece(spark):
    rnd = random.Random(8)
    shapes = [("k%d" % i, [0, rnd.getrandbits(62)], "c%d" % i) for i in range(300)]
    objs = [(i, "x%d" % i, [0, shapes[i][1][1] ^ (1 << rnd.randrange(60)) ^ (1 << rnd.randrange(60))]) for i in range(300)]
    o = spark.createDataFrame(objs, "id int, key string, sig array<bigint>")
    s = spark.createDataFrame(shapes, "key string, sig array<bigint>, label string")
    near = H.exact_then_fuzzy(o, s, "id", "key", "sig", "label", 3, 8)
    got = {r.id: (r.label, r.dist) for r in near.collect()}
    want = {}
    for i, _, sig in objs:
        d, label = min((sum(bin(a ^ b).count("1") for a, b in zip(sig, t)), c) for _, t, c in shapes)
        if d <= 3:
            want[i] = (label, d)
    assert got == want


def test_rules_are_reduced_before_they_meet_contexts(spark):
    rules = spark.createDataFrame([("a", None, i, i, None) for i in range(500)] + [(None, "y", 1000, None, 7), (None, None, 2000, 5, None)], "c1 string, c2 string, o int, p int, q int")
    ctx = spark.createDataFrame([("a", "y"), ("b", "y"), ("a", "z")], "c1 string, c2 string")
    got = {(r.c1, r.c2): (r.p, r.q) for r in J.cascade(rules, ctx, ["c1", "c2"], "o", ["p", "q"]).collect()}
    assert got == {("a", "y"): (5, 7), ("b", "y"): (5, 7), ("a", "z"): (5, None)}


def test_passes_meet_only_measures_they_play(spark):
    measures = spark.createDataFrame([(1, m, 1.0) for m in range(500)], "song int, measure int, len double")
    passes = spark.createDataFrame([(1, p, p * 3, p * 3 + 3, 1, 0.0, None) for p in range(100)] + [(1, 200, 60, 70, 1, 0.0, None)], "song int, pass_ix int, mid int, end_mid int, pass int, offset double, until double")
    got = expand_passes(passes, measures, ["song"]).select("pass_ix", "measure").collect()
    assert sorted(map(tuple, got)) == sorted([(p, p * 3 + k) for p in range(100) for k in range(3)] + [(200, m) for m in range(60, 70)])


def joins_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [name for name in ("BroadcastHashJoin", "SortMergeJoin") if name in plan]


def test_rows_spread_over_buckets_are_not_broadcast(spark, tmp_path):
    """Files small enough for a broadcast whose rows become many more by explode()."""
    spark.range(2000).selectExpr("id AS s", "id * 1.0D AS lo", "id + 900.0D AS hi", "1 AS o", "false AS a", "0.0D AS y", "9.0D AS w").write.parquet(f"{tmp_path}/r")
    r = spark.read.parquet(f"{tmp_path}/r")
    n = r.selectExpr("s", "lo AS t0", "lo + 1 AS t1")
    assert joins_of(J.overlap_join(n, r.select("s", "lo", "hi"), ["s"], ("t0", "t1"), ("lo", "hi"), 4)) == ["SortMergeJoin"]
    assert "SortMergeJoin" in joins_of(J.point_in_range(r.selectExpr("s", "lo AS pos"), r, ["s"], "pos", "lo", "hi", F.col("a"), "o"))
    frames, lines = r.selectExpr("s", "lo AS fx", "y AS fy", "w AS fw", "w AS fh"), r.selectExpr("s", "lo AS x", "y", "w", "w AS h")
    assert joins_of(J.containment_join(frames, lines, ["s"], ["fx", "fy", "fw", "fh"], ["x", "y", "w", "h"], 1.0, 4.0)) == ["SortMergeJoin"]
    passes = r.selectExpr("s", "0 AS mid", "6400 AS end_mid")
    assert joins_of(expand_passes(passes, r.selectExpr("s", "o AS measure"), ["s"])) == ["SortMergeJoin"]


def test_rules_meet_the_characters_where_they_are(spark):
    """A shuffle by character would send one character's rows of all texts to one task."""
    rules = spark.createDataFrame([(1, "a", None, "b", None, None, "A"), (2, "a", None, None, None, True, "#")], "rule_no int, ch string, prev2 string, prev string, next string, at_end boolean, fixed string")
    fixed = J.rule_fix(spark.createDataFrame([(1, "baab"), (2, "aaa"), (None, "ba"), (3, None), (4, "")], "d int, line string"), "line", rules, "d")
    assert joins_of(fixed) == ["BroadcastHashJoin"]
    assert sorted(map(tuple, fixed.collect()), key=str) == sorted([(1, 1, "a", "A"), (2, 2, "a", "#"), (None, 1, "a", "A")], key=str)
