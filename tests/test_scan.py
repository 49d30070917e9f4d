"""Ordered passes on a group that holds a third of the rows, and statistics without keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scoretables.operators import stats as S
from scoretables.operators.scan import BLOCK, Ordered, lag, last_value, lead, next_value, row_number, running_max, running_min, running_sum, total


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None, rnd.randrange(40), i, rnd.choice([None, *range(9)])) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, t int, id int, v int")


def test_cut_group_equals_window(skewed):
    passes = dict(s=running_sum("v"), sx=running_sum("v", before=True), sb=running_sum("v", backward=True), lo=running_min("v"), hi=running_max("v", before=True),
                  last=last_value("v"), nxt=next_value("v", before=True), p=lag("v"), n=lead("v"), r=row_number(), all=total("sum", "v"), top=total("max", "v"))
    plain = Ordered.of(skewed, ["g"], ["t", "id"], max_rows=10**6).add(**passes).done()
    cut = Ordered.of(skewed, ["g"], ["t", "id"], max_rows=60)
    assert cut.blocked
    per = cut.df.filter(F.col(BLOCK) >= 0).groupBy("g", BLOCK).count()
    assert per.filter("g = 'hot'").count() > 8 and per.agg(F.max("count")).first()[0] < 250
    got = cut.add(**passes).done()
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_plain_sum_is_the_window_sum(skewed):
    w = Window.partitionBy("g").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.s for r in skewed.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s")).collect()}
    got = {r.id: r.s for r in Ordered.of(skewed, ["g"], ["t", "id"], max_rows=60).add(s=running_sum("v")).done().collect()}
    assert got == want


def test_statistics_without_keys(skewed):
    vals = sorted(r.v for r in skewed.filter("v is not null").collect())
    s = S.summarize(skewed.filter("v is not null"), [], "v").first()
    assert (s.n, s.p25, s.p50) == (len(vals), vals[len(vals) // 4], vals[len(vals) // 2])
    d = skewed.select(F.col("t").cast("double").alias("x"), F.col("id").cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(2.0).alias("h"))
    box = S.content_box(d, [], "x", "y", "w", "h").first()
    assert (box.y, box.h) == (60.0, 2941.0 - 60.0)
    assert S.drop_noise(S.gap_clusters(d, [], "x", 0.5), [], 0.01).count() == 40


def test_statistics_keep_the_null_group(spark):
    rows = [(g, float(v), 2.0, float(v)) for g in (None, "a") for v in (1, 2, 2, 3, 30, 31)]
    d = spark.createDataFrame(rows, "g string, x double, w double, y double")
    both = {None, "a"}
    assert {r.g for r in S.summarize(d, ["g"], "x").collect()} == both
    box = S.content_box(d.withColumn("h", F.lit(1.0)), ["g"], "x", "y", "w", "h").collect()
    assert {r.g for r in box} == both
    assert {r.g for r in S.body_rows(d, ["g"], "x").collect()} == both
    assert {r.g for r in S.families(d.withColumn("h", F.lit(1.0)), ["g"], "x", "w", "y").collect()} <= both
    cut = {r.g: r.boundary for r in S.two_class_split(d.withColumn("h", F.lit(10.0)), ["g"], "x", "h").collect()}
    assert cut[None] == cut["a"] and cut["a"] > 3


def test_summaries_of_blocks_are_cut_up_too(skewed, monkeypatch):
    from scoretables.operators import scan

    monkeypatch.setattr(scan, "LEAST_SUMMARIES", 5)
    passes = dict(s=running_sum("v"), sb=running_sum("v", backward=True), last=last_value("v"), p=lag("v"), all=total("sum", "v"))
    plain = Ordered.of(skewed, ["g"], ["t", "id"], max_rows=10**6).add(**passes).done()
    got = Ordered.of(skewed, ["g"], ["t", "id"], max_rows=60).add(**passes).done()
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_rows_of_played_measures_are_counted(tiny_groups):
    from scoretables.plans.timeline import played_measures

    spark = tiny_groups
    measures = spark.createDataFrame([(1, m, 4.0) for m in range(40)], "song int, measure int, len double")
    passes = spark.createDataFrame([(1, p, 0, 40, 1, 0.0, None) for p in range(20)], "song int, pass_ix int, mid int, end_mid int, pass int, offset double, until double")
    out = played_measures(passes, measures, ["song"])
    assert out.count() == 800 and out.agg(F.max("onset")).first()[0] == 799 * 4.0


def test_many_rows_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks of a pass hold a bounded number of rows, whatever the cores; the results don't change."""
    from scoretables.operators import scan
    from scoretables.operators.joins import misaligned_onsets
    from scoretables.operators.notes import max_concurrency
    from scoretables.plans.timeline import endings_from_passes

    rows = spark.range(6000).selectExpr("IF(id % 300 = 0, NULL, id % 300) AS g", "CAST(id % 7 AS DOUBLE) AS s", "CAST(id % 7 + id % 4 AS DOUBLE) AS e", "id % 11 AS measure", "id % 3 + 1 AS pass", "id")

    def results():
        a = max_concurrency(rows, ["g"], "s", "e")
        b = misaligned_onsets(rows.filter("id % 600 < 300"), rows.filter("id % 600 >= 300"), ["g"], "s", "e", 2.0)
        c = endings_from_passes(rows.select("g", "measure", "pass"), ["g"])
        d = Ordered.of(rows, ["g"], ["id"]).add(r=row_number()).done()
        return d.rdd.getNumPartitions(), [sorted(map(str, x.collect())) for x in (a, b, c, d)]

    _, plain = results()
    monkeypatch.setattr(scan, "TASK_ROWS", 100)
    n, got = results()
    assert n == 60 and got == plain and plain[0] and plain[1] and plain[3]
