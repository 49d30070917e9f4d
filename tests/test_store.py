"""The bucketed store: what is read and written, and results as those of whole tables."""

import random

from pyspark.sql import functions as F

from scoretables.sources.store import Store

SCHEMA = "a int, b string, v double"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    r = random.Random(6)
    store = Store(spark, str(tmp_path), ["a", "b"], 16)
    assert store.read() is None
    have = {}
    for step in range(4):
        rows = {(r.choice([None, *range(60)]), r.choice(["x", "y", None])): float(step * 100 + i) for i in range(40 if step < 2 else 2)}
        old = {e.path for e in store._manifest()}
        df = spark.createDataFrame([(*k, v) for k, v in rows.items()], SCHEMA)
        touched = set(store.touched(df))
        store.upsert(df)
        have |= rows
        assert rows_of(store.read()) == sorted(((*k, v) for k, v in have.items()), key=str)
        now = {(e.bucket, e.path) for e in store._manifest()}
        assert {b for b, p in now if p not in old} == touched
        if step > 1:
            assert len(touched) <= 2 and len({b for b, _ in now}) == 16
            # a look-up of these buckets reads their files alone
            assert len(store.read(sorted(touched)).inputFiles()) == len(touched)


def test_readers_see_a_change_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path), ["a"], 4)
    store.upsert(spark.createDataFrame([(i, "x", 0.0) for i in range(20)], SCHEMA))
    before = store.read()
    written = store._write(spark.createDataFrame([(1, "half", 1.0)], SCHEMA))  # a run that ended before its manifest
    assert written and rows_of(Store(spark, str(tmp_path), ["a"], 4).read()) == rows_of(before)
    store.upsert(spark.createDataFrame([(1, "y", 1.0)], SCHEMA))
    assert rows_of(before) == sorted([(i, "x", 0.0) for i in range(20)], key=str)
    assert [tuple(r) for r in store.read().filter("a = 1").collect()] == [(1, "y", 1.0)]


def test_work_is_done_once_for_each_key(spark, tmp_path):
    store = Store(spark, str(tmp_path), ["k"], 8)
    seen = []

    def work(df):
        seen.append(df.count())
        return df.select("k", F.upper("t").alias("u"))

    first = spark.createDataFrame([(f"k{i}", f"t{i}") for i in range(50)] + [("k1", "t1")], "k string, t string")
    assert rows_of(store.apply(first, work)) == sorted((f"k{i}", f"T{i}") for i in range(50))
    more = spark.createDataFrame([("k3", "other"), ("n1", "new")], "k string, t string")
    assert rows_of(store.apply(more, work)) == [("k3", "T3"), ("n1", "NEW")]
    assert seen == [50, 1]
    assert rows_of(store.apply(more, work)) == [("k3", "T3"), ("n1", "NEW")] and seen[-1] == 0
