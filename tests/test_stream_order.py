"""The pairing stream against the batch form, with rows that arrive out of order, and from its checkpoint."""

import random

import pytest
from pyspark.sql import functions as F

from scoretables.operators import notes as N
from scoretables.streaming.ordered import pair_table

SCHEMA = "id bigint, key string, ts timestamp, kind string"


def rows(n=400):
    r = random.Random(2)
    out = []
    for i in range(n):
        # many rows share a second, so the id settles their order
        minute = i // 8
        out.append((i, r.choice("abc"), f"2024-01-01 {minute // 60:02}:{minute % 60:02}:{r.randrange(2) * 30:02}", r.choice(["on", "off", "on", "off", "other"])))
    return out + [(n, "late", "2024-01-01 00:00:00", "on"), (n + 1, "off", "2024-01-01 00:05:00", "off"), (n + 2, None, "2024-01-01 00:05:00", "on")]


def frame(spark, part):
    return spark.createDataFrame(part, "id bigint, key string, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))


def told(df):
    return sorted((r.key, r.k, r.t_on, r.t_off) for r in df.collect())


def batch(spark, part):
    pairs = N.pair_on_off(frame(spark, part).filter("key IS NOT NULL"), ["key"], ["ts", "id"], "id", F.col("kind") == "on", F.col("kind") == "off")
    return told(pairs)


def stream(spark, path, folder, **more):
    return pair_table(spark, path, lambda e: e, ["key"], "ts", "id", "id", F.col("kind") == "on", F.col("kind") == "off", folder=folder, files_per_batch=1, **more)


@pytest.mark.parametrize("shuffled", [False, True])
def test_pairs_of_files_in_any_order(spark, tmp_path, shuffled):
    all_rows = rows()
    parts = [all_rows[i::3] for i in range(3)]
    if shuffled:
        random.Random(1).shuffle(all_rows)
        parts = [all_rows[:150], all_rows[150:300], all_rows[300:]]
    docs = str(tmp_path / "in")
    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(docs)
    assert told(stream(spark, docs, str(tmp_path / "s"), idle=10**7)) == batch(spark, rows())


def test_going_on_from_the_checkpoint(spark, tmp_path):
    docs, folder = str(tmp_path / "in"), str(tmp_path / "s")
    all_rows = rows()
    frame(spark, all_rows[:200]).coalesce(1).write.parquet(docs)
    first = told(stream(spark, docs, folder, idle=10**7, delay="10 minutes", close=False))
    frame(spark, all_rows[200:400]).coalesce(1).write.mode("append").parquet(docs)
    assert len(told(stream(spark, docs, folder, idle=10**7, delay="10 minutes", close=False))) > len(first) > 0
    # nothing new: nothing is said twice
    want = batch(spark, all_rows[:400])
    assert told(stream(spark, docs, folder, idle=10**7, delay="10 minutes")) == want
    assert told(stream(spark, docs, folder, idle=10**7, delay="10 minutes", close=False)) == want


def test_keys_without_pairs_make_no_frames():
    import pandas as pd

    from scoretables.streaming.ordered import Pairing

    class State(list):
        def appendList(self, rows):
            self.extend(rows)

    class Handle:
        timers = []

        def getListState(self, *_):
            return State()

        getValueState = getListState

        def registerTimer(self, ms):
            self.timers.append(ms)

    p = Pairing(["g"], 10)
    p.init(Handle())
    rows = pd.DataFrame({"ms_": [5, 3], "seq_": [1, 2], "at_": [7, 8], "on_": [True, False]})
    assert list(p.handleInputRows((1,), iter([rows]), None)) == []
    assert list(p.waiting) == [(5, 1, 7, True), (3, 2, 8, False)] and Handle.timers == [3]
