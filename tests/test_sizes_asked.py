"""What ordered passes count before they run is cheap: a table's keys or rows already written, not the job so far."""

from pyspark.sql import functions as F

from scoretables.operators import scan
from scoretables.operators.sequence import carry_attr
from scoretables.plans.beats import beat_check
from scoretables.plans.timeline import build_timeline


def asked(monkeypatch):
    plans, plain = [], scan._sizes

    def sizes(df, keys, max_rows):
        plans.append(df.select(*keys)._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, keys, max_rows)

    monkeypatch.setattr(scan, "_sizes", sizes)
    return plans


def test_build_timeline_counts_no_joins(spark, monkeypatch):
    plans = asked(monkeypatch)
    passes = spark.createDataFrame([(1, 0, 0, 2, 1, None, None), (1, 1, 0, 1, 2, None, None)], "song int, pass_ix int, mid bigint, end_mid bigint, pass bigint, offset double, until double")
    measures = spark.createDataFrame([(1, 0, 4.0), (1, 1, 4.0)], "song int, measure bigint, len double")
    notes = spark.createDataFrame([(1, 0, 1, 0, 3.0, 1.0, 60, False, None), (1, 1, 2, 0, 0.0, 2.0, 60, True, 80.0)],
                                  "song int, measure bigint, note_ix int, part int, pos double, dur double, pitch int, tie_stop boolean, velocity double")
    got = sorted((r.t0, r.t1, r.velocity, r.pieces, r["pass"]) for r in build_timeline(passes, measures, notes, ["song"]).collect())
    assert got == [(3.0, 6.0, 100.0, 2, 1), (11.0, 12.0, 100.0, 1, 2)]
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_beat_check_counts_a_given_probe_once(spark, monkeypatch):
    plans = asked(monkeypatch)
    lines = spark.createDataFrame([(1, 1, 0, 4.0), (1, 2, 0, 3.0), (1, 2, 1, 4.0), (1, 3, 0, 4.0)], "song int, measure bigint, voice int, q double")
    m = lines.groupBy("song", "measure").agg({"q": "max"}).selectExpr("song", "measure", "false AS implicit", "4.0D AS chg")
    none, probe = F.lit(None).cast("double"), lines.select("song")
    m = carry_attr(m, ["song"], ["measure"], F.col("chg"), none, none, F.lit(4.0), "w", probe=probe)
    m = m.select("song", "measure", "implicit", F.array("w").alias("wants"))
    before = len(scan._SIZES)
    got = sorted(map(tuple, beat_check(m, lines, ["song"], "measure", "voice", "q", probe=probe).collect()))
    assert got == [(1, 2, "length", 4.0, 3.0), (1, 2, "voice", 3.0, 4.0)]
    assert len(scan._SIZES) == before and not any("Aggregate" in p for p in plans)
