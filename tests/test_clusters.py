"""Clusters by the running median against the rule written as a loop."""

import random

import pytest

from scoretables.operators import stats as S


def plain(values, tol):
    """{value: cluster number} of one group."""
    out, cluster, now = {}, 0, []
    for v in sorted(values):
        if now:
            mid = now[len(now) // 2]
            if abs(v - mid) / max(mid, 0.01) > tol:
                cluster, now = cluster + 1, []
        now.append(v)
        out[v] = cluster
    return out


def groups():
    r = random.Random(5)
    yield "drift", [round(4 * 1.01**i, 5) for i in range(120)]
    yield "copies", [1.0] * 50 + [1.05] * 3 + [1.07] * 40 + [1.09, 1.1, 1.12] * 9 + [2.0]
    yield "mixed", [round(r.lognormvariate(1, 0.4), 3) for _ in range(300)]
    yield "small", [0.0, 0.0, 0.0005, 0.0007, 0.001, 0.5]
    yield "minus", [-3.0, -1.0, 0.0, 2.0]
    yield None, [7.0, 7.1, 7.5, 9.0]
    yield "one", [3.0]


def told(spark, tol):
    rows = [(g, v) for g, values in groups() for v in values] + [("one", None), ("one", float("nan"))]
    got = {}
    for r in S.median_clusters(spark.createDataFrame(rows, "g string, x double").repartition(6), ["g"], "x", tol).collect():
        got.setdefault(r.g, {})[r.x] = (r.cluster, r.n)
    return got


@pytest.mark.parametrize("tol", [0.06, 0.3])
def test_running_median(spark, tol):
    got = told(spark, tol)
    for g, values in groups():
        assert got[g] == {v: (c, values.count(v)) for v, c in plain(values, tol).items()}
    assert len(set(plain(dict(groups())["drift"], 0.06).values())) > 5


def test_running_median_of_cut_groups(tiny_groups):
    got = told(tiny_groups, 0.06)
    for g, values in groups():
        assert got[g] == {v: (c, values.count(v)) for v, c in plain(values, 0.06).items()}


def test_no_rows(spark):
    assert S.median_clusters(spark.createDataFrame([], "g string, x double"), ["g"], "x", 0.1).count() == 0
