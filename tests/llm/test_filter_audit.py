"""The audit against a plain one that filters lists in every order."""

import collections
import itertools
import re

import pytest

from scoretables.llm import filter_audit

SCHEMA = "doc_id bigint, text string, source string, mask int, part string, delta bigint"


def failing(rows):
    """(part, letters that fail, doc_id) of each row (doc_id, text, source)."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        out.append((source or "", {k for k, v in fails.items() if v}, i))
    return out


def plain(rows, labels):
    good, toxic = ({i for i, *flags in labels if flags[j] == 1} - {None} for j in (0, 1))
    parts = collections.defaultdict(list)
    for part, fails, i in failing(rows):
        parts[part].append((fails, i in good, i in toxic))
    out, total = {}, collections.Counter()
    for part, rows_ in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = rows_
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                fails = sum(f in r[0] for r in rows_)
                out[part, "".join(order), step] = (len(left), len(gone), fails - len(gone), sum(r[0] == {f} for r in rows_), sum(r[1] for r in gone), sum(r[2] for r in gone))
                total[part, f] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def told(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [(9, LONG, "a"), (7, LONG, "b"), (8, LONG, "a"), (3, LONG, "a"), (3, LONG, "a"), (3, LONG, "c"), (5, LONG, None), (None, LONG, "a"), (None, None, None), (4, None, "a"), (2, "", "a"),
        (10, "SHOUT " * 60, "b"), (11, "a # b", "b"), (12, LONG + " 日本語 $", "b"), (13, "x y z " * 30, "b"), (1, "SHOUT " * 60, "a"), (14, LONG.upper() + " *", ""), (15, "word " * 300_000, "b")]
LABELS = [(3, 1, 0), (3, 0, 1), (8, 0, 1), (9, 1, None), (10, 1, 1), (7, None, None), (None, 1, 1)]


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("turn", [1, -1])
def test_smaller_ids_take_back_what_was_counted(spark, tmp_path, labels, turn):
    for i, row in enumerate(ROWS[::turn]):
        spark.createDataFrame([(*row, 1, "p", 2)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    got = told(filter_audit.filter_audit(spark, str(tmp_path / "docs"), labels, batches=6))
    assert got == plain(ROWS, LABELS)


def test_retractions_occur_and_a_restart_counts_only_new_files(spark, tmp_path, labels):
    docs, at = str(tmp_path / "docs"), str(tmp_path / "stream")
    spark.createDataFrame([(*r, 1, "p", 2) for r in ROWS[:3]], SCHEMA).coalesce(1).write.parquet(docs)
    first = filter_audit.counters(spark, docs, labels, checkpoint=at)
    assert {(r.part, r.n) for r in first.filter("mask = 0").collect()} == {("b", 1)}
    spark.createDataFrame([(*r, 1, "p", 2) for r in ROWS[3:]], SCHEMA).coalesce(3).write.mode("append").parquet(docs)
    again = filter_audit.counters(spark, docs, labels, checkpoint=at)
    assert told(filter_audit.audit(again, "ABCDE")) == plain(ROWS, LABELS)
    said = spark.read.parquet(f"{at}/changes")
    assert said.filter("delta < 0").count() > 0
    # without new files nothing is counted twice
    assert told(filter_audit.audit(filter_audit.counters(spark, docs, labels, checkpoint=at), "ABCDE")) == plain(ROWS, LABELS)


def test_one_file_one_row_and_none(spark, tmp_path, labels):
    one = str(tmp_path / "one")
    spark.createDataFrame([(1, "A b", "s", 1, "p", 2)], SCHEMA).coalesce(1).write.parquet(one)
    file = next(str(p) for p in (tmp_path / "one").glob("*.parquet"))
    assert told(filter_audit.filter_audit(spark, file, labels)) == plain([(1, "A b", "s")], LABELS)
    none = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(none)
    assert told(filter_audit.filter_audit(spark, none, labels)) == {}


def test_other_filters_and_no_labels(spark, tmp_path):
    docs = str(tmp_path / "docs")
    spark.createDataFrame([(*r, 1, "p", 2) for r in ROWS], SCHEMA).coalesce(2).write.parquet(docs)
    got = told(filter_audit.filter_audit(spark, docs, filters={"S": lambda text, words: text.contains("SHOUT")}))
    repeats = {(p, i) for p, f, i in failing(ROWS) if "E" in f}
    assert {k[1] for k in got} == {"SE", "ES"} and sum(v[1] for k, v in got.items() if k[1:] == ("ES", 1)) == len([1 for p, f, i in failing(ROWS) if "E" in f]) and repeats
    assert sum(v[1] for k, v in got.items() if k[1:] == ("SE", 1)) == 2
