"""Personal data: base spans against Python's patterns, trees against the library that grew them, and what training adds."""

import hashlib
import re

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from scoretables.llm import QUERIES, pii

SCHEMA = "doc_id bigint, text string, base string, spans string, value string, proposed int"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else None, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain(text):
    """(counts of the kinds, digest of the base spans, base spans)."""
    spans = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if good(kind, m.group())]
    spans = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]
    return tuple(sum(s.startswith(k + ":") for s in spans) for k in pii.KINDS), hashlib.sha256(",".join(spans).encode()).hexdigest(), spans


@pytest.fixture(scope="module")
def judge(spark):
    return pii.train(pii.labelled(spark))


def told(df):
    return [(r.doc_id, r.b, r.s) for r in df.select("doc_id", pii.named(F.col("base")).alias("b"), pii.named(F.col("spans")).alias("s")).collect()]


AWKWARD = [
    None, "", " ", "a@b.c", "a@b.c_x@y.z", "a@b.c.d@e.f", "x@@y.z q@w", "é.x@y.com ü@ö.de", "日本 tom@mail.com 日本 1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "001.02.3.0004", "1.2.3 4.5.6.7",
    "4111 1111 1111 1111", "4111-1111-1111-1111x", "x4111111111111111", "4111  1111  1111  1111", "4111111111111112", "0" * 12, "0" * 19, "0" * 20, "0" * 11, "1 4111111111111111", "5 4111-1111 1111-1111 9", "4111111111111111 - 4111111111111111",
    "+1 (555) 123-4567", "+1 (555) 123-4567.", "+49 30 123456-", "++1 222 333 444", "+1", "+12", "+1 2", "+123456789", "+12345678", "+1234567890123456", "+1 555 123 4567 +44 20 7946 0958", "+1 4111111111111111",
    "mail a@b.co or 10.0.0.1, call +1 222 333 4444 4111111111111111\n+1 (2) 3", "a" * 30_000 + "@x.y", "1" * 30_000, ("1.2.3.4 " * 700) + ("a@b.c " * 700), "1 " * 20_000, "+" * 5000, "a.b." * 5000, "@" * 3000, ":" * 5000, "(at) " * 2000, "😀 a@b.c 😀"]


def test_base_spans(spark, judge):
    rows = [(i, t, "b", "s", "v", 1) for i, t in enumerate(AWKWARD)] + [(None, "a@b.c", "b", "s", "v", 1), (0, "1.2.3.4", "b", "s", "v", 1), (0, "1.2.3.4", "b", "s", "v", 1)]
    got = told(pii.find(spark.createDataFrame(rows, SCHEMA).repartition(4), judge))
    assert sorted((str(i), b) for i, b, _ in got) == sorted((str(r[0]), ",".join(plain(r[1])[2])) for r in rows)
    for _, base, spans in got:
        assert set(filter(None, base.split(","))) <= set(spans.split(","))
    assert pii.find(spark.createDataFrame([], SCHEMA), judge).count() == 0


def test_query_over_whole_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op11_pii"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == plain(texts[r.doc_id])[:2]
        assert set(plain(texts[r.doc_id])[2]) <= set(r.spans.split(","))


def test_places_of_many_matches(spark):
    rows = spark.createDataFrame([(" ".join(f"{'x' * (i % 5)} {i % 256}.2.3.4" for i in range(3000)),)], "text string")
    text = rows.first().text
    got = pii.base_spans(rows).first().base
    assert [(s.start, s.end) for s in got] == [m.span() for m in re.finditer(PATTERNS["ip"], text)]


def test_training_adds_what_the_patterns_miss_and_not_what_looks_alike(spark, judge):
    private = ["reach me: anna.berg (at) example (dot) com", "write to jürgen.müller@firma.de", "host fe80::1a2b:3c4d:5e6f", "call (555) 123-4567 today", "tel: 030/1234567", "telefon 040 234 5678 or"]
    other = ["the date 2023-11-05 was", "version 1.22.3.4567 is", "at 12:30:45 the", "order 20231105123457 was", "pages 1234-5678 of", "we stay at home dot", "nothing here", "std::vector::x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(private + other)], "doc_id bigint, text string")
    got = {i: s for i, _, s in told(pii.find(rows, judge))}
    assert all(got[i] for i in range(len(private))), got
    assert [got[i] for i in range(len(private), len(got))] == [""] * len(other)
    assert all(0 < t <= 1 for t in judge.thresholds)


def test_trees_as_expressions_score_as_the_library_does(spark):
    rows = spark.range(400).select((F.rand(1) * 4).alias("a"), (F.rand(2) * 4).alias("b")).withColumns({"label": F.when((F.col("a") > 1) != (F.col("b") > 2), 1.0).otherwise(0.0), "f": F.array("a", "b")}).cache()
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(rows.select("label", array_to_vector("f").alias("features")))
    judge = pii.Judge({}, [pii._tree(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights), [])
    from pyspark.ml.functions import vector_to_array

    both = model.transform(rows.withColumn("features", array_to_vector("f"))).select(vector_to_array("probability")[1].alias("p"), judge.score(F.col("f")).alias("q")).collect()
    assert max(abs(r.p - r.q) for r in both) < 1e-9


def test_labelled_examples_are_fixed_and_bounded(spark):
    a, b = (sorted(map(tuple, pii.labelled(spark, 200).collect())) for _ in range(2))
    assert a == b and len(a) == 200 and sum(r[-1] for r in a) == 100
    for _, text, kind, start, end, label in a:
        assert text[start:end].strip() == text[start:end] and (label or kind in range(4))


def test_redacted_texts(spark, judge):
    rows = [(1, "mail a@b.com, call +1 222 333 4444 now", "b", "s", "v", 1), (2, None, "b", "s", "v", 1), (3, "é jürgen.müller@firma.de é", "b", "s", "v", 2), (4, "plain", "b", "s", "v", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = pii.redact(df, judge)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == "mail [EMAIL], call [PHONE] now" and got[2] is None and got[4] == "plain" and "@" not in got[3] and got[3].startswith("é [EMAIL]")
