"""Terms in texts, and styles from rules with many conditions."""

import random
import re

from pyspark.sql import functions as F

from scoretables.functions import text as X
from scoretables.operators import joins as J


def test_terms_are_words(spark):
    texts = ["poco rit.", "D.S.", "praise", "divine", "D. C. al Fine", "RALL", "riten", "rite", "a tempo", "contempo", "soló", "solo", "unisono", "d.c", "d,c", "dim-", "", None, "Più mosso", "sub_", "d.  s"]
    pattern = re.compile(r"\b(?:" + "|".join(t.replace(".", r"\. ?") for t in X.TERMS) + r")\b", re.I)
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.has_term("t").alias("t")).orderBy("i").collect()]
    assert got == [None if t is None else bool(pattern.search(t)) for t in texts]
    assert spark.range(1).select(X.has_term(F.lit("a"), [])).first()[0] is False


def test_ten_thousand_terms_in_one_pass(spark):
    r = random.Random(3)
    terms = sorted({"".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(10_500)})[:10_000]
    known = set(terms)
    texts = [" ".join(r.choice(terms) + r.choice(["", "x", "a"]) if i % 7 == 0 else "zz" for _ in range(5)) for i in range(500)] + ["a.b+c (abc) [x] ^$"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("hit", X.has_term("t", terms))
    assert {r.i for r in df.filter("hit").collect()} == {i for i, t in enumerate(texts) if known & set(re.findall(r"\w+", t))}
    assert len(df._jdf.queryExecution().executedPlan().toString().split("RLIKE")) <= 3


def test_rules_with_many_conditions(spark):
    r = random.Random(4)
    conditions = [f"c{i}" for i in range(12)]
    rules = [(i, *[r.choice([None, None, None, 0, 1]) if i % 4 else None for _ in conditions], r.choice([None, f"p{i}"]), f"q{i}" if i % 3 else None) for i in range(80)]
    contexts = [tuple(r.choice([None, 0, 1, 1]) for _ in conditions) for _ in range(60)]
    ddl = ", ".join(f"{c} int" for c in conditions)
    got = J.cascade(spark.createDataFrame(rules, f"no int, {ddl}, p string, q string"), spark.createDataFrame(contexts, ddl), conditions, "no", ["p", "q"])
    want = {}
    for x in set(contexts):
        ok = [u for u in rules if all(a is None or a == b for a, b in zip(u[1:13], x, strict=True))]
        want[x] = tuple(next((u[k] for u in reversed(ok) if u[k] is not None), None) for k in (13, 14))
    assert {tuple(row[:12]): tuple(row[12:]) for row in got.collect()} == want
    bound = [u for u in rules if u[2]]
    got = J.cascade(spark.createDataFrame(bound, f"no int, {ddl}, p string, q string"), spark.createDataFrame([], ddl), conditions, "no", ["p"])
    assert got.count() == 0
