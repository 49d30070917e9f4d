"""Words that defeat simple hashes: the operators must agree with their plain forms on them."""

import hashlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from scoretables.llm import decontaminate, licenses, near_dup, quality_rules, substring_dedup
from scoretables.llm.common import Texts, Words


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters whose polynomial hashes modulo 2**64 are equal for every odd base from n = 1,024 on."""
    x = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return x, x.translate(str.maketrans("ab", "ba"))


X, Y = thue_morse(1024)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 63, 64, 65, 1024, 5000])
def test_hashes_tell_words_apart(n):
    x, y = thue_morse(n)
    w = Words(Texts(pa.array([f"{x} {y} {x}", f"{y}", f"q{x} {x}q"])))
    h = w.hashes()
    assert h[0] == h[2] and h[1] == h[3]
    assert len(np.unique(h)) == 4


def test_hashes_of_many_words_differ():
    words = [f"{a}{i}" for a in ("", "a", "aaaaaaa", "aaaaaaaaaaaaaaa") for i in range(20_000)]
    assert len(np.unique(Words(Texts(pa.array([" ".join(words)]))).hashes())) == len(set(words))


def test_operators_on_colliding_words(spark):
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{X} {tail}"), (2, f"{Y} {tail}"), (3, f"{X} b c d e"), (4, f"{Y} b c d e"), (5, f"{X} {tail}"), (6, f"{X}\n{Y}\n{X}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.dedup(docs).collect()}
    assert got == brute.substring(rows) and got[2][1] == 0 and got[5][1] == 13
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()} == brute.near(rows)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = {r.doc_id: tuple(r[c] for c in quality_rules.COUNTS) for r in quality_rules.judge(docs, labels).collect()}
    assert got == {i: brute.rule_counts(x) for i, x in rows}
    items = [(1, f"{Y} b c d e"), (2, f"{Y} w0")]
    found = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.doc_id: list(r.item_ids) for r in found.collect()} == {1: [], 2: [2], 3: [], 4: [1], 5: [], 6: []}
    got = licenses.scan(docs, phrases={f"{X} b": "x"}, templates={f"{Y} b c": "y"}, percent=100, by="windows").collect()
    assert {r.doc_id: r.labels for r in got} == {1: "", 2: "", 3: "x", 4: "y", 5: "", 6: ""}
