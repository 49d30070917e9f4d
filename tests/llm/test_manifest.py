"""The Merkle manifest against a plain one that folds lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from scoretables.llm import QUERIES, manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, part string, h int, idx int"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grow(leaves, fanout):
    """Levels of digests, the last one of a single node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels, i, fanout):
    """(digests left of the own one, digests right of it) of each run on the way up."""
    out = []
    for level in levels[:-1]:
        a = i // fanout * fanout
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
        i //= fanout
    return out


def plain(rows, fanout=8):
    """Sorted rows of the query; rows: (doc_id, text, lang, source, n_chars)."""
    made, parts = [], {}
    for doc_id, text, lang, source, n in rows:
        leaf, other = (H("".join(map(enc, (doc_id, source, lang, n, t)))) for t in (text, text and text.translate(LOWER)))
        parts.setdefault(lang, []).append((doc_id, leaf, other))
    langs = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        parts[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {x: grow([r[1] for r in parts[x]], fanout) for x in langs}
    top = grow([trees[x][-1][0] for x in langs], fanout) if langs else [[None]]
    for j, x in enumerate(langs):
        for i, (doc_id, leaf, other) in enumerate(parts[x]):
            path = way(trees[x], i, fanout) + way(top, j, fanout)
            cur = other if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else leaf
            for a, b in path:
                cur = H(a + cur + b)
            made.append((str(doc_id), leaf, trees[x][-1][0], top[-1][0], H("".join(a + b for a, b in path)), cur, cur == top[-1][0]))
    return sorted(made)


def told(spark, docs, fanout=8):
    out = manifest.manifest(docs, fanout=fanout)
    start = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.col("tampered")).otherwise(F.col("leaf"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(F.transform("path", manifest.siblings), ""), 256), manifest.fold(start, F.col("path")).alias("f"))
    return sorted((str(r[0]), *r[1:], r.f == r.root) for r in out.collect())


def awkward(n, langs):
    rows = [(i, f"Text {i} É", langs[i * i % len(langs)], f"src{i % 3}" if i % 7 else None, i) for i in range(n)]
    return rows + [(None, "no Id", "en", "s", 1), (None, None, None, None, None), (5, "again", "en", "s", 2), (5, "again", "en", "s", 2), (-3, "", "en", "s", 0), (10**15, "A" * 100_000, "de", "s", 9)]


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_manifest(spark, fanout):
    rows = awkward(150, ["en", "en", "de", None, "fr"])
    docs = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA).repartition(5)
    assert told(spark, docs, fanout) == plain(rows, fanout)


def test_manifest_of_many_parts_and_lone_leaves(spark):
    rows = [(i, "x", f"l{i % 40:02}é", "s", 1) for i in range(70)]
    assert told(spark, spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA)) == plain(rows)
    for few in ([(1, "One", "en", None, 3)], [(1, "One", "en", None, 3), (2, "Two", None, None, 3)], [(i, "Q", "en", "s", 1) for i in range(9)]):
        assert told(spark, spark.createDataFrame([(*r, "a", 1, 2) for r in few], SCHEMA)) == plain(few)


def test_manifest_of_equal_rows_and_of_none(spark):
    rows = [(1, "same", "en", "s", 4)] * 20 + [(2, "Other", "en", "s", 5)]
    assert told(spark, spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA)) == plain(rows)
    assert told(spark, spark.createDataFrame([], SCHEMA)) == []


def test_proofs_hold_for_what_was_not_changed_and_for_nothing_else(spark):
    rows = QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id").collect()
    assert rows
    for r in rows:
        hit = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None and r.text != r.text.translate(LOWER)
        assert r.verified == (not hit)
