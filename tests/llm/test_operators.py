"""Each operator against its plain form, on the smallest tables with awkward rows added."""

import base64
import collections
import hashlib
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scoretables.llm import QUERIES, bpe, decontaminate, language, licenses, near_dup, quality_model, quality_rules, secrets, sharding, substring_dedup
from scoretables.llm.common import Texts, Words, held_out

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, h1 int, source_id int, key string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(40))
ODD = [
    (900_001, None, None, None), (900_002, "", "en", "src0"), (900_003, " \n\t ", "en", "src0"), (900_004, "word", "en", None), (900_005, "word", "en", "src0"),
    (900_006, LONG, "en", "src0"), (900_007, LONG + " end", "en", "src0"), (900_008, f"{PASSAGE} one", "en", "src0"), (900_009, f"two {PASSAGE}", "en", "src0"),
    (900_010, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "en", "src0"), (900_011, "日本語   é́ 123 !!! ##", None, "src0"),
    (900_012, "12345 67890 !!", "en", "src0"), (-5, f"x {PASSAGE} y", "en", "src0"), (900_013, "line\n\nline\n \nline\r\nline", "en", "src0"),
]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(*r, None) for r in ODD], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = real.unionByName(odd)
    # names that the operators use inside
    return out.withColumns({"id": F.lit("a"), "h1": F.lit(1), "source_id": F.lit(2), "key": F.lit("k"), "__key": F.lit(1)}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def loose(spark):
    """Rows without an id, and rows that repeat one."""
    text = f"{PASSAGE} {PASSAGE} tail"
    return spark.createDataFrame([(None, text), (None, None), (1, text), (1, text), (1, "another text of one id"), (2, text)], "doc_id bigint, text string")


def test_words_follow_the_pattern():
    texts = ["Hello  world a", None, "", "x\ty\x0b\x1cz É", " lead "]
    w = Words(Texts(pa.array(texts)))
    got = [bytes(w.texts.buf[s:e]).decode() for s, e in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in brute.words(t)]
    assert w.count.tolist() == [len(brute.words(t)) for t in texts]
    a, b = Words(Texts(pa.array(["one two", "two"]))).hashes()[1:]
    assert a == b


@pytest.mark.parametrize("frequent", [64, 2])
def test_substring_dedup(docs, rows, monkeypatch, frequent):
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.dedup(docs).collect()}
    assert got == brute.substring(rows)


def test_substring_factors(docs):
    got = {r.doc_id: r for r in substring_dedup.dedup(docs).filter("doc_id IN (900008, 900009, 900007)").collect()}
    assert [tuple(f) for f in got[900_008].factors] == [(0, 40, -5)]
    assert [tuple(f) for f in got[900_009].factors] == [(1, 40, -5)]
    assert got[900_007].kept == "end"


def test_substring_loose_rows(loose, empty):
    got = substring_dedup.dedup(loose).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (0, 0), (1, 0), (1, 0), (1, 0), (2, 81)]
    assert substring_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("small", [64, 1])
def test_near_duplicates(docs, rows, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "CHUNK", 64 if small > 1 else 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute.near(rows)


def test_near_duplicates_loose_rows(loose, empty):
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(loose).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dup.near_duplicates(empty).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(2))
    b[:2400] = a[:2400]
    whole = near_dup.registers(near_dup.least(np.union1d(a, b)))
    ra, rb = (near_dup.registers(near_dup.least(x)) for x in (a, b))
    assert (whole == np.maximum(ra, rb)).all()
    j = near_dup.estimate(ra[None], rb[None], np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(j - 2400 / 3600) < 0.15


def test_quality_rules(docs, rows, labels, empty, loose):
    text = dict(rows)
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        n, *rest = brute.rule_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest), r.doc_id
        assert r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n)
        assert not (r.base_failed and r.kept)
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert all(r.kept for r in got if r.doc_id in good and not r.base_failed)
    assert quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.judge(loose, labels.limit(0)).count() == 6


def test_isolation_forest_finds_what_stands_apart():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (500, 3))
    x[:5] += 12
    s = quality_rules.IsolationForest(x).score(x)
    assert s[:5].min() > s[5:].max()
    assert quality_rules.calibrate(s, np.arange(500) >= 5) < s[:5].min()


def test_quality_threshold_comes_from_all_labels(spark):
    rng = np.random.default_rng(2)
    n = 3000
    names = [*quality_rules.COUNTS, *quality_rules.MORE]
    made = {c: rng.integers(100, 200, n) for c in names}
    stats = spark.createDataFrame([(i, *(int(made[c][i]) for c in names), False) for i in range(n)], "id bigint, " + ", ".join(f"{c} bigint" for c in names) + ", base_failed boolean")
    good = rng.random(n) < 0.9
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id bigint, quality int")
    forest, threshold = quality_rules.fit(stats, labels, sample=200)
    scores = np.round(forest.score(quality_rules.rates(made)), quality_rules.PLACES)
    assert threshold == pytest.approx(quality_rules.calibrate(scores, good))
    assert (scores[good] > threshold).mean() <= 0.002


def test_quality_classifier_on_rows_kept_from_training(spark, empty, loose):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    mine = [(known[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in known]
    assert sum(a == b for a, b in mine) / len(mine) > 0.9
    assert sum(b for a, b in mine if a == 1) / sum(a for a, _ in mine) > 0.97
    assert quality_model.classify(empty, labels).count() == 0
    assert quality_model.classify(loose, labels.limit(0)).count() == 6


def test_quality_score_sees_the_whole_text():
    net = quality_model.Network()
    tables, head = net.pairs(), "a" * 5000
    one, two = quality_model.score(pa.array([head + "b" * 9, head + "#" * 9]), tables, net.parts)
    assert one != two
    alone = quality_model.score(pa.array([head + "b" * 9]), tables, net.parts)
    assert alone[0] == pytest.approx(one)


def test_secret_scan(spark, empty):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'some words token = "{"".join(chr(97 + (i * j) % 6) if (i + j) % 3 else str((i * j) % 10) for j in range(40))}" and more' for i in range(1, 61)]
    texts += [f"the number {4432507379035540 + 7919 * i} stands here" for i in range(60)]
    texts += [f'say token = "{key}" again', None, "", "nothing here", f"a {key}{key} b"]
    docs = spark.createDataFrame([(i, x, "src1", 1) for i, x in enumerate(texts)] + [(None, f'my token = "{key}" x', None, 1)], "doc_id bigint, text string, source string, word int")
    got = secrets.scan(docs).collect()
    secret = {r.run for r in got if r.is_secret}
    assert key in secret and not any(r.run.isdigit() for r in got if r.is_secret)
    assert {r.doc_id for r in got if r.run == key} == {120, None}
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert len(clean) == len(texts) + 1
    assert clean[120] == f'say token = "{secrets.MARK}" again' and clean[None].count(secrets.MARK) == 1
    assert clean[70] == texts[70] and clean[121] is None and clean[122] == ""
    assert secrets.redact(docs).columns == docs.columns
    assert secrets.scan(empty).count() == 0 and secrets.redact(empty).count() == 0


def test_secret_scan_without_labels_keeps_candidates(spark):
    docs = spark.createDataFrame([(1, "a 24be64439e3e49cf46b2d7c9 b")], "doc_id bigint, text string")
    assert [(r.word, r.is_secret) for r in secrets.scan(docs, path=None).collect()] == [(1, True)]


def test_secret_candidates_are_whole(spark, empty):
    texts = ["a QWERTYUIOPASDFGHJKLZ b", "api_key=Zx9!k and", 'x password="correct horse 7" y', "Authorization: Bearer ab.cd~12 z", '{"token":"p4$$","blob":"QUJDREVGR0hJSktMTU5P"}',
             "auth:\n  token = s3cr3t.", "the word stands", "say secret value: xyz1, and", "token='it\\'s 1'", "aws_secret_access_key=ABCDEFGHIJKLMNOPQRST"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = secrets.features(secrets.candidates(docs, path=None), ["the", "word"]).collect()
    got = collections.defaultdict(set)
    for r in found:
        got[r.doc_id].add((r.word, r.run, bool(r.keyword and r.assigned)))
    assert got[0] == {(1, "QWERTYUIOPASDFGHJKLZ", False)} and got[1] == {(0, "Zx9!k", True)} and got[2] == {(1, "correct horse 7", True)}
    assert got[3] == {(2, "ab.cd~12", True)} and got[4] == {(0, "p4$$", True), (0, "QUJDREVGR0hJSktMTU5P", False)}
    assert (3, "s3cr3t", True) in got[5] and 6 not in got and (3, "xyz1", True) in got[7] and (0, "it\\'s 1", True) in got[8]
    assert (0, "ABCDEFGHIJKLMNOPQRST", True) in got[9]
    assert len({(r.doc_id, r.word, r.nth) for r in found}) == len(found)
    assert secrets.candidates(empty).count() == 0


def test_secrets_without_digits_and_short_ones_go(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    key = lambda n: "".join(rng.choice(letters, n))
    keys = [key(20) for _ in range(60)]
    short = [f"{key(3)}!{i}#{key(3)}" for i in range(60)]
    texts = [f'some api_key="{k}" here' for k in keys] + [f"my password={s} Pq and {s[:2]} stay" for s in short]
    texts += [f"the number {4432507379035540 + 7919 * i} and the {'lich' * 3}{'ung' * (i % 7 + 2)} stand" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("source", F.lit("src1"))
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert all(clean[i] == f'some api_key="{secrets.MARK}" here' for i in range(60))
    assert all(clean[60 + i] == f"my password={secrets.MARK} Pq and {s[:2]} stay" for i, s in enumerate(short))
    assert all(clean[i] == texts[i] for i in range(120, 240))


def test_sharding(spark, docs, rows, empty, loose):
    got = sharding.shard_documents(docs).collect()
    text = dict(rows)
    places = collections.defaultdict(list)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (16, r.shard) and (r.region, r.rack) == (r.shard // 4, r.shard // 2)
        places[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_documents(empty).count() == 0
    assert sharding.shard_documents(loose).count() == 6


def test_sharding_by_descent(spark, docs, rows):
    """Each row stands where draws among the children at each level put it, now and with one more shard."""
    old = sharding.tree(16)
    assert sharding.grow(old) == sharding.tree(17)
    for r in sharding.shard_documents(docs).collect():
        assert (r.region, r.rack, r.shard) == brute.placed(r.doc_id, old)
        assert r.grown_shard == brute.placed(r.doc_id, sharding.grow(old))[2]
    uneven = [sharding.Shard(0, 0, 0, 1.0), sharding.Shard(1, 0, 0, 0.0), sharding.Shard(2, 0, 1, 2.5), sharding.Shard(3, 7, 0, 0.5)]
    got = sharding.place(spark.range(500), F.col("id").cast("string"), uneven).collect()
    assert all((r.region, r.rack, r.shard) == brute.placed(r.id, uneven) for r in got) and {r.shard for r in got} == {0, 2, 3}
    with pytest.raises(ValueError):
        sharding.place(spark.range(1), F.lit(""), [sharding.Shard(0, 0, 0, 0.0)])


def test_sharding_of_loose_rows(spark):
    rows = [(None, "a"), (None, None), (3, "b"), (3, "b"), (3, "c"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("x")).withColumn("slot", F.lit("y"))
    got = sharding.shard_documents(df).collect()
    way = {i: brute.placed("" if i is None else i, sharding.tree(16))[2] for i in (None, 3, 4)}
    want = sorted(((i is None, i or 0, len(t or "") + 1, zlib.crc32((t or "").encode()), way[i]) for i, t in rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32, r.shard) for r in got) == want
    for shard in set(way.values()):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_sharding_moves_rows_only_below_what_grows(spark):
    rows = spark.range(4000)
    key = F.col("id").cast("string")
    old = sharding.tree(10)
    new = [sharding.Shard(s.shard, s.region, s.rack, 3.0 if s.shard == 5 else 1.0) for s in old]
    both = sharding.place(sharding.place(rows, key, old), key, new, "now", "r", "k").collect()
    moved = [r for r in both if r.shard != r.now]
    # shard 5 stands in rack 2 of region 1: only that region gains rows, and of rows that were there only that rack
    assert moved and all(r.r == 1 for r in moved)
    assert all(r.now == 5 for r in moved if r.rack == 2) and all(r.k == 2 for r in moved if r.region == 1)
    counts = collections.Counter(r.now for r in both)
    assert 2.2 < counts[5] / (sum(counts[i] for i in counts if i != 5) / 9) < 4
    more = sharding.place(sharding.place(rows, key, old), key, sharding.grow(old), "now", "r", "k").collect()
    assert {r.now for r in more if r.shard != r.now} == {10}
    assert sharding.slots(spark.range(100).withColumnRenamed("id", "doc_id").withColumn("shard", F.lit(0)), rows_each=7).agg(F.max("slot"), F.count_distinct("slot")).first() == (99, 100)


def test_decontamination(spark, docs, rows, empty, loose):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = items.unionByName(spark.createDataFrame([(9001, PASSAGE), (9002, PASSAGE), (9003, "word"), (9004, None), (9005, ""), (9006, "passage3 passage4 passage5 passage6 passage7")], items.schema))
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    want = brute.contained(rows, [(r.item_id, r.text) for r in items.collect() if r.item_id != 9002])
    assert {i: list(r.item_ids) for i, r in got.items()} == want
    assert all(r.contaminated == bool(want[i]) and r.n_items == len(want[i]) for i, r in got.items())
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(loose, items).count() == 6


def test_values_of_rows_without_an_id_and_of_repeated_ones(spark, loose, labels):
    """Quality rules and BPE take each row by itself; decontamination judges rows of one id together."""
    order = lambda out: sorted(out, key=str)
    rows = [(r.doc_id, r.text) for r in loose.collect()]
    judged = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.judge(loose, labels.limit(0)).collect()]
    assert order(judged) == order([(i, *brute.rule_counts(x), True, False) for i, x in rows])
    items = spark.createDataFrame([(9, PASSAGE)], "item_id bigint, text string")
    met = [(r.doc_id, r.n_items, list(r.item_ids), r.containment, r.contaminated) for r in decontaminate.decontaminate(loose, items).collect()]
    assert order(met) == order([(i, 0, [], 0.0, False) if i is None else (i, 1, [9], 1.0, True) for i, _ in rows])
    trips = [(r.doc_id, r.decoded_sha256) for r in bpe.round_trip(loose).collect()]
    assert order(trips) == order([(i, hashlib.sha256((x or "").encode()).hexdigest()) for i, x in rows])
    words = spark.createDataFrame([(1, "x" * 1000 + " b c d e"), (2, "y" * 1000 + " b c d e"), (3, "x" * 1000 + " b c d e")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(words).collect()} == {1: 1, 2: 2, 3: 1}


def test_decontamination_finds_short_items_inside_documents(spark):
    texts = ["one two Alpha Beta three four five six", "alpha beta", "alpha x beta y z a b", "solo", "a b c d e solo", "beta alpha", "p q r s", "o p q r s t", "alpha"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "alpha beta"), (2, "solo"), (3, "p q r s"), (4, "one two alpha beta three")], "item_id bigint, text string")
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {0: [1, 4], 1: [1], 2: [], 3: [2], 4: [2], 5: [], 6: [3], 7: [3], 8: []}


def test_byte_bpe_agrees_with_the_library(docs, rows, empty, loose):
    import public_tokenizers
    import tiktoken

    c = bpe.codec()
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (list(r.ids), bytes(r.bytes)) for r in bpe.decode(bpe.encode(docs)).collect()}
    for i, x in rows:
        assert got[i] == (library.encode_ordinary(x or ""), (x or "").encode())
    for text in ("a" * 20_000, "ab" * 9000, " " * 5000, "aab" * 3 + "é́\U0001f600" * 50, "<|endoftext|>", "1234567 it's we'll\r\n\n  x"):
        ids = c.encode(text)
        assert ids.tolist() == library.encode_ordinary(text) and c.decode(ids) == text.encode()
    r = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    packed = np.array(got[900_006][0], "<u4").tobytes()
    assert (r[900_006].n_tokens, r[900_006].ids_sha256) == (len(packed) // 4, hashlib.sha256(packed).hexdigest())
    assert bpe.round_trip(empty).count() == 0 and bpe.round_trip(loose).count() == 6


def test_license_scan(spark, docs, rows, empty):
    extra = ["Released under the MIT License.", "all\nrights\nreserved", "x\n\nAll rights reserved (c)", "mit license mit license", "license apache license, version 2.0 licensed under it",
             "under the terms of the Mozilla Public License this source code form is subject"]
    more = spark.createDataFrame([(10_000 + i, x) for i, x in enumerate(extra)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan(docs.select("doc_id", "text").unionByName(more)).collect()}
    for i, x in [*rows, *((10_000 + i, x) for i, x in enumerate(extra))]:
        *want, blocks = brute.licenses(x, licenses.PHRASES, licenses.TEMPLATES)
        r = got[i]
        assert [r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels] == want, i
        assert sorted((b.line, b.label, b.containment) for b in r.blocks) == blocks
        assert r.score == (1.0 if r.base_labels else max((b[2] for b in blocks), default=0.0))
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(more, templates={}).filter("labels <> base_labels").count() == 0


def test_license_windows(docs, rows, spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    filler = " ".join(f"filler{i}" for i in range(20))
    extra = [bsd, f"# {bsd}".replace("\n", "\n# "), "all\nrights\nreserved", f"all {filler} rights {filler} reserved", f"{filler} all rights reserved {filler} all rights reserved",
             "x\n\nthis source code form is subject\nto the terms of the mozilla\npublic license", "all rights reserved " * 5, "all rights", "released under under the the the mit license"]
    more = spark.createDataFrame([(10_000 + i, x) for i, x in enumerate(extra)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan(docs.select("doc_id", "text").unionByName(more), by="windows").collect()}
    for i, x in [*rows, *((10_000 + i, x) for i, x in enumerate(extra))]:
        blocks = brute.license_windows(x, licenses.TEMPLATES)
        assert sorted((b.line, b.label, b.containment) for b in got[i].blocks) == blocks, i
        assert set(got[i].labels.split(",")) - {""} == {b[1] for b in blocks} | set(got[i].base_labels.split(",")) - {""}
    assert [got[10_000 + i].labels for i in range(4)] == ["bsd-statement", "bsd-statement", "reserved-statement", ""]
    assert len(got[10_004].blocks) == 2 and len(got[10_006].blocks) == 5


def test_license_query_finds_statements_over_two_lines(spark, tmp_path):
    spark.createDataFrame([(1, "all rights\nreserved")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.labels for r in QUERIES["op8_license_scan"](spark, str(tmp_path)).collect()] == ["reserved-statement"]


def test_language_id_on_rows_kept_from_training(spark, docs, empty, loose):
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r.doc_id: r.lang for r in all_docs.collect()}
    got = language.identify(all_docs).collect()
    mine = [r for r in got if r.held_out]
    assert len(got) == len(known) and sum(r.lang_pred == known[r.doc_id] for r in mine) / len(mine) > 0.95
    odd = {r.doc_id: r for r in language.identify(docs).collect()}
    assert [odd[i].lang_pred for i in (900_001, 900_002, 900_003, 900_012)] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in odd.values()) and odd[900_011].lang_pred != "und"
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(loose.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("k", [1, 2, 4, 9, 40])
def test_codewords_differ(k):
    c = language.codewords(k)
    apart = (c.shape[1] - c @ c.T) / 2
    assert len(c) == k and (k == 1 or apart[~np.eye(k, dtype=bool)].min() >= 1)


def test_held_out_is_the_remainder_of_the_checksum(spark):
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_pipeline_stages_take_effect(spark, docs, labels):
    frame, folder = docs.select("doc_id", "text", "lang", "source", "n_chars"), FOLDER
    ids = [{r.doc_id for r in frame.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        frame = stage(spark, before, folder).cache()
        ids.append({r.doc_id for r in frame.select("doc_id").collect()})
        if name != "byte_bpe":
            assert frame.columns == before.columns
        if name == "quality_rules":
            assert ids[-1] == {r.doc_id for r in quality_rules.judge(before, labels).filter("kept").collect()}
        elif name == "near_duplicates":
            assert ids[-1] == {i for i, (_, _, kept) in brute.near([(r.doc_id, r.text) for r in before.collect()]).items() if kept}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert ids[-1] == {i for i, found in brute.contained([(r.doc_id, r.text) for r in before.collect()], items).items() if not found}
        else:
            assert ids[-1] == ids[-2] and frame.count() == before.count()
    assert len(ids[0]) > len(ids[-1]) > 0


def test_pipeline_takes_loose_and_empty_tables(spark, empty, loose):
    for start in (empty.select("doc_id", "text", "lang", "source", "n_chars"), loose.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(1).cast("bigint")})):
        frame = start
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, FOLDER)
        assert frame.count() <= start.count()


def test_pipeline_judges_rows_of_one_id_each_by_itself(spark):
    words = [f"{a}{b}" for a in ("ka", "mo", "ri", "te", "su") for b in ("lan", "den", "vor", "mit", "sel", "bar", "tun", "gen", "fal", "rad", "hol", "wes")]
    x, y, z = " ".join(words), " ".join(reversed(words)), " ".join(words[::2] + words[1::2])
    rows = [(7, x), (7, y), (7, x), (None, z), (None, "too short"), (None, z), (8, x)]
    frame = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = [None, [(None, z), (None, z), (7, x), (7, x), (7, y), (8, x)], [(None, z), (7, y), (8, x)]]
    for (name, stage), left in zip(corpus_pipeline.STAGES, [*want[1:], want[2], want[2], want[2]], strict=True):
        frame = stage(spark, frame, FOLDER)
        assert sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] or 0, r[1])) == sorted(left, key=lambda r: (r[0] or 0, r[1])), name
    r = frame.filter("doc_id = 7").first()
    assert bytes(bpe.codec().decode(np.array(r.ids))).decode() == y and r.n_tokens == len(r.ids)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
