"""Small cases worked out by hand."""

import math

from pyspark.sql import functions as F

from scoretables.functions import pitch as P
from scoretables.functions import text as X
from scoretables.operators import joins as J
from scoretables.operators import notes as N
from scoretables.operators import sequence as Q
from scoretables.operators import stats as S
from scoretables.operators import votes as V
from scoretables.plans import book as B
from scoretables.plans import timeline as TL
from scoretables.plans.beats import beat_check


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_file_names(spark):
    rows = [(0, 1, "圣 哉"), (1, 1, "圣哉"), (2, None, ""), (3, 1203, "a/b")]
    df = spark.createDataFrame(rows, "i int, number int, title string")
    named = df.withColumn("name", X.safe_name("number", "title", F.lit(4), F.col("i") + 1))
    k = Q.occurrence(named, ["name"], ["i"])
    out = k.select("i", F.concat("name", F.when(F.col("k") > 1, F.concat(F.lit("("), F.col("k").cast("string"), F.lit(")"))).otherwise(""))).orderBy("i")
    assert [r[1] for r in out.collect()] == ["0001 圣哉", "0001 圣哉(2)", "未编号3 未识别曲名", "1203 ab"]


def test_lyric_tokens(spark):
    r = one(spark, X.lyric_label(F.lit("1.哦,千“万”")), X.lyric_tokens(F.lit("1.哦,千“万”")), X.lyric_label(F.lit("3 Je-sus! the name")), X.lyric_tokens(F.lit("3 Je-sus! the name")))
    assert r[0] == "1." and r[1] == ["哦，", "千", "“万”"]
    assert r[2] == "3" and r[3] == ["Je", "sus!", "the", "name"]


def test_two_class_split(spark):
    rows = [("a", float(v)) for v in (2, 3, 2, 12, 14)] + [("b", float(v)) for v in (2, 3, 4)] + [("c", 0.5), ("c", 9.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("h", F.lit(20.0))
    got = {r.g: r.boundary for r in S.two_class_split(df, ["g"], "v", "h").collect()}
    assert abs(got["a"] - 6.0) < 0.1 and math.isinf(got["b"]) and got["c"] == 6.0


def test_otsu_splits_two_heaps(spark):
    df = spark.createDataFrame([(v,) for v in [10] * 5 + [12] * 5 + [200] * 8], "gray bigint")
    assert 12 <= S.otsu(df, [], "gray").first().threshold < 200


def test_contents_vote(spark):
    e = [("b", 1, 10), ("b", 1, 10), ("b", 1, 11), ("b", 2, 11), ("b", 3, 90), ("b", 4, 12)]
    e += [("p", 1, 1), ("p", 7, None), ("n", 1, None), ("n", 2, None)]
    df = spark.createDataFrame(e, "book string, number bigint, page bigint").withColumn("last", F.lit(100))
    top = V.toc_vote(df, "book", "number", "page", "last")
    got = {(r.book, r.number): r.page for r in top.collect()}
    assert got == {("b", 1): 10, ("b", 2): 11, ("b", 3): 90, ("b", 4): 12, ("p", 1): 1, ("n", 1): None, ("n", 2): None}
    kept = B.monotone_keep(top.filter("book = 'b'"), "book", "number", "page")
    assert {r.number for r in kept.filter("keep").collect()} == {1, 2, 4}


def test_numbering_and_region(spark):
    pages = spark.createDataFrame([("b", i, i + 1, 1 if i < 2 else 0) for i in range(4)], "book string, ix bigint, printed bigint, titles int")
    reg = V.region_offset(pages, "book", "ix", "printed", "titles").first()
    assert (reg["offset"], reg["first"], reg["last"]) == (-1, 0, 3)
    titles = spark.createDataFrame([("b", 0, 0, 1), ("b", 0, 1, None), ("b", 1, 0, 9)], "book string, page bigint, k bigint, read bigint")
    toc = spark.createDataFrame([("b", 1, 1), ("b", 2, 1), ("b", 3, 2)], "book string, number bigint, at bigint")
    off = spark.createDataFrame([("b", -1)], "book string, offset bigint")
    got = [(r.page, r.k, r.number, r.how) for r in B.number_titles(titles, off, toc, "book").orderBy("page", "k").collect()]
    assert got == [(0, 0, 1, "read"), (0, 1, 2, "listed"), (1, 0, 3, "listed")]


def test_order_align_leaves_room(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = one(spark, B.order_align(a(10, 52, 60), a(10, 30, 50, 70)), B.order_align(a(1, 2, 3), a(5, 6)))
    assert r[0] == [0, 2, 3] and r[1] == [0, 1, 1]


def test_words(spark):
    t = lambda f, s: f(F.lit(s))
    r = one(spark, t(X.metronome, "J=c.78"), t(X.metronome, "♩ = 110"), t(X.metronome, "1=C"), t(X.dynamic, "mf"), t(X.jump, "D.C. al Fine"),
            t(X.punct_score, "再相亲，”"), t(X.punct_score, "阿们。"), t(X.punct_class, "「"), t(X.script_of, "数算 abc"), t(X.section_word, "【副歌】"))
    assert tuple(r[0]) == (78, True) and tuple(r[1]) == (110, False) and r[2] is None
    assert list(r)[3:] == ["mf", "DaCapo", 4, 6, "open", "Han", "副歌"]


def test_credits_and_terms(spark):
    small = F.lit(True)
    r = one(spark, X.is_credit(F.lit("希伯词 1826")), X.is_credit(F.lit("希伯, 1826"), smaller=small), X.is_credit(F.lit("某某 曲"), smaller=small), X.is_credit(F.lit("爱曲")),
            X.creator_type(F.lit("编 曲：某")), X.creator_type(F.lit("某某 作词")), X.creator_type(F.lit("某（词")), X.has_term(F.lit("poco rit."), ["rit"]), X.has_term(F.lit("D. C. al"), ["d.c"]),
            X.has_term(F.lit("writ"), ["rit"]), X.metronome(F.lit("a=b = circa 7 2")), X.jump(F.lit("D C")), X.jump(F.lit("scoda")))
    assert list(r)[:10] == [False, True, True, False, "arranger", "lyricist", "composer", True, True, False]
    assert tuple(r[10]) == (72, True) and r[11] == "DaCapo" and r[12] is None


def test_chords(spark):
    p = one(spark, X.chord_parse(F.lit("F#m7/C#")), X.chord_normalize(F.lit("CM")), X.chord_normalize(F.lit("C♯SUS4")),
            X.chord_coverage(F.lit("C#mF#mBm7E"))["is_chords"], X.chord_coverage(F.lit("still"))["is_chords"], X.chord_coverage(F.lit("Em F.C/E G"))["is_chords"])
    assert (p[0].root, p[0].alter, p[0].kind, p[0].quality, p[0].bass) == (3, 1, "m7", "minor-seventh", "C#")
    assert p[1] == "Cm" and p[2] == "C#sus4" and p[3] and not p[4] and p[5]


def test_line_kinds(spark):
    kinds = {"词：某人": "credit", "Words by X": "credit", "Copyright 1990": "rights", "12 圣哉（35）": "toc", "圣哉三一 156": "index", "我的神": "text", "C#mF#mBm7E": "annotation",
             "[Verse 1]": "annotation", "副歌": "annotation", "Chorus 2 Am G": "annotation", "词，曲：某": "credit", "music": "credit", "musical": "text", "(c) 1999 X": "rights"}
    got = one(spark, *[X.classify_line(F.lit(k)) for k in kinds])
    assert list(got) == list(kinds.values())


def test_index_pairs(spark):
    got = one(spark, X.index_pairs(F.lit("A圣哉156三一29B 主爱7")))[0]
    assert [(e.kind, e.label, e.song_id) for e in got] == [("heading", "A", None), ("entry", "圣哉", "156"), ("entry", "三一", "029"), ("heading", "B", None), ("entry", "主爱", "007")]


def test_reference_lyrics_in_time_order(spark):
    rows = [("b", "【副歌】主啊\n[Chorus]\n我（1）信（阿们）\n副歌：爱\n二、光 1\n词曲：某")]
    got = X.clean_ref_lines(spark.createDataFrame(rows, "doc string, text string"), "doc", "text").orderBy("line_no").collect()
    assert [r.line for r in got] == ["主啊", "我信（阿们）", "爱", "光 1"]
    text = "[ti:name]\n[00:10.5][00:40]1. 我主\n[00:20]副歌\n[00:30]（副歌）你好"
    df = spark.createDataFrame([("d", text), ("e", "作词：某\n一、主爱\n\nverse 2")], "doc string, text string")
    got = [(r.doc, r.at, r.line) for r in X.clean_ref_lines(df, "doc", "text").orderBy("doc", "at", "line_no").collect()]
    assert got == [("d", 10.5, "我主"), ("d", 30.0, "你好"), ("d", 40.0, "我主"), ("e", None, "主爱")]


def test_pitch_spelling(spark):
    r = one(spark, P.spell_midi(F.lit(61), F.lit(0)), P.spell_midi(F.lit(61), F.lit(-2)), P.degree_to_pitch(F.lit(1), F.lit(0), F.lit(5)),
            P.key_of_degree(F.lit(0), F.lit("b7")), P.degree_of_key(F.lit(0), F.lit(-2)), P.beat_text(F.lit(1.5)), P.beat_text(F.lit(1 / 3)), P.beat_text(F.lit(0.37)))
    assert (r[0].step, r[0].alter, r[0].octave) == (0, 1, 4) and (r[1].step, r[1].alter) == (1, -1)
    assert (r[2].step, r[2].octave) == (6, 3)
    assert list(r)[3:] == [-2, "b7", "1 1/2", "1/3", "0.37"]


def test_clamped_depth_and_pairing(spark):
    ev = [(1, "off"), (2, "on"), (3, "on"), (4, "off"), (5, "off"), (6, "off"), (7, "on")]
    df = spark.createDataFrame(ev, "t int, kind string").withColumn("g", F.lit(0))
    on, off = F.col("kind") == "on", F.col("kind") == "off"
    d = Q.clamped_depth(df, ["g"], ["t"], on.cast("int"), off.cast("int"))
    assert [r.depth for r in d.orderBy("t").collect()] == [0, 1, 2, 1, 0, 0, 1]
    got = sorted((r.t_on, r.t_off) for r in N.pair_on_off(df, ["g"], ["t"], "t", on, off).collect() if r.t_off)
    assert got == [(2, 4), (3, 5)]


def test_right_barline_change_acts_one_measure_later(spark):
    rows = [(0, None, None, None), (1, None, None, 3), (2, None, None, None), (3, None, 2, 5), (4, 6, None, None)]
    df = spark.createDataFrame(rows, "m int, a int, l int, r int").withColumn("g", F.lit(0))
    got = Q.carry_attr(df, ["g"], ["m"], F.col("a"), F.col("l"), F.col("r"), F.lit(4))
    assert [r.in_force for r in got.orderBy("m").collect()] == [4, 4, 3, 2, 6]


def test_beat_check_pardons(spark):
    got = [1.0, 4.0, 1.0, 3.0, 2.5, 4.0, 3.0]  # pickup and last fill, then a split pair, then a wrong one
    m = spark.createDataFrame([(i, [4.0], False) for i in range(7)], "m int, wants array<double>, implicit boolean").withColumn("g", F.lit(0))
    ln = spark.createDataFrame([(i, 1, q) for i, q in enumerate(got)] + [(1, 2, 3.0)], "m int, v int, q double").withColumn("g", F.lit(0))
    bad = {(r.m, r.kind, r.want, r.got) for r in beat_check(m, ln, ["g"], "m", "v", "q").collect()}
    assert bad == {(4, "length", 4.0, 2.5), (1, "voice", 4.0, 3.0)}


def test_timeline_entry_limit_and_ties(spark):
    passes = spark.createDataFrame([("s", 0, 0, 2, 1, 1.0, None), ("s", 1, 0, 1, 2, None, 1.0)], "song string, pass_ix int, mid int, end_mid int, pass int, offset double, until double")
    measures = spark.createDataFrame([("s", 0, 4.0), ("s", 1, 4.0)], "song string, measure int, len double")
    notes = spark.createDataFrame([("s", 0, 0, 0, 0.0, 1.0, 60, False, None), ("s", 0, 1, 0, 3.0, 1.0, 60, False, 80.0), ("s", 1, 2, 0, 0.0, 2.0, 60, True, None)],
                                  "song string, measure int, note_ix int, part int, pos double, dur double, pitch int, tie_stop boolean, velocity double")
    got = sorted((r.t0, r.t1, r.velocity, r.pieces) for r in TL.build_timeline(passes, measures, notes, ["song"]).collect())
    assert got == [(2.0, 5.0, 80.0, 2), (7.0, 8.0, 100.0, 1)]


def test_bars_cut_by_next_meter(spark):
    m = spark.createDataFrame([("f", 0, 4, 4), ("f", 290, 3, 4)], "file string, at bigint, beats int, beat_type int")
    e = spark.createDataFrame([("f", 500)], "file string, until bigint")
    got = [(r.bar_start, r.bar_end, r.beats) for r in N.bars_from_meters(m, e, ["file"]).orderBy("bar_start").collect()]
    assert got == [(0, 192, 4), (192, 288, 4), (288, 432, 3), (432, 500, 3)]


def test_reconcile(spark):
    toc = spark.createDataFrame([("b", 1, 5), ("b", 3, 9)], "book string, number bigint, page bigint")
    found = spark.createDataFrame([("b", 1, 5), ("b", 1, 6), ("b", 4, 1)], "book string, number bigint, page bigint")
    got = {(r.kind, r.number) for r in J.toc_reconcile(found, toc, "book", "number", "page").collect()}
    assert got == {("missing", 2), ("missing", 3), ("extra", 4), ("duplicate", 1), ("page", 1)}


def test_metronome_marks(spark):
    texts = {"= 7  2": None, "= 7 2": 72, "=72": 72, "= 1 2 0": 120, "= 1  20": None, "= 1  20 = 96": 96, "= c. 66": 66, "＝circa 80": 80, "= C 80": None, "= . 80": None, "= 300": None, "= 29": None, "= 1=40": 40, "速 = 80": None, "": None}
    got = {r.t: r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.metronome("t").alias("m")).collect()}
    assert {t: m and m.bpm for t, m in got.items()} == texts
    assert got["= c. 66"].circa and not got["=72"].circa and got["＝circa 80"].circa


def test_credits_in_smaller_print(spark):
    texts = ["(John Laudon)", "（A. B-C）", "(words 3)", "John Laudon 词曲", "J. Smith 作词、作曲", "John Laudon", "盛晓玫 词曲", "Words by X"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [(r.small, r.large) for r in rows.select("i", X.is_credit("t", smaller=F.lit(True)).alias("small"), X.is_credit("t", smaller=F.lit(False)).alias("large")).orderBy("i").collect()]
    assert got == [(True, False), (True, False), (False, False), (True, False), (True, False), (False, False), (True, False), (True, True)]


def test_line_offsets_stay_in_their_row(spark):
    text = "\n".join("x" * (i % 7) + "é" * (i % 3) for i in range(1500))
    rows = spark.createDataFrame([(1, "ab\r\nc\n\nd"), (1, "zz\ny"), (2, ""), (3, None), (4, text)], "d int, t string")
    table = X.line_table(rows, "d", "t")
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.d, r.line_no, r.line, r.offset) for r in table.filter("d < 4").collect())
    assert got == [(1, 0, "ab", 0), (1, 0, "zz", 0), (1, 1, "c", 3), (1, 1, "y", 3), (1, 2, "", 5), (1, 3, "d", 6), (2, 0, "", 0)]
    for r in table.filter("d = 4").collect():
        assert text[r.offset : r.offset + len(r.line)] == r.line and text[: r.offset].count("\n") == r.line_no


def test_match_f1_shuffles_shared_tokens_only(spark):
    from scoretables.operators.votes import match_f1

    items = spark.createDataFrame([(1, 5, w) for w in ("a", "a", "a", "b", "x", "y", "z")] + [(2, 5, None), (3, None, "a"), (None, 5, "b"), (4, 9, "q")], "item int, ref int, token string")
    refs = spark.createDataFrame([(5, "a"), (5, "a"), (5, "b"), (5, "c"), (7, None)], "ref int, token string")
    m = match_f1(items, refs, "item", "ref", "token")
    got = {(r.item, r.ref): (r.len_a, r.len_b, r.matched, r.is_match) for r in m.collect()}
    assert got == {(1, 5): (7, 4, 3, True), (2, 5): (0, 4, 0, False), (3, None): (1, 0, 0, False), (None, 5): (1, 4, 1, False), (4, 9): (1, 0, 0, False)}
    # tokens that the reference doesn't have are one group
    assert "__shared" in m._jdf.queryExecution().analyzed().toString()
