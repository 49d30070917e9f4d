"""Text functions on documents, conversations and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .pitch import L, tally
from .registry import query

# Latin forms of the mark classes: the bound texts hold no Chinese.
END, MID, QUOTES = "[.!?;]$", "[,:]$", "[\"')\\]]+$"
OPENS, CLOSES, STOPS, MIDDLES = "([{", ")]}", ".,;:!?", "-_'"

LINES = """lines AS (SELECT doc_id, source, lang, unnest(range(len(p))) AS line_no, unnest(p) AS line
  FROM (SELECT doc_id, source, lang, string_split_regex(text, '\\r?\\n') AS p FROM documents))"""
BARE = "regexp_replace(line, '[\"'')\\]]+$', '')"


def doc_lines(t):
    return X.lines(t.texts, "text", "doc_id", "source", "lang")


@query("T1_punct_score", f"""WITH {LINES} SELECT source, (CASE WHEN regexp_matches({BARE}, '[.!?;]$') THEN 6
 WHEN regexp_matches({BARE}, '[,:]$') THEN 4 ELSE 0 END)::BIGINT AS score, count(*) AS n FROM lines GROUP BY ALL""")
def _(t):
    return tally(doc_lines(t), "source", X.punct_score("line", END, MID, QUOTES).cast(L).alias("score"))


@query("T2_is_sentence_end", f"""WITH {LINES} SELECT doc_id, count(*) FILTER (regexp_matches({BARE}, '[.!?]$')) AS ends, count(*) AS n
FROM lines GROUP BY ALL""")
def _(t):
    return doc_lines(t).groupBy("doc_id").agg(
        F.count_if(X.is_sentence_end("line", "[.!?]$", QUOTES)).alias("ends"), F.count(F.lit(1)).alias("n"))


@query("T3_punct_class", """WITH ch AS (SELECT unnest(string_split(text, '')) AS ch FROM documents)
SELECT ch, CASE WHEN ch IN ('(','[','{') THEN 'open' WHEN ch IN (')',']','}') THEN 'close' WHEN ch IN ('.',',',';',':','!','?') THEN 'stop'
  WHEN ch IN ('-','_','''') THEN 'middle' ELSE 'none' END AS kind, count(*) AS n FROM ch WHERE ch <> '' GROUP BY ALL""")
def _(t):
    ch = t.texts.select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''")
    n = ch.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return n.select("ch", X.punct_class("ch", OPENS, CLOSES, STOPS, MIDDLES).alias("kind"), "n")


@query("T4_script_of", """WITH k AS (SELECT doc_id, length(regexp_replace(text, '[^㐀-鿿]', '', 'g')) AS han,
  length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g')) AS latin FROM documents)
SELECT doc_id, han::BIGINT AS han, latin::BIGINT AS latin,
  CASE WHEN han = 0 AND latin = 0 THEN 'Other' WHEN han*2 >= latin THEN 'Han' ELSE 'Latin' END AS script FROM k""")
def _(t):
    return t.texts.select("doc_id", X.han_count("text").cast(L).alias("han"), X.latin_count("text").cast(L).alias("latin"),
                              X.script_of("text").alias("script"))


WORD_SQL = """regexp_extract_all(line, '([“‘"''(（]*(?:[㐀-鿿]|[A-Za-zÀ-ɏ](?:[A-Za-zÀ-ɏ''’])*)[，。、；：！？…—,;:!?”’)）]*)', 1)"""


@query("T5_lyric_tokens", f"""WITH {LINES}, tok AS (SELECT unnest({WORD_SQL}) AS token FROM lines)
SELECT token, count(*) AS n FROM tok GROUP BY ALL""")
def _(t):
    return tally(doc_lines(t).select(F.explode(X.lyric_tokens("line")).alias("token")), "token")


@query("T6_verse_prefix_strip", """WITH v AS (SELECT conv_id, turn, (turn + 1)::VARCHAR || '.' || CASE WHEN turn % 3 = 2 THEN '' ELSE text END AS v FROM conversations)
SELECT conv_id, turn, v = regexp_replace(v, '^\\d+\\.(.)', '\\1') AS kept, length(regexp_replace(v, '^\\d+\\.(.)', '\\1'))::BIGINT AS len,
  md5(regexp_replace(v, '^\\d+\\.(.)', '\\1')) AS digest FROM v""")
def _(t):
    v = F.concat((F.col("turn") + 1).cast("string"), F.lit("."), F.when(F.pmod("turn", F.lit(3)) == 2, "").otherwise(F.col("text")))
    s = X.verse_prefix_strip("v")
    return t.conversations.withColumn("v", v).select(
        "conv_id", "turn", (F.col("v") == s).alias("kept"), F.length(s).cast(L).alias("len"), F.md5(s).alias("digest"))


def pick(values, key, n=None):
    """One of the values by key."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col(key), F.lit(n or len(values))).cast("int"))


def sql_list(values):
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


TEMPO_HEADS = ["J = c. ", "= ", "J=ca. ", "q ＝ circa ", "歌 = ", "tempo "]


@query("T7_metronome", f"""WITH m AS (SELECT p_partkey, {sql_list(TEMPO_HEADS)}[p_partkey % 6 + 1] || (p_size * 6)::VARCHAR AS txt, p_size * 6 AS bpm, p_partkey % 6 AS head FROM part)
SELECT p_partkey, txt, CASE WHEN head < 4 AND bpm BETWEEN 30 AND 260 THEN bpm::BIGINT END AS bpm, CASE WHEN head < 4 AND bpm BETWEEN 30 AND 260 THEN head <> 1 END AS circa FROM m""")
def _(t):
    rows = t.part.select("p_partkey", F.concat(pick(TEMPO_HEADS, "p_partkey"), (F.col("p_size") * 6).cast("string")).alias("txt"))
    m = X.metronome("txt")
    return rows.select("p_partkey", "txt", m["bpm"].cast(L).alias("bpm"), m["circa"].alias("circa"))


WORDS = ["m f", "P.P.", "sfz", "D.C. al Fine", "Fine.", "To Coda", "coda", "d.s. al coda", "poco rit.", "allegro"]



@query("T8_words", f"""WITH k(i, dynamic, jump, stays, term) AS (VALUES (0, 'mf', NULL, false, false), (1, 'pp', NULL, false, false), (2, 'sfz', NULL, false, false),
 (3, NULL, 'DaCapo', true, true), (4, NULL, 'Fine', false, true), (5, NULL, 'ToCoda', true, true), (6, NULL, 'Coda', false, true), (7, NULL, 'DalSegno', true, true), (8, NULL, NULL, false, true), (9, NULL, NULL, false, true)),
w AS (SELECT p_partkey % 10 AS i, p_size % 3 = 0 AS long, CASE WHEN p_size % 3 = 0 THEN p_name END AS name FROM part)
SELECT {sql_list(WORDS)}[i + 1] || coalesce(' ' || name, '') AS txt, CASE WHEN NOT long THEN dynamic END AS dynamic, CASE WHEN NOT long OR stays THEN jump END AS jump,
 term OR (long AND list_has_any(string_split(lower(name), ' '), {sql_list(X.TERMS)})) AS term, count(*) AS n FROM w JOIN k USING (i) GROUP BY ALL""")
def _(t):
    txt = F.concat(pick(WORDS, "p_partkey"), F.when(F.pmod("p_size", F.lit(3)) == 0, F.concat(F.lit(" "), F.col("p_name"))).otherwise(""))
    return tally(t.part.select(txt.alias("txt")), "txt", X.dynamic("txt").alias("dynamic"), X.jump("txt").alias("jump"),
                 X.has_term("txt").alias("term"))


CREDITS = ["词曲：", "作词: ", "编 曲：", "译配:", "打谱：", "Arr: ", "", ""]
TAILS = ["", "", "", "", "", "", " 作曲", " 词"]


@query("T9_creator_type", f"""WITH c AS (SELECT {sql_list(CREDITS)}[p_partkey % 8 + 1] || p_name || {sql_list(TAILS)}[p_partkey % 8 + 1] AS txt,
  ['words-and-music','lyricist','arranger','translator','transcriber','composer','composer','lyricist'][p_partkey % 8 + 1] AS role FROM part)
SELECT txt, role, count(*) AS n FROM c GROUP BY ALL""")
def _(t):
    txt = F.concat(pick(CREDITS, "p_partkey"), F.col("p_name"), pick(TAILS, "p_partkey"))
    return tally(t.part.select(txt.alias("txt")), "txt", X.creator_type("txt").alias("role"))


SECTIONS = ["[Verse 1]", "【副歌】", "( Chorus )", "Pre-Chorus 2", "主歌", "verses", "[Bridge", "尾声 3"]


@query("T10_section_word", f"""WITH s AS (SELECT p_partkey % 8 AS i, CASE WHEN p_size % 5 = 0 THEN p_name ELSE '' END AS name FROM part)
SELECT {sql_list(SECTIONS)}[i + 1] || name AS txt, CASE WHEN name = '' THEN ['Verse 1', '副歌', 'Chorus', 'Pre-Chorus 2', '主歌', NULL, 'Bridge', '尾声 3'][i + 1] END AS section, count(*) AS n FROM s GROUP BY ALL""")
def _(t):
    txt = F.concat(pick(SECTIONS, "p_partkey"), F.when(F.pmod("p_size", F.lit(5)) == 0, F.col("p_name")).otherwise(""))
    return tally(t.part.select(txt.alias("txt")), "txt", X.section_word("txt").alias("section"))


KINDS = ["", "m", "7", "maj7", "SUS4", "dim", "M7", "9"]


@query("T11_chord_parse", f"""WITH k AS (SELECT p_partkey % 7 AS root, p_partkey % 3 AS a, p_size % 8 AS k, p_partkey % 2 AS b FROM part),
c AS (SELECT substr('CDEFGAB', root::INT+1, 1) || ['','#','♭'][a+1] || {sql_list(KINDS)}[k+1] || CASE b WHEN 1 THEN '/G' ELSE '' END AS tok, root,
  [0,1,-1][a+1]::BIGINT AS alter, ['','m','7','maj7','sus4','dim','m7','9'][k+1] AS kind,
  ['major','minor','dominant','major-seventh','suspended-fourth','diminished','minor-seventh','dominant-ninth'][k+1] AS quality,
  CASE b WHEN 1 THEN 'G' END AS bass FROM k)
SELECT tok, root, alter, kind, quality, bass, count(*) AS n FROM c GROUP BY ALL""")
def _(t):
    letter = pick(list("CDEFGAB"), "p_partkey")
    tok = F.concat(letter, pick(["", "#", "♭"], "p_partkey"), pick(KINDS, "p_size"), pick(["", "/G"], "p_partkey"))
    p = X.chord_parse("tok")
    return tally(t.part.select(tok.alias("tok")), "tok", p["root"].cast(L).alias("root"), p["alter"].cast(L).alias("alter"),
                 p["kind"].alias("kind"), p["quality"].alias("quality"), p["bass"].alias("bass"))


CHORD_RE = f"({X.chord_pattern()})"
SPACED_SQL = "regexp_replace({x}, '" + X.chord_noise() + "', ' ', 'g')"
FIRST_WORDS, RIGHTS = ["the", "and", "words", "music"], ["copyright", "license", "©"]


@query("T11_chord_coverage", f"""WITH {LINES}, s AS (SELECT doc_id, {SPACED_SQL.replace('{x}', 'line')} AS sp FROM lines),
k AS (SELECT doc_id, length(replace(sp, ' ', '')) AS total, regexp_extract_all(sp, '{CHORD_RE}', 1) AS toks FROM s),
h AS (SELECT doc_id, total, len(toks) AS ntok, coalesce(list_sum(list_transform(toks, lambda x: length(x))), 0) AS hit FROM k)
SELECT doc_id, sum(hit)::BIGINT AS hit, sum(total)::BIGINT AS total, sum(ntok)::BIGINT AS tokens,
 count(*) FILTER (CASE WHEN ntok >= 2 THEN hit >= total*0.85 ELSE ntok = 1 AND hit = total END) AS chord_lines FROM h GROUP BY ALL""")
def _(t):
    cov = doc_lines(t).select("doc_id", X.chord_coverage("line").alias("c"))
    return cov.groupBy("doc_id").agg(
        F.sum("c.hit").cast(L).alias("hit"), F.sum("c.total").cast(L).alias("total"), F.sum("c.tokens").cast(L).alias("tokens"),
        F.count_if(F.col("c.is_chords")).alias("chord_lines"))


IS_SECTION = "regexp_replace(lower({w}), '\\s*[0-9]+$', '') IN " + str(tuple(X.SECTION_WORDS))


# credits in smaller print: Latin text in brackets, a Latin name before roles (at the end, as any two characters before a role), a year
SMALL_CREDIT = (f"regexp_matches(t, '{X.LATIN_BRACKETED.replace(chr(39), chr(39) * 2)}') OR regexp_matches(t, '^\\D{{2,}}[,，(（ ]\\s*(?:1[0-9]|20)[0-9]{{2}}[)）]?$') "
                "OR (length(regexp_replace(t, '\\s', '', 'g')) > 2 AND regexp_matches(regexp_replace(t, '\\s', '', 'g'), '^..+(词曲|作词|作曲|编曲|词|曲|詞|译|譯)$'))")


@query("T12_classify_line", f"""WITH {LINES}, s AS (SELECT lang, trim(line) AS t, length(line) % 2 = 0 AS small, string_split_regex(regexp_replace(trim(line), '{X.BRACKETED}', ' ', 'g'), '\\s+') AS ws FROM lines),
b AS (SELECT lang, t, small, array_to_string(list_filter(ws, lambda w, i: NOT ({IS_SECTION.replace('{w}', 'w')}) AND NOT (regexp_full_match(w, '[0-9]+') AND i > 1 AND coalesce({IS_SECTION.replace('{w}', 'ws[i - 1]')}, false))), ' ') AS bare FROM s),
k AS (SELECT *, length(replace(sp, ' ', '')) AS total, regexp_extract_all(sp, '{CHORD_RE}', 1) AS toks FROM (SELECT *, {SPACED_SQL.replace('{x}', 'bare')} AS sp FROM b)),
h AS (SELECT *, len(toks) AS ntok, coalesce(list_sum(list_transform(toks, lambda x: length(x))), 0) AS hit, lower(regexp_extract(t, '^(\\w+)', 1)) AS word FROM k)
SELECT lang, CASE WHEN t <> '' AND (trim(bare) = '' OR (regexp_matches(bare, '[A-Za-z]') AND CASE WHEN ntok >= 2 THEN hit >= total*0.85 ELSE ntok = 1 AND hit = total END)) THEN 'annotation'
  WHEN word IN ('the', 'and', 'words', 'music') OR (small AND ({SMALL_CREDIT})) THEN 'credit' WHEN word IN ('copyright', 'license') OR t LIKE '©%' THEN 'rights'
  WHEN regexp_matches(t, '[（(]\\d+[)）]\\s*$') THEN 'toc' WHEN regexp_matches(t, '[0-9)]\\s*$') THEN 'index' ELSE 'text' END AS kind, count(*) AS n FROM h GROUP BY ALL""")
def _(t):
    kind = X.classify_line("line", credit=FIRST_WORDS, rights=RIGHTS, index=r"[0-9)]\s*$", smaller=F.length("line") % 2 == 0)
    return tally(doc_lines(t), "lang", kind.alias("kind"))


@query("T13_index_pairs", """WITH p AS (SELECT p_partkey, p_name, p_type, p_size, p_partkey % 1000 AS k FROM part),
e AS (SELECT p_partkey, 1 AS pos, 'heading' AS kind, (p_size)::VARCHAR || '画' AS label, NULL AS song_id FROM p UNION ALL
 SELECT p_partkey, 2, 'entry', p_name, lpad(p_size::VARCHAR, 3, '0') FROM p UNION ALL SELECT p_partkey, 3, 'entry', p_type, lpad(k::VARCHAR, 3, '0') FROM p)
SELECT p_partkey, pos::BIGINT AS pos, kind, label, song_id FROM e""")
def _(t):
    s = lambda x: F.col(x).cast("string")
    line = F.concat(s("p_size"), F.lit("画"), F.col("p_name"), s("p_size"), F.col("p_type"), F.pmod("p_partkey", F.lit(1000)).cast("string"))
    e = t.part.select("p_partkey", F.posexplode(X.index_pairs(line)).alias("pos", "e"))
    return e.select("p_partkey", (F.col("pos") + 1).cast(L).alias("pos"), "e.kind", "e.label", "e.song_id")


@query("T14_line_table", f"""WITH {LINES} SELECT doc_id, line_no, length(line)::BIGINT AS len,
 coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_
FROM lines""")
def _(t):
    return X.line_table(t.texts, "doc_id", "text").select(
        "doc_id", F.col("line_no").cast(L).alias("line_no"), F.length("line").cast(L).alias("len"), F.col("offset").cast(L).alias("offset_"))


ACCENTED, FOLDED = "àâäáãçéèêëíîïñóôöõúùûüß", "aaaaaceeeeiiinoooouuuus"


@query("T15_normalize_variants", f"""SELECT doc_id, md5(translate(text, '{ACCENTED}', '{FOLDED}')) AS digest,
  (length(text) - length(translate(text, '{ACCENTED}', '')))::BIGINT AS folded FROM documents""")
def _(t):
    return t.texts.select("doc_id", F.md5(X.normalize_variants("text", ACCENTED, FOLDED)).alias("digest"),
                              (F.length("text") - F.length(F.translate("text", ACCENTED, ""))).cast(L).alias("folded"))


@query("T16_safe_name", """WITH m AS (SELECT greatest(3, length(max(p_partkey)::VARCHAR)) AS w FROM part WHERE p_size % 7 <> 0),
n AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN lpad(p_partkey::VARCHAR, w::INT, '0') ELSE '未编号' || (p_partkey+1)::VARCHAR END AS head,
  CASE WHEN p_size % 11 = 0 THEN '' ELSE regexp_replace(p_name || '/' || p_type, '[\\\\/:*?"<>|\\s]+', '', 'g') END AS title FROM part, m)
SELECT p_partkey, head || ' ' || CASE WHEN title = '' THEN '未识别曲名' ELSE title END AS name FROM n""")
def _(t):
    rows = t.part.select(
        "p_partkey", F.when(F.pmod("p_size", F.lit(7)) != 0, F.col("p_partkey")).alias("number"),
        F.when(F.pmod("p_size", F.lit(11)) != 0, F.concat("p_name", F.lit("/"), "p_type")).alias("title"))
    width = rows.agg(F.length(F.max("number").cast("string"))).scalar()
    return rows.select("p_partkey", X.safe_name("number", "title", width, F.col("p_partkey") + 1).alias("name"))


@query("T17_clean_ref_lines", f"""WITH d AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN turn % 10 ELSE NULL END AS mm, text FROM conversations),
l AS (SELECT conv_id, turn, mm, unnest(range(len(p))) AS i, unnest(p) AS line FROM (SELECT conv_id, turn, mm, string_split_regex(text, '\\r\\n|\\r|\\n') AS p FROM d)),
s AS (SELECT *, 0 AS k FROM l WHERE mm IS NULL UNION ALL SELECT l.*, k FROM l, (VALUES (1), (2)) v(k) WHERE mm IS NOT NULL AND i = 0),
c AS (SELECT *, trim(regexp_replace(trim(line), '^\\d{{1,2}}\\s*[.:)]\\s*', '')) AS clean FROM s WHERE trim(line) <> ''
   AND NOT coalesce(lower(trim(CASE WHEN contains(line, ':') THEN split_part(line, ':', 1) END)) IN {tuple(X.LYRIC_META)}, false))
SELECT conv_id, turn, i::BIGINT AS line_no, CASE k WHEN 1 THEN mm*60 + 5.5 WHEN 2 THEN mm*60 + 90 END::DOUBLE AS at_, md5(clean) AS line FROM c
WHERE clean <> '' AND regexp_replace(lower(clean), '\\s*[0-9]+$', '') NOT IN {tuple(X.LYRIC_LABELS)}""")
def _(t):
    mm = F.pmod("turn", F.lit(10))
    stamps = F.concat(F.lit("["), mm.cast("string"), F.lit(":05.5]["), (mm + 1).cast("string"), F.lit(":30]"))
    text = F.when(F.pmod("conv_id", F.lit(2)) == 0, F.concat(stamps, F.col("text"))).otherwise(F.col("text"))
    d = t.conversations.select(F.struct("conv_id", "turn").alias("doc"), text.alias("text"))
    out = X.clean_ref_lines(d, "doc", "text")
    return out.select("doc.conv_id", "doc.turn", F.col("line_no").cast(L).alias("line_no"), F.col("at").alias("at_"), F.md5("line").alias("line"))


@query("T18_meta", """WITH e AS (SELECT event_id, event_type, json_extract(props, '$.k')::INT AS k FROM events)
SELECT event_id, (CASE WHEN event_type = 'click' THEN 'overridden' ELSE 'base' END) AS title,
  CASE WHEN k % 3 = 0 THEN 3 WHEN k % 3 = 1 THEN 2 ELSE 1 END::BIGINT AS n_tags, CASE WHEN event_type = 'view' THEN 'note' END AS note FROM e""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    tags = F.when(k % 3 == 0, "a; b；c").when(k % 3 == 1, " a ;;b").otherwise("a,b")
    base = F.create_map(F.lit("title"), X.split_meta(F.lit("title"), F.lit("base")), F.lit("tags"), X.split_meta(F.lit("tags"), tags))
    over = F.when(F.col("event_type") == "click", F.create_map(F.lit("title"), F.array(F.lit("overridden")))).when(
        F.col("event_type") == "view", F.create_map(F.lit("note"), F.array(F.lit("note"))))
    m = t.events.select("event_id", X.overlay_meta(base, over).alias("m"))
    return m.select("event_id", F.get("m.title", F.lit(0)).alias("title"), F.size("m.tags").cast(L).alias("n_tags"),
                    F.get("m.note", F.lit(0)).alias("note"))
