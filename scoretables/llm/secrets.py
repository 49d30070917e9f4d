"""Secret scan: candidates by shape, false positives removed by a random forest.

All of it is DataFrame and MLlib work in the JVM.  A candidate is a run of at least 16 letters, digits or `+/_=-`, or a
value of any length and characters that a telling name and a sign stand before, in the same word or before it; between
quotes it may hold blanks.  The forest judges a candidate by its length, its character classes and the changes between
them, how much of it the dictionary covers (the corpus' own frequent short words), its document's path, and what stands
beside it.  It is trained on labelled findings; `weak_labels` gives such for a corpus without any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table
from .registry import query

RUN = r"[A-Za-z0-9+/_=\-]{16,}"
SPACE = r"[\x20\x09-\x0D]+"
KEYWORD = r"(?i)token|secret|passw|api|key|auth|credential|bearer"
#: Put before each assigned value; a code point that Unicode keeps free for such uses.
START = "\uFDD0"
#: Up to an assigned value: a telling name, perhaps one more word, a sign.
ASSIGN = (r"((?i:token|secret|passw|api|key|auth|credential|bearer)[\w.\-]{0,64}+(?:[\x20\t]++[\w.\-]{1,64}+)?+[\"'`\])]{0,2}+[\x20\x09-\x0D]*+"
          r"(?:=>|:=|==?|:)[\x20\x09-\x0D]*+(?:[\"'`]?(?i:bearer|basic)[\x20\t]++)?)(?=[^\x20\x09-\x0D])")
#: From there: between quotes, or up to the next white space.
VALUE = START + "(?=(" + "|".join(rf"{q}(?:[^{q}\\\r\n]++|\\.){{1,500}}+{q}" for q in "\"'`") + r"|[^\x20\x09-\x0D]++))"
QUOTED = r"""(?s)^(["'`])(.+)\1$"""
#: What may close an unquoted value.
CLOSING = r"""[\"'`,;.)\]}>]"""
SIDE_PATH = r"(?i)test|example|sample|mock|fixture|doc"
#: Words of the dictionary.
DICTIONARY = 2000
FEATURES = ["length", "digits", "upper", "hex", "changes", "distinct_share", "other", "covered", "path_aside", "keyword", "assigned", "quoted", "next_word", "names"]
MARK = "[SECRET]"


def dictionary(docs: DataFrame, text: str = "text", words: int = DICTIONARY) -> list[str]:
    """The most frequent words of three to six letters, counted over all texts."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(r"\b[a-z]{3,6}\b"), F.lit(0))).alias("w"))
    top = found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(words)
    return sorted(r.w for r in top.collect())


def _share(of: Column, pattern: str) -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.length(of)


def mark(text: Column) -> Column:
    """text with START before each assigned value; the white space stays as it is."""
    return F.regexp_replace(F.replace(text, F.lit(START), F.lit("?")), F.lit(ASSIGN), F.lit("$1" + START))


def _maybe(text: Column) -> Column:
    return text.rlike(RUN) | text.rlike(ASSIGN)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """(doc_id, text_key, word, nth, run, before, sign, after, quoted, named, path): every candidate, by the number of its word.

    named: a telling name and a sign stand right before it.  An assigned value has the word it begins in, and its nth
    counts on from the word's runs; one that is a single run appears as such.  text_key tells rows of one doc_id apart.
    """
    none = F.lit("")
    runs = F.regexp_extract_all(F.col("c.w"), F.lit(f"(?:{START}[\"'`]?)?{RUN}"), F.lit(0))
    near = F.transform(F.split("marked", SPACE), lambda w, i: F.when(w.rlike(RUN) | w.contains(START), F.struct(
        i.cast("bigint").alias("word"), w.alias("w"), F.get(F.col("words"), i - 2).alias("before"), F.get(F.col("words"), i - 1).alias("sign"),
        F.get(F.col("words"), i + 1).alias("after"))))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path"))
    rows = rows.filter(_maybe(F.col("text"))).withColumn("marked", mark(F.col("text"))).withColumn("words", F.split("text", SPACE))
    rows = rows.select("doc_id", F.md5("text").alias("text_key"), "path", F.filter(near, lambda c: c.isNotNull()).alias("cs"),
                       F.regexp_extract_all("marked", F.lit(VALUE), F.lit(1)).alias("values"))
    names = ["doc_id", "text_key", "word", "nth", "run", "before", "sign", "after", "quoted", "named", "path"]

    found = rows.select("doc_id", "text_key", "path", F.explode("cs").alias("c"))
    found = found.select("doc_id", "text_key", "path", "c.*", F.posexplode(runs).alias("nth", "m"))
    quoted = F.replace("w", F.lit(START), none).rlike(r"""^["'].*["'][.,;:]?$""")
    found = found.withColumns({"run": F.regexp_extract("m", RUN, 0), "named": F.col("m").startswith(START), "quoted": quoted}).select(*names)

    # the marks of the words in turn, each with its value
    starts = F.flatten(F.transform("cs", lambda c: F.transform(
        F.array_repeat(c, F.length(c.w) - F.length(F.replace(c.w, F.lit(START), none))), lambda c, j: F.struct(c.alias("c"), j.alias("j")))))
    more = rows.select("doc_id", "text_key", "path", F.explode(F.arrays_zip(starts.alias("s"), F.col("values").alias("v"))).alias("z"))
    more = more.select("doc_id", "text_key", "path", F.col("z.s.c").alias("c"), F.col("z.s.j").alias("j"), F.col("z.v").alias("v"))
    quoted = F.col("v").rlike(QUOTED)
    raw = F.when(quoted, F.regexp_extract("v", QUOTED, 2)).otherwise(F.regexp_replace(F.regexp_replace("v", "^[\"'`]", ""), CLOSING + "+$", ""))
    more = more.withColumns({"raw": raw, "quoted": quoted, "named": F.lit(True), "nth": (F.size(runs) + F.col("j")).cast("int")})
    more = more.filter(~F.col("raw").rlike(f"^{RUN}$")).withColumn("run", F.replace("raw", F.lit(START), none)).filter("run <> ''")
    return found.unionByName(more.select("doc_id", "text_key", "path", "c.*", "nth", "run", "quoted", "named").select(*names))


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """found with a column for each feature."""
    run, none = F.col("run"), F.lit("")
    left = F.concat_ws(" ", F.coalesce("before", none), F.coalesce("sign", none))
    # without look-around, so that every run is read once
    changes = reduce(lambda a, b: a + b, [F.regexp_count(run, F.lit(p)) for p in ("[0-9]+", "[a-z]+", "[A-Z]+")])
    pieces = "|".join(sorted(words, key=lambda w: (-len(w), w))) or "$^"
    covered = 1 - F.length(F.regexp_replace(F.lower(run), pieces, "")) / F.length(run)
    values = {
        "length": F.length(run), "digits": _share(run, "[0-9]"), "upper": _share(run, "[A-Z]"), "hex": _share(run, "[0-9a-fA-F]"), "other": _share(run, r"[^A-Za-z0-9+/_=\-]"),
        "changes": changes / F.length(run), "distinct_share": F.size(F.array_distinct(F.split(run, ""))) / F.length(run), "covered": covered,
        "path_aside": F.coalesce(F.col("path").rlike(SIDE_PATH), F.lit(False)), "keyword": F.col("named") | left.rlike(KEYWORD), "assigned": F.col("named") | left.rlike("[=:]$"),
        "quoted": F.col("quoted"), "next_word": F.coalesce(F.col("after").rlike("^[a-zA-Z]+[.,]?$"), F.lit(False)),
        "names": run.rlike(f"(?:{KEYWORD})[\\w-]*=$")}
    return found.withColumns({k: v.cast("double") for k, v in values.items()})


def weak_labels(found: DataFrame) -> DataFrame:
    """found (with features) with `label`: 1 for values assigned to a telling name, 0 for bare numbers, for words of the
    dictionary with a few digits, for words of small letters and for names before a sign, null where neither is sure."""
    number = F.col("run").rlike("^[0-9=_+/-]+$")
    wordy = (F.col("covered") > 0.5) & (F.col("digits") < 0.3)
    plain = F.col("run").rlike(r"^[A-Z]?[\p{Ll}_\-\x20,.'’]+$") | (F.col("names") == 1)
    named = (F.col("keyword") == 1) & (F.col("assigned") == 1)
    prose = wordy & plain & (F.col("quoted") == 0)
    return found.withColumn("label", F.when(named & ~number & ~wordy & ~plain, 1.0).when(((number | wordy | plain) & ~named) | prose, 0.0))


def train(findings: DataFrame, sample: int = 20_000, trees: int = 30, depth: int = 6) -> RandomForestClassificationModel | None:
    """Forest over at most `sample` labelled findings (those of least hash); None unless both labels occur."""
    rows = findings.filter("label IS NOT NULL").orderBy(F.xxhash64("run", "doc_id"), "run", "doc_id", "word", "nth").limit(sample)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.select(*FEATURES, "label"))
    if len(rows.select("label").distinct().take(2)) < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=3, featureSubsetStrategy="onethird").fit(rows)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_key, word, nth, run, score, is_secret): every candidate and the forest's verdict.

    word: number of the word in the text (from 0, over the pieces between white space), nth: of the candidate in it.
    labelled: findings with features and a label; without it those of `weak_labels` over docs.  If not both labels
    occur, nothing is removed and all candidates count as secrets with score 1.  Null and empty texts have no
    candidates; a null doc_id is kept; repeated rows repeat their findings; other columns don't matter.
    """
    found = cut_lineage(features(candidates(docs, doc_id, text, path), dictionary(docs, text)))
    forest = train(weak_labels(found) if labelled is None else labelled)
    if forest is None:
        judged = found.withColumn("score", F.lit(1.0))
    else:
        judged = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
        judged = judged.withColumn("score", vector_to_array("probability")[1])
    return judged.select("doc_id", "text_key", "word", "nth", "run", "score", (F.col("score") >= 0.5).alias("is_secret"))


def _literal(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """docs with every found secret replaced by a mark; all columns and rows stay, other texts are unchanged.

    A secret of 16 characters or more goes wherever it stands in its text, a shorter one only where it is assigned.
    Only rows that have a candidate are shuffled.
    """
    found = scan(docs, doc_id, text, path).filter("is_secret").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    # longer ones first: one may contain another
    found = found.agg(F.array_sort(F.collect_set("run"), lambda a, b: F.length(b) - F.length(a)).alias("__runs"))
    text_ = F.col(text).cast("string")
    maybe = F.coalesce(_maybe(text_), F.lit(False))
    some = docs.filter(maybe).withColumn("__md5", F.md5(text_))
    some = some.join(found, F.col(doc_id).cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__md5") == F.col("__key")), "left")
    runs = F.coalesce("__runs", F.array().cast("array<string>"))
    long, short = F.filter(runs, lambda s: F.length(s) >= 16), F.filter(runs, lambda s: F.length(s) < 16)
    clean = F.aggregate(long, text_, lambda t, s: F.replace(t, s, F.lit(MARK)))
    in_place = F.aggregate(short, mark(clean), lambda t, s: F.regexp_replace(
        t, F.concat(F.lit(f"{START}([\"'`]?)"), _literal(mark(s)), F.lit(rf"(?={CLOSING}*(?:[\x20\x09-\x0D]|$)|[\"'`])")), F.lit("$1" + MARK)))
    some = some.withColumn(text, F.when(F.size(short) > 0, F.replace(in_place, F.lit(START), F.lit(""))).otherwise(clean)).select(*docs.columns)
    return docs.filter(~maybe).withColumn(text, text_).unionByName(some)


@query("op3_secret_scan")
def op3(spark, folder):
    found = scan(table(spark, folder, "documents"))
    return found.select("doc_id", "word", "nth", F.length("run").cast("bigint").alias("length"), F.sha2("run", 256).alias("run_sha256"), F.round("score", 6).alias("score"), "is_secret")
