"""Quality rules: counts over each text, hard limits, and an isolation forest over the rates of those counts.

Each tree of the forest splits a small random sample at random places until its rows stand alone.  Rows that part
early from the rest (short mean path) are anomalies.  How short a path may be is set on all labelled rows, counted by
score: the score that best parts the two classes while at most `max_lost` of the good rows lie beyond it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import NOT_SPACE, U64, Texts, Words, grams, mix, pieces, small_batches, table, within
from .registry import query

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_marks", "n_short"]
#: Lines and words that repeat are left to the hard limits: among clean texts they vary so much that they hide the rest.
RATES = ["word_length", "symbols", "marks", "short"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _by_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def count(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text; all 0 for a null or empty one."""
    texts = Texts(column)
    buf, at, n = texts.buf, texts.offsets, texts.n
    words = Words(texts)
    out = {"n_words": words.count}
    out["word_chars"] = _per_doc(NOT_SPACE[buf] & ~_CONTINUES[buf], at)
    for name, kind in (("n_symbols", _SYMBOL), ("n_marks", _MARK)):
        out[name] = _per_doc(kind[buf], at)
    out["n_short"] = _by_doc(words.doc[words.end - words.start <= 1], n)
    # Lines are words over "every byte but the line feed"; those without a word count for nothing.
    not_feed = np.ones(256, bool)
    not_feed[0x0A] = False
    lines = Words(texts, not_feed)
    has = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    doc = lines.doc[has]
    _, once = np.unique(mix(lines.hashes()[has] + doc.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
    out["n_dup_lines"] = _by_doc(doc, n) - _by_doc(doc[once], n)
    g = grams(words.hashes(), 3)
    ok = within(words.doc, 3)
    covered = np.zeros(len(words.doc), bool)
    if ok.any():
        at3 = np.flatnonzero(ok)
        key = mix(g[at3] + words.doc[at3].astype(U64) * U64(0x9E3779B97F4A7C15))
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        again = at3[times[back] > 1]
        for j in range(3):
            covered[again + j] = True
    out["n_repeat_words"] = _by_doc(words.doc[covered], n)
    return out


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, counts) for each row."""
    names = [*COUNTS, *MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            c = count(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c[x], pa.int64()) for x in names)], ["id", *names])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, " + ", ".join(f"{x} bigint" for x in names))


def rates(c: dict[str, np.ndarray]) -> np.ndarray:
    """Word length, and symbols, exclamation and question marks and one-byte words for each word."""
    w = np.maximum(c["n_words"], 1)
    return np.stack([c[x] / w for x in ("word_chars", "n_symbols", "n_marks", "n_short")], axis=1)


def _usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    """Random trees over samples of `size` rows (small ones, so that anomalies seldom hide each other); each node is (feature, place, left, right) or a leaf's path length."""

    def __init__(self, rows: np.ndarray, trees: int = 100, size: int = 32, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.usual = _usual_path(min(size, len(rows))) or 1.0
        self.trees = [self._grow(rows[rng.choice(len(rows), min(size, len(rows)), replace=False)], rng) for _ in range(trees if len(rows) else 0)]

    @staticmethod
    def _grow(rows: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        limit = math.ceil(math.log2(max(len(rows), 2)))
        feature, place, left, right, path = [], [], [], [], []
        todo = [(rows, 0, -1, 0)]
        while todo:
            x, depth, parent, side = todo.pop()
            me = len(feature)
            if parent >= 0:
                (right if side else left)[parent] = me
            low, high = x.min(axis=0), x.max(axis=0)
            free = np.flatnonzero(high > low)
            for seq, v in ((feature, -1), (place, 0.0), (left, me), (right, me), (path, depth + _usual_path(len(x)))):
                seq.append(v)
            if depth < limit and len(x) > 1 and len(free):
                f = int(rng.choice(free))
                at = rng.uniform(low[f], high[f])
                feature[me], place[me] = f, at
                goes = x[:, f] <= at
                todo += [(x[goes], depth + 1, me, 0), (x[~goes], depth + 1, me, 1)]
        return [np.array(feature), np.array(place), np.array(left), np.array(right), np.array(path)]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): towards 1 for rows that part early."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, place, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                f = feature[at]
                go = f >= 0
                if not go.any():
                    break
                low = rows[every, np.where(go, f, 0)] <= place[at]
                at = np.where(go, np.where(low, left[at], right[at]), at)
            total += path[at]
        return 2.0 ** (-total / max(len(self.trees), 1) / self.usual)


#: Places after the decimal point of a score, where scores are counted: so there are at most 10 ** 4 of them.
PLACES = 4


def calibrate(scores: np.ndarray, good: np.ndarray, max_lost: float = 0.002, counts: np.ndarray | None = None) -> float:
    """Score beyond which a row is anomalous: parts the labelled classes best among those that lose few good rows.

    counts: how often each (score, good) occurs, once without it.
    """
    counts = np.ones(len(scores), np.int64) if counts is None else counts
    if not good.any() or good.all():
        return math.inf
    cut, at = np.unique(scores, return_inverse=True)
    upto = [np.cumsum(np.bincount(at[x], counts[x], len(cut))) for x in (good, ~good)]
    lost, caught = (1 - n / n[-1] for n in upto)
    ok = lost <= max_lost
    best = np.flatnonzero(ok)[(caught - lost)[ok].argmax()]
    # half way to the next score, so that rows like the ones seen fall on their side
    return float(cut[best] + (cut[best + 1] - cut[best]) / 2) if best + 1 < len(cut) else math.inf


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", sample: int = 8000) -> tuple[IsolationForest, float]:
    """Forest over at most `sample` rows with a label (those of least id hash), and its threshold from all labels.

    The forest sees no label; it grows on the rows that the hard limits keep.  The threshold comes from the counts of
    (score, label) over all of these rows, whose scores are rounded to PLACES for it.
    """
    names = [*COUNTS, *MORE]
    known = labels.select(F.col(doc_id).cast("bigint").alias("id"), F.col(quality).cast("int").alias("good")).dropna().groupBy("id").agg(F.min("good").alias("good"))
    rows = cut_lineage(stats.filter("NOT base_failed").join(known, "id").select("id", "good", *names))
    some = rows.orderBy(F.xxhash64("id"), *names).limit(sample).toPandas()
    if some.empty:
        return IsolationForest(np.zeros((0, len(RATES)))), math.inf
    forest = IsolationForest(rates({c: some[c].to_numpy() for c in names}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = forest.score(rates({c: b.column(c).to_numpy() for c in names}))
                yield pa.RecordBatch.from_arrays([pa.array(np.round(s * 10**PLACES).astype(np.int64)), pc.equal(b.column("good"), 1)], ["score", "good"])

    seen = rows.mapInArrow(run, "score bigint, good boolean").groupBy("score", "good").agg(F.count(F.lit(1)).alias("n")).toPandas()
    return forest, calibrate(seen["score"].to_numpy() / 10**PLACES, seen["good"].to_numpy(bool), counts=seen["n"].to_numpy())


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = 8000) -> DataFrame:
    """(doc_id, counts, base_failed, anomaly, kept) for each row of docs.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows; then kept is false.  Else kept
    says that the anomaly score doesn't pass the threshold.  A null or empty text has no words and fails.  Without
    labelled rows of both classes nothing is anomalous.  A null doc_id is judged as any other; repeated rows are
    judged alike; other columns don't matter; an empty table gives no rows.
    """
    docs = small_batches(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = statistics(docs, doc_id, text).withColumn("base_failed", failed)
    forest, threshold = fit(stats, labels, doc_id, quality, sample)
    names = [*COUNTS, *MORE]

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = forest.score(rates({c: b.column(c).to_numpy() for c in names}))
                failed = b.column("base_failed").to_numpy(zero_copy_only=False)
                cols = [b.column("id"), *(b.column(c) for c in COUNTS), b.column("base_failed"), pa.array(s), pa.array(~failed & (s <= threshold))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *COUNTS, "base_failed", "anomaly", "kept"])

    kinds = ", ".join(f"{x} bigint" for x in COUNTS)
    return stats.mapInArrow(run, f"doc_id bigint, {kinds}, base_failed boolean, anomaly double, kept boolean")


@query("op4_quality_rules")
def op4(spark, folder):
    return judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
