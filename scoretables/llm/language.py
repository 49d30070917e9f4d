"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  For each bit a logistic classifier over hashed byte n-grams predicts it; a
text's language is the one whose codeword costs least, the bits' losses weighted by how well each classifier did on
its training rows.  When the two cheapest codewords cost nearly the same, the answer is flagged as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, held_out, pieces, small_batches, table
from .registry import query

BUCKETS = 4096
UNKNOWN = "und"
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def codewords(k: int, seed: int = 10) -> np.ndarray:
    """Codewords (+1, -1) of k classes: every way to part them for few classes, else random parts."""
    if k <= 7:
        bits = [[1 if (c << 1 | 1) >> i & 1 else -1 for i in range(k)] for c in range(2 ** max(k - 1, 1) - 1)]
        return np.array(bits, np.float32).T.reshape(k, len(bits))
    n = max(15, math.ceil(10 * math.log2(k)))
    rng = np.random.default_rng(seed)
    tries = [rng.choice(np.array([-1, 1], np.float32), (k, n)) for _ in range(50)]
    return max(tries, key=lambda c: ((n - c @ c.T) / 2 + n * np.eye(k)).min())


def features(column: pa.Array) -> np.ndarray:
    """Square roots of n-gram shares (n = 1, 2, 3; what isn't a letter counts as one blank), a row for each text."""
    texts = Texts(column)
    b = _LETTERS[texts.buf].astype(np.uint32)
    doc = np.repeat(np.arange(texts.n), texts.sizes())
    out = np.zeros((texts.n, BUCKETS), np.float32)
    cells = []
    for n in (1, 2, 3):
        if len(b) >= n:
            code = np.zeros(len(b) - n + 1, np.uint32)
            for j in range(n):
                code = code << np.uint32(8) | b[j : len(b) - n + 1 + j]
            one = doc[n - 1 :] == doc[: len(doc) - n + 1]
            code, d = code[one], doc[n - 1 :][one]
            place = ((code + np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
            cells.append(d * BUCKETS + place)
    if cells:
        total = np.bincount(np.concatenate(cells), minlength=texts.n * BUCKETS).reshape(texts.n, BUCKETS)
        out = np.sqrt(total / np.maximum(total.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    return out


class Coder:
    """Codewords of the languages and a linear classifier for each bit."""

    def __init__(self, x: np.ndarray, langs: list[str], rounds: int = 150, rate: float = 30.0):
        self.langs = sorted(set(langs))
        self.codes = codewords(len(self.langs))
        y = self.codes[[self.langs.index(v) for v in langs]] if langs else np.zeros((0, 0), np.float32)
        self.w = np.zeros((BUCKETS, y.shape[1]), np.float32)
        self.bias = np.zeros(y.shape[1], np.float32)
        # rows of rare languages weigh as much in all as those of frequent ones
        share = np.array([1 / langs.count(v) for v in langs], np.float32)
        share = (share / share.sum())[:, None] if len(share) else share
        for _ in range(rounds if len(self.langs) > 1 else 0):
            g = -y / (1 + np.exp(y * (x @ self.w + self.bias))) * share
            self.w -= rate * (x.T @ g + 1e-5 * self.w)
            self.bias -= rate * g.sum(axis=0)
        loss = (np.logaddexp(0, -y * (x @ self.w + self.bias)) * share).sum(axis=0) if len(self.langs) > 1 else np.zeros(y.shape[1])
        self.trust = np.exp(-loss) / max(np.exp(-loss).sum(), 1e-12) * y.shape[1]

    def costs(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of each codeword."""
        f = x @ self.w + self.bias
        return (np.logaddexp(0, -self.codes[None] * f[:, None]) * self.trust).sum(axis=2)


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, rows: int) -> DataFrame:
    """(text, lang) of training rows: about `rows` in all, spread over the languages, never over twice as many."""
    known = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    known = known.filter(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return known.select("text", "lang").limit(0)
    each = max(rows // len(counts), 20)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])
    lot = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    return known.filter(lot < share[F.col("lang")]).select("text", "lang").limit(2 * each * len(counts))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = 2000) -> Coder:
    """Coder trained on a bounded sample of the rows that aren't held out (`rows`, twice as many at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = sample(docs, doc_id, text, lang, rows).mapInArrow(run, "lang string, x binary").orderBy("lang", "x").collect()
    x = np.array([np.frombuffer(r.x, np.float16) for r in got], np.float32).reshape(-1, BUCKETS)
    return Coder(x, [r.lang for r in got])


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = 2000, margin: float = 0.2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for each row of docs.

    lang_pred is `und` with score 0 for a text that is null or has no letter, or when no language was learned.  score:
    the chosen codeword's share when costs are read as log-odds; ambiguous: that of the next one lies within `margin`.
    lang is only read to learn.  A null doc_id counts as not held out but is not learned from.  Repeated rows give the
    same; other columns don't matter; an empty table gives no rows.
    """
    docs = small_batches(docs)
    coder = fit(docs, doc_id, text, lang, rows)

    def run(batches):
        for part in pieces(batches, "text", 1 << 19):
            n = part.num_rows
            letter = pc.fill_null(pc.match_substring_regex(part.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pred, score, ambiguous = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
            if coder.langs:
                # long texts a few at a time: a row of features has a fixed width
                x = np.concatenate([features(part.column("text").slice(i, 256)) for i in range(0, n, 256)])
                share = np.exp(-coder.costs(x))
                share /= share.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1)
                pred[letter] = np.array(coder.langs, object)[best][letter]
                ranked = np.sort(share, axis=1)
                score[letter] = ranked[letter, -1]
                ambiguous[letter] = (ranked[:, -1] - (ranked[:, -2] if len(coder.langs) > 1 else 0) < margin)[letter]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(ambiguous)],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows_ = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(F.col(doc_id).cast("bigint")).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows_.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")


@query("op10_language_id")
def op10(spark, folder):
    return identify(table(spark, folder, "documents"))
