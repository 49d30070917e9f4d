"""Quality classifier: a byte-level convolutional network in numpy.

Filters see six neighbouring bytes, at every second byte.  A document is cut into overlapping chunks that cover it; each
filter's largest answer in a chunk, less a learned bound, is the chunk's feature, and the mean of the chunks' features
goes through a logistic unit.  The filters are tables over byte values, so an answer is a sum of three look-ups by byte
pair.  Training follows the gradient through the place of each largest answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, held_out, pieces, small_batches, stream, table
from .registry import query

TAPS, FILTERS = 6, 12
#: A chunk has CHUNK blocks of BLOCK filter places (two bytes each); the next one starts STEP blocks later.
BLOCK, CHUNK, STEP = 64, 4, 3
SPAN = BLOCK * CHUNK * 2


class Network:
    """taps: (TAPS, 256, FILTERS) answers of each filter to a byte at a tap; bound, weight, bias: the units above."""

    def __init__(self, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.parts = {
            "taps": rng.normal(0, 0.3, (TAPS, 256, FILTERS)).astype(np.float32), "bound": np.zeros(FILTERS, np.float32),
            "weight": rng.normal(0, 0.3, FILTERS).astype(np.float32), "bias": np.zeros(1, np.float32)}

    def pairs(self) -> list[np.ndarray]:
        """Answers to pairs of bytes (first * 256 + second) at taps 0-1, 2-3 and 4-5."""
        t = self.parts["taps"]
        return [(t[i][:, None, :] + t[i + 1][None, :, :]).reshape(65536, FILTERS) for i in range(0, TAPS, 2)]

    def train(self, chunks: np.ndarray, row: np.ndarray, y: np.ndarray, rounds: int = 8, batch: int = 64, rate: float = 0.02) -> None:
        """chunks: (n, SPAN) bytes of the rows named in `row` (ascending), y: their labels.  Adam on the mean log loss."""
        rng = np.random.default_rng(7)
        first = np.searchsorted(row, np.arange(len(y) + 1))
        p = self.parts
        m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        step = 0
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for a in range(0, len(y), batch):
                mine = order[a : a + batch]
                at = np.concatenate([np.arange(first[i], first[i + 1]) for i in mine])
                owner = np.repeat(np.arange(len(mine)), [first[i + 1] - first[i] for i in mine])
                n = np.bincount(owner, minlength=len(mine))[:, None]
                x = chunks[at].astype(np.int64)
                places = (SPAN - TAPS) // 2 + 1
                answer = sum(p["taps"][j][x[:, j : j + 2 * places - 1 : 2]] for j in range(TAPS))
                top = answer.argmax(axis=1)
                peak = np.take_along_axis(answer, top[:, None, :], 1)[:, 0] - p["bound"]
                pooled = np.maximum(peak, 0)
                doc = np.zeros((len(mine), FILTERS), np.float32)
                np.add.at(doc, owner, pooled)
                doc /= n
                out = 1 / (1 + np.exp(-(doc @ p["weight"] + p["bias"])))
                err = ((out - y[mine]) / len(mine)).astype(np.float32)
                down = (err[:, None] * p["weight"] / n).astype(np.float32)[owner] * (peak > 0)
                g = {"weight": doc.T @ err, "bias": err.sum(keepdims=True), "bound": -down.sum(axis=0), "taps": np.zeros_like(p["taps"])}
                f = np.arange(FILTERS)[None, :]
                for j in range(TAPS):
                    np.add.at(g["taps"][j], (np.take_along_axis(x, top * 2 + j, 1), f), down)
                step += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def _pair_codes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte pairs of all texts, each padded with zeros to whole blocks and TAPS more bytes, and the first block of each."""
    blocks = np.maximum(-(-texts.sizes() // (2 * BLOCK)), 1)
    first = np.concatenate([[0], np.cumsum(blocks)])
    flat = np.zeros(int(first[-1]) * 2 * BLOCK + TAPS, np.uint8)
    doc = np.repeat(np.arange(texts.n), texts.sizes())
    flat[np.arange(len(texts.buf)) + (first[:-1] * 2 * BLOCK - texts.offsets[:-1])[doc]] = texts.buf
    return flat[0::2].astype(np.int32) << 8 | flat[1::2], first


def score(column: pa.Array, tables: list[np.ndarray], parts: dict[str, np.ndarray]) -> np.ndarray:
    """Probability of each whole text."""
    codes, first = _pair_codes(Texts(column))
    n = int(first[-1]) * BLOCK
    answer = np.take(tables[0], codes[:n], axis=0)
    for i in (1, 2):
        answer += np.take(tables[i], codes[i : n + i], axis=0)
    peaks = answer.reshape(-1, BLOCK, FILTERS).max(axis=1)
    blocks = np.diff(first)
    chunks = np.maximum(-(-(blocks - CHUNK) // STEP), 0) + 1
    doc = np.repeat(np.arange(len(blocks)), chunks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start, last = first[doc] + nth * STEP, first[doc + 1] - 1
    top = peaks[start]
    for j in range(1, CHUNK):
        np.maximum(top, peaks[np.minimum(start + j, last)], out=top)
    pooled = np.maximum(top - parts["bound"], 0)
    total = np.add.reduceat(pooled, np.cumsum(chunks) - chunks, axis=0)
    return 1 / (1 + np.exp(-np.clip((total / chunks[:, None]) @ parts["weight"] + parts["bias"], -60, 60).astype(np.float64)))


def training_chunks(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, quality: str, rows: int, each: int) -> DataFrame:
    """(id, good, chunk) of at most `rows` labelled rows that aren't held out (those of least id hash).

    A row gives up to `each` chunks from places spread over the whole text by a hash of its id.
    """
    known = labels.select(F.col(doc_id).cast("bigint").alias("id"), F.col(quality).cast("int").alias("good")).dropna()
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(rows)
    met = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(known), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            texts = Texts(part.column("text"))
            take, chunks = [], []
            for i in range(texts.n):
                raw = texts.buf[texts.offsets[i] : texts.offsets[i + 1]]
                room = max(len(raw) - SPAN, 0) + 1
                lots = stream(part.column("id")[i].as_py() % 1_000_003, each) % np.uint64(room)
                for at in np.unique(lots if room > 1 else lots[:1]).tolist():
                    take.append(i)
                    chunks.append(raw[at : at + SPAN].tobytes().ljust(SPAN, b"\0"))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(take, pa.int64())) for c in ("id", "good")), pa.array(chunks, pa.binary())], ["id", "good", "chunk"])

    return met.mapInArrow(run, "id bigint, good int, chunk binary").limit(rows * each)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", rows: int = 2000, each: int = 4) -> Network:
    net = Network()
    got = training_chunks(docs, labels, doc_id, text, quality, rows, each).orderBy("id", "chunk").collect()
    if got:
        ids, row = np.unique([r.id for r in got], return_inverse=True)
        y = np.zeros(len(ids), np.float32)
        y[row] = [r.good == 1 for r in got]
        net.train(np.frombuffer(b"".join(r.chunk for r in got), np.uint8).reshape(-1, SPAN), row, y)
    return net


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", rows: int = 2000, each: int = 4) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs: the network's probability of label 1.

    Trained on at most `rows` labelled rows that aren't held out, `each` chunks of a row at most.  A null or empty
    text is one blank chunk.  Without labelled rows the network is as drawn.  A null doc_id counts as not held out but
    is not learned from.  Rows that repeat a doc_id are scored each by its own text; a doc_id with several labels
    counts as 0 if one of them is.  Other columns don't matter; an empty table gives no rows.
    """
    docs = small_batches(docs)
    net = fit(docs, labels, doc_id, text, quality, rows, each)
    parts = net.parts

    def run(batches):
        tables = Network.pairs(net)
        for part in pieces(batches, "text", 1 << 18):
            s = score(part.column("text"), tables, parts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    rows_ = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(F.col(doc_id).cast("bigint")).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows_.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


@query("op2_quality_classifier")
def op2(spark, folder):
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
