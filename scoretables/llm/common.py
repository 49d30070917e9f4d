"""Words, shingles and hashes of whole batches of texts, in numpy over their UTF-8 bytes, and small frame helpers.

A null text has no words. Hashes are 64 bits wide; where equality decides a result, two independent ones are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK_BYTES = 1 << 20

#: White space that parts words: blank, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~_SPACE
#: Letters, digits and every byte of a character outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finalizer of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


#: Words of up to so many bytes are hashed in lanes of eight, longer ones (rare) by a digest.
LANES = 8
_SEEDS = stream(11, 4)


class Texts:
    """Some documents' bytes one after another; `offsets` has their ends."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
        self.buf = _LOWER[raw] if lower else raw
        self.offsets = at - at[0] if len(column) else np.zeros(1, np.int64)
        self.n = len(column)

    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)


class Words:
    """Words of some documents: first byte, end and document of each, and where each document's words begin."""

    def __init__(self, texts: Texts, keep: np.ndarray = NOT_SPACE):
        self.texts = texts
        inside = keep[texts.buf]
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = texts.offsets[1:-1]
        edges = edges[edges < n]
        before[edges] = False
        edges = texts.offsets[1:-1]
        after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, texts.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(texts.n), self.count)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: two states take up eight bytes a step and are joined at the end."""
        buf = self.texts.buf
        padded = np.zeros(len(buf) + 8, np.uint8)
        padded[: len(buf)] = buf
        eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
        size = self.end - self.start
        x = mix(size.astype(U64) * _SEEDS[0] + _SEEDS[1])
        y = x ^ _SEEDS[2]
        on = np.flatnonzero(size <= 8 * LANES)
        lane = 0
        while len(on):
            w = eight[self.start[on] + 8 * lane]
            w &= U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * np.minimum(size[on] - 8 * lane, 8).astype(U64))
            x[on] = mix(x[on] ^ w)
            if lane:
                y[on] = mix((y[on] + w) * (_SEEDS[3] | U64(1)))
            lane += 1
            on = on[size[on] > 8 * lane]
        out = mix(x + y * U64(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(size > 8 * LANES).tolist():
            digest = hashlib.blake2b(memoryview(padded)[self.start[i] : self.end[i]], digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
        return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbouring values; the caller leaves out those that cross documents."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    g = np.zeros(n, U64)
    for j in range(k):
        g = g * U64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(g + U64(k))


def within(doc: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k neighbouring words lie in one document."""
    return doc[k - 1 :] == doc[: len(doc) - k + 1] if len(doc) >= k else np.zeros(0, bool)


def shingle_sets(column: pa.Array, k: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; with fewer words the whole sequence counts as one."""
    words = Words(Texts(column, lower))
    h = words.hashes()
    g = grams(h, k)
    out = []
    for d in range(words.texts.n):
        a, b = words.first[d], words.first[d + 1]
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(grams(h[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about `limit` bytes of text, and one document at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


#: Rows of a batch between the JVM and Python, where the session allows more: texts are long.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session hands over at most BATCH_ROWS rows at once from now on, so that a batch of texts stays small."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def column(df: DataFrame, name: str, kind: str, alias: str) -> Column:
    """A column by another name and type; as it is where it has them, so that equal plans stay equal."""
    if name == alias and dict(df.dtypes)[name] == kind:
        return F.col(name)
    return F.col(name).cast(kind).alias(alias)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a contiguous matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.array([rows.data.cast("B")[i * width : (i + 1) * width] for i in range(len(rows))] if width else [b""] * len(rows), pa.binary())
