"""Byte-level BPE encoding and decoding with a rank queue.

Each pre-token's symbols form a linked list.  Every pair of neighbours that the vocabulary joins waits in the bucket of
its rank; a two-level bitmap over the ranks tells the lowest bucket in use by two find-first-set steps.  A bucket gives
its leftmost place first.  An entry whose pair has changed meanwhile is stale and skipped.  The cost of a pre-token of
n bytes is n log n at most, also for those of many thousand bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, table
from .registry import query

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens that a worker remembers; it forgets all of them when there are more.
REMEMBERED = 400_000
#: Longer pre-tokens (bytes) are encoded each time.
LONG = 64
_WIDE = 8  # a leaf of the bitmap has 2**8 ranks
_LOW = (1 << _WIDE) - 1
_BIT = [1 << i for i in range(max(1 << _WIDE, (1 << 20) >> _WIDE))]
_UNKNOWN = -2  # a byte that has no rank and no neighbour to join


class RankQueue:
    """Buckets of places by rank and the bitmap over them; empty between two pre-tokens.

    Buckets are numbered from the last rank down (`Codec.key_of`), so the lowest rank is the highest bit of the bitmap, which
    an integer tells by its length.

    A bucket is a place, or a heap of places where several wait.  `Codec.merged` works on these parts directly: it
    pushes and pops a few times for each pre-token, and calls would cost more than the work.
    """

    def __init__(self, ranks: int):
        self.buckets: list[int | list[int] | None] = [None] * ranks
        self.leaves = [0] * ((ranks >> _WIDE) + 1)


class Codec(dict):
    """Encodes and decodes by a rank file; as a dict it holds the ids (packed, little-endian) of the pre-tokens met."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.last = max(self.ranks.values())
        self.key_of = {k: self.last - v for k, v in self.ranks.items()}
        self.queue = RankQueue(self.last + 1)
        single = [bytes([i]) for i in range(256)]
        self.byte_ids = [self.ranks.get(x, _UNKNOWN) for x in single]
        self.byte_pairs = [[self.key_of.get(x + y, -1) for y in single] for x in single]

    def merged(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        get, buckets, leaves, bit, low, wide, last, top = self.key_of.get, self.queue.buckets, self.queue.leaves, _BIT, _LOW, _WIDE, self.last, 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids = [*map(self.byte_ids.__getitem__, word)]
        rows = self.byte_pairs
        pair = [rows[x][y] for x, y in zip(word, word[1:], strict=False)]
        for i, key in enumerate(pair):  # push
            if key >= 0:
                waiting = buckets[key]
                if waiting is None:
                    buckets[key] = i
                    leaf = key >> wide
                    leaves[leaf] |= bit[key & low]
                    top |= bit[leaf]
                elif waiting.__class__ is int:
                    buckets[key] = [waiting, i]  # places come in order
                else:
                    waiting.append(i)
        pair.append(-1)
        while top:
            leaf = top.bit_length() - 1  # pop
            bits = leaves[leaf]
            place = bits.bit_length() - 1
            key = (leaf << wide) + place
            waiting = buckets[key]
            if waiting.__class__ is int:
                i, waiting = waiting, None
            else:
                i = heappop(waiting)
            if not waiting:
                buckets[key] = None
                leaves[leaf] = bits = bits ^ bit[place]
                if not bits:
                    top ^= bit[leaf]
            if pair[i] != key:
                continue  # stale
            ids[i] = last - key
            j = after[i]
            k = after[i] = after[j]
            ids[j] = pair[j] = pair[i] = -1
            h = before[i]
            if k < n:
                before[k] = i
                new = pair[i] = get(word[i : after[k]], -1)
                if new >= 0:  # push
                    waiting = buckets[new]
                    if waiting is None:
                        buckets[new] = i
                        leaf = new >> wide
                        leaves[leaf] |= bit[new & low]
                        top |= bit[leaf]
                    elif waiting.__class__ is int:
                        buckets[new] = [waiting, i] if waiting < i else [i, waiting]
                    else:
                        heappush(waiting, i)
            if h >= 0:
                new = pair[h] = get(word[h:k], -1)
                if new >= 0:  # push
                    waiting = buckets[new]
                    if waiting is None:
                        buckets[new] = h
                        leaf = new >> wide
                        leaves[leaf] |= bit[new & low]
                        top |= bit[leaf]
                    elif waiting.__class__ is int:
                        buckets[new] = [waiting, h] if waiting < h else [h, waiting]
                    else:
                        heappush(waiting, h)
        if _UNKNOWN in ids:
            raise KeyError(word)
        return [x for x in ids if x >= 0]

    def __missing__(self, token: str) -> bytes:
        word = token.encode()
        ids = self.merged(word)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.split(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The codec of a rank file, read once by each worker."""
    key = (path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, remember: bool = True) -> DataFrame:
    """(doc_id, ids) for each row of docs; path names a rank file that every executor has.

    remember: workers keep the pre-tokens met from task to task; without it they forget them after each, which costs
    time and leaves their memory to other stages.

    A null or empty text has no ids.  Special tokens aren't looked for.  A null doc_id is kept, repeated rows are
    encoded alike, other columns don't matter, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for part in pieces(batches, "text"):
            ids = [c.encode(x or "") for x in part.column("text").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int32)))], ["doc_id", "ids"])
        if not remember:
            c.clear()

    docs = small_batches(docs)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, bytes) for each row of (doc_id, ids); null ids give no bytes."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            texts = [c.decode(np.asarray(x.values, np.int64)) if x.is_valid else b"" for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(texts, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.mapInArrow(run, "doc_id bigint, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, remember: bool = True, whole: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every text, decodes the ids, and gives digests of both.

    whole: the text and its ids come along as columns `text` and `ids`, for a corpus to train on.
    The same codec as in encode() and decode(), in one pass: each step of its own would hold a Python worker of its own.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["text", "ids"] if whole else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for part in pieces(batches, "text"):
            ids = [c.encode(x or "") for x in part.column("text").to_pylist()]
            sums = [[hashlib.sha256(raw).hexdigest() for raw in made] for made in ((x.tobytes() for x in ids), (c.decode(x) for x in ids))]
            cols = [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), *(pa.array(x, pa.string()) for x in sums)]
            if whole:
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                cols += [part.column("text"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids).astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(cols, names)
        if not remember:
            c.clear()

    docs = small_batches(docs)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", text string, ids array<int>" if whole else ""))


@query("op7_byte_bpe")
def op7(spark, folder):
    return round_trip(table(spark, folder, "documents"))
