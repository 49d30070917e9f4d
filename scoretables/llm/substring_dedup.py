"""Passages that an earlier document has too, by an exact index of windows.

The index is the corpus itself, cut into blocks: a window of n words belongs to the block of its anchor, the least
hashed k-gram in it, and a block maps each of its windows to the least doc_id where it starts.  Neighbouring windows
mostly share an anchor, and windows whose anchor no other document has are left out before anything is looked up.
Every window is looked up, so none is missed and no boundary needs a check of its own; a word goes if any window over it
is found.  This is no Lempel-Ziv parse: a factor is a run of neighbouring windows with the same least document, so a
passage of one document whose middle an earlier one has too makes several factors.

Very frequent windows and anchors would make single blocks large.  Those that stand out in a sample of the documents (a
bounded number) are resolved without a block: one aggregation gives their least documents, and each task has the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Texts, Words, column, grams, mix, pieces, small_batches, table, within
from .oracles import SUBSTRING_DEDUP
from .registry import query

GRAM = 5
#: Documents of the sample for frequent windows: so many, or this part of all if that is more.
SAMPLE, SAMPLE_PART = 20_000, 500
#: In how many documents of the sample a frequent one stands, and how many are listed at most (the most frequent).
FREQUENT, LISTED = 64, 50_000


class Windows:
    """Windows of some documents: content hash, place in the document, document and anchor of each."""

    def __init__(self, column: pa.Array, n: int):
        self.words = words = Words(Texts(column))
        h = words.hashes()
        ok = np.flatnonzero(within(words.doc, n))
        g = grams(h, GRAM)
        self.hash = grams(h, n)[ok]
        self.doc = words.doc[ok]
        self.place = ok - words.first[self.doc]
        if len(ok):
            span = n - GRAM + 1
            self.anchor_at = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1)[ok] + ok
            self.anchor = g[self.anchor_at]
        else:
            self.anchor_at, self.anchor = np.zeros(0, np.int64), np.zeros(0, U64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _listed(x: np.ndarray, sorted_list: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the list, and where."""
    if not len(sorted_list):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.searchsorted(sorted_list, x)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == x, at


def _once(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Index of one row for each distinct (doc, value)."""
    return np.unique(mix(value + doc.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]


def _frequent(docs: DataFrame, n: int) -> dict[str, np.ndarray]:
    """Sorted hashes of the frequent anchors and windows."""
    rows = docs.count()
    part = min(1.0, max(SAMPLE, rows // SAMPLE_PART) / max(rows, 1))
    lot = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(part * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, "text"):
            w = Windows(p.column("text"), n)
            for kind, value in (("anchor", w.anchor), ("window", w.hash)):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(i)), _signed(value[i])] if len(i := _once(w.doc, value)) else [pa.array([], pa.string()), pa.array([], pa.int64())], ["kind", "hash"])

    seen = docs.filter(lot).mapInArrow(run, "kind string, hash bigint").groupBy("kind", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    out = {}
    for kind in ("anchor", "window"):
        rows = seen.filter(F.col("kind") == kind).orderBy(F.desc("n"), "hash").limit(LISTED).select("hash").toPandas()
        out[kind] = np.sort(rows["hash"].to_numpy(np.int64).view(U64))
    return out


def _least_documents(docs: DataFrame, windows: np.ndarray, n: int) -> np.ndarray:
    """Least doc_id where each listed window starts."""

    def run(batches):
        for p in pieces(batches, "text"):
            w = Windows(p.column("text"), n)
            met, at = _listed(w.hash, windows)
            met = np.flatnonzero(met)
            met = met[_once(w.doc[met], w.hash[met])]
            yield pa.RecordBatch.from_arrays([pa.array(at[met].astype(np.int64)), p.column("doc_id").take(pa.array(w.doc[met]))], ["at", "doc_id"])

    out = np.full(len(windows), np.iinfo(np.int64).max)
    if len(windows):
        got = docs.mapInArrow(run, "at bigint, doc_id bigint").groupBy("at").agg(F.min("doc_id").alias("doc_id")).toPandas()
        out[got["at"].to_numpy()] = got["doc_id"].to_numpy()
    return out


def factors(place: np.ndarray, source: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(start, length, source) of runs; place (ascending) and source are the windows that an earlier document has.

    A factor runs on while the next windows have the same least document.
    """
    if not len(place):
        return []
    cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(source) != 0)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(place)] - 1
    return list(zip(place[first].tolist(), (place[last] - place[first] + n).tolist(), source[first].tolist(), strict=True))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, factors, kept) for each row of docs.

    Words are parted by white space and otherwise unchanged.  A word goes if a window of n words that covers it also
    starts in a document with a smaller doc_id; all windows are judged on the input.  factors: (start, length, source)
    in words, source being the least such document; kept: the other words, joined by one blank.  A null text has no
    words; texts with fewer than n words, and rows without a doc_id, keep all and give no reference.  Rows with equal
    doc_id don't remove each other's words.  Other columns don't matter; an empty table gives no rows.
    """
    docs = small_batches(docs)
    rows = docs.select(column(docs, doc_id, "bigint", "doc_id"), column(docs, text, "string", "text"))
    # Tells rows of one doc_id apart where there are any; it is shuffled with every row.
    repeated = not rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    keys, kinds = (["doc_id", "crc"], "doc_id bigint, crc int") if repeated else (["doc_id"], "doc_id bigint")
    if repeated:
        rows = rows.withColumn("crc", (F.crc32("text") - (1 << 31)).cast("int"))
    known = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    listed = _frequent(known, n)
    least = _least_documents(known, listed["window"], n)

    # Whole copies of an earlier document need no look-up.
    first = known.groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(F.min("doc_id").alias("source"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = known.select(*keys, F.xxhash64("text").alias("h"), F.md5("text").alias("m")).join(first, ["h", "m"]).filter("doc_id > source")
    copies = same.select(*keys, "source").distinct()

    def anchors(batches):
        for p in pieces(batches, "text"):
            w = Windows(p.column("text"), n)
            at, i = np.unique(w.anchor_at, return_index=True)
            i = i[~_listed(w.anchor[i], listed["anchor"])[0]]
            i = i[_once(w.doc[i], w.anchor[i])]
            yield pa.RecordBatch.from_arrays([_signed(w.anchor[i]), *(p.column(c).take(pa.array(w.doc[i])) for c in keys)], ["anchor", *keys])

    every = known.mapInArrow(anchors, f"anchor bigint, {kinds}")
    block = Window.partitionBy("anchor")
    shared = every.withColumns({"lo": F.min("doc_id").over(block), "hi": F.max("doc_id").over(block)}).filter("lo < hi")
    marks = shared.groupBy(*keys).agg(F.collect_list("anchor").alias("anchors"))

    def windows(batches):
        for p in pieces(batches, "text"):
            p = p.filter(p.column("source").is_null())
            w = Windows(p.column("text"), n)
            anchors = p.column("anchors")
            owner = np.repeat(np.arange(p.num_rows), [len(x) if x.is_valid else 0 for x in anchors])
            mine = np.asarray(anchors.flatten(), np.int64).view(U64)
            tag = U64(0x9E3779B97F4A7C15)
            go = np.isin(mix(w.anchor + w.doc.astype(U64) * tag), mix(mine + owner.astype(U64) * tag))
            often = _listed(w.anchor, listed["anchor"])[0]
            i = np.flatnonzero((go | often) & ~_listed(w.hash, listed["window"])[0])
            # windows of frequent anchors are dealt by their own hash
            block = np.where(often[i], w.hash[i], w.anchor[i])
            yield pa.RecordBatch.from_arrays([_signed(block), _signed(w.hash[i]), *(p.column(c).take(pa.array(w.doc[i])) for c in keys), pa.array(w.place[i].astype(np.int32))],
                                             ["block", "window", *keys, "place"])

    texts = known.join(marks, keys, "left").join(copies, keys, "left").select(*keys, "text", "anchors", "source")
    looked = texts.mapInArrow(windows, f"block bigint, window bigint, {kinds}, place int")
    looked = looked.withColumn("source", F.min("doc_id").over(Window.partitionBy("block", "window"))).filter("source < doc_id")
    found = looked.groupBy(*keys).agg(F.collect_list(F.struct("place", "source")).alias("found"))

    def parse(batches):
        for p in pieces(batches, "text"):
            w = Windows(p.column("text"), n)
            ids = p.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            often, at = _listed(w.hash, listed["window"])
            often &= least[at] < ids[w.doc] if len(least) else False
            edge = np.searchsorted(w.doc, np.arange(p.num_rows + 1))
            removed, parses, kept = [], [], []
            words, buf = w.words, w.words.texts.buf
            for d in range(p.num_rows):
                count, copy_of, own = int(words.count[d]), p.column("source")[d].as_py(), slice(edge[d], edge[d + 1])
                if copy_of is not None:
                    fs = [(0, count, copy_of)] if count >= n else []
                else:
                    place, source = w.place[own][often[own]], least[at[own]][often[own]] if len(least) else np.zeros(0, np.int64)
                    if (more := p.column("found")[d]).is_valid:
                        place = np.concatenate([place, more.values.field("place").to_numpy().astype(np.int64)])
                        source = np.concatenate([source, more.values.field("source").to_numpy()])
                        place, i = np.unique(place, return_index=True)
                        source = source[i]
                    fs = factors(place, source, n)
                gone = np.zeros(count, bool)
                for a, size, _ in fs:
                    gone[a : a + size] = True
                removed.append(int(gone.sum()))
                parses.append([{"start": a, "length": b, "source": c} for a, b, c in fs])
                a, b = words.first[d], words.first[d + 1]
                raw = buf.tobytes() if d == 0 else raw
                kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[a:b][~gone].tolist(), words.end[a:b][~gone].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [p.column("doc_id"), pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(parses, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "factors", "kept"])

    out = known.join(copies, keys, "left").join(found, keys, "left").select("doc_id", "text", "source", "found")
    blank = rows.filter("doc_id IS NULL OR text IS NULL").select("doc_id", "text", F.lit(None).cast("bigint").alias("source"), F.lit(None).cast("array<struct<place:int,source:bigint>>").alias("found"))
    return out.unionByName(blank).mapInArrow(parse, "doc_id bigint, n_words bigint, n_removed bigint, factors array<struct<start: bigint, length: bigint, source: bigint>>, kept string")


@query("op1_substring_dedup", SUBSTRING_DEDUP)
def op1(spark, folder):
    out = dedup(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("factors").cast("bigint").alias("n_factors"))
