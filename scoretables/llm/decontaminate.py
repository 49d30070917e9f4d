"""Benchmark items inside documents, found by MinHash containment search.

Items are parted by size: class c holds the sets of 2**c to 2**(c+1)-1 shingles.  An item's sketch is its least
shingle under each of several hash functions, more of them in larger classes; the part of these that a document holds
estimates how much of the item it holds, however long the document is.  Pairs that may reach the threshold are
confirmed by counting the item's shingles in the document.

Documents pass a bit table of all items' shingles first.  The table has a fixed largest size, so it may be sent to
every task; with more items than it was made for it lets more shingles through, which costs time but changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import U64, Texts, Words, grams, mix, pieces, shingle_sets, small_batches, stream, table, within
from .registry import query

#: Bits of the largest shingle table (2 MB).
TABLE_BITS = 1 << 24
#: Hash functions for items with fewer than 2**c shingles: 2 * c of them, and this many at most.
MOST_HASHES = 32


def size_class(n: int) -> int:
    return max(int(n).bit_length() - 1, 0)


def hashes_of(size: int) -> int:
    return min(MOST_HASHES, 4 * (size + 1))


def sketch(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """Distinct least shingles under the hash functions."""
    return np.unique(shingles[mix(shingles[None, :] ^ stream(61, hashes)[:, None]).argmin(axis=1)])


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 5) -> DataFrame:
    """(item, size, n, sketch_n, n_words, shingle, in_sketch): the shingles of each distinct item set.

    An item with fewer than k words is one shingle of its n_words words.
    Equal sets are one item, named by the least id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            sets = shingle_sets(part.column("text"), k)
            sums = [np.array([mix(s ^ U64(seed)).sum(dtype=U64) for s in sets], U64).view(np.int64) for seed in (7, 1 << 40)]
            lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            chosen = pa.array([np.isin(s, sketch(s, hashes_of(size_class(len(s))))) if len(s) else np.zeros(0, bool) for s in sets], pa.list_(pa.bool_()))
            n_words = pa.array(Words(Texts(part.column("text"), True)).count, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("item"), pa.array(sums[0]), pa.array(sums[1]), lists, chosen, n_words], ["item", "h1", "h2", "shingles", "chosen", "n_words"])

    rows = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(text).cast("string").alias("text")).dropna()
    sets = rows.mapInArrow(run, "item bigint, h1 bigint, h2 bigint, shingles array<bigint>, chosen array<boolean>, n_words bigint").filter(F.size("shingles") > 0)
    one = sets.groupBy("h1", "h2").agg(F.min(F.struct("item", "shingles", "chosen", "n_words")).alias("m")).select("m.*")
    n = F.size("shingles").cast("bigint")
    return one.select("item", F.floor(F.log2(n)).cast("int").alias("size"), n.alias("n"), F.size(F.filter("chosen", lambda c: c)).alias("sketch_n"), "n_words",
                      F.explode(F.arrays_zip("shingles", "chosen")).alias("s")).select(
        "item", "size", "n", "sketch_n", "n_words", F.col("s.shingles").alias("shingle"), F.col("s.chosen").alias("in_sketch"))


def shingle_table(shingles: DataFrame) -> np.ndarray:
    """Bit table over the items' shingles, as set bytes; made from the distinct table places, never more than its bits."""
    n = max(shingles.count(), 1)
    bits = min(TABLE_BITS, 1 << max(16, (n * 256).bit_length()))
    places = shingles.select(F.pmod(F.shiftrightunsigned("shingle", 20), F.lit(bits)).cast("int").alias("at")).select(
        F.shiftright("at", 3).alias("byte"), F.expr("shiftleft(1, at & 7)").alias("bit"))
    got = places.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 8, np.uint8)
    out[got["byte"].to_numpy()] = got["bits"].to_numpy().astype(np.uint8)
    return out


def hits(docs: DataFrame, bits: np.ndarray, doc_id: str = "doc_id", text: str = "text", k: int = 5, shorter: tuple[int, ...] = ()) -> DataFrame:
    """(doc, shingle): the distinct shingles of each document that the bit table lets through, of k words and of the shorter lengths."""
    mask = U64(len(bits) * 8 - 1)

    def run(batches):
        for part in pieces(batches, "text"):
            words = Words(Texts(part.column("text"), True))
            h = words.hashes()
            passed = []
            for length in (k, *shorter):
                at = np.flatnonzero(within(words.doc, length))
                g, d = grams(h, length)[at], words.doc[at]
                place = (g >> U64(20)) & mask
                ok = (bits[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1
                passed.append((g[ok], d[ok]))
            g, d = (np.concatenate(x) for x in zip(*passed, strict=True))
            _, first = np.unique(mix(g + d.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
            yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(d[first])), pa.array(g[first].view(np.int64))], ["doc", "shingle"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text")).filter("doc IS NOT NULL")
    return rows.mapInArrow(run, "doc bigint, shingle bigint").distinct()


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(doc, item, containment) for each document that holds at least `percent` of an item's shingles.

    Words are lower-cased (A-Z) and parted by white space.  An item with fewer than k words is one shingle, met
    wherever its words stand one after another.  Items and documents without words, and those without an id, meet nothing.
    """
    docs = small_batches(docs)
    known = cut_lineage(item_shingles(items, item_id, item_text, k))
    shorter = tuple(sorted(r.n_words for r in known.filter(F.col("n_words") < k).select("n_words").distinct().collect()))
    found = cut_lineage(hits(docs, shingle_table(known), doc_id, text, k, shorter))
    # A document with c of n shingles lacks n - c; each can be the least under any number of functions, so what is
    # sure is: sketch_n - (n - c) of the sketch's shingles are held. The estimate may lie 5 errors below the threshold.
    t = percent / 100
    floor = F.greatest(F.lit(1), F.floor(F.col("sketch_n") * t - 5 * F.sqrt(F.col("sketch_n") * t * (1 - t))))
    sk = known.filter("in_sketch").select("shingle", "item", "sketch_n")
    maybe = found.join(sk, "shingle").groupBy("doc", "item").agg(F.count(F.lit(1)).alias("held"), F.min("sketch_n").alias("sketch_n"))
    maybe = maybe.filter(F.col("held") >= floor).select("doc", "item")
    full = known.select("shingle", "item", "n")
    sure = found.join(full, "shingle").join(maybe, ["doc", "item"], "left_semi").groupBy("doc", "item").agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("n"))
    return sure.filter(100 * F.col("held") >= percent * F.col("n")).select("doc", "item", (F.col("held") / F.col("n")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_items, item_ids, containment, contaminated) for each row of docs.

    item_ids: items found in the document, ascending (equal items by their least id); containment: the largest, else
    0.  Rows that repeat a doc_id are judged together.  A null doc_id or text is clean.  Other columns don't matter.
    No rows for an empty table; without items all rows are clean.
    """
    met = search(docs, items, doc_id, text, item_id, item_text, k, percent).groupBy(F.col("doc").alias("doc_id")).agg(
        F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("containment").alias("containment"))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id")).join(met, "doc_id", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return rows.select("doc_id", F.size(ids).cast("bigint").alias("n_items"), ids.alias("item_ids"), F.coalesce("containment", F.lit(0.0)).alias("containment"),
                       F.col("item_ids").isNotNull().alias("contaminated"))


@query("op6_benchmark_decontamination")
def op6(spark, folder):
    return decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
