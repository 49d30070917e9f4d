"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards, shards have weights; a node weighs what the shards below it weigh.  A row goes
down from the root: at each node the children draw waiting times from a hash of the row's key and the child's name,
exponential with the child's weight as rate, and the least wins.  Only the children of the nodes on a row's way draw, so
a row costs depth x fan-out digests, not one for each shard.

When a shard's weight changes, so do its rack's and its region's, and no other draws: rows move into or out of that
region alone, within it into or out of that rack alone, except that a row which enters a region or rack is drawn anew
among all of its children.  A new shard that stands in a region of its own (`grow`) therefore takes rows only into
itself; one that is put into an old rack would draw rows into its neighbours too.

All of it is column expressions; the only shuffles carry (key, size, shard), never the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .registry import query


@dataclass(frozen=True)
class Shard:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def tree(shards: int, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """Shards of equal weight, rack by rack and region by region in the order of their numbers."""
    return [Shard(i, i // (racks * per_rack), i // per_rack) for i in range(shards)]


def grow(shards: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a rack and a region of its own; it takes rows only into itself."""
    more = Shard(*(1 + max((getattr(s, c) for s in shards), default=-1) for c in ("shard", "region", "rack")), weight)
    return [*shards, more]


def draw(key: Column, name: Column, weight: Column) -> Column:
    """Waiting time of a node for a key: -ln(u) / weight, u in (0, 1) from 52 bits of a digest of name and key."""
    digest = F.md5(F.concat_ws(":", name, key))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def _children(nodes: dict[tuple[int, ...], float]) -> Column:
    """Children of one node as an array of (node, name, weight); a node is known by the numbers on the way to it."""
    one = [F.struct(F.lit(way[-1]).alias("node"), F.lit("/".join(map(str, way))).alias("name"), F.lit(float(w)).alias("weight")) for way, w in sorted(nodes.items())]
    return F.array(*one)


def _choose(key: Column, children: Column) -> Column:
    """Number of the child with the least draw; equal draws go to the lower number."""
    drawn = F.transform(children, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["node"].alias("node")))
    return F.array_min(drawn)["node"]


def place(df: DataFrame, key: Column, shards: list[Shard], shard: str = "shard", region: str = "region", rack: str = "rack") -> DataFrame:
    """df with the region, rack and shard of each row; shards of weight 0 take nothing; key must not be null."""
    # by depth: way to a node -> ways to its children -> their weights
    levels: list[dict[tuple[int, ...], dict[tuple[int, ...], float]]] = [{}, {}, {}]
    for s in shards:
        way = (s.region, s.rack, s.shard)
        for depth, level in enumerate(levels):
            if s.weight > 0:
                below = level.setdefault(way[:depth], {})
                below[way[: depth + 1]] = below.get(way[: depth + 1], 0.0) + s.weight
    if not levels[0]:
        raise ValueError("no shard has a weight")
    out = df
    for depth, name in enumerate((region, rack, shard)):
        if depth:
            of = F.create_map(*[x for way, below in levels[depth].items() for x in (F.lit("/".join(map(str, way))), _children(below))])
            children = F.element_at(of, F.concat_ws("/", *[F.col(c).cast("string") for c in (region, rack)[:depth]]))
        else:
            children = _children(levels[0][()])
        out = out.withColumn(name, _choose(key, children))
    return out


def slots(df: DataFrame, shard: str = "shard", order: str = "doc_id", rows_each: int = 20_000, slot: str = "slot") -> DataFrame:
    """df with each row's place in its shard, gapless from 0.

    A shard's rows are cut into blocks by a hash of `order`, as many as its size asks for; rows are numbered within a
    block and the blocks' counts add up before it, so no shard is one task's work.
    """
    n = df.agg(F.count(F.lit(1)).alias("n")).first().n
    blocks = max(1, n // rows_each)
    cut = df.withColumn("__b", F.pmod(F.xxhash64(order, F.lit(5)), F.lit(blocks)).cast("int"))
    tie = [c for c in df.columns if c not in (shard, order)]
    inner = F.row_number().over(Window.partitionBy(shard, "__b").orderBy(order, *tie)).cast("bigint") - 1
    counts = cut.groupBy(shard, "__b").agg(F.count(F.lit(1)).alias("__n"))
    # as many rows as there are shards x blocks; a shard's counts are n / rows_each numbers
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(shard).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__before", before).drop("__n")
    return cut.withColumn("__in", inner).join(counts, [shard, "__b"]).withColumn(slot, F.col("__in") + F.col("__before")).drop("__b", "__in", "__before")


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 16, racks: int = 2, per_rack: int = 2) -> DataFrame:
    """(doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard) for each row of docs.

    The law is `key`: doc_id and the number of shards decide; grown_shard is the shard when `grow` adds one.  size:
    UTF-8 bytes of the text and 1 (a null text has none and the checksum of an empty one).  A null doc_id counts as
    the key ''.  Repeated rows share a shard and take a slot each.  Other columns don't matter; an empty table gives
    no rows.
    """
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (F.octet_length(words) + 1).cast("bigint").alias("size"), F.crc32(words).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    old = tree(shards, racks, per_rack)
    out = place(rows, key, old)
    out = place(out, key, grow(old), "grown_shard", "grown_region", "grown_rack").drop("grown_region", "grown_rack")
    out = slots(out)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", "slot", "grown_shard")


@query("op5_sharding")
def op5(spark, folder):
    return shard_documents(table(spark, folder, "documents"))
