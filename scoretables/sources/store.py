"""A keyed table in hash buckets: a run reads and writes only the buckets that its keys fall in.

Each bucket is one or more Parquet folders.  A manifest names them; every change writes new folders first and then a
manifest of its own, one file that appears at once, so a reader has the state before or after a change and never half of
it.  Folders that no manifest names any more are left for an expiry rule.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MANIFEST = "seq bigint, bucket int, path string, schema string"


class Store:
    """A table under `folder`, keyed by columns; `buckets` is fixed for its life."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), list(key), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.key]), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> list:
        """Rows of the newest manifest: a few for each bucket."""
        self.spark.range(0).select(*[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in MANIFEST.split(", ")]).write.mode("append").json(f"{self.folder}/manifest")
        rows = self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest")
        return rows.filter(F.col("seq") == rows.agg(F.max("seq")).scalar()).collect()

    def _say(self, entries: list[tuple[int, str]], seq: int, schema: str) -> None:
        rows = self.spark.createDataFrame([(seq, b, p, schema) for b, p in entries], MANIFEST)
        rows.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that the keys of rows fall in."""
        return sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The rows of all buckets, or of some; None while nothing was written."""
        entries = self._manifest()
        if not entries:
            return None
        schema = entries[0].schema
        paths = [e.path for e in entries if only is None or e.bucket in set(only)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _write(self, rows: DataFrame) -> list[tuple[int, str]]:
        """Writes rows by bucket; where each bucket that has rows went."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        kinds = rows.columns
        # a bucket goes to one task unless it is large
        rows.withColumn("__bucket", self.bucket()).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(path)
        made = self.spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kinds).schema.fields) + ", __bucket int").parquet(path)
        return [(r["__bucket"], f"{path}/__bucket={r['__bucket']}") for r in made.select("__bucket").distinct().collect()]

    def _change(self, rows: DataFrame, replaced: set[int]) -> None:
        old = self._manifest()
        written = self._write(rows)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        seq = max((e.seq for e in old), default=0) + 1
        self._say([(e.bucket, e.path) for e in old if e.bucket not in replaced] + written, seq, schema)

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of their keys; a key occurs once in rows.  Other buckets are neither read nor written."""
        buckets = self.touched(rows)
        if not buckets and self._manifest():
            return
        before = self.read(buckets)
        if before is not None:
            same = [before[k].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.key)]
            keys = rows.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.key)])
            rows = rows.unionByName(before.join(keys, same, "left_anti"))
        self._change(rows, set(buckets))

    def apply(self, new: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Results for all keys of new: those in the store, and fn over one row of each key that it doesn't have.

        fn keeps the key columns; what it makes is added to its buckets, which are not rewritten.
        """
        one = new.dropDuplicates(self.key)
        buckets = self.touched(one)
        known = self.read(buckets)
        fresh = one if known is None else one.join(known.select(*self.key), self.key, "left_anti")
        made = fn(fresh)
        self._change(made, set())
        return self.read(buckets).join(one.select(*self.key), self.key, "left_semi")
