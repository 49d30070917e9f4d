"""Inputs, field lines, results and incremental runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines, natural_key

# File endings taken as input.
EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"]


def list_inputs(spark: SparkSession, globs: list[str], extensions: list[str] = EXTENSIONS) -> DataFrame:
    """(path, length) of the files the patterns name, known endings only, in natural order.  Contents are not read."""
    found = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(g).select("path", "length") for g in globs]
    df = reduce(lambda a, b: a.union(b), found).distinct()
    known = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)
    return natural_order(df.filter(known), "path")


def natural_order(df: DataFrame, name: str, *more: str) -> DataFrame:
    return df.orderBy(natural_key(name), *more)


def header_fields(docs: DataFrame, doc: str, text: str, fields: str = "[A-Za-z]") -> DataFrame:
    """(doc, line_no, field, value) of the `X:value` lines of a text score; `%` starts a comment."""
    ln = lines(docs, text, doc)
    bare = F.regexp_replace("line", r"\s*%.*$", "")
    shape = rf"^\s*({fields}):\s*(.*?)\s*$"
    return ln.filter(bare.rlike(shape)).select(doc, "line_no", F.regexp_extract(bare, shape, 1).alias("field"), F.regexp_extract(bare, shape, 2).alias("value"))


def result_rows(df: DataFrame, file: str, value: Column, name: str = "value", error: str = "not readable") -> DataFrame:
    """One row per input: its value, or an error where there is none.  A bad input does not stop the job, so `value`
    must be built from `try_` functions."""
    return df.select(F.col(file).alias("file"), value.alias(name)).withColumn("error", F.when(F.col(name).isNull(), F.lit(error)))


def write_results(df: DataFrame, path: str) -> None:
    """One JSON line per row; empty fields are left out."""
    df.write.mode("errorifexists").json(path)


def content_key(version: str, *inputs: Column) -> Column:
    """Key of a result: what went in, and the parameters and code that made it."""
    return F.sha2(F.concat_ws("\u0001", F.lit(version), *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in inputs]), 256)


def incremental_apply(new: DataFrame, cache: DataFrame, key: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results for all keys of `new`: those in `cache`, and `fn` over one row of each key not seen before.

    `fn` keeps the key column.  Write the outcome with `write_version`, not over the cache that is being read.
    """
    fresh = new.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    made = fn(fresh)
    kept = cache.join(new.select(key).distinct(), key, "left_semi")
    return kept.select(*made.columns).unionByName(made)


def write_version(df: DataFrame, folder: str) -> str:
    """Write a new version next to the old ones and return its path; readers move on when it is complete."""
    path = f"{folder}/version={uuid.uuid4().hex}"
    df.write.parquet(path)
    return path
