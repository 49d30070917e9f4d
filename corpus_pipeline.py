"""The cleaning of a corpus in five stages, each written as Parquet and read again by the next.

The last one gives the corpus to train on: doc_id, text, token ids and digests of each row that is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoretables.llm import bpe, decontaminate, near_dup, quality_rules, secrets
from scoretables.llm.common import table
from scoretables.session import shared_folder


KEY, LOOSE = "__row_key", "__loose"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key for each row: its doc_id, or a digest of id and text where the id is null or stands in several rows.

    So every row is judged by itself.  The digests lie above all usual ids; rows equal in both share a key, and a verdict.
    Only ids are shuffled, unless some repeat.
    """
    key = F.col("doc_id").cast("bigint")
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__again"))
    if again.isEmpty():
        return docs.withColumn(KEY, key)
    digest = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.md5("text")), 1).bitwiseOR(F.lit(1 << 62))
    marked = docs.join(again.filter("__again IS NOT NULL"), F.col("doc_id") == F.col("__again"), "left")
    return marked.withColumn(KEY, F.when(F.col("__again").isNull() & F.col("doc_id").isNotNull(), key).otherwise(digest)).withColumnRenamed("__again", LOOSE)


def _keep(keyed: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows whose key the verdict (doc_id: the key, kept) keeps.  Only keys of rows that go are shuffled beside the documents."""
    gone = verdict.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return keyed.join(gone, F.col(KEY) == F.col("__gone"), "left_anti").drop(KEY, LOOSE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _keyed(docs)
    return _keep(docs, quality_rules.judge(docs, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", KEY), doc_id=KEY))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group; of rows equal in id and text one."""
    docs = _keyed(docs)
    if LOOSE in docs.columns:
        own = F.col(KEY).eqNullSafe(F.col("doc_id").cast("bigint"))
        docs = docs.filter(own).unionByName(docs.filter(~own).dropDuplicates([KEY]))
    return _keep(docs, near_dup.near_duplicates(docs, doc_id=KEY))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _keyed(docs)
    verdict = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), doc_id=KEY)
    return _keep(docs, verdict.select("doc_id", (~F.col("contaminated")).alias("kept")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, remember=False, whole=True)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("byte_bpe", tokens)]

# Neither the forests nor BPE can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
