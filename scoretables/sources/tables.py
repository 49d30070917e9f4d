"""Tables with declared schemas: no inference pass, and a missing column shows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


# Score and page model: one table per entity, keyed by document and position.
MODEL = {
    "docs": "doc_id BIGINT, source_format STRING",
    "songs": "doc_id BIGINT, song_ix INT, fifths INT, beats INT, beat_type INT, tempos ARRAY<STRING>, meta MAP<STRING,ARRAY<STRING>>",
    "parts": "doc_id BIGINT, song_ix INT, part_ix INT, name STRING, staff_of INT",
    "measures": "doc_id BIGINT, part_ix INT, measure_ix INT, implicit BOOLEAN, divisions INT, fifths INT, beats INT, "
    "beat_type INT, left_time STRUCT<beats INT, beat_type INT>, right_time STRUCT<beats INT, beat_type INT>, "
    "repeat_fwd BOOLEAN, repeat_bwd BOOLEAN, ending_nums ARRAY<INT>, system INT, multi_rest INT",
    "elements": "doc_id BIGINT, part_ix INT, measure_ix INT, element_ix INT, element_id INT, voice INT, staff INT, dur_div INT, "
    "dur_type STRING, dots INT, tm_actual INT, tm_normal INT, onset_div INT, is_rest BOOLEAN, is_grace BOOLEAN, "
    "slur_starts INT, slur_ends INT",
    "notes": "doc_id BIGINT, element_id INT, note_ix INT, step STRING, alter INT, octave INT, degree INT, octave_shift INT, "
    "accidental STRING, tie_stop BOOLEAN, cue BOOLEAN",
    "lyrics": "doc_id BIGINT, element_id INT, verse_from INT, verse_to INT, text STRING, extend BOOLEAN, refrain BOOLEAN",
    "marks": "doc_id BIGINT, type STRING, start_id INT, end_id INT, tuplet_actual INT, tuplet_normal INT",
    "play_passes": "doc_id BIGINT, pass_ix INT, mid INT, end_mid INT, pass INT, offset DOUBLE, until DOUBLE",
    "midi_events": "file STRING, track INT, seq INT, tick BIGINT, type STRING, channel INT, pitch INT, velocity INT",
    "glyphs": "page INT, obj_id BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, curves INT, points ARRAY<DOUBLE>",
    "toc_entries": "book STRING, text STRING, number INT, page INT",
    "titles": "book STRING, page INT, k INT, number INT, title STRING",
    "book_pages": "book STRING, index INT, printed INT, is_toc BOOLEAN, n_titles INT",
    "run_report": "key STRING, class STRING, area STRING, used DOUBLE, scratch DOUBLE",
}

# Tables the bundled queries run on.
BOUND = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, "
    "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def load_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    ddl = schema or BOUND.get(name) or MODEL[name]
    return spark.read.schema(struct(ddl)).parquet(f"{folder}/{name}.parquet")


def load_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: load_table(spark, folder, n) for n in names or BOUND}


def spread(df: DataFrame, *key: str) -> DataFrame:
    """An input of less than one split, dealt over the cores; any larger one passes through unchanged.

    For work that is heavy per row (texts) on tables so small that one core would do all of it.
    """
    spark = df.sparkSession
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 128 << 20
    return df.repartition(spark.sparkContext.defaultParallelism, *key) if small else df


def dealt(df: DataFrame, piece: int) -> DataFrame:
    """Rows dealt evenly, a partition for each `piece` bytes of the files they come from, one for each core at least.

    For small rows of which large ones are made: splits and row groups of files say nothing about that work.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // piece)))
