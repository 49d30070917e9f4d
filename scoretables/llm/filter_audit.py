"""Filter interaction audit: what each of several filters removes, in every order, by a stream that takes back what it said.

The files of a table are read as available-now micro-batches.  Each row has a mask of the conditions that it fails by
itself; whether it repeats a text of a smaller id depends on all other rows.  So the stream keeps, for each text, the
least id met so far and the masks counted for it.  Rows beyond the least id count as repeats.  When a smaller id arrives
later, the masks counted for the old one are retracted and counted again as repeats.  What comes out are changes of
counters by (part, mask, labels), whose sums are right once all files are read.  From the 2 ** n sums of a part follow
the counts for all n! orders, as a filter's removals depend only on the set of filters before it.

State is keyed by the digest of a text, several digests to a bucket, and kept by the session's state store (RocksDB, if
the session names it, where state outgrows memory) with checkpoints in the shared folder, as is the stream's output, so
a lost executor or a restart repeats no change.  Before rows are dealt to the state, each batch of a task is reduced to
one row for each text: rows beyond the batch's least id are repeats already.
"""

from __future__ import annotations

import io
import itertools
import math
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder
from .common import table
from .registry import query

WORDS = r"[^\x20\x09-\x0D]+"
REPEAT = "E"

#: Conditions under which a text fails, by letter; the words of the text are `words`.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: Micro-batches that a table's files are dealt to, whatever its size.
BATCHES = 4
LABELS = ["quality", "toxic"]
COUNTED = "part string, mask int, quality int, toxic int, delta bigint"
#: State of a bucket of texts: the rows counted for each text's least id, as Arrow bytes.
STATE = "rows binary"
#: Buckets of texts for each partition of the state, so that a bucket stays small and a key isn't a single text.
BUCKETS = 16


def masked(docs: DataFrame, filters: dict, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(text_key, doc_id, part, mask) of each row; bit i of the mask is set where the i-th condition fails."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    return rows.select(F.sha2("text", 256).alias("text_key"), "doc_id", "part", sum(bits[1:], bits[0]).cast("int").alias("mask"))


FIELDS = ["part", "mask", *LABELS]
#: A row to the state: counts of one text and id, or (without an id) counts that no later row changes.
TOLD = pa.schema([("bucket", pa.int64()), ("text_key", pa.string()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("quality", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])


def _judged(rows: pd.DataFrame, repeat: int) -> pd.DataFrame:
    """rows (with ids) with `beyond`: whether the text has a smaller id among them."""
    least = rows.groupby("text_key", sort=False)["doc_id"].transform("min")
    return rows.assign(beyond=(rows["doc_id"] > least).to_numpy(bool))


def _by_text(batches: Iterator[pa.RecordBatch], repeat: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch counted by text, id and kind; rows beyond the batch's least id of their text are repeats for good.

    A null id gives no reference and is no repeat.
    """
    for b in batches:
        if not b.num_rows:
            continue
        known = b.column("doc_id").is_valid()
        rows = _judged(b.filter(known).to_pandas(), repeat)
        rows.loc[rows["beyond"], "mask"] |= repeat
        first = rows[~rows["beyond"]].groupby(["text_key", "doc_id", *FIELDS], sort=False).size().rename("n").reset_index()
        first["bucket"] = [int(k[:15], 16) % buckets for k in first["text_key"]]
        loose = pd.concat([rows.loc[rows["beyond"], FIELDS], b.filter(pa.compute.invert(known)).select(FIELDS).to_pandas()])
        loose = loose.groupby(FIELDS, sort=False).size().rename("n").reset_index()
        # settled counts may go to any bucket
        loose["bucket"] = [zlib.crc32(f"{p} {m}".encode()) % buckets for p, m in zip(loose["part"], loose["mask"], strict=True)]
        for part in (first, loose.assign(text_key="", doc_id=None)):
            yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type, from_pandas=True) for f in TOLD], schema=TOLD)


def _updates(repeat: int):
    """What new rows of a bucket of texts change, given the rows counted for each text's least id so far."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(frames))
        settled = new["doc_id"].isna()
        out = [new.loc[settled, [*FIELDS, "n"]]]
        new = new.loc[~settled, ["text_key", "doc_id", *FIELDS, "n"]].astype({"doc_id": "int64"})
        if len(new):
            old = pd.read_feather(io.BytesIO(state.get[0])) if state.exists else new.iloc[:0]
            both = _judged(pd.concat([old, new], ignore_index=True), repeat)
            was, beyond = (both.index < len(old)), both["beyond"]
            back = both[was & beyond]
            out += [both.loc[~was & ~beyond, [*FIELDS, "n"]], both[beyond].assign(mask=both["mask"] | repeat)[[*FIELDS, "n"]], back.assign(n=-back["n"])[[*FIELDS, "n"]]]
            kept = both[~beyond].groupby(["text_key", "doc_id", *FIELDS], sort=False)["n"].sum().reset_index()
            sink = io.BytesIO()
            kept.to_feather(sink, compression="uncompressed")
            state.update((sink.getvalue(),))
        yield pd.concat(out).groupby(FIELDS, sort=False)["n"].sum().rename("delta").reset_index().astype({"mask": "int32", "quality": "int32", "toxic": "int32", "delta": "int64"})

    return update


def _pattern(path: str) -> str:
    """path as a pattern that only it matches: a stream takes a folder or a pattern, and a table may be a single file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def counters(spark: SparkSession, path: str, labels: DataFrame | None, filters: dict | None = None, doc_id: str = "doc_id", text: str = "text", part: str = "source", batches: int = BATCHES, checkpoint: str | None = None) -> DataFrame:
    """(part, mask, quality, toxic, n): how many rows fail which conditions, over all Parquet files under path.

    The bit after those of `filters` says that the text is one of a smaller id.  Reads what a stream with this
    checkpoint has not read yet; without one it is a new stream.
    """
    filters = FILTERS if filters is None else filters
    repeat = 1 << len(filters)
    where = checkpoint or f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    known = spark.read.parquet(path)
    per_batch = max(1, math.ceil(len(known.inputFiles()) / batches))
    stream = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", per_batch).option("maxFileAge", "36500d").parquet(_pattern(path))
    rows = masked(stream, filters, doc_id, text, part)
    if labels is None:
        rows = rows.withColumns({x: F.lit(0) for x in LABELS})
    else:
        flags = labels.select(F.col(doc_id).cast("bigint").alias("__id"), *[F.col(x).cast("int").alias(x) for x in LABELS])
        flags = flags.groupBy("__id").agg(*[F.max(x).alias(x) for x in LABELS])
        rows = rows.join(flags, F.col("doc_id") == F.col("__id"), "left")
        rows = rows.select("text_key", "doc_id", "part", "mask", *[F.coalesce((F.col(x) == 1).cast("int"), F.lit(0)).alias(x) for x in LABELS])
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.mapInArrow(lambda b: _by_text(b, repeat, buckets), "bucket bigint, text_key string, doc_id bigint, part string, mask int, quality int, toxic int, n bigint")
    changes = rows.groupBy("bucket").applyInPandasWithState(_updates(repeat), COUNTED, STATE, "append", GroupStateTimeout.NoTimeout)

    started = changes.writeStream.format("parquet").option("checkpointLocation", f"{where}/checkpoint").option("path", f"{where}/changes").trigger(availableNow=True).start()
    started.awaitTermination()
    said = spark.read.schema(COUNTED).parquet(f"{where}/changes")
    return said.groupBy("part", "mask", *LABELS).agg(F.sum("delta").alias("n")).filter("n <> 0")


def orders(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, number of the step's filter, set of the filters before it) of every step of every order."""
    out = []
    for p in itertools.permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(p):
            out.append(("".join(letters[j] for j in p), step + 1, i, before))
            before |= 1 << i
    return out


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from counters.

    For every set of filters a part's rows that pass all of it are summed; every column is a difference of such sums.
    """
    n = len(letters)
    every = (1 << n) - 1

    def passing(of: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, of)), F.lit(0)).cast("bigint") for s in range(1 << n)])

    one = counts.groupBy("part").agg(passing(F.col("n")).alias("all_"), passing(F.col("n") * F.col("quality")).alias("good"), passing(F.col("n") * F.col("toxic")).alias("toxic"))
    def removed(of: str, before: Column, bit: int) -> Column:
        return F.get(of, before) - F.get(of, before.bitwiseOR(bit))

    def orders_with(s: int) -> int:
        """How many orders have just the filters of s before a given other one."""
        return math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())

    shapley = []
    for i in range(n):
        without = [s for s in range(1 << n) if not s >> i & 1]
        terms = [F.lit(orders_with(s)) * removed("all_", F.lit(s), 1 << i) for s in without]
        shapley.append(sum(terms[1:], terms[0]))
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(i).alias("i"), F.lit(b).alias("before"), F.lit(b | 1 << i).alias("after"), F.lit(1 << i).alias("bit"))
                      for o, k, i, b in orders(letters)])
    rows = one.withColumn("shapley", F.array(*shapley)).withColumn("s", F.explode(steps)).select("*", "s.*")

    def lost(of: str) -> Column:
        return F.get(of, F.col("before")) - F.get(of, F.col("after"))

    fails = F.get("all_", F.lit(0)) - F.get("all_", F.col("bit"))
    alone = F.get("all_", F.lit(every) - F.col("bit")) - F.get("all_", F.lit(every))
    return rows.select("part", "filter_order", "step", F.get("all_", F.col("after")).alias("kept"), lost("all_").alias("removed"), (fails - lost("all_")).alias("redundant"),
                       alone.alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", F.col("i")).alias("shapley"))


def filter_audit(spark: SparkSession, path: str, labels: DataFrame | None = None, filters: dict | None = None, doc_id: str = "doc_id", text: str = "text", part: str = "source", batches: int = BATCHES, checkpoint: str | None = None) -> DataFrame:
    """One row for each part, order of the filters and step: see audit().  The letters of `filters` and then E, which
    fails texts that a row of a smaller id has, whether that row is removed or not.

    A null text is empty, a null part the empty one.  A row without an id is no repeat and makes none; rows that repeat
    an id aren't repeats of each other; a row counts as good or toxic where any label of its id says so (none does for a null id).  Other columns
    don't matter.  An empty table gives no rows.
    """
    filters = FILTERS if filters is None else filters
    counts = counters(spark, path, labels, filters, doc_id, text, part, batches, checkpoint)
    return audit(counts, "".join(filters) + REPEAT)


SQL = r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a, unnest([1, 2, 4, 8, 16]) AS v),
p AS (SELECT p.a || q.a || r.a || s.a || t.a AS filter_order, [p.v, q.v, r.v, s.v, t.v] AS vs FROM x p JOIN x q ON q.a <> p.a JOIN x r ON r.a NOT IN (p.a, q.a) JOIN x s ON s.a NOT IN (p.a, q.a, r.a) JOIN x t ON t.a NOT IN (p.a, q.a, r.a, s.a)),
k AS (SELECT filter_order, step, vs[step] AS v, coalesce(list_sum(vs[1:step - 1]), 0)::INT AS before FROM p, range(1, 6) z(step)),
r AS (SELECT part, filter_order, step, v, sum(CASE WHEN mask & (before | v) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & v > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & v > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = v THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & v > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & v > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, k GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, v))::BIGINT AS shapley FROM r"""


@query("op13_filter_audit", SQL)
def op13(spark, folder):
    return filter_audit(spark, f"{folder}/documents.parquet", table(spark, folder, "labels"))
