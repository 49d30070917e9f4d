"""Note pairing over a stream whose events arrive out of order: rows wait in state until the watermark has passed them.

Each key keeps the rows that wait, a queue of open notes and the number of notes so far.  When event time has moved on
past waiting rows, they are taken in order: a note-on joins the queue, a note-off closes the first of it.  Notes still
open `idle` seconds after the key's last row are reported without an end, and the key's state goes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_folder

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Event time that ends a stream; no event is so late.
END = "9999-01-01"
OUT = "k bigint, t_on bigint, t_off bigint"


class Pairing(StatefulProcessor):
    """Rows: `ms_` (event time), `seq_` (settles equal times), `at_` (what is reported) and `on_`."""

    def __init__(self, keys: list[str], idle: int):
        self.keys, self.idle = keys, idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms bigint, seq bigint, at bigint, on boolean")
        self.open = handle.getListState("open", "k bigint, at bigint")
        self.seen = handle.getValueState("seen", "notes bigint, last_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(a), int(b), int(c), bool(d)) for df in rows if len(df) for a, b, c, d in zip(df["ms_"], df["seq_"], df["at_"], df["on_"], strict=True)]
        if new:
            self.waiting.appendList(new)
            # the first of them is enough: a timer takes all that event time has passed and asks for the next one
            self.handle.registerTimer(min(ms for ms, *_ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        rows = sorted(self.waiting.get())
        due = [r for r in rows if r[0] <= now]
        queue = list(self.open.get())
        notes, last = self.seen.get() if self.seen.exists() else (0, 0)
        done = []
        for ms, _, at, on in due:
            last = max(last, ms)
            if on:
                notes += 1
                queue.append((notes, at))
            elif queue:
                k, began = queue.pop(0)
                done.append((*key, k, began, at))
        later = rows[len(due):]
        if not later and last + self.idle <= now:
            done += [(*key, k, began, None) for k, began in queue]
            for state in (self.waiting, self.open, self.seen):
                state.clear()
        else:
            for state, values in ((self.waiting, later), (self.open, queue)):
                if values:
                    state.put(values)
                else:
                    state.clear()
            self.seen.update((notes, last))
            self.handle.registerTimer(later[0][0] if later else last + self.idle)
        if done:  # a frame costs more than a key's rows
            yield self.told(key, done)

    def told(self, key, rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*self.keys, "k", "t_on", "t_off"])
        return out.astype({"k": "Int64", "t_on": "Int64", "t_off": "Int64"})

    def close(self) -> None:
        pass


def _plain(events: DataFrame, keys: list[str], time: str, seq: str, at: str, on: Column, off: Column) -> DataFrame:
    at_time = F.col(time).cast("timestamp")
    return events.filter((on | off) & F.col(time).isNotNull()).select(
        *keys, at_time.alias("time_"), F.unix_millis(at_time).alias("ms_"), F.col(seq).cast("bigint").alias("seq_"), F.col(at).cast("bigint").alias("at_"),
        F.coalesce(on, F.lit(False)).alias("on_")).dropna(subset=keys)


def _paired(rows: DataFrame, keys: list[str], delay: str, idle: int) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    # the row that only tells the time goes behind the watermark; a condition on other columns would be moved before it
    rows = rows.withWatermark("time_", delay).filter(F.col("time_") < F.lit(END).cast("timestamp"))
    return rows.groupBy(*keys).transformWithStateInPandas(Pairing(keys, idle), f"{kinds}, {OUT}", "append", "eventTime")


def pair_events(events: DataFrame, keys: list[str], time: str, seq: str, at: str, on: Column, off: Column, delay: str = "1 day", idle: int = 3600) -> DataFrame:
    """(keys, k, t_on, t_off) of a stream, as pair_on_off() gives them for a table: k counts the note-ons of a key from 1.

    `time` is the event time, `seq` settles equal times; rows may come up to `delay` late.  Notes never closed come out
    with t_off NULL `idle` seconds after the last row of their key.  A note-off with nothing open is ignored.  Rows
    without a time or key are left out.  Names of keys don't begin with an underscore.
    """
    return _paired(_plain(events, keys, time, seq, at, on, off), keys, delay, idle)


def run_available(stream: DataFrame, folder: str) -> None:
    """Takes what the stream's sources hold now; its place, state and rows are kept under the (shared) folder."""
    conf = stream.sparkSession.conf
    before = conf.get(ROCKS[0], None)
    conf.set(*ROCKS)
    try:
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    finally:
        if before is None:
            conf.unset(ROCKS[0])
        else:
            conf.set(ROCKS[0], before)
    q.awaitTermination()


def pattern(path: str) -> str:
    """path as a pattern that only it matches: a file source takes a folder or a pattern, and a table may be one file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def pair_table(spark: SparkSession, path: str, prepare, keys: list[str], time: str, seq: str, at: str, on: Column, off: Column, delay: str = "1 day", idle: int = 3600, files_per_batch: int = 1000, folder: str | None = None, close: bool = True) -> DataFrame:
    """The pairs of all events under path, streamed in micro-batches and read back.

    prepare: from the table's rows to events.  Running again with the same `folder` goes on with files that are new.
    close: end of input; one more row, in a source of its own and later than all others, lets event time pass everything
    that still waits.
    """
    folder = folder or f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").parquet(pattern(path))
    rows = _plain(prepare(source), keys, time, seq, at, on, off)
    # a row that only tells the time
    end = spark.range(1).select(*[F.lit(0).cast(rows.schema[k].dataType).alias(k) for k in keys], F.lit(END).cast("timestamp").alias("time_"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("ms_", "seq_", "at_", "on_")])
    end.filter(F.lit(False)).write.mode("append").parquet(f"{folder}/end")
    ends = spark.readStream.schema(end.schema).parquet(f"{folder}/end")
    stream = _paired(rows.unionByName(ends), keys, delay, idle)
    run_available(stream, folder)
    if close:
        end.coalesce(1).write.mode("append").parquet(f"{folder}/end")
        run_available(stream, folder)
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return spark.read.schema(f"{fields}, {OUT}").parquet(f"{folder}/rows")
