"""Note pairing over an event stream: the batch rule, one queue of open notes per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "file string, track int, channel int, pitch int, t_on bigint, t_off bigint"
STATE = "open array<bigint>"
KEYS = ["file", "track", "channel", "pitch"]


def _pair(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    open_ = list(state.get[0]) if state.exists else []
    rows = pd.concat(batches).sort_values(["tick", "seq"])
    done = []
    for tick, kind in zip(rows.tick, rows.type):
        if kind == "noteOn":
            open_.append(int(tick))
        elif open_:
            done.append((*key, open_.pop(0), int(tick)))
    if open_:
        state.update((open_,))
        if "until" in rows:
            state.setTimeoutTimestamp(int(rows.until.max()))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(done, columns=[*KEYS, "t_on", "t_off"])


def pair_stream(events: DataFrame, time: str | None = None, idle: int = 3600) -> DataFrame:
    """Closed notes of a stream of (file, track, seq, tick, type, channel, pitch) that arrives in order per key.

    Percussion (channel 9) is left out.  The state of a key is its open notes; it goes when the last one closes.  With a
    `time` column (event time) it also goes once the stream is `idle` seconds past the key's last event.
    """
    notes = events.filter("type in ('noteOn', 'noteOff') and channel <> 9")
    kind = GroupStateTimeout.NoTimeout
    if time is not None:
        kind = GroupStateTimeout.EventTimeTimeout
        notes = notes.withWatermark(time, f"{idle} seconds").withColumn("until", (F.unix_millis(time) + idle * 1000))
    return notes.groupBy(*KEYS).applyInPandasWithState(_pair, OUT, STATE, "append", kind)
