"""Notes of MusicXML texts as rows.

Not a full reader: parts, measures, attributes, notes, backup and forward of partwise scores.  The tags of a text are
walked once, in their order, with a small state (part, measure, cursor, head of the chord), so comments, CDATA,
entities and either kind of quotes are read as XML has them.  A text stays in its row until it has become measures:
nothing is shuffled, and rows that share an id are not mixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = re.compile(r"[+-]?[0-9]{1,18}")
SIGNS = ["divisions", "fifths", "beats", "beat_type"]
#: Where a measure's signs and a note's values stand below their own tag.
SIGN_AT = {"divisions": "divisions", "key/fifths": "fifths", "time/beats": "beats", "time/beat-type": "beat_type"}
NOTE_AT = {"pitch/step": "step", "pitch/alter": "alter", "pitch/octave": "octave", "type": "dur_type", "voice": "voice", "staff": "staff", "duration": "duration"}
NOTE = [("item_ix", pa.int32()), ("step", pa.string()), ("alter", pa.int32()), ("octave", pa.int32()), ("dur_div", pa.int32()), ("dur_type", pa.string()), ("voice", pa.int32()), ("staff", pa.int32()),
        ("onset_div", pa.int32()), ("is_rest", pa.bool_()), ("is_chord", pa.bool_()), ("is_grace", pa.bool_()), ("tie_stop", pa.bool_())]
NOTE_SQL = ", ".join(f"{name}: {'string' if kind == pa.string() else 'boolean' if kind == pa.bool_() else 'int'}" for name, kind in NOTE)

#: Measures and notes of small texts that leave a task together.
BATCH = 10_000


def _whole(text: str | None) -> int | None:
    value = int(text) if text and WHOLE.fullmatch(text) else None
    return value if value is not None and -(1 << 31) <= value < 1 << 31 else None


class Measures:
    """Measures of one text, filled tag by tag."""

    def __init__(self):
        self.done: list[dict] = []
        self.path: list[str] = []
        self.chars: list[str] = []
        self.part = self.measure = -1
        self.now: dict | None = None  # the open measure
        self.got: dict | None = None  # what the open note, backup or forward has shown

    def start(self, tag: str, attributes: dict):
        self.path.append(tag)
        self.chars.clear()
        if len(self.path) == 2 and tag == "part":
            self.part, self.measure = self.part + 1, -1
        elif len(self.path) == 3 and tag == "measure" and self.path[1] == "part":
            self.measure += 1
            self.now = {"part_ix": self.part, "measure_ix": self.measure, "notes": []}
            self.item, self.at, self.head = -1, 0, 0
        elif self.now is not None and len(self.path) == 4 and tag in ("note", "backup", "forward"):
            self.item += 1
            self.got = {}
        elif self.got is not None and len(self.path) == 5 and (tag in ("chord", "grace", "rest") or tag == "tie" and attributes.get("type") == "stop"):
            self.got[tag] = True

    def end(self, tag: str):
        deep = len(self.path) > 4
        below, text = "/".join(self.path[4:]) if deep else "", "".join(self.chars).strip() if deep else ""
        if self.got is not None and text and below in NOTE_AT:
            self.got.setdefault(NOTE_AT[below], text)
        elif self.now is not None and text and below in SIGN_AT and self.path[3] == "attributes":
            self.now.setdefault(SIGN_AT[below], _whole(text))
        elif self.got is not None and len(self.path) == 4:
            self._item(tag, self.got)
            self.got = None
        elif self.now is not None and len(self.path) == 3:
            self.done.append(self.now)
            self.now = None
        self.path.pop()
        self.chars.clear()

    def _item(self, tag: str, got: dict):
        chord, grace = "chord" in got, "grace" in got
        length = 0 if grace else _whole(got.get("duration")) or 0
        if not chord:
            self.head = self.at
        if tag == "note":
            number = {name: _whole(got.get(name)) for name in ("alter", "octave", "voice", "staff")}
            self.now["notes"].append({
                "item_ix": self.item, "step": got.get("step"), "alter": number["alter"] or 0, "octave": number["octave"], "dur_div": length, "dur_type": got.get("dur_type"),
                "voice": 1 if number["voice"] is None else number["voice"], "staff": 1 if number["staff"] is None else number["staff"],
                "onset_div": self.head, "is_rest": "rest" in got, "is_chord": chord, "is_grace": grace, "tie_stop": "tie" in got})
        if not chord:
            self.at += -length if tag == "backup" else length


def measures_of(text: bytes | None) -> list[dict]:
    """Measures of a UTF-8 text with their notes; where it stops being XML, those that were whole before."""
    state = Measures()
    if text:
        reader = expat.ParserCreate("UTF-8")  # whatever the file was written in, it is UTF-8 as a column
        reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = state.start, state.end, state.chars.append
        try:
            reader.Parse(text, True)
        except expat.ExpatError:
            pass
    return state.done


def _measures(texts: DataFrame, doc: str, text: str, with_notes: bool) -> DataFrame:
    """(doc, part_ix, measure_ix, signs), one row per measure; `with_notes`: and its notes as an array."""
    notes = pa.list_(pa.struct(NOTE))
    names = ["part_ix", "measure_ix", *SIGNS]

    def made(ids: pa.Array, at: list[int], rows: list[dict]) -> pa.RecordBatch:
        cols = [ids.take(pa.array(at, pa.int64())), *(pa.array([r.get(c) for r in rows], pa.int32()) for c in names)]
        if with_notes:
            cols.append(pa.array([r["notes"] for r in rows], notes))
        return pa.RecordBatch.from_arrays(cols, [doc, *names, *(["notes"] if with_notes else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, size = [], [], 0
            for i in range(batch.num_rows):  # a text at a time; small ones share a batch, a large one ends it
                for r in measures_of(batch.column(1)[i].as_py()):
                    at.append(i)
                    rows.append(r)
                    size += 1 + len(r["notes"])
                if size >= BATCH:
                    yield made(batch.column(0), at, rows)
                    at, rows, size = [], [], 0
            yield made(batch.column(0), at, rows)

    out = T.StructType([T.StructField(doc, texts.schema[doc].dataType), *[T.StructField(c, T.IntegerType()) for c in names],
                        *([T.StructField("notes", T.DataType.fromDDL(f"array<struct<{NOTE_SQL}>>"))] if with_notes else [])])
    return texts.select(doc, F.col(text).cast("string").cast("binary").alias("__text")).mapInArrow(run, out)


def musicxml_measures(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, part_ix, measure_ix, divisions, fifths, beats, beat_type); signs are null where a measure has none."""
    return _measures(texts, doc, text, False)


def musicxml_notes(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per note with its onset in divisions inside the measure; chord members share their head's onset."""
    return _measures(texts, doc, text, True).select(doc, "part_ix", "measure_ix", F.inline("notes"))


def ingest_musicxml(spark: SparkSession, path: str) -> DataFrame:
    """Notes of all MusicXML files under a path; one file is one row."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return musicxml_notes(texts, "path", "text")
