"""License statements: exact set-similarity search of license templates in text blocks.

A template is a short licence statement, a block a stretch of a text; both are sets of words.  The query's blocks are
windows of words: up to 1.25 times as many as the template has, from every word on, across line feeds and inside long
lines.  `scan` can also take lines as blocks.  A block meets a template when it holds at least `percent` of the
template's words.  Words are ordered by how often they occur in all texts, rare ones first.  A block that meets a
template holds one of the template's first n - o + 1 words (o: the words it must share), so blocks are looked up by
those alone (prefix filter); it has o words at least (length filter), and from the place of its first shared word in the
template's order, o must still be within reach (position filter).  The remaining pairs are counted in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, Texts, Words, pieces, small_batches, table, within
from .registry import query

#: Phrases of the base labels: the words must stand one after another.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Statements by which the method labels blocks, with labels of their own.
TEMPLATES = {
    "released under the mit license": "mit-statement",
    "licensed under the apache license version 2 0": "apache-statement",
    "this work is licensed under the gnu general public license version 3": "gpl-statement",
    "this text is available under cc by 4 0": "cc-by-statement",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-statement",
    "this source code form is subject to the terms of the mozilla public license": "mpl-statement",
    "all rights reserved": "reserved-statement",
    "dedicated to the public domain": "public-domain-statement",
}

_LINES = np.ones(256, bool)
_LINES[0x0A] = False


def _hash_words(text: str) -> np.ndarray:
    return Words(Texts(pa.array([text]), True), ALNUM).hashes()


def word_counts(docs: DataFrame, vocabulary: np.ndarray, text: str = "text") -> dict[int, int]:
    """How often each word of the vocabulary (hashes, sorted) occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for part in pieces(batches, "text"):
            h = Words(Texts(part.column("text"), True), ALNUM).hashes()
            at = np.searchsorted(vocabulary, h)
            at[at == len(vocabulary)] = 0
            total += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.view(np.int64)), pa.array(total)], ["word", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word bigint, n bigint")
    return {r.word: r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Templates:
    """Templates as ranked word sets and the index of their prefixes."""

    def __init__(self, templates: dict[str, str], counts: dict[int, int], percent: int):
        sets = [np.unique(_hash_words(t)) for t in templates]
        sets = [(s, label) for s, label in zip(sets, templates.values(), strict=True) if len(s)]
        every = np.unique(np.concatenate([s for s, _ in sets])) if sets else np.zeros(0, U64)
        order = sorted(range(len(every)), key=lambda i: (counts.get(int(every[i].view(np.int64)), 0), int(every[i])))
        #: words by hash, and the rank of each in the global order
        self.words = every
        self.rank = np.empty(len(every), np.int64)
        self.rank[order] = np.arange(len(every))
        self.labels = [label for _, label in sets]
        self.sets = [np.sort(self.rank[np.searchsorted(every, s)]) for s, _ in sets]
        self.need = [-(-percent * len(s) // 100) for s in self.sets]
        #: words of a window
        self.width = [max(len(_hash_words(t)) * 5 // 4, o) for t, o in zip([t for t in templates if len(_hash_words(t))], self.need, strict=True)]
        self.prefix: dict[int, list[int]] = {}
        for i, (s, o) in enumerate(zip(self.sets, self.need, strict=True)):
            for r in s[: len(s) - o + 1].tolist():
                self.prefix.setdefault(r, []).append(i)

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 for words of no template."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, self.rank[at], -1)

    def meet(self, ranks: np.ndarray, size: int) -> dict[int, float]:
        """Templates met by a block of `size` words of which these distinct ranks (ascending) are template words."""
        found, seen = {}, set()
        for at, r in enumerate(ranks.tolist()):
            for i in self.prefix.get(r, ()):
                if i in seen:
                    continue
                seen.add(i)
                s, o = self.sets[i], self.need[i]
                if size < o or min(len(s) - int(np.searchsorted(s, r)), len(ranks) - at) < o:
                    continue
                shared = len(np.intersect1d(s, ranks, assume_unique=True))
                if shared >= o:
                    found[i] = shared / len(s)
        return found

    def windows(self, ranks: np.ndarray, words: Words) -> Iterator[tuple[int, int, int, float]]:
        """(template, first word, word after the last, containment) of the windows of the batch that meet a template.

        A window that meets a template also does so from its first template word on, so only those are starts.  Words
        are looked for in the order of their ranks, and starts are dropped once too few words can still be found:
        after the prefix those without any of it (prefix filter), then those out of reach (position filter).
        """
        for i, (s, o, width) in enumerate(zip(self.sets, self.need, self.width, strict=True)):
            starts = np.flatnonzero(np.isin(ranks, s))
            stop = np.minimum(starts + width, words.first[words.doc[starts] + 1])
            long = stop - starts >= o
            starts, stop = starts[long], stop[long]
            shared, end = np.zeros(len(starts), np.int64), starts + 1
            for j, r in enumerate(s.tolist()):
                places = np.append(np.flatnonzero(ranks == r), len(ranks))
                at = places[np.searchsorted(places, starts)]
                shared += at < stop
                end = np.where(at < stop, np.maximum(end, at + 1), end)
                open_ = shared + len(s) - 1 - j >= o
                starts, stop, shared, end = starts[open_], stop[open_], shared[open_], end[open_]
                if not len(starts):
                    break
            # of windows that overlap the fullest, and of those the first
            k = 0
            while k < len(starts):
                best = k + int(shared[k : np.searchsorted(starts, end[k])].argmax())
                yield i, int(starts[best]), int(end[best]), float(shared[best] / len(s))
                k = int(np.searchsorted(starts, end[best]))


def _phrase_places(words: Words, h: np.ndarray, phrases: list[np.ndarray]) -> list[np.ndarray]:
    """Word numbers (in the batch) where each phrase starts."""
    out = []
    for p in phrases:
        k = len(p)
        if len(h) < k:
            out.append(np.zeros(0, np.int64))
            continue
        at = np.flatnonzero(h[: len(h) - k + 1] == p[0])
        at = at[within(words.doc, k)[at]]
        for j in range(1, k):
            at = at[h[at + j] == p[j]]
        out.append(at)
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, percent: int = 80, by: str = "lines") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) for each row of docs.

    by: "windows" of words, as the query has it, or "lines".  blocks: those that meet a template, as (line, label,
    containment), lines counted from 0; a window has the line of its first word, and of windows that overlap the fullest
    counts.  score: the largest containment of a template in a block, 1 where a base phrase stands.  A null or empty
    text has no words, places or labels; its label columns are empty strings, its score 0.  A null doc_id is kept;
    repeated rows give the same; other columns don't matter; an empty table gives no rows.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    if by not in ("windows", "lines"):
        raise ValueError(f"by: {by}")
    docs = small_batches(docs)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    hashed = [_hash_words(t) for t in templates]
    vocabulary = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, U64)
    index = Templates(templates, word_counts(rows, vocabulary) if len(vocabulary) else {}, percent)
    wanted, labels = [_hash_words(p) for p in phrases], list(phrases.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            texts = Texts(part.column("text"), True)
            words = Words(texts, ALNUM)
            h = words.hashes()
            n = texts.n
            places, base = [[] for _ in range(n)], [set() for _ in range(n)]
            for label, at in zip(labels, _phrase_places(words, h, wanted), strict=True):
                for w, d in zip(at.tolist(), words.doc[at].tolist(), strict=True):
                    places[d].append(w - int(words.first[d]))
                    base[d].add(label)
            more, blocks = [set() for _ in range(n)], [[] for _ in range(n)]
            ranks = index.ranks(h)
            # every \n counts in the number of a line, also where lines are empty
            feeds = np.concatenate([[0], np.cumsum(~_LINES[texts.buf])])

            def add(d: int, byte: int, t: int, share: float) -> None:
                more[d].add(index.labels[t])
                blocks[d].append({"line": int(feeds[byte] - feeds[texts.offsets[d]]), "label": index.labels[t], "containment": share})

            if by == "windows":
                for t, a, _, share in index.windows(ranks, words):
                    add(int(words.doc[a]), words.start[a], t, share)
            else:
                starts = np.array([r in index.prefix for r in range(len(index.words))] + [False])[ranks]
                lines = Words(texts, _LINES)
                line = np.searchsorted(lines.start, words.start, "right") - 1
                for i in np.unique(line[starts]).tolist():
                    a, b = np.searchsorted(words.start, (lines.start[i], lines.end[i]))
                    own = np.unique(ranks[a:b])
                    for t, share in index.meet(own[own >= 0], len(np.unique(h[a:b]))).items():
                        add(int(lines.doc[i]), lines.start[i], t, share)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words.count, pa.int64()), pa.array([len(p) for p in places], pa.int64()),
                 pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()),
                 pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x | y)) for x, y in zip(base, more, strict=True)]),
                 pa.array([1.0 if x else max((b["containment"] for b in y), default=0.0) for x, y in zip(base, blocks, strict=True)], pa.float64()),
                 pa.array(blocks, pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
                                "blocks array<struct<line: bigint, label: string, containment: double>>")


@query("op8_license_scan")
def op8(spark, folder):
    return scan(table(spark, folder, "documents"), by="windows")
