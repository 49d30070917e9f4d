"""Book splitting: page numbers, contents lists, titles and songs."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import BLOCK, Ordered, lag
from ..session import cut_lineage


#: How a stretch of pages turns the number before it into its last one: `known`: for the numbers `came` it is `made`
#: and for all others `usual`; not `known` (no page of it was read): it grows by `pages`.
TURN = "known boolean, came array<bigint>, made array<bigint>, usual bigint, pages bigint"


def _step(turn: tuple, read: int | None, candidates: list[int]) -> tuple:
    """The turn of a stretch and one more page."""
    known, made, usual, n = turn
    seen = set(candidates)
    if not known:
        if read is None:
            return False, {}, None, n + 1
        # before the first page that was read, numbers only grow
        return True, {c - n - 1: c for c in seen if c != read}, read, n + 1

    def after(last: int) -> int:
        return last + 1 if last + 1 in seen or read is None else read

    usual = after(usual)
    # numbers that now lead where all others do need no entry: there are never more than one page's candidates
    return True, {came: y for came, y in ((came, after(last)) for came, last in made.items()) if y != usual}, usual, n + 1


def _turns(names: list[str]):
    """One turn for each stretch; rows come sorted, `__first` at the start of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turn = None, None
        for b in batches:
            out = []
            for i, (read, cands, first) in enumerate(zip(b.column("__read").to_pylist(), b.column("__cands").to_pylist(), b.column("__first").to_pylist(), strict=True)):
                if first:
                    if held is not None:
                        out.append((held, turn))
                    held, turn = tuple(b.column(c)[i].as_py() for c in names), (False, {}, None, 0)
                turn = _step(turn, read, [c for c in cands or [] if c is not None])
            yield _turn_rows(out, b, names)
            last = b
        if held is not None:
            yield _turn_rows([(held, turn)], last, names)

    return run


def _turn_rows(turns: list, like: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    cols = [pa.array([k[i] for k, _ in turns], like.column(c).type) for i, c in enumerate(names)]
    longs = pa.list_(pa.int64())
    made = [pa.array([t[0] for _, t in turns], pa.bool_()), pa.array([list(t[1]) for _, t in turns], longs), pa.array([list(t[1].values()) for _, t in turns], longs),
            pa.array([t[2] for _, t in turns], pa.int64()), pa.array([t[3] for _, t in turns], pa.int64())]
    return pa.RecordBatch.from_arrays([*cols, *made], [*names, "known", "came", "made", "usual", "pages"])


def _numbered_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends each page's number; rows come sorted, `__first` at the start of each stretch, `__before` the number before it."""
    last = None
    for b in batches:
        out = []
        for read, cands, first, before in zip(*(b.column(c).to_pylist() for c in ("__read", "__cands", "__first", "__before")), strict=True):
            if first:
                last = before
            hit = last is not None and last + 1 in (cands or ())
            page = last + 1 if hit else read
            out.append(page)
            last = page if page is not None else (None if last is None else last + 1)
        yield b.append_column("page", pa.array(out, pa.int64()))


def expected_pages(pages: DataFrame, book: str, index: str, printed: str, candidates: str) -> DataFrame:
    """pages with `page`: one more than the page before where that is among the readings (`candidates`), else the number
    read first (`printed`, may be NULL).  A page without a number still counts for the next one.

    Books are walked in order, many in a task.  A book of more than `scoretables.maxGroupRows` pages is walked in blocks:
    first each block gives its turn, how it changes any number that comes in; the turns of a book, one for each block,
    give every block the number before it; then the blocks are walked on their own.
    """
    rows = pages.withColumns({"__read": F.col(printed).cast("bigint"), "__cands": F.col(candidates).cast("array<bigint>")})
    o = Ordered.of(rows, [book], [index]).add(__was=lag(F.lit(True)))
    rows = o.df.withColumns({"__first": F.col("__was").isNull(), "__before": F.lit(None).cast("bigint")}).drop("__was")
    by = [book]
    if o.blocked:
        by = [book, BLOCK]
        rows = cut_lineage(rows.drop("__first").withColumn("__first", F.row_number().over(Window.partitionBy(*by).orderBy(index)) == 1))
        names = [f.name for f in rows.select(*by).schema.fields]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
        cut = rows.filter(F.col(BLOCK) >= 0)
        turns = cut.select(*by, index, "__read", "__cands", "__first").repartition(*by).sortWithinPartitions(*by, index).mapInArrow(_turns(names), f"{kinds}, {TURN}")
        # one row for each block of a book that was cut
        turn = F.struct(F.col(BLOCK).alias("block"), "known", "came", "made", "usual", "pages")
        books = turns.groupBy(book).agg(F.array_sort(F.collect_list(turn)).alias("__turns"))
        none = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<struct<block:int,before:bigint>>").alias("out"))

        def through(s, t):
            at = F.array_position(t["came"], s["last"])
            last = F.when(~t["known"], s["last"] + t["pages"]).when(F.coalesce(at, F.lit(0)) > 0, F.get(t["made"], (at - 1).cast("int"))).otherwise(t["usual"])
            return F.struct(last.alias("last"), F.array_append(s["out"], F.struct(t["block"].cast("int").alias("block"), s["last"].alias("before"))).alias("out"))

        before = books.select(book, F.explode(F.aggregate("__turns", none, through, lambda s: s["out"])).alias("__b")).select(F.col(book).alias("__k"), F.col("__b.block").alias("__kb"), F.col("__b.before").alias("__start"))
        rows = rows.join(before, F.col(book).eqNullSafe(F.col("__k")) & (F.col(BLOCK) == F.col("__kb")), "left")
        rows = rows.withColumn("__before", F.col("__start")).drop("__k", "__kb", "__start")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", page bigint"
    walked = rows.repartition(*by).sortWithinPartitions(*by, index).mapInArrow(_numbered_pages, ddl)
    return walked.select(*pages.columns, "page")


def _kept(pages: list[int]) -> list[bool]:
    """Which entries belong to a longest chain whose pages don't fall; of equal ones the chain that ends last.

    Patience piles: an entry goes on the first pile whose top is larger and remembers the top of the pile before.
    """
    tops, top_at, back = [], [], []
    for i, page in enumerate(pages):
        k = bisect_right(tops, page)
        back.append(top_at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(page)
            top_at.append(i)
        else:
            tops[k], top_at[k] = page, i
    kept, i = [False] * len(pages), top_at[-1] if top_at else -1
    while i >= 0:
        kept[i], i = True, back[i]
    return kept


def monotone_keep(toc: DataFrame, book: str, number: str, page: str) -> DataFrame:
    """(book, number, page, keep) of contents entries, `keep` false for those whose page breaks the rising order.

    One row per book and song number, so a group is as long as the book's list of songs, whatever the votes were.  A
    longest chain of entries with rising pages is kept, of equal ones the one that ends last.
    """
    rows = toc.select(book, number, page)
    name = [f.name for f in rows.schema.fields]

    def run(entries: pd.DataFrame) -> pd.DataFrame:
        entries = entries.sort_values([name[1], name[2]])
        return entries.assign(keep=_kept(entries[name[2]].tolist()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(book).applyInPandas(run, ddl + ", keep boolean")


def number_titles(titles: DataFrame, offsets: DataFrame, toc: DataFrame, book: str) -> DataFrame:
    """(book, page, k, number, how): the song number of every title of a book, in reading order.

    `titles`: page, k, read (number read or NULL), one row per title; `offsets`: offset; `toc`: number, at (page).
    A number read stands if the contents list it on this page, or if it goes on from the last one by at most six
    and its listed page is within one.  Else the list decides by place, then its next free number, else the last
    number plus one.  `how` is `read`, `listed` or `next`.

    What a title needs to know of the list comes to it by joins; the numbers then follow in one pass over the array of
    a book's titles.
    """
    big = [F.col(x).cast("bigint").alias(x) for x in ("page", "k", "read")]
    t = titles.join(offsets, book, "left").select(book, *big, (F.col("page") - F.col("offset")).cast("bigint").alias("printed"))
    entries = toc.select(book, F.col("number").cast("bigint").alias("number"), F.col("at").cast("bigint").alias("at"))
    on_page = entries.groupBy(book, F.col("at").alias("printed")).agg(F.sort_array(F.collect_list("number")).alias("listed"))
    of_read = entries.select(book, F.col("number").alias("read"), F.col("at").alias("read_at"))
    beside = Window.partitionBy(book, "page")  # the titles of one page
    t = t.join(on_page, [book, "printed"], "left").join(of_read, [book, "read"], "left").select(
        book, "page", "k", "read", F.coalesce("listed", F.array().cast("array<bigint>")).alias("listed"),
        F.coalesce(F.abs(F.col("read_at") - F.col("printed")) <= 1, F.lit(True)).alias("placed"),
        F.row_number().over(beside.orderBy("k")).alias("nth"), F.count(F.lit(1)).over(beside).alias("titles"))
    books = t.groupBy(book).agg(F.sort_array(F.collect_list(F.struct("page", "k", "read", "listed", "placed", "nth", "titles"))).alias("__titles"))
    done = "array<struct<page:bigint,k:bigint,number:bigint,how:string>>"
    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("open"), F.array().cast(done).alias("done"))

    def give(s, x):
        last = s["last"]
        open_ = F.when(x["nth"] == 1, x["listed"]).otherwise(s["open"])
        follows = (x["read"] > last) & (x["read"] <= last + 6) & x["placed"]
        own = F.get(x["listed"], x["nth"] - 1)
        choice = F.coalesce(
            F.when(F.array_contains(open_, x["read"]) | follows, F.struct(x["read"].alias("number"), F.lit("read").alias("how"))),
            F.when((F.size(x["listed"]) == x["titles"]) & (own > last), F.struct(own.alias("number"), F.lit("listed").alias("how"))),
            F.get(F.transform(F.slice(F.filter(open_, lambda n: n > last), 1, 1), lambda n: F.struct(n.alias("number"), F.lit("listed").alias("how"))), F.lit(0)),
            F.struct((last + 1).alias("number"), F.lit("next").alias("how")))
        row = F.struct(x["page"].alias("page"), x["k"].alias("k"), choice["number"].alias("number"), choice["how"].alias("how"))
        return F.struct(choice["number"].alias("last"), F.filter(open_, lambda n: n != choice["number"]).alias("open"), F.array_append(s["done"], row).cast(done).alias("done"))

    rows = books.select(book, F.explode(F.aggregate("__titles", start, give, lambda s: s["done"])).alias("__r"))
    return rows.select(book, "__r.*")


def order_align(syllables: Column, notes: Column) -> Column:
    """Place of the note each syllable of a line goes to: the nearest free one, in order, leaving room for the rest."""
    n, m = F.size(notes), F.size(syllables)
    start = F.struct(F.lit(0).alias("next"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("out"))

    def put(s, x):
        room = F.greatest(s["next"] + 1, n - (m - s["k"] - 1))
        gaps = F.transform(F.slice(notes, s["next"] + 1, F.greatest(F.lit(0), room - s["next"])), lambda v: F.abs(v - x))
        j = F.when(s["next"] >= n, n - 1).otherwise(s["next"] + F.array_position(gaps, F.array_min(gaps)).cast("int") - 1)
        nxt = F.when(s["next"] >= n, s["next"]).otherwise(j + 1)
        return F.struct(nxt.alias("next"), (s["k"] + 1).alias("k"), F.array_append(s["out"], j).alias("out"))

    return F.when(n > 0, F.aggregate(syllables, start, put, lambda s: s["out"])).otherwise(F.array().cast("array<int>"))
