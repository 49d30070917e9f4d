"""Page numbers and contents lists against the rules written as loops."""

import itertools
import random
import time

import pytest

from scoretables.plans import book as B


def pages_of(rows):
    """{(book, index): page}."""
    out, last = {}, {}
    for book, index, printed, cands in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        was = last.get(book)
        page = was + 1 if was is not None and was + 1 in (cands or []) else printed
        out[book, index] = page
        last[book] = page if page is not None else (None if was is None else was + 1)
    return out


def books():
    r = random.Random(7)
    for book in ("a", "b", None):
        for i in range(150):
            read = None if r.random() < 0.3 else i + r.choice([0, 0, 0, 1, 5, -4])
            cands = None if r.random() < 0.1 else [x for x in (read, i, i + 1, i + r.randrange(9), None) if r.random() < 0.6]
            yield book, i * 3, read, cands
    for i in range(40):
        yield "unread", i, None if i < 17 else 5, [i, 3 * i]
        yield "never", i, None, [i]


def told(spark, rows):
    df = spark.createDataFrame(rows, "book string, index int, printed int, cands array<int>").repartition(5)
    return {(r["book"], r["index"]): r["page"] for r in B.expected_pages(df, "book", "index", "printed", "cands").collect()}


def test_page_numbers(spark):
    rows = list(books())
    want = pages_of(rows)
    assert told(spark, rows) == want
    assert sum(want[b, i] != p for b, i, p, _ in rows) > 50  # the chain decides


def test_page_numbers_of_cut_books(tiny_groups):
    rows = list(books())
    assert told(tiny_groups, rows) == pages_of(rows)


def test_turns_of_stretches_are_their_pages_one_after_another():
    r = random.Random(1)
    for _ in range(200):
        pages = [(None if r.random() < 0.4 else r.randrange(12), [r.randrange(12) for _ in range(r.randrange(4))]) for _ in range(r.randrange(1, 7))]
        known, made, usual, n = turn = (False, {}, None, 0)
        for p in pages:
            turn = B._step(turn, *p)
        known, made, usual, n = turn
        assert n == len(pages) and len(made) <= 3
        for start in (None, *range(-3, 15)):
            last = start
            for read, cands in pages:
                page = last + 1 if last is not None and last + 1 in cands else read
                last = page if page is not None else (None if last is None else last + 1)
            got = made.get(start, usual) if known else (None if start is None else start + n)
            assert got == last


@pytest.mark.parametrize("n", [1, 2, 7])
def test_longest_chains(n):
    for pages in itertools.product(range(4), repeat=n):
        kept = B._kept(list(pages))
        chain = [p for p, k in zip(pages, kept, strict=True) if k]
        best = max(m for m in range(1, n + 1) if any(all(c[i] <= c[i + 1] for i in range(m - 1)) for c in itertools.combinations(pages, m)))
        assert chain == sorted(chain) and len(chain) == best


def test_votes_drop_what_breaks_the_order_and_long_lists_take_seconds(spark):
    toc = spark.createDataFrame([("x", 1, 5), ("x", 2, 9), ("x", 3, 6), ("x", 4, 7), (None, 1, 3)], "book string, number int, page int")
    assert {(r.book, r.number) for r in B.monotone_keep(toc, "book", "number", "page").filter("NOT keep").collect()} == {("x", 2)}
    long = spark.range(100_000).selectExpr("1 AS book", "id AS number", "id + pmod(xxhash64(id), 1000) AS page")
    t0 = time.time()
    kept = B.monotone_keep(long, "book", "number", "page").filter("keep").count()
    assert 1000 < kept < 100_000 and time.time() - t0 < 60
