import random

from scoretables.operators.repeats import repeat_segments


def brute(fp, least=2):
    n, best = len(fp), {}
    for i in range(n):
        for j in range(i + 1, n):
            if fp[i] is None or fp[i] != fp[j] or (i and fp[i - 1] is not None and fp[i - 1] == fp[j - 1]):
                continue
            k = 0
            while j + k < n and fp[i + k] is not None and fp[i + k] == fp[j + k]:
                k += 1
            if k >= least:
                for e in (i - 1, i + k - 1, j - 1, j + k - 1):
                    best[e] = max(best.get(e, 0), k)
    return best


def test_songs_agree_with_brute_force(spark):
    rnd = random.Random(5)
    songs = {s: [rnd.choice("ab" if s % 2 else "abcd") if rnd.random() > 0.05 else None for _ in range(n)]
             for s, n in enumerate((0, 1, 2, 9, 40, 60, 33))}
    songs[7] = ["a"] * 30
    rows = [(s, i, v) for s, fp in songs.items() for i, v in enumerate(fp)]
    df = spark.createDataFrame(rows, "song int, m int, fp string")
    want = {(s, e, n) for s, fp in songs.items() for e, n in brute(fp).items()}
    assert {tuple(r) for r in repeat_segments(df, ["song"], ["m"], "fp").collect()} == want


def test_null_song_and_floating_values(spark):
    nan = float("nan")
    rows = [(None, i, v) for i, v in enumerate([1.0, nan, 2.0, 1.0, nan, 2.0, 3.0, 0.0, 4.0, -0.0, 4.0])] + [(1, i, float(v)) for i, v in enumerate([5, 6, 7, 5, 6])]
    got = {tuple(r) for r in repeat_segments(spark.createDataFrame(rows, "song int, m int, v double"), ["song"], ["m"], "v").collect()}
    assert got == {(None, e, n) for e, n in brute(["1", "n", "2", "1", "n", "2", "3", "0", "4", "0", "4"]).items()} | {(1, e, n) for e, n in brute([5, 6, 7, 5, 6]).items()}
