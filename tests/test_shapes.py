import random

from pyspark.sql import functions as F

from scoretables.operators import shapes
from scoretables.operators.shapes import components, connected_frames, exact_then_fuzzy, near_links


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


def near(a, b, m):
    return a[1] - m <= b[1] + b[3] and b[1] - m <= a[1] + a[3] and a[2] - m <= b[2] + b[4] and b[2] - m <= a[2] + a[4]


def test_near_links_connect_what_pairs_connect(spark):
    rnd = random.Random(3)
    for trial in range(3):
        boxes = [(i, rnd.uniform(0, 60), rnd.uniform(0, 60), rnd.choice([0.0, 1.0, 9.0]), rnd.choice([0.0, 0.5, 7.0])) for i in range(120)]
        want = roots(len(boxes), [(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and near(a, b, 1.5)])
        df = spark.createDataFrame(boxes, "id bigint, x double, y double, w double, h double").withColumn("page", F.lit(1))
        links = [(r.a, r.b) for r in near_links(df, ["page"], "id", "x", "y", "w", "h", 1.5).collect()]
        assert roots(len(boxes), links) == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 105), (105, 106)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41))
    assert {got[i] for i in (100, 101, 103)} == {100} and {got[i] for i in (105, 106, 200)} == {105}


def test_connected_frames_keeps_real_frames(spark):
    rules = [(1, 0.0, 0.0, 50.0, 1.0), (2, 0.0, 20.0, 50.0, 1.0), (3, 0.0, 0.0, 1.0, 20.0), (4, 49.0, 0.0, 1.0, 20.0), (5, 200.0, 200.0, 50.0, 1.0)]
    df = spark.createDataFrame(rules, "id bigint, x double, y double, w double, h double").withColumn("page", F.lit(7))
    got = [tuple(r) for r in connected_frames(df, ["page"], "id", ["x", "y", "w", "h"]).collect()]
    assert got == [(7, 1, 4, 0.0, 0.0, 50.0, 21.0)]


def test_fuzzy_lookup_agrees_with_brute_force(spark):
    rnd = random.Random(8)
    words = lambda: [rnd.getrandbits(64) - 2**63 for _ in range(4)]
    shapes = [(i, words()) for i in range(20)]
    objs = []
    for i in range(60):
        sig = list(shapes[rnd.randrange(20)][1])
        for _ in range(rnd.randrange(0, 9)):
            k = rnd.randrange(256)
            v = (sig[k // 64] ^ (1 << (k % 64))) & (2**64 - 1)
            sig[k // 64] = v - 2**64 if v >= 2**63 else v
        objs.append((i, sig))

    def dist(a, b):
        return sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))

    want = {}
    for i, sig in objs:
        d, label = min((dist(sig, s), n) for n, s in shapes)
        if d <= 7:
            want[i] = (label, d)
    o = spark.createDataFrame(objs, "obj bigint, sig array<bigint>").withColumn("key", F.xxhash64("sig"))
    s = spark.createDataFrame(shapes, "label bigint, sig array<bigint>").withColumn("key", F.xxhash64("sig"))
    got = {r.obj: (r.label, r.dist) for r in exact_then_fuzzy(o, s, "obj", "key", "sig", "label", 7, 32).collect()}
    assert got == want


def test_a_huge_box_among_small_ones(spark):
    import random

    rnd = random.Random(4)
    boxes = [(1, i, rnd.uniform(0, 4000), rnd.uniform(0, 4000), rnd.uniform(1, 9), rnd.uniform(1, 9)) for i in range(300)]
    boxes += [(1, 900, 500.0, 500.0, 2000.0, 3000.0), (1, 901, 2503.0, 100.0, 1.0, 500.0), (1, 902, -9e6, -9e6, 10.0, 10.0)]
    df = spark.createDataFrame(boxes, "page int, id int, x double, y double, w double, h double")
    links = near_links(df, ["page"], "id", "x", "y", "w", "h", 4.0)
    got = {r.node: r.root for r in components(links, "a", "b").collect()}
    up = {b[1]: b[1] for b in boxes}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for _, i, x, y, w, h in boxes:
        for _, j, x2, y2, w2, h2 in boxes:
            if i < j and x2 <= x + w + 4 and x <= x2 + w2 + 4 and y2 <= y + h + 4 and y <= y2 + h2 + 4:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert got == {k: find(k) for k in up if any(find(k) == find(o) for o in up if o != k)}


def test_boxes_are_shuffled_once_by_tiles(spark, monkeypatch):
    """Chains over the borders of tiles, copies, boxes without id and with turned edges connect as they do by the cells' own joins."""
    rnd = random.Random(11)
    boxes = []
    for i in range(700):
        page, key = rnd.choice(["a", "b", None]), None if rnd.random() < 0.02 else rnd.randrange(650)
        boxes.append((page, key, rnd.uniform(-130, 130), rnd.uniform(-130, 130), rnd.choice([0.0, 3.0, 9.0, -5.0]), rnd.choice([0.0, 0.5, 7.0])))
    boxes += [("a", 700, 5.0, 5.0, None, 1.0), ("b", 701, 5.0, 5.0, 100.0, 1.0), ("c", 702, 0.0, 0.0, 1.0, 1.0), ("c", 703, 1e15, 0.0, 1.0, 1.0), ("c", 704, 2.0, 2.0, -400.0, 1.0)]
    df = spark.createDataFrame(boxes, "page string, id bigint, x double, y double, w double, h double")
    args = (df, ["page"], "id", "x", "y", "w", "h", 3.0)
    monkeypatch.setattr(shapes, "TILE", 16)
    monkeypatch.setattr(shapes, "BUCKET_ROWS", 100)
    links = near_links(*args)
    monkeypatch.setattr(shapes, "TILE_ROWS", 0)
    slow = near_links(*args)
    found = [[tuple(r) for r in d.collect()] for d in (links, slow)]
    trees = [roots(705, [(a, b) for _, a, b in got]) for got in found]
    assert trees[0] == trees[1] and len(set(trees[0].values())) < 600
    ends = [{(page, i) for page, *ab in got for i in ab} for got in found]
    assert ends[0] == ends[1] and {page for page, _ in ends[0]} == {"a", "b", "c"}

    monkeypatch.undo()
    plan = near_links(df.filter("abs(w) < 10 and abs(x) < 1000"), *args[1:])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
