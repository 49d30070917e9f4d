"""Shape dictionaries and connected frames."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import _level, _levels, _spread
from .scan import Ordered, _by_rows, running_min


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two signatures packed into arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def _bands(sig: Column, width: int) -> Column:
    """The signature cut into pieces of `width` bits (a divisor of 64), each marked with its place."""
    per = 64 // width
    mask = F.lit(2**width - 1).cast("bigint")
    place = F.sequence(F.lit(0), F.size(sig) * per - 1)

    def piece(i):
        word = F.get(sig, F.floor(i / per).cast("int"))
        part = reduce(lambda out, k: F.when(i % per == k, F.shiftrightunsigned(word, k * width)).otherwise(out), range(1, per), word)
        return F.struct(i.alias("place"), part.bitwiseAND(mask).alias("bits"))

    return F.transform(place, piece)


def exact_then_fuzzy(objs: DataFrame, shapes: DataFrame, obj: str, key: str, sig: str, label: str, max_dist: int, width: int) -> DataFrame:
    """(obj, label, dist): the dictionary entry with the object's key, else the nearest one by signature.

    Equal keys meet in an equi-join.  The rest are looked up once per distinct signature: two signatures no more
    than `max_dist` bits apart agree in full on at least one of more than `max_dist` pieces, so they meet on that
    piece; the signature must have more than `max_dist` pieces of `width` bits.  Of its pieces a signature asks only for
    the `max_dist` + 1 that fewest shapes have, as one of any so many must agree; a blank piece that most shapes share
    is not among them.  The nearest wins, then the lower label.
    """
    first = shapes.groupBy(key).agg(F.min(label).alias(label))
    met = objs.join(first, key, "left")
    hits = met.filter(F.col(label).isNotNull()).select(obj, label, F.lit(0).alias("dist"))
    miss = met.filter(F.col(label).isNull()).select(obj, sig)
    want = miss.select(sig).distinct().select(F.col(sig).alias("__a"), F.explode(_bands(F.col(sig), width)).alias("__k"))
    have = shapes.groupBy(sig).agg(F.min(label).alias(label)).select(
        F.col(sig).alias("__b"), label, F.explode(_bands(F.col(sig), width)).alias("__k"))
    often = have.groupBy("__k").agg(F.count(F.lit(1)).alias("__n"))
    asked = want.join(often, "__k", "left").groupBy("__a").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__k").alias("k")))).alias("__ks"))
    want = asked.select("__a", F.explode(F.slice("__ks", 1, max_dist + 1)).alias("__p")).filter("__p.n > 0").select("__a", F.col("__p.k").alias("__k"))
    near = want.join(have, "__k").groupBy("__a", "__b").agg(F.min(label).alias(label)).withColumn("dist", hamming(F.col("__a"), F.col("__b"))).filter(F.col("dist") <= max_dist)
    best = near.groupBy(F.col("__a").alias(sig)).agg(F.min(F.struct("dist", label)).alias("__m"))
    fuzzy = miss.join(best, sig).select(obj, f"__m.{label}", "__m.dist")
    return hits.unionByName(fuzzy)


WIDE = 16


def _wide_links(wide: DataFrame, every: DataFrame, page: list[str], m: float) -> DataFrame:
    """(page, a, b): each wide box with every box within m of it; a pair meets in the grid of the larger one."""
    level = _level(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * m, m)
    levels = F.array(*[F.lit(k) for k in _levels((wide, level))])
    size = F.lit(m) * F.pow(F.lit(2.0), F.col("__lv"))

    def cells(df, at, margin):
        d = _spread(df, F.col("x0") - margin, F.col("x1") + margin, m, at).withColumnRenamed("__bk", "cx")
        return d.withColumn("cy", F.explode(F.sequence(F.floor((F.col("y0") - margin) / size), F.floor((F.col("y1") + margin) / size))))

    a = cells(wide, F.array(level), m).select(*page, "__lv", "cx", "cy", F.col("id").alias("a"), *[F.col(c).alias("a" + c) for c in ("x0", "y0", "x1", "y1")])
    b = cells(every.withColumn("__own", level), F.filter(levels, lambda k: k >= F.col("__own")), 0).withColumnRenamed("id", "b").drop("__own")
    near = [F.col(hi) + m >= F.col(lo) for lo, hi in (("x0", "ax1"), ("ax0", "x1"), ("y0", "ay1"), ("ay0", "y1"))]
    return a.join(b.hint("merge"), [*page, "__lv", "cx", "cy"]).filter(reduce(lambda p, q: p & q, near)).select(*page, "a", "b").distinct()


TILE = 512  # cells on a side of a tile
TILE_ROWS = 100_000  # a page with a tile of more boxes is linked by joins and ordered passes over its cells
BUCKET_ROWS = 50_000  # rows of the tiles that are linked at once
FAR = 2.0**40  # cells from the origin up to which boxes are linked by tiles


def _boxes(rects: DataFrame, page: list[str], id_: str, x: str, y: str, w: str, h: str) -> DataFrame:
    x0, y0, x1, y1 = F.col(x), F.col(y), F.col(x) + F.col(w), F.col(y) + F.col(h)
    return rects.select(*page, F.col(id_).alias("id"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def near_links(rects: DataFrame, page: list[str], id_: str, x: str, y: str, w: str, h: str, m: float) -> DataFrame:
    """Links (page, a, b) whose chains connect the same boxes as "within `m` of each other on both axes".

    Boxes that touch one grid cell of side `m` are all near each other, so each cell ties its boxes to the least of
    them, and two neighbouring cells need at most one link between those.  Side by side, the closest edges decide it;
    corner to corner, one ordered pass does.  The links grow with the boxes, not with the pairs.  Boxes of more than
    `WIDE` cells on a side would fill the grid; they meet all others in grids of their own size instead.

    The boxes are shuffled once, by tiles of cells, and each tile is linked within a task.  Pages with a tile that is too
    full for that take one shuffle for each of the steps.
    """
    return _links(cut_lineage(_boxes(rects, page, id_, x, y, w, h)), page, m)


def _links(b: DataFrame, page: list[str], m: float) -> DataFrame:
    """As near_links(); `b`: page, id, x0, y0, x1, y1, read several times."""
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")
    is_wide = F.greatest(x1 - x0, y1 - y0) > WIDE * m
    wide, small = b.filter(is_wide), b.filter(~is_wide)
    links = [] if wide.isEmpty() else [_wide_links(wide, b, page, m)]
    small = small.filter(reduce(lambda p, q: p & q, [F.col(k).isNotNull() for k in [*page, "x0", "y0", "x1", "y1"]]))
    odd = (F.greatest(x0 - x1, y0 - y1) > WIDE * m) | (F.greatest(*[F.abs(v) for v in (x0, y0, x1, y1)]) > FAR * m)
    tiled = small.withColumn("__odd", odd)
    for tile, p, q in (("__tx", x0, x1), ("__ty", y0, y1)):  # a box lies in the tiles of its cells and of their neighbours
        lo, hi = (F.floor((F.floor(v / m) + d) / TILE) for v, d in ((F.least(p, q), -1), (F.greatest(p, q), 1)))
        tiled = tiled.withColumn(tile, F.explode(F.sequence(lo, F.when(F.col("__odd"), lo).otherwise(hi))))
    counts = tiled.groupBy(*page, "__tx", "__ty").agg(F.count(F.lit(1)).alias("__n"), F.max("__odd").alias("__odd"))
    full = F.col("__odd") | (F.col("__n") > TILE_ROWS)
    got = counts.agg(F.sum("__n").alias("rows"), F.max(full).alias("full")).first()
    if got["full"]:
        pages = counts.filter(full).select(*page).distinct()
        links.append(_grid_links(small.join(pages, page, "left_semi") if page else small, page, m))
        tiled = tiled.join(pages, page, "left_anti") if page else None
    if tiled is not None:
        links.append(_tile_links(tiled.drop("__odd"), page, m, got["rows"] or 0))
    out = reduce(lambda p, q: p.unionByName(q), links).filter("a <> b")
    return out.select(*page, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tile_links(tiled: DataFrame, page: list[str], m: float, rows: int) -> DataFrame:
    """Links from the least box to each other one of those that are connected within a tile."""
    bucket = F.pmod(F.xxhash64(*page, "__tx", "__ty"), F.lit(rows // BUCKET_ROWS + 1))
    names, kind = [*page, "a", "b"], tiled.schema["id"].dataType.simpleString()

    def link(t: pa.Table) -> pa.Table:
        rank = pc.rank(t["id"], null_placement="at_end", tiebreaker="dense").to_numpy()
        order = np.argsort(rank, kind="stable")
        code = np.zeros(len(order), np.int64)
        for c in [*page, "__tx", "__ty"]:
            code = code * len(order) + t[c].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            code = np.unique(code, return_inverse=True)[1]
        tx, ty, *ends = (t[c].to_numpy()[order] for c in ("__tx", "__ty", "x0", "y0", "x1", "y1"))
        named = pc.is_valid(t["id"]).to_numpy()[order]
        root = _tile_roots(code[order], named, tx * TILE, ty * TILE, *(v.astype(np.float64) for v in ends), m)
        b = np.flatnonzero(root != np.arange(len(root)))
        a, b = order[root[b]], order[b]
        a, b = a[rank[a] != rank[b]], b[rank[a] != rank[b]]
        return pa.table([*(t[c].take(b) for c in page), t["id"].take(a), t["id"].take(b)], names)

    dealt = _by_rows(tiled.withColumn("__bucket", bucket), ["__bucket"], rows)
    schema = "".join(f"`{c}` {tiled.schema[c].dataType.simpleString()}, " for c in page) + f"a {kind}, b {kind}"
    return dealt.groupBy("__bucket").applyInArrow(link, schema)


def _tile_roots(tile: np.ndarray, named: np.ndarray, left: np.ndarray, low: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, m: float) -> np.ndarray:
    """The first of the boxes that each box is connected with in its tile, by the links that `_grid_links` makes.

    `tile`: its number; `left`, `low`: its first cells.  The boxes come in order of their ids, those without one (not
    `named`) last; these are linked with none, but fill their cells.
    """
    n, pad = len(tile), 2 * WIDE  # a box reaches less than `pad` cells beyond its tile
    (ax0, ax1), (ay0, ay1) = ([np.floor(v / m).astype(np.int64) - at + pad for v in ends] for at, ends in ((left, (x0, x1)), (low, (y0, y1))))
    cx, cy = np.minimum(ax0, ax1), np.minimum(ay0, ay1)
    across, up = np.abs(ax1 - ax0) + 1, np.abs(ay1 - ay0) + 1
    box = np.repeat(np.arange(n), across * up)
    k = np.arange(len(box)) - np.repeat(np.cumsum(across * up) - across * up, across * up)
    cx, cy = cx[box] + k % across[box], cy[box] + k // across[box]
    side = TILE + 2 * pad
    cell = (tile[box] * side + cx) * side + cy
    order = np.argsort(cell, kind="stable")
    first = np.flatnonzero(np.diff(cell[order], prepend=-1))
    cells, by_cell = cell[order][first], box[order]
    rep = by_cell[first]
    ends = {"x1": np.maximum.reduceat(x1[by_cell], first), "y1": np.maximum.reduceat(y1[by_cell], first),
            "x0": np.minimum.reduceat(x0[by_cell], first), "y0": np.minimum.reduceat(y0[by_cell], first)}

    def find(want):
        i = np.minimum(np.searchsorted(cells, want), len(cells) - 1)
        return i, cells[i] == want

    links = [(np.repeat(rep, np.diff(first, append=len(by_cell))), by_cell)]
    for step, edge, other in ((side, "x1", "x0"), (1, "y1", "y0")):
        i, there = find(cells + step)
        met = there & (ends[other][i] - ends[edge] <= m)
        links.append((rep[met], rep[i[met]]))
    for sy in (1, -1):
        near_y, far_y, a_near, a_far = (y1, y0, ay1, ay0) if sy == 1 else (y0, y1, ay0, ay1)
        # a lies left of the corner, b right of it, as in _grid_links; `corner` is the cell of a
        a = (cx == ax1[box]) & (cy == a_near[box])
        a &= find(cell + side + sy)[1]
        b = (cx == ax0[box]) & (cy == a_far[box])
        b &= find(cell - side - sy)[1]
        corner = np.concatenate([cell[a], cell[b] - side - sy])
        if not a.any() or not b.any():
            continue
        at = np.concatenate([m + x1[box[a]], x0[box[b]]])
        is_a = np.arange(len(corner)) < a.sum()
        yy = np.concatenate([-sy * near_y[box[a]], sy * far_y[box[b]]])
        by = np.lexsort((is_a, at, corner))
        corner, is_a, yy = corner[by], is_a[by], yy[by]
        # running minimum of the b's within each corner: later corners stand lower, so it starts anew in each
        values, place = np.unique(yy, return_inverse=True)
        none = len(values)
        below = np.cumsum(np.diff(corner, prepend=corner[0]) != 0) * (none + 1)
        least = np.minimum.accumulate(np.where(is_a, none, place) - below) + below
        hit = is_a & (least < none)
        hit[hit] = values[least[hit]] + yy[hit] <= m
        met = np.unique(corner[hit])
        links.append((rep[find(met)[0]], rep[find(met + side + sy)[0]]))
    a, b = (np.concatenate(v) for v in zip(*links, strict=True))
    both = named[a] & named[b]
    return _roots(n, a[both], b[both])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the nodes that the links a, b connect with each of n nodes."""
    root = np.arange(n)
    while True:
        u, v = root[a], root[b]
        apart = u != v
        if not apart.any():
            return root
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]


def _grid_links(b: DataFrame, page: list[str], m: float) -> DataFrame:
    """Links between the boxes of `b` (page, id, x0, y0, x1, y1, none wide), where a tile of cells may hold any number."""
    keep = [*page, "cx", "cy"]
    for lo, hi, cell in (("x0", "x1", "cx"), ("y0", "y1", "cy")):
        b = b.withColumn(cell, F.explode(F.sequence(F.floor(F.col(lo) / m), F.floor(F.col(hi) / m))))
    b = cut_lineage(b)  # read by several steps below
    cells = cut_lineage(b.groupBy(*keep).agg(
        F.min("id").alias("rep"), F.max("x1").alias("x1"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.min("y0").alias("y0")))
    reps = cells.select(*keep, "rep")
    links = [b.join(reps, keep).filter("id <> rep").select(*page, F.col("rep").alias("a"), F.col("id").alias("b"))]
    for dx, dy, edge, other in ((1, 0, "x1", "x0"), (0, 1, "y1", "y0")):
        there = cells.select(*page, (F.col("cx") - dx).alias("cx"), (F.col("cy") - dy).alias("cy"), F.col(other).alias("__e"), F.col("rep").alias("b"))
        met = cells.join(there, keep).filter(F.col("__e") - F.col(edge) <= m)
        links.append(met.select(*page, F.col("rep").alias("a"), "b"))
    # Corner to corner only the cell a box ends in matters: a box that goes on is met beside or below.
    ends = {c: F.floor(F.col(c) / m) == F.col("c" + c[0]) for c in ("x0", "x1", "y0", "y1")}
    for sy in (1, -1):
        near_y, far_y = ("y1", "y0") if sy == 1 else ("y0", "y1")
        # a lies left of the corner, b right of it; all four values shrink towards the corner
        left = b.filter(ends["x1"] & ends[near_y]).select(
            *keep, (F.lit(m) + F.col("x1")).alias("at"), F.lit(1).alias("kind"), "id", (-sy * F.col(near_y)).alias("yy"))
        right = b.filter(ends["x0"] & ends[far_y]).select(
            *page, (F.col("cx") - 1).alias("cx"), (F.col("cy") - sy).alias("cy"), F.col("x0").alias("at"), F.lit(0).alias("kind"), "id", (sy * F.col(far_y)).alias("yy"))
        o = Ordered.of(left.unionByName(right), keep, ["at", "kind", "id"])
        o = o.add(mate=running_min(F.when(F.col("kind") == 0, F.col("yy"))))
        hit = o.filter((F.col("kind") == 1) & (F.col("mate") + F.col("yy") <= m)).done().select(*keep).distinct()
        there = reps.select(*page, (F.col("cx") - 1).alias("cx"), (F.col("cy") - sy).alias("cy"), F.col("rep").alias("b"))
        links.append(hit.join(reps, keep).join(there, keep).select(*page, F.col("rep").alias("a"), "b"))
    return reduce(lambda p, q: p.unionByName(q), links)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): connected nodes share the least node as root.  Rounds grow with the logarithm of the size.

    Each round ties every node to the least of its neighbours, first among the larger ones, then among the
    smaller; rounds are written to the shared folder, so a lost executor does not replay them.
    """
    def digest(e):
        return e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = cut_lineage(e)
    seen = digest(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(down.select("u", F.col("m").alias("v"))).select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e = cut_lineage(small)
        now = digest(e)
        if now == seen:
            break
        seen = now
    tree = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tree.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def connected_frames(rects: DataFrame, page: list[str], id_: str, box: list[str], m: float = 4.0, least: int = 4, min_w: float = 40.0, min_h: float = 10.0) -> DataFrame:
    """Frames drawn by rules that nearly touch: envelopes of at least `least` of them, not too small."""
    x, y, w, h = box
    rects = cut_lineage(rects.select(*page, id_, *box))  # read by several steps below
    links = _links(_boxes(rects, page, id_, *box), page, m)
    comp = components(links.select("a", "b"), "a", "b")
    rows = rects.join(comp.withColumnRenamed("node", id_), id_)
    frames = rows.groupBy(*page, "root").agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("x"), F.min(y).alias("y"), (F.max(F.col(x) + F.col(w)) - F.min(x)).alias("w"),
        (F.max(F.col(y) + F.col(h)) - F.min(y)).alias("h"))
    return frames.filter((F.col("n") >= least) & (F.col("w") >= min_w) & (F.col("h") >= min_h))
