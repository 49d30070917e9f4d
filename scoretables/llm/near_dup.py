"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct k-word shingles.  Its sketch has one register per hash function: the least hash of
the set, read as a truncated exponential value on an exponentially spaced scale, so sketches of parts merge by maximum.
Groups of registers (bands) are hashed; documents that share a band meet, their similarity is estimated from both
sketches by likelihood, and what may reach the threshold is confirmed on the full sets.

Within a band bucket no all-pairs list is made.  Every member meets two heads of its bucket.  Once those links have
joined components, only buckets that still hold several components go on: small ones with their pairs between
components, large ones as families (buckets that share members).  A family is cut into chunks, and two chunks at a time
are compared in one task: only pairs between components, by estimate and then in full, and only links come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import U64, binary, mix, pieces, shingle_sets, small_batches, stream, table
from .oracles import NEAR_DUPLICATES
from .registry import query

ROWS, BANDS = 4, 40
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Buckets up to this size are settled by their pairs between components; larger ones as families.
SMALL = 64
#: Documents of a family's chunk.
CHUNK = 512
#: Standard errors that the estimate may lie below the threshold before a pair is left out.
SLACK = 6.0

_A = (stream(101, REGISTERS) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (stream(102, REGISTERS) >> U64(32)).astype(np.uint32)


def least(shingles: np.ndarray) -> np.ndarray:
    """Least value of each hash function over a set of 64-bit values."""
    x = (shingles >> U64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 2048):
        np.minimum(out, (_A[:, None] * x[None, a : a + 2048] + _B[:, None]).min(axis=1), out=out)
    return out


def registers(low: np.ndarray) -> np.ndarray:
    """Least hashes as register values."""
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / math.log(BASE)) + TOP / 2, 0, TOP + 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely similarity of each row's two sketches, given the set sizes."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    grid = np.linspace(0.0, 1.0, 101)[None, :] * np.minimum(u / v, v / u)[:, None]

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    p_up, p_down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    score = up[:, None] * np.log(p_up + tiny) + down[:, None] * np.log(p_down + tiny) + same[:, None] * np.log(np.maximum(1 - p_up - p_down, 0) + tiny)
    return grid[np.arange(len(grid)), score.argmax(axis=1)]


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Bucket key of each band of each sketch."""
    r = regs.reshape(len(regs), BANDS, ROWS).astype(U64)
    packed = r[:, :, 0] | r[:, :, 1] << U64(16) | r[:, :, 2] << U64(32) | r[:, :, 3] << U64(48)
    return mix(mix(packed) ^ stream(200, BANDS)[None, :]).view(np.int64)


def least_likely(percent: int) -> float:
    """Estimates under this are taken to be under the threshold."""
    t = percent / 100
    return t - SLACK * math.sqrt(t * (1 - t) / REGISTERS)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """(id, h1, h2, n_shingles, regs) for each row; h1 and h2 tell sets apart, empty sets have n_shingles 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            sets = shingle_sets(part.column("text"), k)
            regs = registers(np.stack([least(s) for s in sets]))
            sums = [np.array([mix(s ^ U64(seed)).sum(dtype=U64) for s in sets], U64).view(np.int64) for seed in (7, 1 << 40)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(sums[0]), pa.array(sums[1]), pa.array([len(s) for s in sets], pa.int64()), binary(regs)],
                ["id", "h1", "h2", "n_shingles", "regs"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, h1 bigint, h2 bigint, n_shingles bigint, regs binary")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _buckets(reps: DataFrame) -> DataFrame:
    """(key, id) of each set in each band."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = band_keys(_matrix(b.column("regs")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column("id").to_numpy(), BANDS))], ["key", "id"])

    return reps.select("id", "regs").mapInArrow(run, "key bigint, id bigint")


def _confirm(pairs: DataFrame, sk: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: by likelihood first, then by count."""

    def likely(batches):
        for b in batches:
            if not b.num_rows:
                continue
            j = estimate(_matrix(b.column("ra")), _matrix(b.column("rb")), b.column("na").to_numpy().astype(float), b.column("nb").to_numpy().astype(float))
            yield b.select(["a", "b"]).filter(pa.array(j >= least_likely(percent)))

    def linked(batches):
        for b in batches:
            for part in pieces([b], "ta"):
                x, y = shingle_sets(part.column("ta"), k), shingle_sets(part.column("tb"), k)
                met = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)])
                whole = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)]) - met
                yield part.select(["a", "b"]).filter(pa.array((whole > 0) & (100 * met >= percent * whole)))

    side = [sk.select(F.col("id").alias(c), F.col("n_shingles").alias("n" + c), F.col("regs").alias("r" + c)) for c in "ab"]
    maybe = pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(likely, "a bigint, b bigint")
    side = [texts.select(F.col("id").alias(c), F.col("text").alias("t" + c)) for c in "ab"]
    return maybe.distinct().join(side[1], "b").join(side[0], "a").select("a", "b", "ta", "tb").mapInArrow(linked, "a bigint, b bigint")


def linked(pairs: DataFrame) -> DataFrame:
    """(node, root) of each node of the pairs (a, b): the least node that chains of pairs lead to.

    Each round points every node to its least neighbour or itself and goes on with the pairs of what is pointed to;
    their number falls from round to round, and for stars it is nothing after two.  Rounds are written to the shared
    folder, so that a lost executor doesn't replay them.
    """
    e = cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    steps = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
        steps.append(low)
        x, y = (low.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in "ab")
        e = e.join(x, "a").join(y, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a < b").distinct()
        e = cut_lineage(e)
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for n, low in enumerate(reversed(steps)):
        further = out.select(F.col("node").alias("root"), F.col("root").alias("end"))
        out = low.join(further, "root", "left").select("node", F.coalesce("end", "root").alias("root")) if n else low
    return out


def _families(family: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between components (comp) of the same family; family: (id, family, comp).

    Enough links come out to join what belongs together: once two components have met in a task, their other pairs
    are left out there.
    """
    size = family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("id", F.lit(9)), F.col("chunks")).cast("int")
    rows = cut_lineage(family.join(size, "family").withColumn("mine", mine))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    met = met.join(reps, "id").join(texts, "id").select("family", "lo", "hi", "mine", "id", "comp", "n_shingles", "regs", "text")

    def compare(group: pa.Table) -> pa.Table:
        lo, mine = group.column("lo")[0].as_py(), group.column("mine").to_numpy()
        same = lo == group.column("hi")[0].as_py()
        ids, comp, n = (group.column(c).to_numpy() for c in ("id", "comp", "n_shingles"))
        regs, text, sets = _matrix(group.column("regs")), group.column("text"), {}

        def own(i):
            if i not in sets:
                sets[i] = shingle_sets(text.slice(i, 1).combine_chunks(), k)[0]
            return sets[i]

        joined: dict[int, int] = {}

        def root(c):
            while (up := joined.get(c, c)) != c:
                c = up
            return c

        out = []
        right = np.arange(len(ids)) if same else np.flatnonzero(mine != lo)
        for i in np.flatnonzero(mine == lo).tolist():
            to = right[(comp[right] != comp[i]) & ((right > i) if same else True)]
            to = to[100 * np.minimum(n[to], n[i]) >= percent * np.maximum(n[to], n[i])]
            if not len(to):
                continue
            to = to[(regs[to] == regs[i]).sum(axis=1) >= (least_likely(percent) - 0.05) * REGISTERS]
            to = to[estimate(np.broadcast_to(regs[i], (len(to), REGISTERS)), regs[to], np.full(len(to), float(n[i])), n[to].astype(float)) >= least_likely(percent)] if len(to) else to
            for j in to.tolist():
                p, q = root(comp[i]), root(comp[j])
                if p != q:
                    both = len(np.intersect1d(own(i), own(j), assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        joined[max(p, q)] = min(p, q)
                        out.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return met.groupBy("family", "lo", "hi").applyInArrow(compare, "a bigint, b bigint")


def links(docs: DataFrame, sk: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(node, root): sets linked by chains of pairs at or over the threshold, named by their least document."""
    reps = sk.filter("n_shingles > 0 AND id IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct("id", "n_shingles", "regs")).alias("m"))
    reps = cut_lineage(reps.select("m.id", "m.n_shingles", "m.regs"))
    lot = F.struct(F.xxhash64("id").alias("lot"), "id")
    heads = _buckets(reps).groupBy("key").agg(F.min(lot).alias("p"), F.max(lot).alias("q"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    heads = heads.select("key", F.col("p.id").alias("head"), F.col("q.id").alias("tail"), "n")
    met = cut_lineage(_buckets(reps).join(heads, "key"))
    want = met.select("id").distinct()
    texts = cut_lineage(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).join(want, "id", "left_semi"))
    star = met.select("id", F.explode(F.array("head", "tail")).alias("to")).filter("id <> to")
    star = star.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()
    found = cut_lineage(_confirm(star, reps, texts, k, percent))

    tree = cut_lineage(linked(found).withColumnRenamed("node", "id"))
    live = met.join(tree, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = live.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    live = cut_lineage(live.join(open_, "key", "left_semi"))
    many = live.filter(F.col("n") > SMALL)
    more = []
    if not many.isEmpty():
        family = linked(many.select(F.col("head").alias("a"), F.col("id").alias("b"))).select(F.col("node").alias("id"), F.col("root").alias("family"))
        family = cut_lineage(family.join(many.select("id", F.col("root").alias("comp")).distinct(), "id"))
        more.append(_families(family, reps, texts, k, percent))
        live = live.join(family.select("id", "family"), "id", "left")
    else:
        live = live.withColumn("family", F.lit(None).cast("bigint"))
    few = live.filter((F.col("n") <= SMALL) & (F.col("id") != F.col("head")) & (F.col("id") != F.col("tail")))
    x, y = (few.select("key", F.col("id").alias(c), F.col("root").alias("r" + c), F.col("family").alias("f" + c)) for c in "ab")
    cross = x.join(y, "key").filter("a < b AND ra <> rb AND NOT coalesce(fa = fb, false)").select("a", "b").distinct()
    more.append(_confirm(cross, reps, texts, k, percent))
    # what was found joins the components known so far
    all_links = tree.select(F.col("id").alias("a"), F.col("root").alias("b"))
    for m in more:
        all_links = all_links.unionByName(m)
    return linked(all_links)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Words are lower-cased (A-Z) and parted by white space.  A text with fewer than k words has its whole sequence as
    one shingle; one without words is linked with nothing and kept.  Equal sets always share a component.  Rows that
    repeat a doc_id count as one document, linked where any of their texts is.  A null doc_id is linked with nothing,
    has a null component_id and is kept.  Other columns of docs don't matter.  An empty table gives no rows.
    """
    docs = small_batches(docs)
    sk = cut_lineage(sketches(docs, doc_id, text, k))
    tree = links(docs, sk, doc_id, text, k, percent)
    known = sk.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = known.groupBy("h1", "h2").agg(F.min("id").alias("node")).join(tree, "node", "left")
    classes = classes.select("h1", "h2", F.coalesce("root", "node").alias("root"))
    rows = known.select("id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "n_shingles", F.col("root").alias("component_id"))
    alone = sk.filter("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = rows.unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


@query("op9_near_duplicates", NEAR_DUPLICATES)
def op9(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))
