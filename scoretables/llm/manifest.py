"""Merkle manifest of a dataset: a digest for each row, trees over the rows of each part, and a proof for every row.

Rows are numbered within their part over range partitions, so no part is sorted in one task.  A level of a tree is a
table of nodes (part, idx, h).  Each level is an equi-join of the nodes with themselves: the first node of a run asks
for its siblings by their computed indices (idx XOR offset where the fan-out is a power of two, idx plus offset
otherwise) and emits the parent.  The parts' last nodes are the leaves of one more tree, whose last node is the root.

Proofs come down the same way: a run hands its children's digests, and those of all runs above, to the runs of its
children, by an equi-join on the child's index.  So no key is hotter than the fan-out, and a part may hold any share of
the rows.  Levels are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table
from .registry import query

FANOUT = 8
PART, TOP = "part", "top"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def encoded(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def lowered(text: Column) -> Column:
    """text with A-Z in lower case and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `idx`: their place in their part, from 0, in the given order (nulls first).

    Rows are dealt by ranges of part and order and sorted there; the counts of the ranges before (one row for each part
    and range) give a range its start.  Rows equal in all of it are dealt by their place in the input.
    """
    tied = rows.withColumn("__tie", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)))
    dealt = tied.repartitionByRange(PART, *order, "__tie").sortWithinPartitions(PART, *order, "__tie")
    dealt = cut_lineage(dealt.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    counts = dealt.groupBy(PART, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(PART).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    out = dealt.join(counts.select(PART, "__range", shift.alias("__shift")), [PART, "__range"])
    return out.withColumn("idx", F.col("__at") + F.col("__shift")).drop("__tie", "__range", "__at", "__shift")


def sibling(idx: Column, offset: Column, fanout: int) -> Column:
    """Index of a sibling of the first node of a run."""
    return idx.bitwiseXOR(offset) if fanout & (fanout - 1) == 0 else idx + offset


def runs_of(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(part, idx, hs): the runs of up to `fanout` nodes, numbered as their parents, with the digests in order."""
    heads = nodes.filter(F.col("idx") % fanout == 0)
    offsets = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(fanout - 1).cast("bigint")))
    asked = heads.select(PART, F.col("idx").alias("__head"), offsets.alias("__offset"))
    asked = asked.select(PART, "__head", sibling(F.col("__head"), F.col("__offset"), fanout).alias("idx"))
    met = asked.join(nodes, [PART, "idx"]).select(PART, "__head", "idx", "h")
    whole = met.unionByName(heads.select(PART, F.col("idx").alias("__head"), "idx", "h"))
    # at most `fanout` digests
    whole = whole.groupBy(PART, "__head").agg(F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("__run"))
    return whole.select(PART, F.expr(f"__head div {fanout}").alias("idx"), F.col("__run.h").alias("hs"))


def open_parts(nodes: DataFrame) -> DataFrame:
    """The parts with more than one node: those that have a node 1."""
    return nodes.filter("idx = 1").select(PART)


def grow(leaves: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level, lowest first, and (part, h, level): the last node of each part and the level it is on."""
    nodes, levels, ends = leaves.select(PART, "idx", "h"), [], []
    while True:
        many, first = open_parts(nodes), nodes.filter("idx = 0")
        ends.append(first.join(many, PART, "left_anti").select(PART, "h", F.lit(len(levels)).alias("level")))
        if many.isEmpty():
            break
        # only the first nodes may be all of a part, so only they are looked up by part
        live = nodes.filter("idx > 0").unionByName(first.join(many, PART, "left_semi"))
        runs = cut_lineage(runs_of(live, fanout))
        levels.append(runs)
        nodes = runs.select(PART, "idx", F.sha2(F.array_join("hs", ""), 256).alias("h"))
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return levels, cut_lineage(out)


STEP = "array<struct<hs:array<string>,slot:int>>"


def paths(levels: list[DataFrame], ends: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """For each level (part, idx, path): what a child of run idx meets on its way up, without its own place in that run.

    ends: (part, level, above): the path from the part's last node on, which levels up to that node hand down.
    path: the run's digests and those of the runs above with the place taken in them.
    """
    out: list[DataFrame] = []
    above = None
    for k in reversed(range(len(levels))):
        last = ends.filter(F.col("level") == k + 1).select(PART, F.lit(0).cast("bigint").alias("idx"), "above")
        from_above = last
        if above is not None:
            parents = above.select(PART, F.col("idx").alias("__parent"), "path")
            inner = levels[k].select(PART, "idx", F.expr(f"idx div {fanout}").alias("__parent")).join(parents, [PART, "__parent"])
            placed = _placed(F.col("path"), (F.col("idx") % fanout).cast("int"))
            from_above = inner.select(PART, "idx", placed.alias("above")).unionByName(last)
        path = F.concat(F.array(F.struct("hs", F.lit(None).cast("int").alias("slot"))), F.col("above")).cast(STEP)
        above = levels[k].join(from_above, [PART, "idx"]).select(PART, "idx", path.alias("path"))
        out.insert(0, above)
    return out


def _placed(path: Column, slot: Column) -> Column:
    """path with the place taken in its first run."""
    first = F.get(path, F.lit(0))
    return F.concat(F.array(F.struct(first["hs"].alias("hs"), slot.alias("slot"))), F.slice(path, 2, F.size(path))).cast(STEP)


def siblings(step: Column) -> Column:
    """The digests of a run without the own one, one after another."""
    return F.array_join(F.filter(step["hs"], lambda h, i: i != step["slot"]), "")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf leads to beside the given siblings."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.array_join(F.transform(s["hs"], lambda x, i: F.when(i == s["slot"], h).otherwise(x)), ""), 256))


def manifest(docs: DataFrame, doc_id: str = "doc_id", part: str = "lang", columns: list[str] | None = None, text: str = "text", fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, tampered) for each row of docs.

    leaf: digest of the given columns; tampered: that of the row with A-Z of its text in lower case.  path: the runs a
    leaf meets up to the root, each with its digests and the leaf's place.  A part's leaves ascend by doc_id (null first)
    and, for equal ids, by their digest; equal rows have equal digests, so their order doesn't matter.  A null part is a
    part of its own, before all others; texts of any size enter by their digest alone; other columns don't matter.  An
    empty table gives no rows, a single row is its own root.
    """
    columns = columns or COLUMNS
    values = [F.col(c) for c in columns]
    changed = [lowered(F.col(c).cast("string")) if c == text else F.col(c) for c in columns]
    # parts as texts that sort null first and otherwise by their bytes
    key = F.coalesce(F.concat(F.lit("1"), F.col(part).cast("string")), F.lit("0"))
    rows = docs.select(key.alias(PART), F.col(doc_id).cast("bigint").alias("doc_id"), digest(values).alias("h"), digest(changed).alias("tampered"))
    # written before ranges are taken, which reads them twice
    leaves = cut_lineage(numbered(cut_lineage(rows), ["doc_id", "h"]))
    levels, ends = grow(leaves, fanout)

    # the last nodes of the parts are the leaves of one more tree
    tops = numbered(ends.select(F.lit(TOP).alias(PART), F.col(PART).alias("of"), F.col("h")), ["of"])
    tops = cut_lineage(tops)
    top_levels, top_end = grow(tops, fanout)
    top_ends = top_end.select(PART, "level", F.array().cast(STEP).alias("above"))
    if top_levels:
        over = paths(top_levels, top_ends, fanout)[0].select(F.col("idx").alias("__run"), "path")
        tops = tops.withColumn("__run", F.expr(f"idx div {fanout}")).join(over, "__run")
        tops = tops.withColumn("above", _placed(F.col("path"), (F.col("idx") % fanout).cast("int")))
    else:
        tops = tops.withColumn("above", F.array().cast(STEP))
    tops = tops.select(F.col("of").alias(PART), "above")
    root = top_end.select("h").scalar()

    # subroots come down with the paths, so that no leaf is joined by its part
    sub = cut_lineage(ends.join(tops, PART))
    alone = sub.filter("level = 0").select(PART, F.lit(0).cast("bigint").alias("idx"), "above")
    if levels:
        runs = paths(levels, sub, fanout)[0].select(PART, F.col("idx").alias("__run"), "path")
        placed = leaves.withColumn("__run", F.expr(f"idx div {fanout}")).join(runs, [PART, "__run"])
        placed = placed.withColumn("path", _placed(F.col("path"), (F.col("idx") % fanout).cast("int")))
        placed = placed.select(PART, "doc_id", "h", "tampered", "path")
    else:
        placed = leaves.filter(F.lit(False)).select(PART, "doc_id", "h", "tampered", F.array().cast(STEP).alias("path"))
    lone = leaves.join(alone, [PART, "idx"]).select(PART, "doc_id", "h", "tampered", F.col("above").alias("path"))
    out = placed.unionByName(lone)
    if top_levels:
        step = F.get("path", F.size("path") - len(top_levels))
        subroot = F.get(step["hs"], step["slot"])
    else:
        subroot = root
    return out.select("doc_id", F.col("h").alias("leaf"), "tampered", subroot.alias("subroot"), root.alias("root"), "path")


SQL = """WITH RECURSIVE d AS (SELECT doc_id, lang, sha256(E(doc_id) || E(source) || E(lang) || E(n_chars) || E(text)) AS leaf,
  sha256(E(doc_id) || E(source) || E(lang) || E(n_chars) || E(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
nodes(lang, k, i, h, c) AS (SELECT lang, 0, i, leaf, count(*) OVER (PARTITION BY lang) FROM l UNION ALL
  SELECT lang, k + 1, g, h, count(*) OVER (PARTITION BY lang) FROM (SELECT lang, k, i // 8 AS g, sha256(string_agg(h, '' ORDER BY i)) AS h FROM nodes WHERE c > 1 GROUP BY lang, k, i // 8)),
sub AS (SELECT lang, k AS depth, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM nodes WHERE c = 1),
tops(k, i, h, c) AS (SELECT 0, i, subroot, count(*) OVER () FROM sub UNION ALL
  SELECT k + 1, g, h, count(*) OVER () FROM (SELECT k, i // 8 AS g, sha256(string_agg(h, '' ORDER BY i)) AS h FROM tops WHERE c > 1 GROUP BY k, i // 8)),
runs AS (SELECT lang, k, i // 8 AS g, list(h ORDER BY i) AS hs FROM nodes WHERE c > 1 GROUP BY lang, k, i // 8),
top_runs AS (SELECT k, i // 8 AS g, list(h ORDER BY i) AS hs FROM tops WHERE c > 1 GROUP BY k, i // 8),
low(lang, leaf0, doc_id, start, k, i, cur, proof) AS (SELECT lang, leaf, doc_id, i, 0, i, CASE WHEN CRC(doc_id) % 3 = 0 THEN tampered ELSE leaf END, '' FROM l UNION ALL
  SELECT w.lang, leaf0, doc_id, start, w.k + 1, w.i // 8, sha256(array_to_string(hs[1:w.i % 8], '') || cur || array_to_string(hs[w.i % 8 + 2:], '')),
    proof || array_to_string(hs[1:w.i % 8], '') || array_to_string(hs[w.i % 8 + 2:], '') FROM low w JOIN runs r ON r.lang IS NOT DISTINCT FROM w.lang AND r.k = w.k AND r.g = w.i // 8),
up(lang, leaf0, doc_id, start, k, i, cur, proof) AS (SELECT w.lang, leaf0, doc_id, start, 0, s.i, cur, proof FROM low w JOIN sub s ON s.lang IS NOT DISTINCT FROM w.lang AND s.depth = w.k UNION ALL
  SELECT w.lang, leaf0, doc_id, start, w.k + 1, w.i // 8, sha256(array_to_string(hs[1:w.i % 8], '') || cur || array_to_string(hs[w.i % 8 + 2:], '')),
    proof || array_to_string(hs[1:w.i % 8], '') || array_to_string(hs[w.i % 8 + 2:], '') FROM up w JOIN top_runs r ON r.k = w.k AND r.g = w.i // 8),
root AS (SELECT k AS depth, h AS root FROM tops WHERE c = 1)
SELECT doc_id, leaf0 AS leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM up JOIN root ON up.k = root.depth JOIN sub ON sub.lang IS NOT DISTINCT FROM up.lang"""
#: Macros of the SQL written out: the encoding of a value, and CRC-32 of a number's decimal digits, bit by bit.
_ENCODED = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_CRC = ("xor(4294967295, list_reduce(list_transform(range(0, 8 * strlen({0}::VARCHAR)), lambda j: ((ascii(substr({0}::VARCHAR, (j // 8)::INT + 1, 1)) >> (j % 8)::INT) & 1)::BIGINT), "
        "lambda c, b: xor(c >> 1, ((c & 1) ^ b) * 3988292384), 4294967295::BIGINT))")


def _sql() -> str:
    sql = SQL.replace("CRC(doc_id)", _CRC.replace("((c & 1) ^ b)", "xor(c & 1, b)").format("doc_id"))
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        sql = sql.replace(f"E({name})", _ENCODED.format(name))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return sql.replace(f"E({lower})", _ENCODED.format(lower))


@query("op12_merkle_manifest", _sql())
def op12(spark, folder):
    rows = manifest(table(spark, folder, "documents"))
    start = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.col("tampered")).otherwise(F.col("leaf"))
    proof = F.sha2(F.array_join(F.transform("path", siblings), ""), 256)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(start, F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
