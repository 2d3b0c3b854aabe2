"""Merkle manifest of a table: a tree of SHA-256 digests per source and one over the sources, with a proof for every row.

Digests are lowercase hex text; H is the SHA-256 of its inputs' concatenation. A tree's nodes are numbered from 0. At every
level, node i stands in slot i % FAN of run i div FAN; a run's slot-zero node finds its siblings by equal joins on the
computed indices i + 1 .. i + FAN - 1 and emits the parent, H of the run in slot order. A run may be short, even one node;
only a tree of a single node is finished, its node being the tree's root.

Every level is a stored table of runs, a FAN-th of the rows of the level below. Proofs flow down the same tables: a run
knows what lies before and after its parent at every level above, so a leaf meets its whole path in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.store import numbered, staged
from lexweave.scale import bounded_broadcast

FAN = 16
TAMPER = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """H of texts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it goes into a leaf: `-` if null, else its UTF-8 byte count, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return digest(*[field(c) for c in columns])


def tree_key(source: Column) -> Column:
    """Sources as non-null keys in the same order: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def in_trees(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """rows with `idx`, their number in their `tree` by `order`; a large tree lies in many ranges and is never one task."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    held = numbered(ranged, "place", label)
    # A tree begins at its least place. Pairs of tree and piece of the order are few and are sent to the rows; where they are
    # too many for that, a large tree still is as many keys as it has pieces.
    piece = F.floor(F.col("place") / F.lit(1 << 12)).alias("piece")
    begins = held.groupBy("tree").agg(F.min("place").alias("begin"))
    pairs = bounded_broadcast(held.select("tree", piece).distinct().join(begins, "tree"), 1_000_000)
    return held.withColumn("piece", piece).join(pairs, ["tree", "piece"]).withColumn("idx", F.col("place") - F.col("begin")).drop("piece", "place", "begin")


def runs(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """(tree, up, run, h, whole) of nodes (tree, idx, h): every run in slot order and its parent.

    `whole` marks the run of a tree that has one node; its h is that node itself.
    """
    anchors = nodes.filter(F.col("idx") % fan == 0).select("tree", "idx", "h")
    wanted = anchors.select("tree", F.col("idx").alias("first"), F.explode(F.sequence(F.lit(1), F.lit(fan - 1))).alias("slot"))
    met = wanted.withColumn("idx", F.col("first") + F.col("slot")).join(nodes.select("tree", "idx", "h"), ["tree", "idx"])
    both = (met.select("tree", "first", F.struct("slot", "h").alias("node"))
            .unionAll(anchors.select("tree", F.col("idx").alias("first"), F.struct(F.lit(0).alias("slot"), "h").alias("node"))))
    run = both.groupBy("tree", "first").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    whole = (F.col("first") == 0) & (F.size("nodes") == 1)
    held = run.select("tree", F.expr(f"first div {fan}").alias("up"), F.col("nodes.h").alias("run"), whole.alias("whole"))
    return held.withColumn("h", F.when(F.col("whole"), F.get("run", F.lit(0))).otherwise(F.sha2(F.array_join("run", ""), 256)))


def levels(nodes: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """The stored run tables from the leaves upward, until every tree has one node."""
    out = []
    while True:
        level = staged(runs(nodes, fan), "runs")
        out.append(level)
        nodes = level.filter(~F.col("whole")).select("tree", F.col("up").alias("idx"), "h")
        if nodes.isEmpty():
            return out


def roots(tables: list[DataFrame]) -> DataFrame:
    """(tree, h) of all trees."""
    ends = [t.filter("whole").select("tree", "h") for t in tables]
    out = ends[0]
    for end in ends[1:]:
        out = out.unionAll(end)
    return out


def _step(run: Column, slot: Column, whole: Column) -> Column:
    """What stands before and after a slot of a run; nothing where the node is its tree's root."""
    beside = F.struct(F.array_join(F.slice(run, F.lit(1), slot), "").alias("before"),
                      F.array_join(F.slice(run, slot + 2, F.greatest(F.size(run) - slot - 1, F.lit(0))), "").alias("after"))
    return F.when(whole, F.array().cast("array<struct<before:string,after:string>>")).otherwise(F.array(beside))


def with_paths(nodes: DataFrame, tables: list[DataFrame], above: DataFrame, fan: int = FAN) -> DataFrame:
    """nodes (tree, idx, ...) with `path` (before and after of every level, upward) and the columns of `above`.

    `above` has a row per tree: its own `path`, appended to those of its nodes, and columns to hand down. It meets the tables
    at the trees' roots, where every tree has one row.
    """
    kept = [c for c in above.columns if c not in ("tree", "path")]
    known = None
    for level in reversed(tables):
        at_root = level.filter("whole").join(above, "tree").select("tree", "up", "run", "whole", "path", *kept)
        inner = level.filter(~F.col("whole"))
        if known is None:
            known = at_root
            continue
        slot = F.col("up") % fan
        met = (inner.withColumn("over", F.expr(f"up div {fan}")).alias("n")
               .join(known.select("tree", F.col("up").alias("over"), F.col("run").alias("over_run"), F.col("whole").alias("over_whole"), "path", *kept).alias("p"), ["tree", "over"]))
        path = F.concat(_step(F.col("over_run"), slot.cast("int"), F.col("over_whole")), F.col("path"))
        known = staged(at_root.unionByName(met.select("tree", "up", "run", "whole", path.alias("path"), *kept)), "paths")
    slot = (F.col("idx") % fan).cast("int")
    met = nodes.withColumn("up", F.expr(f"idx div {fan}")).join(known, ["tree", "up"])
    path = F.concat(_step(F.col("run"), slot, F.col("whole")), F.col("path"))
    return met.select(*[F.col(c) for c in nodes.columns], path.alias("path"), *kept)


def siblings(path: Column) -> Column:
    """The siblings of all levels, left to right, upward."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             fan: int = FAN) -> DataFrame:
    """doc_id, source, leaf, tampered (leaf of the changed row), idx, subroot, root, path: one row per row of docs.

    `columns` go into the leaf in that order. Leaves of a source ascend by id (null first); rows of one id by their digest,
    so equal rows stand side by side and each has its own place. A null source is a tree of its own, the first. The changed
    row of `tampered` has A-Z of the text lowered; it differs from the row where TAMPER divides CRC-32 of the decimal id
    (never for a null id). Other columns are not looked at. An empty table gives an empty one.
    """
    text = F.col(f"`{text_col}`").cast("string")
    named = [F.col(f"`{c}`") for c in columns]
    lowered = [F.translate(text, UPPER, LOWER) if c == text_col else F.col(f"`{c}`") for c in columns]
    id_ = F.col(f"`{id_col}`")
    plain = leaf(named)
    hit = F.coalesce(F.crc32(id_.cast("string")) % TAMPER == 0, F.lit(False))
    rows = docs.select(id_.cast("long").alias("doc_id"), tree_key(F.col(f"`{source_col}`")).alias("tree"), plain.alias("h"),
                       F.when(hit, leaf(lowered)).alias("changed"))
    leaves = staged(in_trees(rows, ["doc_id", "h"], "leaves"), "leaves")
    tables = levels(leaves.select("tree", "idx", "h"), fan)
    # The trees' roots are the leaves of one more tree.
    tops = roots(tables).select(F.lit("root").alias("tree"), F.col("tree").alias("of"), "h")
    subroots = staged(in_trees(tops, ["of"], "subroots"), "subroots")
    upper = levels(subroots.select("tree", "idx", "h"), fan)
    root = roots(upper).select("tree", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("h").alias("root"))
    above = with_paths(subroots, upper, root, fan).select(F.col("of").alias("tree"), "path", F.col("h").alias("subroot"), "root")
    out = with_paths(leaves, tables, staged(above, "above"), fan)
    return out.select("doc_id", F.col("h").alias("leaf"), F.coalesce("changed", "h").alias("tampered"), "idx", "subroot", "root", "path")


def verified(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of a manifest."""
    fold = folded(F.col("tampered"), F.col("path"))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
