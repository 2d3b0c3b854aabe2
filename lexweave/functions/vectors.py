"""Vector column functions and batched top-k over vectors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.scale import cut, top_k

# Vectors in a query block and in an item pack; bytes of query blocks that may be broadcast; results a task holds.
BLOCK_QUERIES, PACK_ITEMS = 1000, 8192
BROADCAST_BYTES = 64 * 1024 * 1024
MAX_HELD = 5_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for missing, empty or zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))),
                       F.lit(0.0), lambda acc, x: acc + x)


def centroid(df: DataFrame, key: str, vector: str, out: str) -> DataFrame:
    """Mean vector per key, summed map-side per (key, position)."""
    return (
        df.select(key, F.posexplode(vector).alias("_p", "_x"))
        .groupBy(key, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
        .groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias(out))
    )


def _packed(df: DataFrame, key: str, size: int) -> DataFrame:
    """Vectors of (key, embedding) as rows of at most `size` vectors: ids, dim, data. Nothing is shuffled.

    Missing and empty vectors are left out; vectors of different widths are an error.
    """
    kind = df.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = pc.fill_null(pc.list_value_length(batch["embedding"]), 0)
            held = batch.filter(pc.greater(width, 0))
            for at in range(0, held.num_rows, size):
                part = held.slice(at, size)
                dims = set(pc.list_value_length(part["embedding"]).to_pylist())
                if len(dims) > 1:
                    raise ValueError(f"vectors of different widths: {sorted(dims)}")
                data = part["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part["key"].to_pylist()], pa.list_(part["key"].type)), pa.array([dims.pop()], pa.int32()), pa.array([data], pa.binary())],
                                                 ["ids", "dim", "data"])

    return df.select(F.col(key).alias("key"), "embedding").mapInArrow(pack, f"ids array<{kind}>, dim int, data binary")


def _costs(queries: np.ndarray, items: np.ndarray, metric: str, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query the places and rounded costs of all items that can be among its best k, ties included."""
    dots = queries @ items.T
    squares = (items * items).sum(axis=1)
    if metric == "cosine":
        den = np.outer(np.sqrt((queries * queries).sum(axis=1)), np.sqrt(squares))
        near = -np.round(np.divide(dots, den, out=np.zeros_like(den), where=den > 0), 6)
    else:
        near = squares[None, :] + (queries * queries).sum(axis=1)[:, None] - 2 * dots
    for q in range(len(queries)):
        row = near[q]
        # The expanded square is only used to leave out what is farther than rounding can bridge.
        bound = np.partition(row, k - 1)[k - 1] + 1e-5 if k < len(row) else np.inf
        at = np.flatnonzero(row <= bound)
        if metric == "cosine":
            at = at[row[at] < 0]
            yield at, row[at]
        else:
            yield at, np.round(((items[at] - queries[q]) ** 2).sum(axis=1), 6)


def _best(k: int, metric: str, text_ids: bool):
    """Best k items per query and task, from rows that pair a block of queries with a pack of items."""
    named: dict = {}  # a query id that is a struct arrives as a dict; its items stand for it

    def flush(best: dict, schema: pa.Schema) -> pa.RecordBatch:
        rows = [(named[q], i, -c if metric == "cosine" else c) for q, found in best.items() for c, i in found]
        kinds = [schema.field("q_ids").type.value_type, schema.field("ids").type.value_type, pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["query_id", "item_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        out = None
        named.clear()
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch[c][r].as_py() for c in batch.schema.names}
                if row["q_dim"] != row["dim"]:
                    raise ValueError(f"queries have {row['q_dim']} places, items {row['dim']}")
                block = np.frombuffer(row["q_data"]).reshape(-1, row["q_dim"])
                pack = np.frombuffer(row["data"]).reshape(-1, row["dim"])
                ids = np.array(row["ids"], dtype=object if text_ids else None)
                for q, (at, cost) in zip(row["q_ids"], _costs(block, pack, metric, k)):
                    name = tuple(q.items()) if isinstance(q, dict) else q
                    named[name] = q
                    merged = best.get(name, []) + list(zip(cost.tolist(), ids[at].tolist()))
                    best[name] = heapq.nsmallest(k, merged)
            out = batch.schema
            if len(best) * k > MAX_HELD:
                yield flush(best, out)
                best = {}
        if best:
            yield flush(best, out)
    return run


def vector_topk(queries: DataFrame, items: DataFrame, k: int, metric: str = "l2", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact nearest items: (query_id, item_id, score, rank).

    queries(query_id, embedding), items(item_id, embedding). metric "l2" ranks by ascending squared
    distance; "cosine" ranks descending and keeps only positive similarities. Scores are rounded to
    6 digits before ranking, ties go to the smaller id. Queries are packed into blocks and items into
    packs where they lie; one scan of the items meets all blocks, and a task emits at most k rows per
    query it has seen. The blocks are broadcast only if their bytes are within `broadcast_bytes`.
    """
    qtype = queries.schema["query_id"].dataType.simpleString()
    itype = items.schema["item_id"].dataType.simpleString()
    blocks = cut(_packed(queries.select("query_id", "embedding"), "query_id", BLOCK_QUERIES)
                 .select(F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("data").alias("q_data")))
    held = blocks.agg(F.coalesce(F.sum(F.octet_length("q_data") + 64 * F.size("q_ids")), F.lit(0))).first()[0]
    packs = _packed(items.select("item_id", "embedding"), "item_id", PACK_ITEMS)
    met = packs.crossJoin(F.broadcast(blocks) if held <= broadcast_bytes else blocks)
    found = met.mapInArrow(_best(k, metric, itype == "string"), f"query_id {qtype}, item_id {itype}, score double")
    order = F.col("score").desc() if metric == "cosine" else F.col("score").asc()
    return top_k(found, ["query_id"], [order, F.col("item_id").asc()], k)
