"""Exact nearest vectors by distances to a few pivots: what the triangle inequality rules out is not computed.

`build_pivots` puts every item to its nearest pivot, sorted by the distance to it, in packs of `PACK_ITEMS`. A pack knows the
least and greatest distance of its items to every pivot. A query's distance to a pack lies above the gaps between its own
pivot distances and the pack's, and below their sums; packs that lie beyond the k nearest ones' greatest distance are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.scale import bounded_broadcast, cut, top_k

PIVOTS, PACK_ITEMS, SAMPLE = 16, 256, 64
MAX_QUERIES = 100_000
MARGIN = 1e-5


def choose_pivots(items: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Items that lie far from each other, out of the `pivots` * `sample` ones of the least hash."""
    held = items.select("item_id", "embedding").orderBy(F.xxhash64("item_id"), "item_id").limit(pivots * sample).select("embedding").toArrow()
    if not held.num_rows:
        return np.zeros((0, 0))
    points = np.array(held["embedding"].to_pylist(), float)
    chosen = [0]
    near = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < pivots and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))


def build_pivots(items: DataFrame, path: str, pivots: int = PIVOTS) -> None:
    """Store items(item_id, embedding) below `path` as `packs` and the pivots as `pivots`. All vectors have one width."""
    spark, chosen = items.sparkSession, choose_pivots(items, pivots)
    kind = items.schema["item_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(chosen)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _distances(np.array(batch["embedding"].to_pylist(), float), shared.value)
            near = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch["item_id"], batch["embedding"].cast(pa.list_(pa.float64())), pa.array(near.astype(np.int32)),
                                              pa.array(far[np.arange(len(near)), near]), pa.array(list(far), pa.list_(pa.float64()))],
                                             ["item_id", "embedding", "pivot", "near", "far"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            owner = batch["pivot"].to_numpy()
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(owner)]):
                for at in range(begin, end, PACK_ITEMS):
                    some = batch.slice(at, min(PACK_ITEMS, end - at))
                    far, data = np.array(some["far"].to_pylist()), np.array(some["embedding"].to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part << 32 | number], pa.int64()), pa.array([some.num_rows], pa.int32()), pa.array([far.min(axis=0)], pa.list_(pa.float64())),
                         pa.array([far.max(axis=0)], pa.list_(pa.float64())), pa.array([some["item_id"].to_pylist()], pa.list_(some["item_id"].type)),
                         pa.array([data.tobytes()], pa.binary())], ["pack", "size", "low", "high", "ids", "data"])
                    number += 1

    placed = items.select("item_id", "embedding").mapInArrow(place, f"item_id {kind}, embedding array<double>, pivot int, near double, far array<double>")
    ordered = cut(placed).repartitionByRange("pivot", "near", "item_id").sortWithinPartitions("pivot", "near", "item_id")
    (ordered.mapInArrow(pack, f"pack long, size int, low array<double>, high array<double>, ids array<{kind}>, data binary")
     .write.mode("overwrite").parquet(f"{path}/packs"))
    spark.createDataFrame([(p.tolist(),) for p in chosen], "pivot array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")


def pivot_topk(queries: DataFrame, path: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(hits, report): the k nearest items by squared distance, as `vector_topk` gives them, and one row with the number of
    queries times items and of distances computed (pairs, computed).

    queries(query_id, embedding) is a stated set of at most `MAX_QUERIES` vectors, which every worker holds.
    """
    spark = queries.sparkSession
    packs = spark.read.parquet(f"{path}/packs")
    pivots = np.array([r["pivot"] for r in spark.read.parquet(f"{path}/pivots").collect()], float)
    asked = queries.select("query_id", "embedding").limit(MAX_QUERIES + 1).toArrow()
    if asked.num_rows > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries")
    vectors = np.array(asked["embedding"].to_pylist(), float).reshape((asked.num_rows, -1) if asked.num_rows else (0, 0))
    shared = spark.sparkContext.broadcast((vectors, _distances(vectors, pivots) if len(vectors) and len(pivots) else np.zeros((len(vectors), len(pivots)))))

    def bounds(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query and pack the least and greatest possible distance."""
        least, most = np.zeros((len(shared.value[1]), len(low))), np.full((len(shared.value[1]), len(low)), np.inf)
        for p in range(low.shape[1]):
            d = shared.value[1][:, p, None]
            least = np.maximum(least, np.maximum(d - high[None, :, p], low[None, :, p] - d))
            most = np.minimum(most, d + high[None, :, p])
        return least, most

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per query and task the packs of the least greatest distances that hold k items together."""
        for batch in batches:
            if not batch.num_rows or not len(shared.value[0]):
                continue
            size = batch["size"].to_numpy()
            most = bounds(*[np.array(batch[c].to_pylist()) for c in ("low", "high")])[1]
            order = most.argsort(axis=1)
            held = size[order].cumsum(axis=1)
            q, at = np.nonzero(held - size[order] < k)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(most[q, order[q, at]]), pa.array(size[order[q, at]].astype(np.int64))], ["q", "most", "size"])

    found = packs.select("size", "low", "high").mapInArrow(nearest, "q long, most double, size long")
    # The least distance within which k items surely lie.
    reached = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("most", "size"))).alias("near")).select("q", F.aggregate(
        "near", F.struct(F.lit(0).cast("long").alias("held"), F.lit(float("inf")).alias("limit")),
        lambda a, x: F.struct((a["held"] + x["size"]).alias("held"), F.when((a["held"] < k) & (a["held"] + x["size"] >= k), x["most"]).otherwise(a["limit"]).alias("limit")),
        lambda a: a["limit"]).alias("limit"))
    limits = np.full(len(vectors), np.inf)
    for row in reached.collect():
        limits[row["q"]] = row["limit"]
    allowed = spark.sparkContext.broadcast(np.sqrt(limits ** 2 + MARGIN))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(shared.value[0]):
                continue
            least = bounds(*[np.array(batch[c].to_pylist()) for c in ("low", "high")])[0]
            for i in range(batch.num_rows):
                asked = np.flatnonzero(least[:, i] <= allowed.value)
                ids = np.array(batch["ids"][i].as_py(), dtype=object)
                items = np.frombuffer(batch["data"][i].as_py()).reshape(len(ids), -1)
                for at in range(0, len(asked), 256):
                    some = asked[at:at + 256]
                    cost = np.round(((shared.value[0][some, None, :] - items[None, :, :]) ** 2).sum(axis=2), 6)
                    near = cost <= np.round(allowed.value[some, None] ** 2 + MARGIN, 6)
                    # Every query gets its k best of the pack, the smaller id first; the count of all goes with the first.
                    q, j = np.nonzero(near)
                    keep = np.lexsort((ids[j], cost[q, j], q))
                    q, j = q[keep], j[keep]
                    rank = np.arange(len(q)) - np.searchsorted(q, q)
                    q, j = q[rank < k], j[rank < k]
                    rows = [pa.array([-1, *some[q]], pa.int64()), pa.array([None, *ids[j]], batch["ids"].type.value_type), pa.array([float(cost.size), *cost[q, j]])]
                    yield pa.RecordBatch.from_arrays(rows, ["q", "item_id", "score"])

    kind = packs.schema["ids"].dataType.elementType.simpleString()
    scored = cut(packs.mapInArrow(search, f"q long, item_id {kind}, score double"))
    names = spark.createDataFrame(pa.table({"q": pa.array(range(asked.num_rows), pa.int64()), "query_id": asked["query_id"]}))
    hits = top_k(scored.filter("q >= 0").join(bounded_broadcast(names, MAX_QUERIES), "q").select("query_id", "item_id", "score"), ["query_id"], [F.col("score"), F.col("item_id")], k)
    total = packs.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("items"))
    report = scored.filter("q < 0").agg(F.coalesce(F.sum("score"), F.lit(0.0)).cast("long").alias("computed")).join(F.broadcast(total)).select(
        (F.col("items") * len(vectors)).cast("long").alias("pairs"), "computed")
    return hits, report
