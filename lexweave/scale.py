"""Building blocks that keep hot groups out of a single task.

`last_wins` replaces "row_number = 1" by an aggregate, so a hot key is reduced on the map side.
`running` computes prefix sums, prefix maxima and lag over (key, bucket) pieces and carries one row
per piece forward, so an ordered scan of a hot key is spread over many tasks.
`exact_ranks` gives full-list ranks of a few candidates by counting, without sorting the list.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's own setting, a temp folder only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="lexweave-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and keeps iterative plans short."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet below the checkpoint folder and read it back: lineage ends, lost executors cost nothing."""
    path = scratch_path(df.sparkSession, label)
    # zstd works in pooled buffers; the default codec leaves off-heap buffers of every written file to the garbage collector.
    df.write.option("compression", "zstd").parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.staged_path = path
    return held


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let Spark remove the shuffle files of finished steps.

    Of a table that is not staged only the files of its finished steps go.
    Spark drops shuffle files when the driver's garbage collector finds their plans gone, which a roomy driver may not do
    for a long time; a chain of many steps would keep the files of all of them until then.
    """
    for table in tables:
        path = table.__dict__.pop("staged_path", None)
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep, per key, the row with the greatest order tuple."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*[F.col(k) for k in keys], *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep, per key, the row with the least order tuple."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*[F.col(k) for k in keys], *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
            values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add values of all rows *before* the current one, per key in the given order.

    `bucket` must be non-decreasing along `order`. `values` maps an output column to (kind, column)
    with kind "sum" (0 before the first row), "max" (null before the first row) or
    "last" (the previous row's value, null before the first row).
    Each (key, bucket) piece is scanned by itself; pieces exchange one row each.
    """
    src = df.withColumn("_bucket", bucket)
    for name, (_, col) in values.items():
        src = src.withColumn(f"_v_{name}", col)
    piece = [*keys, "_bucket"]
    local = Window.partitionBy(*piece).orderBy(*order)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    over_pieces = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)

    out, totals, carries = src, [], []
    for name, (kind, _) in values.items():
        v = F.col(f"_v_{name}")
        if kind == "sum":
            out = out.withColumn(f"_l_{name}", F.sum(v).over(before))
            totals.append(F.sum(v).alias(f"_t_{name}"))
            carries.append(F.sum(f"_t_{name}").over(over_pieces).alias(f"_c_{name}"))
        elif kind == "max":
            out = out.withColumn(f"_l_{name}", F.max(v).over(before))
            totals.append(F.max(v).alias(f"_t_{name}"))
            carries.append(F.max(f"_t_{name}").over(over_pieces).alias(f"_c_{name}"))
        elif kind == "last":
            out = out.withColumn(f"_l_{name}", F.lag(F.struct(v.alias("v"))).over(local))
            totals.append(F.max_by(F.struct(v.alias("v")), F.struct(*order)).alias(f"_t_{name}"))
            carries.append(F.last(f"_t_{name}").over(over_pieces).alias(f"_c_{name}"))
        else:
            raise ValueError(f"unknown kind {kind}")
    carried = src.groupBy(*piece).agg(*totals).select(*piece, *carries)
    joined = out.alias("o").join(
        carried.alias("c"),
        on=[F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in piece],
        how="left",
    )
    cols = [F.col(f"o.{c}") for c in df.columns]
    for name, (kind, _) in values.items():
        here, prev = F.col(f"o._l_{name}"), F.col(f"c._c_{name}")
        if kind == "sum":
            cols.append((F.coalesce(here, F.lit(0)) + F.coalesce(prev, F.lit(0))).alias(name))
        elif kind == "max":
            cols.append(F.greatest(here, prev).alias(name))
        else:
            cols.append(F.coalesce(here, prev)["v"].alias(name))
    return joined.select(*cols)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "pos") -> DataFrame:
    """Add each row's place (from 1) in the full order of its key; `bucket` must not decrease along `order`.

    Pieces are numbered by themselves and exchange one count each, so even one list of all rows is no single task.
    """
    return running(df, keys, order, bucket, {name: ("sum", F.lit(1))}).withColumn(name, (F.col(name) + 1).cast("bigint"))


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a side of short rows if it has at most max_rows of them, else leave the join to shuffle.

    The check counts the side itself. Beyond the bound a merge hint keeps the planner from broadcasting
    the other side on a low estimate.
    """
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to all partitions of a shuffle, by `keys` or evenly.

    For work that costs far more than its bytes tell: neither a single input file nor the joining of small
    partitions puts it in a few tasks then.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def exploded(df: DataFrame, keep: Sequence[Column | str], array: Column, name: str) -> DataFrame:
    """keep + one row per array element.

    An inner explode makes the optimizer test size(array) > 0 in a filter of its own, which computes an
    expensive array a second and third time; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best k rows per key. Spark prunes to k rows per task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def exact_ranks(scored: DataFrame, candidates: DataFrame, key: str = "query_id",
                item: str = "item_id", score: str = "score") -> DataFrame:
    """Rank (1 = best, ties by item) of each candidate inside the whole list `scored`.

    Candidates are a bounded pool per key and must occur in `scored`. Every scored row only adds one
    to the counter of its gap between two candidates, so the list is never sorted or collected.
    """
    pool = candidates.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i")))).alias("_pool")
    )
    pool = cut(pool)
    here = F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))
    gaps = (
        scored.join(bounded_broadcast(pool, 10_000), key)
        .withColumn("_gap", F.size(F.filter("_pool", lambda c: c <= here)))
        .groupBy(key, "_gap").agg(F.count("*").alias("_n"))
    )
    placed = pool.select(key, F.posexplode("_pool").alias("_idx", "_c"))
    return (
        placed.join(gaps, key, "left")
        .groupBy(key, "_idx", F.col("_c.i").alias(item))
        .agg((F.coalesce(F.sum(F.when(F.col("_gap") <= F.col("_idx"), F.col("_n"))), F.lit(0)) + 1).alias("rank"))
        .select(key, item, F.col("rank").cast("bigint").alias("rank"))
    )
