"""Tables that an operator writes once in the shared folder and reads several times, and the numbering of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.scale import bounded_broadcast, release, staged  # noqa: F401  release: for the modules that import it from here

_LOCAL = 33  # bits of monotonically_increasing_id that count rows inside a partition


def bases(totals: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): the sum of `value` over all smaller keys; one row per partition of a table, hence one narrow window."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long").alias(name))


def numbered(df: DataFrame, name: str, label: str = "numbered") -> DataFrame:
    """df, staged, with a gapless number from 0 in the order of its partitions and of the rows inside them.

    Only one row per partition is carried from piece to piece; rows stay where they lie.
    """
    held = staged(df.withColumn("_at", F.monotonically_increasing_id()), label)
    pieces = held.groupBy(F.shiftright("_at", _LOCAL).alias("_piece")).agg(F.count("*").alias("_rows"))
    base = bounded_broadcast(bases(pieces, "_piece", "_rows", "_base"), 1_000_000)
    local = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL) - 1))
    return (held.withColumn("_piece", F.shiftright("_at", _LOCAL)).join(base, "_piece")
            .withColumn(name, F.col("_base") + local).drop("_at", "_piece", "_base"))
