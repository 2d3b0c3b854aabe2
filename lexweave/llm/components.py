"""Connected components of an edge table, with the edges never leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.store import release, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least node around each node; `large` moves the greater neighbours, else the lesser ones."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")) if not large else (
        edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    moved = both.join(least, "u")
    if large:
        return moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()
    return (moved.select(F.col("v").alias("a"), F.col("low").alias("b"))
            .unionAll(least.select(F.col("u").alias("a"), F.col("low").alias("b")))
            .filter(F.col("a") != F.col("b")).distinct())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the least node reachable.

    Large-star and small-star steps alternate until nothing moves; each round keeps at most one edge per old edge,
    so a hub costs no more than its links. Loops and repeated edges are allowed; an empty table gives an empty one.
    Roots themselves are included. The result is a stored table.
    """
    now = staged(edges.filter(F.col("a") != F.col("b"))
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark or not seen["n"]:
            break
        mark = (seen["n"], seen["h"])
        last, now = now, staged(_star(_star(now, large=True), large=False), "edges")
        release(last)
    else:
        raise RuntimeError("components did not settle")
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) of all nodes, after new links (a, b) between nodes: only links between different roots are followed."""
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    lifted = (links.join(side("a"), "a").join(side("b"), "b").filter(F.col("root_a") != F.col("root_b"))
              .select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    moved = components(lifted).select(F.col("node").alias("root"), F.col("root").alias("moved"))
    return staged(roots.join(moved, "root", "left").select("node", F.coalesce("moved", "root").alias("root")), "roots")
