"""Exact BM25 top k that skips most postings: blocks of documents with the greatest impact of each term.

Documents of a tenant are ordered by length, equal ones by a hash of their ids, and dealt to ranges of about `RANGE_DOCS`. A block holds one term's postings
in one range, with their impacts (what a posting adds per unit of query weight) and the greatest of them. A query's bound
on a range is the sum of its weights times those maxima. Ranges are scored in rounds, those of the greatest bounds
first; the k-th best score so far is the query's threshold, and a range whose bound lies below it cannot hold a hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions.text import rag_tokens
from lexweave.operators import index as ix
from lexweave.operators.retrieve import K1, B
from lexweave.scale import bounded_broadcast, cut, release, spread, staged, top_k

RANGE_DOCS = 128
ROUNDS = (4, 32)
# Rows of (tenant, length) that are sent to every task.
BROADCAST_LENGTHS = 500_000
PASSES = 2
#: Scores are rounded to six digits before they are compared, bounds are not.
MARGIN = 1e-5


@dataclass(frozen=True)
class Blocks:
    """blocks(tenant, term, range, most, entries), terms(tenant, term, df), corpus(tenant, n, avgdl)."""

    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of rows(tenant, term, range, doc_id, impact) of one tenant, term and range."""
    held: list[pa.RecordBatch] = []
    keys = ["tenant", "term", "range"]

    def gathered(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0]
        entries = pa.StructArray.from_arrays([rows["doc_id"], rows["impact"]], ["doc_id", "impact"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, rows.num_rows), pa.int32()), entries)
        most = np.maximum.reduceat(rows["impact"].to_numpy(), starts)
        return pa.RecordBatch.from_arrays([*[rows[k].take(pa.array(starts)) for k in keys], pa.array(most), lists], [*keys, "most", "entries"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([*held, batch])
        fresh = np.zeros(rows.num_rows, bool)
        fresh[0] = True
        for k in keys:
            column = rows[k].combine_chunks()
            fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(fresh)
        # The last block may go on in the next batch.
        if len(starts) > 1:
            yield gathered(rows.slice(0, starts[-1]), starts[:-1])
        held = rows.slice(starts[-1]).to_batches()
    if held:
        yield gathered(pa.Table.from_batches(held), np.zeros(1, np.int64))


def build_blocks(index: ix.Index, path: str, range_docs: int = RANGE_DOCS) -> None:
    """Store the blocks of an index below `path`, in files of whole ranges, each ordered by (term, tenant, range).

    A posting's length tells its range, so postings move once, to the task of their range.
    """
    sizes = index.docs.groupBy("tenant", "dl").agg(F.count("*").alias("_docs"))
    before = Window.partitionBy("tenant").orderBy("dl").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(sizes.withColumn("_before", F.coalesce(F.sum("_docs").over(before), F.lit(0))))
    few = sizes.count() <= BROADCAST_LENGTHS
    number = F.floor((F.col("_before") + F.pmod(F.xxhash64("doc_id"), F.col("_docs"))) / range_docs)
    ranged = (index.postings.filter(F.col("doc_id").isNotNull()).select("tenant", "doc_id", "term", "tf", "dl")
              .join(F.broadcast(sizes) if few else sizes.hint("merge"), ["tenant", "dl"]).select("tenant", "doc_id", "term", "tf", "dl", number.alias("range")))
    tf = F.col("tf")
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / (F.col("avgdl") + 1e-9)))
    # Every pass moves the postings of its own ranges, so that much fewer lie in shuffle files at once.
    for part in range(PASSES):
        # Terms first: they tell rows apart soonest.
        placed = (spread(ranged.filter(F.col("range") % PASSES == part), "tenant", "range").join(F.broadcast(index.corpus.select("tenant", "avgdl")), "tenant")
                  .select("tenant", "term", "range", "doc_id", impact.alias("impact")).sortWithinPartitions("term", "tenant", "range"))
        kinds = {c: placed.schema[c].dataType.simpleString() for c in placed.columns}
        (placed.mapInArrow(_blocks, f"tenant {kinds['tenant']}, term {kinds['term']}, range {kinds['range']}, most double, entries array<struct<doc_id:{kinds['doc_id']},impact:double>>")
         .write.mode("append" if part else "overwrite").option("compression", "zstd").parquet(f"{path}/blocks"))
        release(placed)
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.corpus.write.mode("overwrite").parquet(f"{path}/corpus")


def open_blocks(spark: SparkSession, path: str) -> Blocks:
    return Blocks(*[spark.read.parquet(f"{path}/{name}") for name in ("blocks", "terms", "corpus")])


def range_bounds(held: Blocks, weighted: DataFrame) -> DataFrame:
    """(tenant, query_id, range, bound, postings): the most a document of each range can score; one row per query and range."""
    meta = held.blocks.select("tenant", "term", "range", "most", F.size("entries").alias("postings"))
    met = meta.join(bounded_broadcast(weighted, ix.BROADCAST_TERMS), ["tenant", "term"])
    return met.groupBy("tenant", "query_id", "range").agg(F.sum(F.col("w") * F.col("most")).alias("bound"), F.sum("postings").alias("postings"))


def pruned_topk(held: Blocks, queries: DataFrame, k: int, tokenizer=rag_tokens, rounds: tuple[int, ...] = ROUNDS,
                digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(hits, report): the best k documents per query as `retrieve.bm25_topk` gives them, and per query what it took:
    query_id, ranges, ranges_scored, postings, postings_scored."""
    terms = ix.query_terms(queries, tokenizer)
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighted = cut(terms.join(held.terms, ["tenant", "term"]).join(held.corpus, "tenant").select("tenant", "query_id", "term", (F.col("qtf") * idf).alias("w")))
    asked = bounded_broadcast(weighted, ix.BROADCAST_TERMS)
    bounds = staged(top_k(range_bounds(held, weighted), ["tenant", "query_id"], [F.col("bound").desc(), F.col("range")], 1 << 30, "place"), "bounds")
    release(terms)
    best, limit, last = None, None, 0
    for until in [*rounds, None]:
        some = bounds.filter(F.col("place") > last)
        some = some if until is None else some.filter(F.col("place") <= until)
        if limit is not None:
            some = some.join(limit, ["tenant", "query_id"], "left").filter(F.col("threshold").isNull() | (F.col("bound") + MARGIN >= F.col("threshold"))).drop("threshold")
        some = staged(some.select("tenant", "query_id", "range", "postings"), "scored")
        # A block moves once, to the task of its range, however many queries ask for it; a document is scored where its range lies.
        met = (held.blocks.select("tenant", "term", "range", "entries").join(bounded_broadcast(weighted.select("tenant", "term").distinct(), ix.BROADCAST_TERMS), ["tenant", "term"], "left_semi")
               .join(bounded_broadcast(some.select("tenant", "range").distinct(), ix.BROADCAST_TERMS), ["tenant", "range"], "left_semi"))
        live = some.groupBy("tenant", "range").agg(F.collect_list("query_id").alias("_live"))
        wanted = spread(met, "tenant", "range").join(live, ["tenant", "range"]).join(asked, ["tenant", "term"]).filter(F.array_contains("_live", F.col("query_id")))
        scored = (wanted.select("tenant", "query_id", "range", "w", F.explode("entries").alias("e")).groupBy("tenant", "query_id", "range", F.col("e.doc_id").alias("item_id"))
                  .agg(F.round(F.sum(F.col("w") * F.col("e.impact")), digits).alias("score")).filter("score > 0").drop("range"))
        both = scored if best is None else best.select(scored.columns).unionByName(scored)
        before, best = best, staged(top_k(both, ["tenant", "query_id"], [F.col("score").desc(), F.col("item_id")], k), "best")
        limit = best.groupBy("tenant", "query_id").agg(F.count("*").alias("c"), F.min("score").alias("threshold")).filter(F.col("c") >= k).drop("c")
        read = some if last == 0 else read.unionByName(some)
        last = until
        release(terms if before is None else before)
    taken = read.groupBy("tenant", "query_id").agg(F.count("*").alias("ranges_scored"), F.sum("postings").alias("postings_scored"))
    report = (bounds.groupBy("tenant", "query_id").agg(F.count("*").alias("ranges"), F.sum("postings").alias("postings")).join(taken, ["tenant", "query_id"])
              .select("query_id", "ranges", "ranges_scored", "postings", "postings_scored"))
    return best.select("query_id", "item_id", "score", "rank"), report
