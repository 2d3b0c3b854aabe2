"""Lexical, vector and fused retrieval for whole batches of queries.

Shapes: queries(tenant, query_id, text), hits(query_id, item_id, score, rank).
Scores are rounded before ranking and ties go to the smaller id, so results do not depend on order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import rag_tokens
from lexweave.operators import index as ix
from lexweave.scale import bounded_broadcast, cut, exact_ranks, spread, top_k

K1, B, RRF_K, RRF_ALPHA = 1.5, 0.75, 60, 0.1
KEYWORD_TOP_K, RERANK_BATCH, RERANK_TOP_N = 10, 20, 5
# Postings that a task scores at a time, places of a score table (queries by documents), rows it gives out at a time.
SCORED_POSTINGS, SCORE_PLACES, SCORED_ROWS = 100_000, 2_000_000, 65_536


def keyword_pool(top_k_: int, keyword_top_k: int = KEYWORD_TOP_K, rerank_batch: int = RERANK_BATCH) -> int:
    return max(top_k_, keyword_top_k, rerank_batch)


def _limits(limit, most: int, least_pool: int, factor: int):
    if isinstance(limit, Column):
        shown = F.greatest(F.lit(1), F.least(F.coalesce(F.nullif(limit, F.lit(0)), F.lit(5)), F.lit(most)))
        return shown, F.greatest(F.lit(least_pool), shown * factor)
    shown = max(1, min(int(limit or 5), most))
    return shown, max(least_pool, shown * factor)


def tool_limits(limit: int | Column | None):
    """(limit, pool) of a tool search, for one number or a column of numbers; 0 and none mean 5."""
    return _limits(limit, 20, 20, 4)


def service_limits(limit: int | Column | None):
    return _limits(limit, 10, 30, 8)


def _length_norm(dl: Column, avgdl: Column, catalog: bool) -> Column:
    return dl / F.greatest(avgdl, F.lit(1.0)) if catalog else dl / (avgdl + 1e-9)


def bm25_scores(docs: DataFrame | ix.Index, queries: DataFrame, tokenizer=rag_tokens, catalog: bool = False,
                digits: int = 6, best: int | None = None) -> DataFrame:
    """(query_id, item_id, score > 0) for every matching pair, from a stored index or straight from the texts.

    With `best` a task leaves out pairs that are not among its own best so many of a query; all that can rank are there.
    """
    terms = ix.query_terms(queries, tokenizer)
    if isinstance(docs, ix.Index):
        return score_postings(terms, docs.postings, docs.terms, docs.corpus, catalog, digits, best)
    post, corpus = ix.postings_and_lengths(docs, terms, tokenizer)
    return score_postings(terms, post, ix.term_stats(post), corpus, catalog, digits, best)


@dataclass(frozen=True)
class _Asked:
    """The weights of a batch of queries by term number: rows offsets[i] to offsets[i + 1] belong to terms[i]."""

    terms: np.ndarray
    offsets: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    ids: pa.Array


def _asked(lists: DataFrame) -> _Asked:
    rows = lists.select("number", F.explode("asks").alias("a")).select("number", "a.query_id", "a.w").toArrow()
    coded = rows["query_id"].combine_chunks()
    if pa.types.is_struct(coded.type):
        seen: dict = {}
        codes = np.array([seen.setdefault(tuple(q.items()), len(seen)) for q in coded.to_pylist()], dtype=np.int64)
        ids = pa.array([dict(q) for q in seen], coded.type)
    else:
        named = pc.dictionary_encode(coded, null_encoding="encode")
        codes, ids = named.indices.to_numpy(zero_copy_only=False).astype(np.int64), named.dictionary
    number = rows["number"].to_numpy()
    order = np.argsort(number, kind="stable")
    terms, offsets = np.unique(number[order], return_index=True)
    return _Asked(terms, np.append(offsets, len(order)), codes[order], rows["w"].to_numpy()[order], ids)


def _scorer(shared, digits: int, best: int | None):
    """Sums the impacts of postings(doc_id, number, impact), which come ordered by document, per query and document."""

    def ranked(query: np.ndarray, score: np.ndarray) -> np.ndarray:
        # Documents come by id, so of equal scores the earlier place counts.
        order = np.lexsort((-score, query))
        starts = np.flatnonzero(np.diff(query[order], prepend=-1))
        nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        return np.sort(order[nth < best])

    def scored(asked: _Asked, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """(documents, query, place in documents, score) of pieces of a batch of whole documents."""
        named = pc.dictionary_encode(batch["doc_id"], null_encoding="encode")
        doc = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(asked.terms, batch["number"].to_numpy())
        impact = batch["impact"].to_numpy()
        width = max(1, SCORE_PLACES // max(1, len(asked.ids)))
        for low in range(0, len(named.dictionary), width):
            high = min(low + width, len(named.dictionary))
            begin, end = np.searchsorted(doc, [low, high])
            sums = np.zeros(len(asked.ids) * (high - low))
            # One posting meets at most all queries, so the pieces have about as many matches as the table has places.
            reach = np.cumsum(asked.offsets[at[begin:end] + 1] - asked.offsets[at[begin:end]])
            cuts = np.searchsorted(reach, np.arange(SCORE_PLACES, reach[-1] if len(reach) else 0, SCORE_PLACES), side="right")
            for first, last in zip([begin, *(begin + cuts)], [*(begin + cuts), end]):
                t = at[first:last]
                times = asked.offsets[t + 1] - asked.offsets[t]
                ends = np.cumsum(times)
                of = np.arange(ends[-1] if len(ends) else 0) + np.repeat(asked.offsets[t] - ends + times, times)
                place = asked.query[of] * (high - low) + np.repeat(doc[first:last] - low, times)
                sums += np.bincount(place, asked.weight[of] * np.repeat(impact[first:last], times), minlength=len(sums))
            table = np.round(sums, digits).reshape(len(asked.ids), high - low)
            if best is not None and best < high - low:
                least = np.partition(table, high - low - best, axis=1)[:, high - low - best]
                table = np.where(table >= least[:, None], table, 0.0)
            query, place = np.nonzero(table > 0)
            yield named.dictionary.slice(low, high - low), query, place, table[query, place]

    def given(asked: _Asked, docs: pa.Array, query: np.ndarray, place: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(query), SCORED_ROWS):
            part = slice(at, at + SCORED_ROWS)
            yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query[part])), docs.take(pa.array(place[part])), pa.array(score[part])],
                                             ["query_id", "item_id", "score"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows in larger batches, none of which ends within a document."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < SCORED_POSTINGS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            doc = pc.dictionary_encode(rows["doc_id"], null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            end = int(np.searchsorted(doc, doc[-1]))
            if end:
                yield rows.slice(0, end)
            held = [rows.slice(end)]
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        kept: tuple | None = None
        for batch in whole(batches):
            for docs, query, place, score in scored(asked, batch):
                if best is None:
                    yield from given(asked, docs, query, place, score)
                    continue
                if kept is not None:
                    docs = pa.concat_arrays([kept[0], docs])
                    query, score = np.concatenate([kept[1], query]), np.concatenate([kept[3], score])
                    place = np.concatenate([kept[2], place + len(kept[0])])
                # By document, then the best of every query; documents that are no one's hit go.
                order = np.argsort(place, kind="stable")
                top = order[ranked(query[order], score[order])]
                used, place = np.unique(place[top], return_inverse=True)
                kept = docs.take(pa.array(used)), query[top], place, score[top]
        if kept is not None:
            yield from given(asked, *kept)
    return run


def score_postings(terms: DataFrame, post: DataFrame, dfs: DataFrame, corpus: DataFrame,
                   catalog: bool = False, digits: int = 6, best: int | None = None) -> DataFrame:
    """BM25 from index tables: post(tenant, doc_id, term, tf, dl), dfs(df), corpus(n, avgdl).

    The weight of a term is folded into the query side first, so the big side is joined once. While the batch has few
    terms that side is sent to the tasks: of the postings only the wanted ones move, once, to the task of their document,
    and meet the queries there, so pairs of queries and documents never move and a frequent term heats no partition.
    Beyond that the join shuffles and skew is split at run time.
    """
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    terms = cut(terms)
    wanted = bounded_broadcast(terms.select("tenant", "term").distinct(), ix.BROADCAST_TERMS)
    dfs = dfs.join(wanted, ["tenant", "term"], "left_semi")
    weighted = (terms.join(dfs, ["tenant", "term"]).join(corpus, "tenant")
                .select("tenant", "query_id", "term", "avgdl", (F.col("qtf") * idf).alias("w")))
    tf = F.col("tf")
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * _length_norm(F.col("dl"), F.col("avgdl"), catalog)))
    if terms.count() > ix.BROADCAST_TERMS:
        return (post.join(weighted.hint("merge"), ["tenant", "term"])
                .groupBy("query_id", F.col("doc_id").alias("item_id"))
                .agg(F.round(F.sum(F.col("w") * impact), digits).alias("score"))
                .filter("score > 0"))
    # Written once, so that all readers meet the same numbers.
    lists = cut(weighted.groupBy("tenant", "term", "avgdl").agg(F.collect_list(F.struct("query_id", "w")).alias("asks"))
                .withColumn("number", F.monotonically_increasing_id()))
    shared = terms.sparkSession.sparkContext.broadcast(_asked(lists))
    met = post.join(F.broadcast(lists.select("tenant", "term", "avgdl", "number")), ["tenant", "term"]).select("doc_id", "number", impact.alias("impact"))
    met = spread(met, "doc_id").sortWithinPartitions("doc_id")
    kinds = terms.schema["query_id"].dataType.simpleString(), post.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(_scorer(shared, digits, best), f"query_id {kinds[0]}, item_id {kinds[1]}, score double")


def bm25_topk(docs: DataFrame | ix.Index, queries: DataFrame, k: int, tokenizer=rag_tokens, zero_fill: bool = False) -> DataFrame:
    """Best k documents per query. `zero_fill` completes short lists with unmatched documents by id."""
    # Short, and read several times by whoever fuses or fills it.
    hits = cut(rank_hits(bm25_scores(docs, queries, tokenizer, best=k), k))
    if not zero_fill:
        return hits
    short = (queries.join(hits.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left")
             .select("tenant", "query_id", F.coalesce("have", F.lit(0)).alias("have")).filter(F.col("have") < k))
    # At most k documents of a tenant are hits of a short query, so its first 2k ids always suffice.
    head = top_k(docs.select("tenant", F.col("doc_id").alias("item_id")), ["tenant"], [F.col("item_id")], 2 * k, "pos")
    fill = (short.join(head, "tenant").join(hits.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti"))
    fill = top_k(fill, ["query_id"], [F.col("item_id")], k, "extra").filter(F.col("extra") <= k - F.col("have"))
    return hits.select("query_id", "item_id", "score", "rank").unionByName(
        fill.select("query_id", "item_id", F.lit(0.0).alias("score"), (F.col("have") + F.col("extra")).cast("int").alias("rank")))


def rank_hits(scored: DataFrame, k: int, descending: bool = True) -> DataFrame:
    """1-based rank per query of the best k hits."""
    s = F.col("score").desc() if descending else F.col("score").asc()
    return top_k(scored, ["query_id"], [s, F.col("item_id")], k)


def rrf(ranked: DataFrame, keys: tuple[str, ...] = ("query_id",), k: int = RRF_K) -> DataFrame:
    """Sum of 1/(k + rank) over all lists an item is in. One shuffle, no full outer join."""
    return (ranked.groupBy(*keys, "item_id")
            .agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score")))


def fuse_routes(lexical: DataFrame, vector: DataFrame, keys: tuple[str, ...] = ("query_id",),
                k: int = RRF_K) -> DataFrame:
    """RRF of two ranked routes; a query with only one route keeps that route's order.

    With a single list 1/(k + rank) is monotone in the rank, so the same formula serves both cases.
    """
    cols = [*keys, "item_id", "rank"]
    return rrf(lexical.select(*cols).unionByName(vector.select(*cols)), keys, k)


def retrieve(docs: DataFrame | ix.Index, queries: DataFrame, vector_hits: DataFrame, top_n: int) -> DataFrame:
    """Keyword pool and vector list, fused and cut: (query_id, item_id, score, rank)."""
    lexical = bm25_topk(docs, queries, keyword_pool(top_n))
    return rank_hits(fuse_routes(lexical, vector_hits.filter(F.col("rank") <= top_n)), top_n)


def pick_items(table: DataFrame, hits: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Rows of a large table whose item_id is hit. While the hits are few the table is not shuffled."""
    return table.join(bounded_broadcast(hits.select("item_id").distinct(), max_rows), "item_id", "left_semi")


def attach_payload(hits: DataFrame, chunks: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """Text from the chunk table; source only for items the vector route found, else ''."""
    hits = cut(hits)
    seen = vector_hits.select("query_id", "item_id").withColumn("_v", F.lit(True))
    found = pick_items(chunks.select(F.col("doc_id").alias("item_id"), "text", "source"), hits)
    return (hits.join(found, "item_id", "left")
            .join(seen, ["query_id", "item_id"], "left")
            .withColumn("text", F.coalesce("text", F.lit("")))
            .withColumn("source", F.when(F.col("_v"), F.coalesce("source", F.lit(""))).otherwise(F.lit("")))
            .drop("_v"))


def rerank(candidates: DataFrame, scores: DataFrame, batch: int = RERANK_BATCH, top_n: int = RERANK_TOP_N) -> DataFrame:
    """Rescore the first `batch` candidates from scores(query_id, item_id, score); missing score is 0."""
    pool = candidates.filter(F.col("rank") <= batch).select("query_id", "item_id", F.col("rank").alias("old_rank"))
    scored = (pool.join(scores.select("query_id", "item_id", "score"), ["query_id", "item_id"], "left")
              .withColumn("score", F.coalesce("score", F.lit(0.0))))
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("old_rank")], top_n)


def vote(variant_hits: DataFrame, top_n: int, k: int = RRF_K) -> DataFrame:
    """variant_hits(query_id, variant, item_id, rank) -> RRF over the variants, with the first variant seen."""
    fused = (variant_hits.groupBy("query_id", "item_id")
             .agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"),
                  F.min("variant").alias("first_variant")))
    return top_k(fused, ["query_id"], [F.col("score").desc(), F.col("item_id")], top_n)


def multi_query(docs: DataFrame | ix.Index, variants: DataFrame, variant_hits: DataFrame, top_n: int,
                rerank_scores: DataFrame | None = None) -> DataFrame:
    """Every variant goes the whole way on its own, then the variants' final lists vote.

    variants(tenant, query_id, variant, text); variant_hits(query_id, variant, item_id, rank) is the vector route of
    each variant that has a vector; rerank_scores(query_id, variant, item_id, score) rescores each variant's list.
    """
    keyed = lambda df: df.withColumn("query_id", F.struct("query_id", "variant")).drop("variant")
    lexical = bm25_topk(docs, keyed(variants), keyword_pool(top_n))
    vector = keyed(variant_hits).filter(F.col("rank") <= top_n)
    final = rank_hits(fuse_routes(lexical, vector), top_n if rerank_scores is None else RERANK_BATCH)
    if rerank_scores is not None:
        final = rerank(final, keyed(rerank_scores), top_n=top_n)
    return vote(final.select("query_id.query_id", "query_id.variant", "item_id", "rank"), top_n)


def context_text(hits: DataFrame, queries: DataFrame, separator: str = "\n\n---\n\n",
                 fallback: str = "未找到相关文档信息。") -> DataFrame:
    """One text per query from its (already cut) hits in rank order; a fallback line if there are none."""
    joined = hits.groupBy("query_id").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]), separator).alias("ctx"))
    return (queries.select("query_id").join(joined, "query_id", "left")
            .select("query_id", F.coalesce("ctx", F.lit(fallback)).alias("context")))


def dense_pool(m: int, k: int = RRF_K, alpha: float = RRF_ALPHA) -> int:
    """How deep the dense list must be so that nothing below it can reach the fused top m.

    An item at dense rank > P scores at most (1-a)/(k+P+1) + a/(k+1); one at dense rank <= m scores at
    least (1-a)/(k+m).
    """
    floor = (1 - alpha) / (k + m) - alpha / (k + 1)
    if floor <= 0:
        raise ValueError("pool too deep for an exact bound")
    return max(m, math.ceil((1 - alpha) / floor - k - 1) + 1)


def weighted_fusion(sparse: DataFrame, dense: DataFrame, m: int, k: int = RRF_K,
                    alpha: float = RRF_ALPHA) -> DataFrame:
    """Fused top m of a(1/(k+sparse rank)) + (1-a)(1/(k+dense rank)); sparse only where no dense list.

    sparse(query_id, item_id, score) is the whole list; dense(query_id, item_id, rank) must be at least
    `dense_pool(m)` deep. Sparse ranks of the dense items are counted exactly, however deep they are.
    """
    best = rank_hits(sparse, m).select("query_id", "item_id", F.col("rank").cast("bigint").alias("sr"))
    deep = sparse.join(dense.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi")
    sr = best.unionByName(exact_ranks(sparse, deep).withColumnRenamed("rank", "sr"))
    dr = dense.select("query_id", "item_id", F.col("rank").alias("dr"))
    has_dense = dr.select("query_id").distinct().withColumn("has_dense", F.lit(True))
    both = (sr.unionByName(dr, allowMissingColumns=True)
            .groupBy("query_id", "item_id").agg(F.max("sr").alias("sr"), F.max("dr").alias("dr"))
            .join(has_dense, "query_id", "left"))
    score = F.when(F.col("has_dense"),
                   F.coalesce(alpha / (k + F.col("sr")), F.lit(0.0))
                   + F.coalesce((1 - alpha) / (k + F.col("dr")), F.lit(0.0))
                   ).otherwise(1.0 / (k + F.col("sr")))
    return rank_hits(both.select("query_id", "item_id", F.round(score, 12).alias("score")), m)


def stage_counts(lexical: DataFrame, vector: DataFrame, fused: DataFrame, final: DataFrame) -> DataFrame:
    """Hits per stage and query."""
    parts = None
    for name, df in [("bm25_hits", lexical), ("vector_hits", vector), ("fused_hits", fused), ("final_hits", final)]:
        one = df.select("query_id", F.lit(name).alias("stage"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("query_id", "stage").agg(F.count("*").alias("hits"))
