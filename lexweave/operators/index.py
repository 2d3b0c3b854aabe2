"""Inverted index: postings, term, document and corpus statistics, kept per tenant."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import rag_tokens, token_count
from lexweave.scale import bounded_broadcast, cut, exploded, release, spread

BROADCAST_TERMS = 500_000
# Tokens that a task of the index counts at a time; documents are not split.
COUNTED_TOKENS = 1_000_000
# Tokens go to Python as one string a document, which costs half of what an array of strings does; no token holds this character.
SEPARATOR = "\x1f"

Tokenizer = Callable[[Column], Column]


def tokenized(docs: DataFrame, tokenizer: Tokenizer = rag_tokens, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(tenant, doc_id, text) -> (tenant, doc_id, tokens, dl)."""
    return (docs.select("tenant", "doc_id", *keep, tokenizer(F.col("text")).alias("tokens"))
            .withColumn("dl", F.size("tokens").cast("bigint")))


def postings(docs: DataFrame, tokenizer: Tokenizer = rag_tokens) -> DataFrame:
    """(tenant, doc_id, term, tf). A document's tokens sit in one task, so counting starts map-side."""
    tok = exploded(docs, ["tenant", "doc_id"], tokenizer(F.col("text")), "term")
    return tok.groupBy("tenant", "doc_id", "term").agg(F.count("*").alias("tf"))


def doc_stats(docs: DataFrame, tokenizer: Tokenizer = rag_tokens) -> DataFrame:
    return docs.select("tenant", "doc_id", token_count(tokenizer, F.col("text")).cast("bigint").alias("dl"))


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("tenant", "term").agg(F.count("*").alias("df"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    return stats.groupBy("tenant").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, tokenizer: Tokenizer = rag_tokens) -> DataFrame:
    """queries(tenant, query_id, text) -> (tenant, query_id, term, qtf): repeats count repeatedly."""
    return (exploded(queries, ["tenant", "query_id"], tokenizer(F.col("text")), "term")
            .groupBy("tenant", "query_id", "term").agg(F.count("*").alias("qtf")))


def matching_postings(docs: DataFrame, terms: DataFrame, tokenizer: Tokenizer = rag_tokens) -> DataFrame:
    """Postings of the wanted terms only, with dl: nothing else of the corpus is shuffled while the terms are few."""
    wanted = bounded_broadcast(terms.select("tenant", "term").distinct(), BROADCAST_TERMS)
    tok = exploded(tokenized(docs, tokenizer), ["tenant", "doc_id", "dl"], F.col("tokens"), "term")
    return (tok.join(wanted, ["tenant", "term"], "left_semi")
            .groupBy("tenant", "doc_id", "term", "dl").agg(F.count("*").alias("tf")))


# Marks the one row per document that carries its length; no tokenizer gives an empty token.
DOCUMENT_ROW = ""


def postings_and_lengths(docs: DataFrame, terms: DataFrame, tokenizer: Tokenizer = rag_tokens) -> tuple[DataFrame, DataFrame]:
    """(matching postings, corpus statistics) from one scan and one tokenising of the texts.

    Each document gets an extra marker row, so the statistics come from the same written table as the
    postings. The table holds the matching postings and one row per document.
    """
    wanted = terms.select("tenant", "term").unionByName(terms.select("tenant", F.lit(DOCUMENT_ROW).alias("term"))).distinct()
    marked = tokenized(docs, tokenizer).withColumn("tokens", F.concat("tokens", F.array(F.lit(DOCUMENT_ROW))))
    tok = exploded(marked, ["tenant", "doc_id", "dl"], F.col("tokens"), "term")
    both = cut(tok.join(bounded_broadcast(wanted, BROADCAST_TERMS), ["tenant", "term"], "left_semi")
               .groupBy("tenant", "doc_id", "term", "dl").agg(F.count("*").alias("tf")))
    return both.filter(F.col("term") != DOCUMENT_ROW), corpus_stats(both.filter(F.col("term") == DOCUMENT_ROW))


@dataclass(frozen=True)
class Index:
    """Stored index tables: postings(tenant, doc_id, term, tf, dl), docs(tenant, doc_id, dl), terms(tenant, term, df),
    corpus(tenant, n, avgdl). Every search reads only the postings of its own terms."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def select(self, *cols) -> DataFrame:
        """Columns of the documents, as of the texts that were indexed."""
        return self.docs.select(*cols)


def _coded(values: pa.Array) -> tuple[np.ndarray, int]:
    """Numbers that are equal where the values are, nulls included, and how many there are."""
    named = pc.dictionary_encode(values, null_encoding="encode")
    return named.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(named.dictionary)


def _documents(rows: pa.RecordBatch) -> np.ndarray:
    """One number per (tenant, doc_id)."""
    (tenant, _), (doc, many) = _coded(rows["tenant"]), _coded(rows["doc_id"])
    return tenant * max(1, many) + doc


def _counted(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Postings and marker rows of rows(tenant, doc_id, tokens), ordered by (tenant, term); equal ids of one length are one document."""
    tokens = pc.split_pattern(rows["tokens"], SEPARATOR)
    size = pc.list_value_length(tokens).to_numpy().astype(np.int64)
    _, shown, document = np.unique(_documents(rows) * (size.max() + 1) + size, return_index=True, return_inverse=True)
    named = pc.dictionary_encode(tokens.flatten())
    sort = pc.sort_indices(named.dictionary).to_numpy()
    place = np.empty(len(sort), np.int64)
    place[sort] = np.arange(len(sort))
    of = np.repeat(document, size)
    tenants = pc.rank(rows["tenant"].take(pa.array(shown)), tiebreaker="dense").to_numpy().astype(np.int64)
    pairs, tf = np.unique((tenants[of] * len(sort) + place[named.indices.to_numpy()]) * len(shown) + of, return_counts=True)
    row, term = pa.array(shown[pairs % len(shown)]), pa.array(sort[pairs // len(shown) % len(sort)])
    return pa.RecordBatch.from_arrays([rows["tenant"].take(row), rows["doc_id"].take(row), named.dictionary.take(term), pa.array(size - 1).take(row), pa.array(tf, pa.int64())],
                                      ["tenant", "doc_id", "term", "dl", "tf"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_counted of pieces of rows that come ordered by (tenant, doc_id); no piece ends within a document, texts that are null have no rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch["tokens"]))
        if batch.num_rows == 0:
            continue
        ends = pa.Table.from_batches([b.select(["tenant", "doc_id"]).slice(b.num_rows - 1) for b in held[-1:]] + [batch.select(["tenant", "doc_id"])]).combine_chunks().to_batches()[0]
        codes = _documents(ends)
        if held and (codes == codes[0]).all():
            held.append(batch)
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        starts = np.flatnonzero(np.diff(_documents(rows), prepend=-1))
        sizes = pc.add(pc.count_substring(rows["tokens"], SEPARATOR), 1).to_numpy()
        before = (np.cumsum(sizes, dtype=np.int64) - sizes)[starts]
        cuts = [*starts[np.flatnonzero(np.diff(before[:-1] // COUNTED_TOKENS, prepend=-1))], starts[-1]]
        for begin, end in zip(cuts, cuts[1:]):
            yield _counted(rows.slice(begin, end - begin))
        held = [rows.slice(starts[-1])]
    if held:
        yield _counted(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def build_index(docs: DataFrame, path: str, tokenizer: Tokenizer = rag_tokens) -> None:
    """Tokenise docs(tenant, doc_id, text) once and store the index below `path`.

    Texts move once, to the task of their document, postings not at all. A task counts some documents at a time, so its memory
    does not grow with its texts; a file is made of runs ordered by (tenant, term), each begun by the marker rows.
    """
    spark = docs.sparkSession
    rows = spread(docs.select("tenant", "doc_id", "text"), "doc_id").sortWithinPartitions("tenant", "doc_id")
    # The marker row is an empty token at the end of every document.
    tokens = rows.select("tenant", "doc_id", F.array_join(F.concat(tokenizer(F.col("text")), F.array(F.lit(DOCUMENT_ROW))), SEPARATOR).alias("tokens"))
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("tenant", "doc_id")]
    tokens.mapInArrow(_count, ", ".join([*kinds, "term string", "dl bigint", "tf bigint"])).write.mode("overwrite").parquet(f"{path}/rows")
    release(tokens)
    stored = spark.read.parquet(f"{path}/rows")
    term_stats(stored.filter(F.col("term") != DOCUMENT_ROW)).write.mode("overwrite").parquet(f"{path}/terms")
    corpus_stats(stored.filter(F.col("term") == DOCUMENT_ROW)).write.mode("overwrite").parquet(f"{path}/corpus")
    release(stored)


def open_index(spark: SparkSession, path: str) -> Index:
    """A stored index, or the latest version of one that a stream maintains (`segments`)."""
    from lexweave.operators import segments
    if segments.exists(spark, f"{path}/manifest"):
        return segments.open_segments(spark, path)
    rows, marker = spark.read.parquet(f"{path}/rows"), F.col("term") == DOCUMENT_ROW
    return Index(rows.filter(~marker).select("tenant", "doc_id", "term", "tf", "dl"), rows.filter(marker).select("tenant", "doc_id", "dl"),
                 spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/corpus"))


def merge_term_stats(old: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """New df table from the old one and the postings that came and went."""
    parts = old.select("tenant", "term", "df").unionByName(term_stats(added))
    if removed is not None:
        parts = parts.unionByName(term_stats(removed).withColumn("df", -F.col("df")))
    return parts.groupBy("tenant", "term").agg(F.sum("df").alias("df")).filter("df > 0")
