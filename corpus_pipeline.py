"""A training corpus from `documents`, stage by stage.

Language identification, line deduplication, near-duplicate removal, mixing to target weights, BPE encoding: each stage
takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.bpe import encode, n_tokens
from lexweave.llm.langid import UNKNOWN, fit, identify
from lexweave.llm.mixing import by_rank, mixture, word_count
from lexweave.llm.neardup import drop_near_duplicates
from lexweave.llm.queries import MIX_TILTS, MIX_WEIGHTS
from lexweave.llm.registry import documents
from lexweave.llm.store import staged
from lexweave.llm.templates import drop_recurring_lines


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language stay; null texts, texts without a letter and texts that no learned language explains go."""
    packed = docs.select(F.struct(*_columns(docs)).alias("row"), F.col("text"))
    told = identify(packed, fit(docs), ["row"])
    return told.filter((F.col("lang_pred") != UNKNOWN) & F.col("likely")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; every document stays."""
    return drop_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates stays."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as the weights ask; a copy counts whole if half of it is taken."""
    sized = docs.select(F.struct(*_columns(docs)).alias("doc"), F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    return (mixture(sized, by_rank(sized, MIX_WEIGHTS, MIX_TILTS), whole=True)).select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids (little-endian unsigned 32-bit integers) and n_tokens of every row, in the order of the mix."""
    return encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", n_tokens(F.col("ids")).alias("n_tokens"), "ids")


STAGES = [("language_id", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("bpe", tokens)]

#: BPE and the other stages have no SQL form; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each result is written and read again as the next one's documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
