"""Lexicon tables at work: word segmentation of unspaced text, and known wrong forms in texts.

A lexicon is a curated table. It is counted, held to `MAX_ENTRIES` and `MAX_CHARS`, and sent to the workers, where
its automaton is built once; texts stay where they are and are read once, whatever the number of entries.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions import text as tx
from lexweave.functions.lexicon import Automaton, Segmenter

MAX_ENTRIES, MAX_CHARS = 1_000_000, 32_000_000
CJK_RUN = f"{tx.CJK}+"
_ISSUES = T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                    T.StructField("wrong", T.StringType()), T.StructField("right", T.StringType())]))
_built: dict = {}


def _once(shared: Broadcast, kind: str, build):
    """What a worker builds from a broadcast lexicon, kept for its later batches; one lexicon of a kind at a time."""
    rows = shared.value
    held = _built.get(kind)
    if held is None or held[0] is not rows:
        held = _built[kind] = (rows, build(rows))
    return held[1]


def shared_lexicon(lexicon: DataFrame, entry: str, other: str) -> Broadcast:
    """The distinct (entry, other) rows of a lexicon, in order, after a check of their number and length."""
    rows = lexicon.filter(F.col(entry).isNotNull() & (F.col(entry) != "")).select(entry, other).distinct()
    count, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length(entry)), F.lit(0))).first()
    if count > MAX_ENTRIES or chars > MAX_CHARS:
        raise ValueError(f"a lexicon of {count} entries and {chars} characters; {MAX_ENTRIES} and {MAX_CHARS} are held by every worker")
    return lexicon.sparkSession.sparkContext.broadcast(sorted((tuple(r) for r in rows.collect()), key=repr))


def segmented_tokens(lexicon: DataFrame) -> Callable[[Column], Column]:
    """A tokenizer: lower-case ASCII words, then the words of all CJK runs by the best path over lexicon(word, weight).

    With an empty lexicon it is `catalog_tokens`. Of a word that has several weights the greatest counts.
    """
    shared = shared_lexicon(lexicon.groupBy("word").agg(F.max(F.col("weight").cast("double")).alias("weight")), "word", "weight")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(runs: pd.Series) -> pd.Series:
        segmenter = _once(shared, "segments", lambda rows: Segmenter([w for w, _ in rows], [n for _, n in rows]))
        return runs.map(lambda r: [w for run in r for w in segmenter.cut(run)] if r is not None and len(r) else [])

    def tokens(c: Column) -> Column:
        words = F.transform(F.regexp_extract_all(c, F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower)
        return F.concat(words, cut(F.regexp_extract_all(c, F.lit(CJK_RUN), F.lit(0))))
    return tokens


def lexicon_issues(docs: DataFrame, lexicon: DataFrame | list[tuple[str, str]] | None = None) -> DataFrame:
    """Every occurrence of a known wrong form in docs(doc_id, text), with its line and offsets in the whole text.

    Occurrences of one form do not overlap; those of different forms may. A form with several corrections gives a row for
    each. Forms never reach over a line end.
    """
    if not isinstance(lexicon, DataFrame):
        pairs = list(dict.fromkeys(lexicon or tx.TYPO_PAIRS))
        lexicon = docs.sparkSession.createDataFrame(pairs, "wrong string, right string")
    shared = shared_lexicon(lexicon.filter(~F.contains("wrong", F.lit("\n"))), "wrong", "right")

    def built(rows):
        rights: dict[str, list] = {}
        for wrong, right in rows:
            rights.setdefault(wrong, []).append(right)
        return Automaton(list(rights)), list(rights.values())

    @F.pandas_udf(_ISSUES)
    def find(texts: pd.Series) -> pd.Series:
        automaton, rights = _once(shared, "issues", built)

        def of(text):
            if not text:
                return []
            out, line, counted = [], 1, 0
            for number, start in sorted(automaton.matches(text), key=lambda m: m[1]):
                line += text.count("\n", counted, start)
                counted = start
                wrong = automaton.entries[number]
                out += [(line, start, start + len(wrong), wrong, right) for right in rights[number]]
            return out
        return texts.map(of)

    found = docs.select("doc_id", F.explode_outer(find("text")).alias("i")).filter(F.col("i").isNotNull())
    return found.select("doc_id", "i.line", F.lit("error").alias("type"), F.lit(tx.DEFAULT_CATEGORY).alias("category"),
                        "i.start", "i.end", F.col("i.wrong").alias("original"), F.col("i.right").alias("suggestion"))
