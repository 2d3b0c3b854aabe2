"""Token counts of the documents in flat, unindexed token files, found by their end-of-document identifiers.

A token file is a run of little-endian unsigned 16-bit ids without an index; every document ends with `END`. Files are
held as tables of fixed-size blocks (file, block, data), so any block can be searched by any task. Each block is searched
for END in one vectorised comparison; a prefix scan over the blocks' summaries gives every block the number of documents
before it and the place where the document that runs into it began.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.batches import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The id after the vocabulary's last one, which no text encodes to.
END = 50256
BLOCK_BYTES = 1 << 18


_loaded: dict = {}


def encoder(path: str):
    """The public vocabulary's encoder, loaded once a worker; without special tokens, so their names are ordinary text."""
    if path not in _loaded:
        import tiktoken
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows of two kinds, one file per task: blocks (file, block, data) and, with null data, the file's document order.

    The ordinal rows (file, ordinal, doc_id) are what a data loader would have kept beside the file; the search does
    not read them. Texts that hold the separator's name are ordinary text. Null text: a document without tokens.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        file, block, ordinal, held = TaskContext.get().partitionId(), 0, 0, b""

        def rows(blocks: list[bytes], at: int, ids=None, first: int = 0) -> pa.RecordBatch:
            n, m = len(blocks), 0 if ids is None else len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * (n + m), pa.int32()), pa.array([*range(at, at + n), *[None] * m], pa.int64()), pa.array([*blocks, *[None] * m], pa.binary()),
                 pa.array([*[None] * n, *range(first, first + m)], pa.int64()), pa.array([*[None] * n, *(ids or [])], pa.int64())],
                ["file", "block", "data", "ordinal", "doc_id"])

        for batch in batches:
            for part in slices(batch, "text"):
                coded = [np.array([*encode(t or ""), END], "<u2").tobytes() for t in part["text"].to_pylist()]
                held = b"".join([held, *coded])
                cut = [held[i:i + BLOCK_BYTES] for i in range(0, len(held) - BLOCK_BYTES + 1, BLOCK_BYTES)]
                held = held[len(cut) * BLOCK_BYTES:]
                yield rows(cut, block, part["doc_id"].to_pylist(), ordinal)
                block, ordinal = block + len(cut), ordinal + part.num_rows
        if held:
            yield rows([held], block)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        write, "file int, block long, data binary, ordinal long, doc_id long")


def blocks_of(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, data) of whole files as Spark's binaryFile reader gives them (path, content)."""
    count = F.ceil(F.octet_length("content") / block_bytes).cast("int")
    return (files.select(F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).alias("block"))
            .select("file", F.col("block").cast("long").alias("block"), F.substring("content", F.col("block") * block_bytes + 1, F.lit(block_bytes)).alias("data")))


def scanned(blocks: DataFrame, end: int = END) -> DataFrame:
    """(file, block, tokens, ends): the length of every block in tokens and the places of END in it."""
    kind = blocks.schema["file"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(v.as_py() or b"", "<u2") for v in batch["data"]]
            yield pa.RecordBatch.from_arrays(
                [batch["file"], batch["block"], pa.array([len(v) for v in found], pa.int64()),
                 pa.array([np.flatnonzero(v == end) for v in found], pa.list_(pa.int64()))], ["file", "block", "tokens", "ends"])

    return blocks.select("file", "block", "data").mapInArrow(search, f"file {kind}, block long, tokens long, ends array<long>")


def document_counts(blocks: DataFrame, end: int = END) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document, in tokens of its file; END itself is not counted.

    Tokens after a file's last END belong to no document. An empty document has 0 tokens; a file without END has none.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = scanned(blocks, end)
    offset = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    placed = local.withColumn("offset", offset)
    stitched = (placed.withColumn("last", F.when(F.size("ends") > 0, F.col("offset") + F.element_at("ends", -1)))
                .withColumn("documents", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
                .withColumn("carried", F.coalesce(F.max("last").over(before), F.lit(-1))))
    begin = lambda i: F.when(i == 0, F.col("carried")).otherwise(F.col("offset") + F.get("ends", i - 1)) + 1
    found = F.transform("ends", lambda at, i: F.struct((F.col("documents") + i).alias("ordinal"), begin(i).alias("start"), (F.col("offset") + at - begin(i)).alias("n_tokens")))
    return stitched.select("file", F.explode(found).alias("d")).select("file", "d.ordinal", "d.start", "d.n_tokens")
