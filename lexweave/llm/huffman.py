"""Token ids in binary files: canonical length-limited Huffman codes from global counts, decoded by table in blocks.

1. `token_ids`: ids of every whole text, by the public tokenizer's own library. White space never lies inside a piece of
   this vocabulary, so words are coded once a worker and looked up by a 64-bit hash afterwards.
2. `id_counts`: how often every id occurs in all rows; at most one row per vocabulary entry.
3. `code_lengths`: the best code lengths of at most `limit` bits (package-merge); codes follow from lengths alone.
4. `write_files`: rows in ascending order, one file of blocks per range of rows. A block holds at most `BLOCK_TOKENS` ids
   and can be decoded without any other: a header (documents, their id counts, where the block begins in its file),
   the bit offset of every `STRIDE`th id, a checksum and the coded bits. A document longer than what is left of a block
   goes on in the next one.
5. `documents_of`: every block is decoded by one table of 2 ** longest entries, all checkpoints in step. A document's
   pieces give its length and its CRC-32, which are joined without its ids ever meeting in one place.

The book of lengths is a table of one row beside the blocks; blocks lie in a column of a Parquet table, so any store that
Spark can write holds them and a lost task is written anew.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm.batches import flat, slices, span_hashes, spans
from lexweave.llm.store import bases
from lexweave.scale import bounded_broadcast

VOCABULARY = "word_bpe_49k.json"
END = 1
LIMIT = 20
BLOCK_TOKENS = 1 << 18
STRIDE = 256
POOL_IDS = 8 << 20
_MAGIC = b"LWH1"
#: magic, documents, ids, checkpoints, flags (1: the first document began before), first document and first id in the file,
#: CRC-32 of the coded words.
_HEAD = struct.Struct("<4sIIIIQQI")

_loaded: dict = {}


class Coder:
    """The tokenizer of a file, with a table of whole words: 64-bit hash, place and number of their ids in one pool."""

    BITS = 21

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pool = np.zeros(POOL_IDS, self.kind)
        self.clear()

    def clear(self) -> None:
        self.held = np.zeros(1 << self.BITS, np.uint64)
        self.place = np.zeros(1 << self.BITS, np.int32)
        self.count = np.zeros(1 << self.BITS, np.int32)
        self.used = 0

    def _code(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        ids, counts = [], []
        for at in range(0, len(words), 4096):
            for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[at:at + 4096]], add_special_tokens=False):
                found = e.ids
                ids += found
                counts.append(len(found))
        return np.array(ids, self.kind), np.array(counts, np.int64)

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text (null: empty), each followed by END."""
        data, offsets = flat(texts)
        starts, ends, first = spans(data, offsets)
        keys = span_hashes(data, starts, ends) | np.uint64(1)
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        place, count = self.place[slot].astype(np.int64), self.count[slot].astype(np.int64)
        missed = np.flatnonzero(self.held[slot] != keys)
        pool = self.pool
        if len(missed):
            _, one, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            one = missed[one]
            raw = data.tobytes()
            ids, counts = self._code([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())])
            begins = np.cumsum(counts) - counts
            if self.used + len(ids) <= len(pool):
                pool[self.used:self.used + len(ids)] = ids
                begins += self.used
                self.used += len(ids)
                self.held[slot[one]] = keys[one]
                self.place[slot[one]] = begins
                self.count[slot[one]] = counts
                full = False
            else:  # this batch is answered from a longer copy; the table starts anew
                pool = np.concatenate([pool[:self.used], ids])
                begins += self.used
                full = True
            place[missed], count[missed] = begins[back], counts[back]
            if full:
                self.clear()
        # Every text ends with one more id.
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        until = np.cumsum(count)
        out = np.full((int(until[-1]) if len(until) else 0) + len(offsets) - 1, END, self.kind)
        into = until - count + doc
        moves = np.arange(len(out) - (len(offsets) - 1)) - np.repeat(until - count, count)
        out[np.repeat(into, count) + moves] = pool[np.repeat(place, count) + moves]
        done = np.concatenate([[0], until])[first[1:]] + np.arange(1, len(offsets))
        packed, size = out.tobytes(), self.kind.itemsize
        return [packed[a * size:b * size] for a, b in zip([0, *done[:-1].tolist()], done.tolist())]


def coder(path: str) -> Coder:
    if path not in _loaded:
        _loaded[path] = Coder(path)
    return _loaded[path]


def width(path: str) -> int:
    """Bytes an id takes before it is coded."""
    return coder(path).kind.itemsize


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): little-endian unsigned integers of `width` bytes, END last. Null and empty texts: END alone."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = code.batch(part["text"])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids binary")


def id_counts(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, n) over all rows of (doc_id, ids); each task sends one row per id it saw."""
    kind = np.dtype(f"<u{width(path or public_tokenizers.path(VOCABULARY))}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                found = np.bincount(np.frombuffer(b"".join(part["ids"].to_pylist()), kind))
                if len(found) > len(total):
                    total, found = found, total
                total[:len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids].astype(np.int64))], ["id", "n"])

    return coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of every symbol's code: the least total for these counts with no code over `limit` bits; 0 for count 0.

    Package-merge: in each of `limit` turns the packages, pairs of the last turn's list, are merged with the symbols. The
    first 2n - 2 entries of the last list hold every symbol as often as its code is long.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    listed, leaves = weights, []
    leaves.append(np.ones(n, bool))
    for _ in range(limit - 1):
        packages = listed[:len(listed) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        turn = np.argsort(both, kind="stable")
        listed = both[turn]
        leaves.append(turn < n)
    length = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(leaves):
        alone = int(is_leaf[:take].sum())
        length[:alone] += 1
        take = 2 * (take - alone)
        if not take:
            break
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of every symbol with a length: ascending by (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    count = np.bincount(lengths, minlength=1)
    for bits in range(1, len(count)):
        code <<= bits - last
        last = bits
        symbols = np.flatnonzero(lengths == bits)
        codes[symbols] = code + np.arange(len(symbols), dtype=np.uint64)
        code += len(symbols)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(table, longest): for any `longest` bits the symbol they begin with (times 64) plus its length."""
    longest = int(lengths.max()) if len(lengths) else 0
    table = np.zeros(1 << longest, np.int64)
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    filled = np.repeat(symbols.astype(np.int64) << 6 | lengths[symbols], 1 << (longest - lengths[symbols].astype(np.int64)))
    table[:len(filled)] = filled
    return table, longest


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): the coded ids in big-endian 32-bit words, and the bit at which every `stride`th id begins."""
    bits = lengths[ids].astype(np.int64)
    at = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(bits, out=at[1:])
    begin = at[:-1]
    placed = codes[ids] << (64 - (begin & 31) - bits).astype(np.uint64)
    word = begin >> 5
    n = int(at[-1] + 31 >> 5)
    # Codes never overlap, so sums are unions; every sum is below 2 ** 32 and exact.
    high = np.bincount(word, (placed >> np.uint64(32)).astype(np.float64), n + 1)
    low = np.bincount(word + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)
    return (high + low)[:n].astype(">u4"), begin[::stride].astype("<u4")


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, table: np.ndarray, longest: int, stride: int = STRIDE) -> np.ndarray:
    """The n ids of a block; all checkpoints step through their ids together."""
    padded = np.zeros(len(words) + 2, np.uint64)
    padded[:len(words)] = words
    pair = padded[:-1] << np.uint64(32) | padded[1:]
    at, last = offsets.astype(np.int64), len(pair) - 1
    out = np.empty((stride, len(at)), np.uint32)
    mask = np.uint64((1 << longest) - 1)
    for k in range(min(stride, n)):
        window = pair[np.minimum(at >> 5, last)] >> (64 - longest - (at & 31)).astype(np.uint64) & mask
        entry = table[window.astype(np.int64)]
        out[k] = entry >> 6
        at = at + (entry & 63)
    return out.T.ravel()[:n] if n >= stride else out[:n].T.ravel()[:n]


def block_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, first: int, start: int, goes_on: bool,
                codes: np.ndarray, lengths: np.ndarray) -> bytes:
    words, offsets = pack(ids, codes, lengths)
    raw = words.tobytes()
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([_HEAD.pack(_MAGIC, len(doc_ids), len(ids), len(offsets), int(goes_on), first, start, zlib.crc32(raw)),
                     np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), raw])


class Block:
    """The parts of a block's bytes; raises ValueError on anything that is not one."""

    def __init__(self, data: bytes):
        if len(data) < _HEAD.size or data[:4] != _MAGIC:
            raise ValueError("not a block of coded ids")
        _, docs, self.n, marks, flags, self.first, self.start, check = _HEAD.unpack_from(data)
        at, parts = _HEAD.size, []
        for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", marks)):
            end = at + np.dtype(kind).itemsize * count
            parts.append(np.frombuffer(data[at:end], kind))
            at = end
        if zlib.crc32(data[at:]) != check:
            raise ValueError("damaged block of coded ids")
        self.doc_ids, self.known, self.counts, self.offsets = parts
        self.goes_on = bool(flags & 1)
        self.words = np.frombuffer(data, ">u4", offset=at)

    def ids(self, table: np.ndarray, longest: int) -> np.ndarray:
        return unpack(self.words, self.offsets, self.n, table, longest)


def blocks(ordered: DataFrame, lengths: np.ndarray, kind: np.dtype, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens, data) of rows (doc_id, ids) that are in order; a file is a partition."""
    shared = ordered.sparkSession.sparkContext.broadcast((canonical(lengths), lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = shared.value
        file, block, start, first, goes_on = TaskContext.get().partitionId(), 0, 0, 0, False
        docs, counts, parts, held = [], [], [], 0

        def full(unfinished: bool) -> pa.RecordBatch:
            nonlocal block, start, first, goes_on, docs, counts, parts, held
            data = block_bytes(docs, counts, np.concatenate(parts), first, start, goes_on, codes, lengths)
            row = pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())],
                                             ["file", "block", "tokens", "data"])
            block, start, first, goes_on = block + 1, start + held, first + len(docs) - unfinished, unfinished
            docs, counts, parts, held = [], [], [], 0
            return row

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), batch["ids"]):
                left = np.frombuffer(ids.as_buffer(), kind)
                while len(left):
                    some = left[:block_tokens - held]
                    left = left[len(some):]
                    docs.append(doc_id), counts.append(len(some)), parts.append(some)
                    held += len(some)
                    if held == block_tokens:
                        yield full(len(left) > 0)
        if held:
            yield full(False)

    return ordered.select("doc_id", "ids").mapInArrow(run, "file int, block long, tokens long, data binary")


def write_files(coded: DataFrame, folder: str, path: str | None = None, limit: int = LIMIT, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write (doc_id, ids) below `folder`: `book` with the code lengths and `blocks` with the coded ids.

    Rows go in ascending order of doc_id (null first), those of one doc_id by a hash of their ids. `coded` is read
    three times, so it should be a stored table.
    """
    spark, path = coded.sparkSession, path or public_tokenizers.path(VOCABULARY)
    kind = np.dtype(f"<u{width(path)}")
    found = id_counts(coded, path).toArrow()
    counts = np.zeros(int(max(found["id"].to_pylist(), default=-1)) + 1, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    lengths = code_lengths(counts, limit)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.option("compression", "zstd").parquet(f"{folder}/book")
    # Rows that are equal in all else are told apart by where they lay, so that even they spread over ranges.
    order = ["doc_id", F.xxhash64("ids"), F.monotonically_increasing_id()]
    ranged = coded.select("doc_id", "ids", order[1].alias("_tie"), order[2].alias("_at")).repartitionByRange("doc_id", "_tie", "_at")
    blocks(ranged.sortWithinPartitions("doc_id", "_tie", "_at"), lengths, kind, block_tokens).write.option("compression", "zstd").parquet(f"{folder}/blocks")


def read_book(spark: SparkSession, folder: str) -> np.ndarray:
    return np.frombuffer(bytes(spark.read.parquet(f"{folder}/book").first()["lengths"]), np.uint8)


def decoded(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    """(file, block, ordinal, doc_id, at, ids): each document's part of each block, ids as unsigned 32-bit integers."""
    return _decoded(blocks, lengths, lambda ids: ids.astype("<u4").tobytes(), "ids binary", pa.binary())


def _decoded(blocks: DataFrame, lengths: np.ndarray, convert, column: str, kind: pa.DataType) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(lengths)
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            if table is None:
                table, longest = decoding_table(shared.value)
            for file, number, data in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), batch["data"]):
                held = Block(data.as_py())
                ids = held.ids(table, longest)
                ends = np.cumsum(held.counts.astype(np.int64))
                begins = ends - held.counts
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.int32()), pa.array([number] * n, pa.int64()), pa.array(held.first + np.arange(n, dtype=np.int64)),
                     pa.array(held.doc_ids.astype(np.int64), mask=held.known == 0), pa.array(held.start + begins),
                     pa.array(held.counts.astype(np.int64)), pa.array([convert(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())], kind)],
                    ["file", "block", "ordinal", "doc_id", "at", "n", name])

    return blocks.select("file", "block", "data").mapInArrow(run, f"file int, block long, ordinal long, doc_id long, at long, n long, {column}")


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two reflected polynomials modulo that of CRC-32."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc32(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two runs of bytes after another, from their own and the length of the second."""
    shift, square, bits = 1 << 31, 1 << 30, 8 * n_bytes
    while bits:
        if bits & 1:
            shift = _times(shift, square)
        square = _times(square, square)
        bits >>= 1
    return _times(shift, first) ^ second


@F.pandas_udf(T.LongType())
def _crc_of_parts(crcs: pd.Series, counts: pd.Series) -> pd.Series:
    def whole(crc, n):
        total = int(crc[0])
        for part, ids in zip(crc[1:], n[1:]):
            total = joined_crc32(total, int(part), 4 * int(ids))
        return total
    return pd.Series([whole(c, n) for c, n in zip(crcs, counts)], dtype="int64")


def documents_of(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files; start counts all ids before it, over all files."""
    parts = _decoded(blocks, lengths, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "crc long", pa.int64())
    one = F.struct("block", "doc_id", "at", "n", "crc")
    whole = parts.groupBy("file", "ordinal").agg(F.array_sort(F.collect_list(one)).alias("parts"))
    n = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    first = F.get("parts", F.lit(0))
    crc: Column = F.when(F.size("parts") == 1, first["crc"]).otherwise(_crc_of_parts("parts.crc", "parts.n"))
    base = bounded_broadcast(bases(blocks.groupBy("file").agg(F.sum("tokens").alias("tokens")), "file", "tokens", "base"), 1_000_000)
    return (whole.select("file", first["doc_id"].alias("doc_id"), first["at"].alias("at"), n.alias("n_tokens"), crc.alias("ids_crc32"))
            .join(base, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))
