"""Byte-level BPE: encoding with a priority queue of merge ranks over a doubly linked symbol list, and decoding.

The file is a public tokenizer's JSON (vocabulary, merges, added tokens). Texts are cut at added tokens, then by the
public pattern; each piece's bytes become symbols of a linked list, and the queue gives the next merge by rank, then
place. Entries whose symbols have changed since are stale and skipped.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.batches import slices

VOCABULARY = "byte_bpe_50k.json"
CACHE = 300_000
#: White space of the pattern: the Unicode property, which Python's own \s extends.
_BLANK = "".join(re.escape(chr(c)) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_PATTERN = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{_BLANK}").replace(r"\S", f"[^{_BLANK}]").replace(r"\s", f"[{_BLANK}]")
#: A blank next to other white space, or at an end: such texts are not cut at single blanks.
_UNEVEN = re.compile(f"^ | $|[{_BLANK}] | [{_BLANK}]")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next beyond 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Bpe:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items()}
        self.texts = [b""] * (1 + max([*vocabulary.values(), *[t["id"] for t in spec["added_tokens"]]]))
        for token, at in vocabulary.items():
            self.texts[at] = bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, at in self.added.items():
            self.texts[at] = content.encode()
        self.cut = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.single = [vocabulary[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        #: left id, right id -> rank and merged id, packed.
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocabulary[left] << 32 | vocabulary[right], (rank, vocabulary[left + right]))
        self.find = regex.compile(_PATTERN).findall
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        symbols = [self.single[b] for b in piece]
        n = len(symbols)
        if n < 2:
            return symbols
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get(symbols[i] << 32 | symbols[i + 1])
            if found:
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, merged = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = merges.get(symbols[i] << 32 | symbols[j])
            if not found or found[0] != rank:
                continue  # stale: one of its symbols has merged since
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get(merged << 32 | symbols[k])
                if found:
                    heapq.heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get(symbols[h] << 32 | merged)
                if found:
                    heapq.heappush(queue, (found[0], h, found[1]))
        return [s for s in symbols if s >= 0]

    def _piece(self, piece: str) -> bytes:
        packed = self.pieces.get(piece)
        if packed is None:
            packed = np.array(self.merge(piece.encode()), "<u4").tobytes()
            if len(piece) < 100:
                if len(self.pieces) >= CACHE:
                    self.pieces.clear()
                self.pieces[piece] = packed
        return packed

    def _word(self, word: str) -> bytes:
        packed = b"".join(map(self._piece, self.find(word)))
        if len(word) < 100:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        if _UNEVEN.search(text):
            return b"".join(map(self._piece, self.find(text)))
        # Each blank between two other characters starts a piece, so words with their blank are independent.
        first, *rest = text.split(" ")
        get, out = self.words.get, []
        for word in [first, *[" " + w for w in rest]]:
            packed = get(word)
            out.append(self._word(word) if packed is None else packed)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text) if text else b""
        return b"".join(np.array([self.added[part]], "<u4").tobytes() if part in self.added else self._plain(part)
                        for part in self.cut.split(text) if part)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _mapped(df: DataFrame, source: str, name: str, kind: str, column: pa.DataType, convert) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_in"):
                values = [convert(v.as_py()) for v in part["_in"]]
                yield pa.RecordBatch.from_arrays([part["_row"], pa.array(values, column)], ["_row", "_out"])

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != name]).alias("_row"), F.col(f"`{source}`").alias("_in"))
    out = rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, _out {kind}")
    return out.select("_row.*", F.col("_out").alias(name))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with a column `ids` (little-endian unsigned 32-bit integers; null text: no ids), replacing one of that name."""
    path = path or public_tokenizers.path(VOCABULARY)
    return _mapped(df.withColumn(text, F.col(text).cast("string")), text, ids, "binary", pa.binary(), lambda v: bpe(path).encode(v) if v else b"")


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """df with a column `text`: the vocabulary's bytes of all ids in a row, read as UTF-8 (null ids: empty text)."""
    path = path or public_tokenizers.path(VOCABULARY)
    return _mapped(df, ids, text, "string", pa.string(), lambda v: bpe(path).decode(v) if v else "")


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
