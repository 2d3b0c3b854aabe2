"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces (forward algorithm); a text's is the product over its words. Words are runs of ASCII
letters (lowered) and non-ASCII characters, led by a blank, of any length: the forward state of the last bytes is carried on
and rescaled, so no word and no piece of the vocabulary is cut.

The piece probabilities are fitted by expectation maximisation on at most `docs_per_lang` whole labelled texts a
language (the least hashes of doc_id), which is the documented bound of the classifier's sample. Expected counts of words
beyond `FIT_BYTES` bytes are taken in blocks of whole characters; scores never are.

Beside the languages stands one that uses all pieces alike. A text is `likely` if its best language explains its words
better than that one does: random letters and scripts that no learned language uses have no such language.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.batches import LOWER_CODES, flat, mix, slices, span_hashes, spans
from lexweave.scale import bounded_broadcast, top_k

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
DOCS_PER_LANG = 400
EM_ROUNDS = 4
FIT_BYTES = 48
SHORT_BYTES = 64
LANES, COLUMNS, RESCALE = 64, 256, 16
SMOOTH = 0.05
UNKNOWN = "und"
MAX_LANGS = 200
_APART = np.ones(256, bool)
_APART[65:91] = _APART[97:123] = _APART[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.Generator(np.random.PCG64(6))
_CODES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class Pieces:
    """The vocabulary's pieces, found by their hash in one of two tables."""

    BITS = 21

    def __init__(self, path: str):
        held = {base64.b64decode(line.split()[0]).lower() for line in open(path, "rb") if line.strip()}
        held |= {bytes([b]) for b in range(256)}
        self.pieces = held = sorted(held)
        self.longest = max(map(len, held))
        keys = np.array([self._hash(p) for p in held], np.uint64)
        self.keys = keys
        self.tables = []
        left = np.arange(len(keys))
        for turn in range(2):
            slot = self._slot(keys[left], turn)
            table = np.full(1 << self.BITS, -1, np.int32)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]
        self.rest = {int(keys[i]): int(i) for i in left}

    @staticmethod
    def _hash(piece: bytes) -> int:
        return int(sum(int(_CODES[b]) * int(_PLACE[k]) for k, b in enumerate(piece)) + len(piece)) & ((1 << 64) - 1)

    def _slot(self, keys: np.ndarray, turn: int) -> np.ndarray:
        factor = np.uint64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)[turn])
        return ((keys ^ (keys >> np.uint64(29))) * factor >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each hashed piece, or the number of pieces where there is none."""
        found = np.full(keys.shape, len(self.keys), np.int32)
        for turn in range(2):
            at = self.tables[turn][self._slot(keys, turn)]
            hit = (at >= 0) & (self.keys[at] == keys)
            found[hit] = at[hit]
        for key, at in self.rest.items():
            found[keys == np.uint64(key)] = at
        return found


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _lattice(words: np.ndarray, book: Pieces) -> list[np.ndarray]:
    """For k = 1..longest the piece index of the k bytes from every position of the byte matrix `words`."""
    codes = _CODES[words]
    out, h = [], np.zeros(words.shape, np.uint64)
    for k in range(1, min(book.longest, words.shape[1]) + 1):
        width = words.shape[1] - k + 1
        h = h[:, :width] + codes[:, k - 1:] * _PLACE[k - 1]
        out.append(book.find(h + np.uint64(k)))
    return out


def forward(words: np.ndarray, book: Pieces, prob: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """log probability (rows: words, columns: languages); prob is (pieces + 1, languages), last row 0.

    Words stand in the first `lengths` bytes of their rows (all bytes, if none are given). The sums over all segmentations
    of the first bytes are kept for the last `longest` places only, and are rescaled as they shrink.
    """
    n, width = words.shape
    lengths = np.full(n, width) if lengths is None else lengths
    span = book.longest
    window = np.zeros((span, n, prob.shape[1]))
    window[0] = 1
    scale, out = np.zeros(n), np.zeros((n, prob.shape[1]))
    for begin in range(0, width, COLUMNS):
        low = max(0, begin - span + 1)
        found = _lattice(words[:, low:begin + COLUMNS], book)
        for end in range(begin + 1, min(width, begin + COLUMNS) + 1):
            total = np.zeros((n, prob.shape[1]))
            for k in range(1, min(span, end) + 1):
                total += window[(end - k) % span] * prob[found[k - 1][:, end - k - low]]
            window[end % span] = total
            at_end = lengths == end
            if at_end.any():
                out[at_end] = np.log(np.maximum(total[at_end], 1e-300)) + scale[at_end, None]
            if end % RESCALE == 0:
                most = window.max(axis=(0, 2))
                most[most <= 0] = 1
                window /= most[None, :, None]
                scale += np.log(most)
    return out


def _by_length(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: int = 1, block: int = 8192):
    """(indices, byte matrix, led by a blank if `lead` is 1) for runs of equal length, at most `block` runs at a time."""
    lengths = ends - starts
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        for at in range(0, len(rows), block):
            some = rows[at:at + block]
            words = np.full((len(some), length + lead), 32, np.uint8)
            words[:, lead:] = _LOWER[data[starts[some, None] + np.arange(length)]]
            yield some, words


def word_logs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, book: Pieces, prob: np.ndarray) -> np.ndarray:
    """log probability of every run: short ones by equal lengths, long ones side by side in lanes of about equal length."""
    out = np.empty((len(starts), prob.shape[1]))
    lengths = ends - starts
    short = np.flatnonzero(lengths <= SHORT_BYTES)
    for some, words in _by_length(data, starts[short], ends[short]):
        out[short[some]] = forward(words, book, prob)
    long = np.flatnonzero(lengths > SHORT_BYTES)
    long = long[np.argsort(lengths[long], kind="stable")]
    for at in range(0, len(long), LANES):
        lanes = long[at:at + LANES]
        # Lanes of very different lengths are not padded to another.
        for some in np.split(lanes, np.flatnonzero(np.diff(np.floor(np.log2(lengths[lanes])))) + 1):
            words = np.full((len(some), int(lengths[some].max()) + 1), 32, np.uint8)
            for row, i in enumerate(some):
                words[row, 1:lengths[i] + 1] = _LOWER[data[starts[i]:ends[i]]]
            out[some] = forward(words, book, prob, lengths[some] + 1)
    return out


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter runs, and each text's first one."""
    return spans(data, offsets, _APART)


def fit_blocks(run: bytes) -> list[bytes]:
    """A run, led by a blank, in blocks of whole characters of at most FIT_BYTES bytes (more if one UTF-8 character is)."""
    run, out = b" " + run, []
    while len(run) > FIT_BYTES:
        at = FIT_BYTES
        while at > 1 and run[at] & 0xC0 == 0x80:
            at -= 1
        out.append(run[:at])
        run = run[at:]
    return [*out, run]


class Scorer:
    """Word log probabilities per language, kept in a direct-mapped table of fixed size."""

    BITS = 20

    def __init__(self, book: Pieces, prob: np.ndarray):
        self.book, self.prob = book, prob
        self.held = np.zeros(1 << self.BITS, np.uint64)
        self.logs = np.zeros((1 << self.BITS, prob.shape[1]), np.float32)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log probability of every text by every language."""
        starts, ends, first = runs(data, offsets)
        keys = span_hashes(data, starts, ends, LOWER_CODES) | np.uint64(1)
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        logs = self.logs[slot]
        missed = np.flatnonzero(self.held[slot] != keys)
        if len(missed):
            fresh, at, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            one = missed[at]
            values = word_logs(data, starts[one], ends[one], self.book, self.prob).astype(np.float32)
            logs[missed] = values[back]
            self.held[slot[one]] = fresh
            self.logs[slot[one]] = values
        sums = np.zeros((len(keys) + 1, logs.shape[1]))
        np.cumsum(logs, axis=0, out=sums[1:], dtype=np.float64)
        return sums[first[1:]] - sums[first[:-1]]


def _fit(book: Pieces, words: list[bytes], counts: np.ndarray, rounds: int) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation over all segmentations."""
    size = len(book.pieces)
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - np.array([len(w) for w in words])
    prob = np.zeros(size + 1)
    prob[:size] = 1.0 / size
    for turn in range(rounds):
        expected = np.zeros(size + 1)
        for some, chars in _by_length(data, starts, ends, lead=0):
            found = _lattice(chars, book)
            n, width = chars.shape
            weights = counts[some]
            alpha, beta = np.zeros((width + 1, n)), np.zeros((width + 1, n))
            alpha[0], beta[width] = 1, 1
            for end in range(1, width + 1):
                for k in range(1, min(book.longest, end) + 1):
                    alpha[end] += alpha[end - k] * prob[found[k - 1][:, end - k]]
            for at in range(width - 1, -1, -1):
                for k in range(1, min(book.longest, width - at) + 1):
                    beta[at] += beta[at + k] * prob[found[k - 1][:, at]]
            total = np.maximum(alpha[width], 1e-300)
            for k in range(1, min(book.longest, width) + 1):
                share = alpha[:width - k + 1] * prob[found[k - 1].T] * beta[k:] / total * weights
                np.add.at(expected, found[k - 1].T.ravel(), share.ravel()) if share.size < 1000 else expected.__iadd__(
                    np.bincount(found[k - 1].T.ravel(), share.ravel(), size + 1))
        expected[size] = 0
        prob[:size] = (expected[:size] + SMOOTH) / (expected.sum() + SMOOTH * size)
    return prob[:size]


def held_out(id_col: str) -> Column:
    """True for the quarter of documents that no model may learn from; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """Languages in code-point order and their piece probabilities."""

    names: list[str]
    prob: np.ndarray

    def table(self) -> np.ndarray:
        """Probabilities by piece and language, the last of which uses all pieces alike; a last row of zeros for what is no piece."""
        size = self.prob.shape[1]
        return np.vstack([np.hstack([self.prob.T, np.full((size, 1), 1 / size)]), np.zeros((1, len(self.names) + 1))])


def fit(docs: DataFrame, path: str | None = None, docs_per_lang: int = DOCS_PER_LANG, rounds: int = EM_ROUNDS,
        max_langs: int = MAX_LANGS) -> Model:
    """The model of the labelled rows that are not held out.

    It has one number per language and vocabulary piece, whatever the size of `docs`. More than `max_langs` different
    labels are an error: every worker holds all languages.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    labels = rows.select("lang").distinct().limit(max_langs + 1).count()
    if labels > max_langs:
        raise ValueError(f"more than {max_langs} different labels")
    chosen = top_k(rows.select("doc_id", "lang").distinct(), ["lang"], [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], docs_per_lang)
    sample = rows.select("doc_id", "lang", "text").join(bounded_broadcast(chosen.select("doc_id", "lang"), 100_000), ["doc_id", "lang"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part["text"])
                starts, ends, first = runs(data, offsets)
                names = part["lang"].to_pylist()
                text = _LOWER[data].tobytes()
                tally: dict[tuple[str, bytes], int] = {}
                for name, a, b in zip(names, first[:-1].tolist(), first[1:].tolist()):
                    for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist()):
                        for block in fit_blocks(text[s:e]):
                            tally[(name, block)] = tally.get((name, block), 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.binary()), pa.array(list(tally.values()), pa.int64())],
                    ["lang", "word", "n"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("word")
        prob = _fit(pieces(path), [bytes(w) for w in group["word"]], group["n"].to_numpy(float), rounds)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "prob": [prob.tolist()]})

    tally = sample.select("lang", "text").mapInArrow(words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    models = sorted(tally.groupBy("lang").applyInPandas(learn, "lang string, prob array<double>").collect(), key=lambda r: r["lang"])
    return Model([r["lang"] for r in models], np.array([r["prob"] for r in models]).reshape(len(models), -1 if models else 0))


def identify(docs: DataFrame, model: Model, keep: list[str], path: str | None = None) -> DataFrame:
    """`keep` columns of docs, lang_pred, score (posterior under equal priors) and likely (false for what is no text of it).

    Null text, text without a letter, or a model without languages: `und` with score 0, not likely. Ties go to the first language
    in code-point order. Repeated rows get equal answers. Only `text` is looked at.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = shared.value, shared.value.names
        scorer = Scorer(pieces(path), model.table()) if names else None
        for batch in batches:
            for part in slices(batch, "_text"):
                letters = part["_letters"].to_numpy(zero_copy_only=False).astype(bool)
                if scorer is None:
                    told, score, likely = [UNKNOWN] * len(letters), np.zeros(len(letters)), np.zeros(len(letters), bool)
                else:
                    logs = scorer.texts(*flat(part["_text"]))
                    logs, alike = logs[:, :-1], logs[:, -1]
                    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                    best, score = odds.argmax(axis=1), np.where(letters, 1 / odds.sum(axis=1), 0.0)
                    told = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
                    likely = letters & (logs.max(axis=1) > alike)
                yield pa.RecordBatch.from_arrays([*[part[f"_k{i}"] for i in range(len(keep))], pa.array(told, pa.string()), pa.array(score), pa.array(likely)],
                                                 [*keep, "lang_pred", "score", "likely"])

    inner = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("_text"),
                        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return inner.mapInArrow(predict, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "lang_pred string", "score double", "likely boolean"]))
