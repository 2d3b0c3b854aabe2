"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the ledger stores its measurement and one failure bit. Policies are versions of
a mask over these bits and are applied to the stored bits; ablations (what a policy would keep without one of its rules)
come from the bit patterns' counts, so neither needs the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.batches import counts_between, flat, mix, slices, span_hashes, spans

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_ellipsis_lines",
            "n_bullet_lines", "max_word_repeat"]


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails` (SQL over the measures) is true; its place in the list is its bit."""
    name: str
    fails: str


#: Bits are given by place: append rules, never reorder them.
RULES = [
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule("few_letter_words", "10 * n_letter_words < 5 * n_words"),
    Rule("ellipsis_lines", "10 * n_ellipsis_lines > 5 * n_lines"),
    Rule("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    Rule("one_word_dominates", "10 * max_word_repeat > 5 * n_words"),
    Rule("too_many_words", "n_words > 1000000"),
]
BASE = ["too_few_words", "repeated_windows"]
#: Version -> the rules whose failure rejects a document.
POLICIES = {
    1: BASE,
    2: [*BASE, "short_words", "long_words", "symbols", "few_letter_words"],
    3: [r.name for r in RULES if r.name != "too_many_words"],
}
CURRENT = 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FACTORS = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each key occurs, and whether an equal key stands before it."""
    order = np.argsort(keys, kind="stable")
    same = np.r_[False, keys[order][1:] == keys[order][:-1]] if len(keys) else np.zeros(0, bool)
    group = np.cumsum(~same) - 1
    often, again = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    often[order] = np.bincount(group)[group] if len(keys) else 0
    again[order] = same
    return often, again


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = flat(part["text"])
            docs = len(offsets) - 1
            starts, ends, first = spans(data, offsets)
            n_words = np.diff(first)
            doc = np.repeat(np.arange(docs), n_words)
            salt = mix(np.arange(docs).astype(np.uint64) + np.uint64(1))
            words = span_hashes(data, starts, ends)
            own = words ^ salt[doc]

            # Code points are the bytes that do not continue a character.
            points = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=points[1:])
            letters = np.zeros(len(data) + 1, np.int64)
            np.cumsum(_LETTER[data], out=letters[1:])
            inner = np.r_[0, np.cumsum(points[ends] - points[starts])]
            letter = np.r_[0, np.cumsum(letters[ends] > letters[starts])]

            windows = np.zeros(max(0, len(words) - 2), np.uint64)
            for k in range(3):
                windows += words[k:k + len(windows)] * _FACTORS[k]
            whole = doc[2:] == doc[:-2] if len(doc) > 2 else np.zeros(0, bool)
            at = np.flatnonzero(whole)
            often, _ = _repeats(mix(windows[at]) ^ salt[doc[at]])
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[at[often > 1] + k] = True
            repeated = np.r_[0, np.cumsum(covered)]
            word_often, _ = _repeats(own)
            top = np.maximum.reduceat(np.r_[word_often, 0], np.minimum(first[:-1], len(word_often))) if docs else np.zeros(0, np.int64)
            top = np.where(n_words > 0, top, 0)

            # Lines: a line belongs to the text in which it starts; only lines with a word count.
            breaks = np.flatnonzero(data == 10)
            line_starts = np.sort(np.r_[offsets[:-1], breaks + 1])
            line_docs = np.sort(np.r_[np.arange(docs), np.searchsorted(offsets, breaks, side="right") - 1])
            line_ends = np.minimum(np.r_[line_starts[1:] - 1, len(data)], len(data))
            last = np.r_[line_docs[1:] != line_docs[:-1], True] if len(line_docs) else np.zeros(0, bool)
            line_ends[last] = offsets[line_docs[last] + 1]
            head, tail = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
            held = tail > head
            a, b, owner = line_starts[held], line_ends[held], line_docs[held]
            _, again = _repeats(span_hashes(data, a, b) ^ salt[owner])
            opening, closing = data[starts[head[held]]] if held.any() else a, ends[tail[held] - 1] if held.any() else b
            bullet = np.isin(opening, [ord("-"), ord("*")]) | ((opening == 0xE2) & (data[np.minimum(starts[head[held]] + 2, len(data) - 1)] == 0xA2) if held.any() else False)
            dots = np.zeros(len(a), bool)
            for i in np.flatnonzero(closing - a >= 3) if len(a) else []:
                tail3 = data[closing[i] - 3:closing[i]].tobytes()
                dots[i] = tail3 in (b"...", b"\xe2\x80\xa6")
            per = lambda flags: np.bincount(owner, flags, docs).astype(np.int64) if len(owner) else np.zeros(docs, np.int64)
            values = [n_words, inner[first[1:]] - inner[first[:-1]], counts_between(_SYMBOL[data], offsets), per(np.ones(len(owner))), per(again),
                      repeated[first[1:]] - repeated[first[:-1]], letter[first[1:]] - letter[first[:-1]], per(dots), per(bullet), top]
            yield pa.RecordBatch.from_arrays([part["key"], *[pa.array(np.asarray(v, np.int64)) for v in values]], ["key", *MEASURES])


def ledger(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, measures, failed): every rule evaluated once; bit i of `failed` is set where rule i fails.

    Null and empty texts have all measures 0. Repeated rows and repeated or null keys get a row each. Other columns are not looked at.
    """
    kind = docs.schema[key].dataType.simpleString()
    measured = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(
        _measure, f"key {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)), F.lit(0).cast("long"))
    return measured.withColumn("failed", bits).withColumnRenamed("key", key)


def mask(names: list[str]) -> int:
    place = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << place[n] for n in names)


def passes(version: int, failed: str = "failed") -> Column:
    """Whether a ledger row passes a policy version."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0


def ablations(rows: DataFrame) -> DataFrame:
    """(version, rule, kept, kept_without): per policy and rule, documents kept, and kept if that rule were left out.

    Documents are first counted per bit pattern, of which there are at most 2 ** len(RULES), whatever the table's size.
    """
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    cases = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(name).alias("rule"), F.lit(mask(names)).cast("long").alias("all"),
                               F.lit(mask(names) & ~mask([name])).cast("long").alias("rest")) for v, names in POLICIES.items() for name in names])
    spread = patterns.select("failed", "n", F.explode(cases).alias("c"))
    count = lambda bits: F.sum(F.when(F.col("failed").bitwiseAND(bits) == 0, F.col("n")).otherwise(0)).cast("long")
    return spread.groupBy("c.version", "c.rule").agg(count(F.col("c.all")).alias("kept"), count(F.col("c.rest")).alias("kept_without"))
