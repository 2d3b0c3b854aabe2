"""Line deduplication by a log-template tree.

Lines are parsed to a fixed depth: a leaf is a token count and the first `DEPTH` tokens, where a token with a digit is a
variable field. The distinct lines of a leaf are gathered into templates by leaders: two lines are similar if they differ in
at most one of `APART` places. Places are dealt into classes, one more than two similar lines may differ in, so similar lines
agree in all places of a class and meet in the group of that class. In every round the first lines of every group lead it
(leaders of an earlier round before others, then by hash); a line joins the first leader similar to it and leaves all its
groups; a leader leaves the groups it has led, as it has met all their lines. Rounds go on, with twice as many leaders a
group each time, until no group holds two lines, so every line has met a leader in every group or joined one. A template is
a leader with all lines that joined it; leaders that join leaders bring their lines. Other lines (variable fields masked) are
templates by themselves.
A template recurs if it lies in two different texts. Lines of `LONG_TOKENS` tokens then go; shorter ones, down to
`SHORT_TOKENS`, go if their template lies in `SHORT_TEXTS` texts, or as part of a passage: a run of consecutive recurring
lines of `RUN_WORDS` words together (lines below `SHORT_TOKENS` never recur and do not break a run).
Recurring lines are dropped everywhere but in one text, that of the least hash, whatever their share of a text. Exact
copies of a text count once and fare alike. Only a text of which one other text keeps `COPY_SHARE` of the words is a copy
rather than a carrier of boilerplate: it is left whole, for document deduplication.

Places have a fixed width (64 places of 8 bits; longer lines fold) and groups are reduced by minimum and maximum, so no
leaf or template is ever collected, however often its lines occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.batches import flat, mix, slices, span_hashes, spans
from lexweave.llm.components import components
from lexweave.llm.store import staged
from lexweave.scale import top_k

DEPTH = 3
APART = 5
LONG_TOKENS, SHORT_TOKENS, SHORT_TEXTS = 8, 3, 8
RUN_WORDS = 50
COPY_SHARE = 0.95
PLACES = 64
_random = np.random.Generator(np.random.PCG64(9))
_FACTORS = _random.integers(0, 1 << 63, DEPTH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xA24BAED4963EE407)
_FIELD = np.uint64(0x9FB21C651E98DF25)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SLOTS = [f"s{i}" for i in range(PLACES // 8)]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = np.ones(1, np.uint64)
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = flat(part["text"])
            starts, ends, first = spans(data, offsets)
            tokens = span_hashes(data, starts, ends)
            digits = np.zeros(len(data) + 1, np.int64)
            np.cumsum(_DIGIT[data], out=digits[1:])
            tokens[digits[ends] > digits[starts]] = _FIELD
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            breaks = np.flatnonzero(data == 10)
            line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[doc] if len(starts) else np.zeros(0, np.int64)
            begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]) if len(starts) else np.zeros(0, np.int64)
            count = np.diff(np.r_[begin, len(starts)])
            at = np.arange(len(starts)) - np.repeat(begin, count)
            if len(count) and count.max() > len(powers):
                powers = np.full(int(count.max()), _STEP, np.uint64)
                powers[0] = 1
                powers = np.multiply.accumulate(powers)
            leaf = count.astype(np.uint64) * _FACTORS[0]
            for k in range(DEPTH):
                held = begin + k < begin + count
                leaf[held] += tokens[begin[held] + k] * _FACTORS[k + 1]
            exact = np.add.reduceat(tokens * powers[at], begin) if len(begin) else np.zeros(0, np.uint64)
            cells = np.zeros((len(begin), PLACES), np.uint8)
            row = np.repeat(np.arange(len(begin)), count)
            near = at < PLACES
            cells[row[near], at[near]] = (tokens[near] >> np.uint64(56)).astype(np.uint8)
            far = ~near
            np.add.at(cells, (row[far], at[far] % PLACES), (tokens[far] * powers[at[far] // PLACES] >> np.uint64(56)).astype(np.uint8))
            words = np.diff(first)
            keep = count >= SHORT_TOKENS
            of = doc[begin][keep] if len(begin) else begin
            place = np.arange(len(of)) - np.searchsorted(of, of)
            slots = cells.view(np.int64)[keep]
            keys = part["key"].take(pa.array(of))
            short = np.frombuffer(b"".join(k[:8] for k in part["key"].to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(short[of]), pa.array(line[begin][keep].astype(np.int32) if len(begin) else np.zeros(0, np.int32)), pa.array(place.astype(np.int32)),
                 pa.array(count[keep].astype(np.int32)), pa.array(words[of].astype(np.int64)), pa.array(mix(leaf)[keep].view(np.int64)),
                 pa.array(mix(mix(exact) + leaf)[keep].view(np.int64)), *[pa.array(np.ascontiguousarray(slots[:, i])) for i in range(len(_SLOTS))]],
                ["key", "text_hash", "row", "place", "n", "words", "leaf", "line", *_SLOTS])


def text_key(text: str = "text") -> Column:
    """128-bit key of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def parsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of at least SHORT_TOKENS tokens: its text's key, row, place among such lines, tokens, leaf, hash of all
    tokens (`line`) and places."""
    schema = "key binary, text_hash long, row int, place int, n int, words long, leaf long, line long, " + ", ".join(f"{s} long" for s in _SLOTS)
    return docs.select(text_key(text).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_lines, schema)


def _differing(a: Column, b: Column) -> Column:
    """In how many of the places two lines' slots differ."""
    bytes_ = lambda x: sum((F.when(F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)) != 0, 1).otherwise(0) for k in range(8)), F.lit(0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda acc, x: acc + bytes_(x))


def _classes(free: Column, slots: Column) -> Column:
    """The places of every class in one array each."""
    masks = F.array(*[F.lit(-(1 << 56) if k == 7 else 255 << 8 * k).cast("long") for k in range(8)])
    place = lambda i: F.get(slots, F.floor(i / 8).cast("int")).bitwiseAND(F.element_at(masks, (i % 8 + 1).cast("int")))
    return F.transform(F.sequence(F.lit(0), free), lambda turn: F.transform(F.sequence(turn, F.lit(PLACES - 1), free + 1), place))


def templates(distinct: DataFrame) -> DataFrame:
    """(line, template) of the distinct lines (line, leaf, n, places) that share a template with another one."""
    # Only leaves of several lines are looked at.
    several = distinct.groupBy("leaf").agg(F.count("*").alias("lines")).filter("lines > 1").select("leaf")
    lined = (distinct.join(several, "leaf", "left_semi")
             .select("line", "leaf", F.array(*_SLOTS).alias("slots"), F.floor(F.least(F.col("n"), F.lit(PLACES)) / APART).cast("int").alias("free")))
    keyed = (lined.select("*", F.posexplode(_classes(F.col("free"), F.col("slots"))).alias("turn", "shared"))
             .select(F.xxhash64("leaf", "turn", "shared").alias("key"), "line", "slots", "free"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("lines")).filter("lines > 1").select("key")
    members = staged(keyed.join(shared, "key", "left_semi").withColumn("led", F.lit(0)), "members")
    links, many = None, 1
    while not members.isEmpty():
        order = F.struct((-F.col("led")).alias("led"), F.xxhash64("line", "key").alias("hash"), "line")
        ranked = members.select("*", order.alias("order"))
        leaders = (top_k(ranked, ["key"], [F.col("order")], many) if many > 1 else
                   ranked.groupBy("key").agg(F.min_by(F.struct("order", "line", "slots"), "order").alias("l")).select("key", "l.*"))
        leaders = staged(leaders.select("key", F.col("order").alias("leads"), F.col("line").alias("leader"), F.col("slots").alias("reference")), "leaders")
        tried = ranked.join(leaders, "key").filter((F.col("leads") < F.col("order")) & (_differing(F.col("slots"), F.col("reference")) <= F.col("free")))
        joined = staged(tried.groupBy("line").agg(F.min_by("leader", F.struct("leads", "leader")).alias("leader")), "joined")
        links = joined if links is None else links.unionAll(joined)
        chosen = joined.select(F.col("leader").alias("line")).distinct().withColumn("chosen", F.lit(1))
        left = (members.join(joined.select("line"), "line", "left_anti")
                .join(leaders.select("key", F.col("leader").alias("line")), ["key", "line"], "left_anti").join(chosen, "line", "left")
                .select("key", "line", "slots", "free", F.greatest("led", F.coalesce("chosen", F.lit(0))).alias("led")))
        pairs = left.groupBy("key").agg(F.count("*").alias("lines")).filter("lines > 1").select("key")
        members = staged(left.join(pairs, "key", "left_semi"), "members")
        many *= 2
    if links is None:
        return distinct.filter(F.lit(False)).select("line", F.col("line").alias("template"))
    return components(links.select(F.col("line").alias("a"), F.col("leader").alias("b"))).select(F.col("node").alias("line"), F.col("root").alias("template"))


def recurring(lines: DataFrame) -> DataFrame:
    """(line, template, least, often): the distinct lines whose template lies in two texts or more, and the text that
    keeps it; often is true if the line surely goes, by its length or by as many occupied cells of a 64-cell counter."""
    distinct = staged(lines.groupBy("line").agg(
        F.min("leaf").alias("leaf"), F.min("text_hash").alias("least"), F.max("text_hash").alias("most"), F.min("n").alias("n"),
        F.bit_or(F.expr("shiftleft(1L, int(pmod(text_hash, 64)))")).alias("cells"), *[F.min(s).alias(s) for s in _SLOTS]), "distinct")
    dealt = distinct.select("line", "least", "most", "n", "cells").join(templates(distinct), "line", "left").withColumn("template", F.coalesce("template", "line"))
    dealt = staged(dealt, "dealt")
    found = dealt.groupBy("template").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("n").alias("n"), F.bit_or("cells").alias("cells"))
    often = ((F.col("n") >= LONG_TOKENS) | (F.bit_count("cells") >= SHORT_TEXTS)).alias("often")
    return dealt.select("line", "template").join(found.filter(F.col("least") != F.col("most")).select("template", "least", often), "template")


def drops(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, lines, words_dropped): which lines (from 0) every text loses; texts that lose none are not listed."""
    lines = staged(parsed(docs, text), "lines")
    once = ["text_hash", "place", "n", "words", "template", "least", "often"]
    hits = staged(lines.select("key", "text_hash", "row", "place", "n", "words", "line").join(recurring(lines), "line")
                  .groupBy("key", "row").agg(*[F.min(c).alias(c) for c in once]), "hits")
    rare = hits.filter(~F.col("often")).drop("often")
    counted = rare.groupBy("template").agg((F.count_distinct("key") >= SHORT_TEXTS).alias("often"))
    judged = hits.filter("often").unionByName(rare.join(counted, "template"))
    # Consecutive places have one difference to their rank.
    run = (F.col("place") - F.row_number().over(Window.partitionBy("key").orderBy("place"))).alias("run")
    passage = F.sum("n").over(Window.partitionBy("key", "run")) >= RUN_WORDS
    gone = judged.select("*", run).withColumn("often", F.col("often") | passage).filter(F.col("often") & (F.col("text_hash") != F.col("least")))
    kept_by = gone.groupBy("key", "least").agg(F.collect_list("row").alias("lines"), F.sum("n").alias("n"), F.max("words").alias("words"))
    return (kept_by.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines"), F.sum("n").alias("words_dropped"),
                                       F.max("n").alias("covered"), F.max("words").alias("words"))
            .filter(F.col("covered") < COPY_SHARE * F.col("words")).select("key", "lines", "words_dropped"))


def without_recurring_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, text, n_lines, lines, words_dropped): every row of docs with its remaining text, lines joined as before.

    Null and empty texts come back as they are; repeated rows lose the same lines; no row is dropped.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(text).alias("key"))
    joined = packed.join(drops(docs, text), "key", "left").withColumn("text", F.col("row")[text].cast("string"))
    parts = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("lines"))
    left = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    return joined.select("row", left.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
                         F.coalesce("lines", F.array().cast("array<int>")).alias("lines"), F.coalesce("words_dropped", F.lit(0)).cast("long").alias("words_dropped"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """docs with cleaned texts; n_chars, where there is one, follows the text."""
    cleaned = without_recurring_lines(docs).select("row.*", F.col("text").alias("_cleaned"))
    changed = {"text": F.col("_cleaned")} | ({"n_chars": F.length("_cleaned").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return cleaned.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])
