"""Near-duplicate documents by SetSketch registers over five-word shingles.

A document's set holds its distinct five-word shingles (A-Z lowered); with one to four words it holds the whole
sequence; without words it is empty and links with nothing. Documents link when 100 * intersection is at least
`percent` times the union.

1. `sketches`: per document the set size, a 128-bit digest of the set and SetSketch registers, that is minima of
   exponentially distributed hashes, truncated to powers of `BASE`. Registers of parts merge by their maximum.
2. Documents of equal sets become one node. A node's registers are cut into bands; nodes that share a band meet.
3. Inside a bucket no pair list is made. `STAR_BANDS` first meet only a hashed centre of each bucket, then all bands
   do. Copies and most near copies have merged by then. Where a bucket still holds several components, a link can only be
   missing between a node outside the bucket's largest component and another one. These outsiders go through an exact
   filter on full sets: to reach the threshold, two sets must share one of their rarest shingles early enough that the rest
   can still hold the needed overlap. Shingles that no outsider holds, or one component only, come first in that order, so
   a document of mostly own text meets nobody, however many bucket mates it has. A shingle's nodes meet by classes of set
   size, each only those its place in the order leaves possible. Here too a few nodes of the largest component come first,
   and then all that is still apart.
4. Every pair gets a joint likelihood estimate of its similarity from the registers and exact set sizes; pairs
   that lie `DEVIATIONS` standard errors below the threshold go, all others are confirmed on the full sets.

Misses: a pair at the threshold shares no band with probability (1 - 0.85 ** 5) ** 24 = 7e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.batches import LOWER_CODES, flat, mix, slices, span_hashes, spans
from lexweave.llm.components import merged
from lexweave.llm.store import release, staged
from lexweave.scale import bounded_broadcast, top_k

WORDS = 5
BASE, RATE, TOP = 1.02, 20.0, 1500
BANDS, ROWS = 24, 5
STAR_BANDS = 3
RARE_CENTRES = 2
DEVIATIONS = 5.0
#: Set sizes of one class differ by less than this factor.
SIZE_STEP = 1.05
#: Sides of up to so many short rows (node ids, shingles) are broadcast after a count; longer ones shuffle.
SIDE_ROWS = 500_000
_random = np.random.Generator(np.random.PCG64(4))
_PLACES = _random.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCALES = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_KEYS = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of every text's shingles."""
    data, offsets = flat(texts)
    starts, ends, first = spans(data, offsets)
    words = span_hashes(data, starts, ends, LOWER_CODES)
    n = len(words)
    runs = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        runs += words[k:k + len(runs)] * _PLACES[k]
    runs = mix(runs)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            yield np.unique(runs[a:b - WORDS + 1])
        elif b > a:
            few = (words[a:b] * _PLACES[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([few], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def registers(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes."""
    low = np.full(len(_SCALES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), block):
        np.minimum(low, (shingles[at:at + block, None] * _SCALES[None, :]).min(axis=0), out=low)
    waits = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0 ** 64) / RATE
    return np.clip(np.floor(1 - np.log(waits) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sizes, digests, bands, regs = [], [], [], []
            for s in shingle_sets(part["text"]):
                sizes.append(len(s))
                if not len(s):
                    digests.append(None), bands.append(None), regs.append(None)
                    continue
                r = registers(s)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys = mix((r.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_KEYS).sum(axis=1, dtype=np.uint64))
                bands.append(keys.view(np.int64))
                regs.append(r.tobytes())
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["text_key"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(regs, pa.binary())],
                ["doc_id", "text_key", "n", "digest", "bands", "regs"])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (MD5 of the text), n (set size), digest of the set, bands, regs; null text is empty."""
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
                        F.col(text_col).cast("string").alias("text"))
            .mapInArrow(_sketch, "doc_id long, text_key string, n long, digest binary, bands array<long>, regs binary"))


def _odds(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def joint_estimate(greater: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 40) -> np.ndarray:
    """Most likely similarity of set pairs, given how many registers are greater or less in the first set.

    The log likelihood is concave, so a golden-section search over [0, min(na/nb, nb/na)] finds its peak.
    """
    m = float(len(_SCALES))
    u, v = na / (na + nb), nb / (na + nb)

    def value(j):
        p = np.clip(_odds(np.maximum(u - v * j, 0)), 1e-12, 1)
        q = np.clip(_odds(np.maximum(v - u * j, 0)), 1e-12, 1)
        return greater * np.log(p) + less * np.log(q) + (m - greater - less) * np.log(np.clip(1 - p - q, 1e-12, 1))

    lo, hi = np.zeros(len(na)), np.minimum(na / nb, nb / na)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        x, y = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        up = value(x) < value(y)
        lo, hi = np.where(up, x, lo), np.where(up, hi, y)
    return (lo + hi) / 2


def _likely(percent: int):
    level = percent / 100
    floor = level - DEVIATIONS * np.sqrt(level * (1 - level) / (BANDS * ROWS))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("regs_a", "regs_b"))
            na, nb = (batch[c].to_numpy().astype(float) for c in ("n_a", "n_b"))
            j = joint_estimate((a > b).sum(axis=1), (a < b).sum(axis=1), na, nb)
            fits = pa.array((j >= floor) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)))
            yield batch.select(["a", "b"]).filter(fits)
    return keep


def _full_sets(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the rows (node, doc_id, text_key), from the text of the one row that stands for each node."""
    def sets(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part["node"], pa.array([s.view(np.int64) for s in shingle_sets(part["text"])], pa.list_(pa.int64()))],
                    ["node", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = bounded_broadcast(rows.select(F.col("doc_id").alias("of"), "text_key", "node"), SIDE_ROWS)
    held = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.md5("text") == F.col("text_key")))
    found = staged(held.select("node", "text").mapInArrow(sets, "node long, shingles array<long>"), "sets")
    # Rows that repeat both id and text give their set more than once.
    count, nodes = found.agg(F.count("*"), F.count_distinct("node")).first()
    if count == nodes:
        return found
    once = staged(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    release(found)
    return once


def _confirmed(pairs: DataFrame, held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that reach the threshold on their full sets."""
    side = lambda x: held.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    likely = staged(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely(percent), "a long, b long"), "likely")
    side = lambda x: sets.join(bounded_broadcast(likely.select(F.col(x).alias("node")).distinct(), SIDE_ROWS), "node", "left_semi").select(
        F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = likely.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    out = staged(both.filter(100 * common >= percent * (F.size("s_a") + F.size("s_b") - common)).select("a", "b"), "links")
    release(likely)
    return out


def _outsiders(placed: DataFrame) -> DataFrame:
    """(node, root, outside) of nodes whose buckets hold several components; outside: of another than some bucket's largest."""
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("c", "root")).alias("most")).filter("parts > 1")
    return placed.join(bounded_broadcast(mixed.select("key", "most"), SIDE_ROWS), "key").groupBy("node", "root").agg(F.max(F.col("root") != F.col("most")).alias("outside"))


def _rare_tokens(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root, outside, n, i, shingle) of the shingles that can begin an overlap with a node of another component.

    With sizes n and m a link needs an overlap of at least percent * (n + m) / (100 + percent). A node's shingles are
    ordered by (held by no outsider or by one component only, frequency, value); if the first common shingle stands after i
    of n shingles, the overlap is at most n - i.
    """
    held = sets.join(bounded_broadcast(apart, SIDE_ROWS), "node")
    each = lambda rows: rows.select("node", "root", "outside", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    foreign = staged(each(held.filter("outside")).select("shingle").distinct(), "foreign")
    tokens = staged(each(held).join(bounded_broadcast(foreign, SIDE_ROWS), "shingle", "left_semi"), "tokens")
    tag = F.xxhash64("root")
    spread = staged(tokens.groupBy("shingle").agg(F.count("*").alias("df"), (F.min(tag) == F.max(tag)).alias("alone"))
                    .filter(~F.col("alone")).select("shingle", "df"), "spread")
    ordered = (tokens.join(bounded_broadcast(spread, SIDE_ROWS), "shingle").groupBy("node", "root", "outside", "n")
               .agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("order")))
    first = F.col("n") - F.size("order")
    ranked = (ordered.select("node", "root", "outside", "n", first.alias("first"), F.posexplode("order").alias("at", "token"))
              .select("node", "root", "outside", "n", (F.col("first") + F.col("at")).alias("i"), F.col("token.shingle").alias("shingle"))
              .filter(100 * (F.col("n") - F.col("i")) >= percent * F.col("n")))
    out = staged(ranked, "rare")
    release(foreign, tokens, spread)
    return out


def _rare_pairs(ranked: DataFrame, percent: int, stars: bool) -> DataFrame:
    """Pairs (a, b) of nodes in different components, one at least an outsider, that share a rare shingle in time.

    Nodes outside a shingle's largest component meet all others there; with `stars`, RARE_CENTRES nodes of that
    component only.
    """
    parts = ranked.groupBy("shingle", "root").agg(F.count("*").alias("c"))
    most = parts.groupBy("shingle").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("c", "root")).alias("most")).filter("parts > 1")
    right = ranked.join(bounded_broadcast(most.select("shingle", "most"), SIDE_ROWS), "shingle")
    left = right.filter(F.col("root") != F.col("most")).select("shingle", *[F.col(c).alias(f"l_{c}") for c in ("node", "root", "outside", "n", "i")])
    keys = ["shingle"]
    if stars:
        # The nodes in which the shingle stands earliest: they bound an overlap least.
        best = [(F.col("i") / F.col("n")).asc(), F.xxhash64("node", "shingle")]
        right = top_k(right.filter(F.col("root") == F.col("most")), ["shingle"], best, RARE_CENTRES)
    else:
        # Sizes m that can link: percent * n <= 100 * m, 100 * n >= percent * m and enough of n left after place i.
        size_class = lambda n: F.floor(F.log(n) / F.log(F.lit(SIZE_STEP))).cast("int")
        n, i = F.col("l_n"), F.col("l_i")
        low = F.ceil(n * percent / 100)
        high = F.least(F.floor(n * 100 / percent), F.floor((n - i) * (100 + percent) / percent) - n)
        left = left.filter(low <= high).withColumn("size", F.explode(F.sequence(size_class(low), size_class(high))))
        right = right.withColumn("size", size_class(F.col("n")))
        keys = ["shingle", "size"]
    fits = lambda n, i: (100 + percent) * (F.col(n) - F.col(i)) >= percent * (F.col("n") + F.col("l_n"))
    met = left.join(right, keys).filter((F.col("l_root") != F.col("root")) & (F.col("l_outside") | F.col("outside")) & fits("n", "i") & fits("l_n", "l_i")
                                        & ((F.col("root") == F.col("most")) | (F.col("l_node") < F.col("node"))))
    return met.select(F.least("l_node", "node").alias("a"), F.greatest("l_node", "node").alias("b")).distinct()


def node_roots(sketched: DataFrame, docs: DataFrame, percent: int = 85, id_col: str = "doc_id",
               text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Nodes (one per distinct set, with its least doc_id) and (node, root) of those that share a band: the components."""
    filled = sketched.filter(F.col("n") > 0)
    nodes = staged(filled.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least"),
        *[F.first(c).alias(c) for c in ("n", "bands", "regs")]).select(
            F.monotonically_increasing_id().alias("node"), "digest", "least.doc_id", "least.text_key", "n", "bands", "regs"), "nodes")
    every = nodes.select("node", F.posexplode("bands").alias("band", "hash")).withColumn("key", F.xxhash64("band", "hash")).select("key", "band", "node")
    # Only the keys that two nodes share can link anything.
    shared = every.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    members = staged(every.join(shared, "key", "left_semi"), "bands")
    wanted = staged(members.select("node").distinct(), "wanted")
    kept = nodes.join(bounded_broadcast(wanted, SIDE_ROWS), "node", "left_semi")
    held = staged(kept.select("node", "n", "regs"), "held")
    # Texts travel once: the full sets of all nodes that share a band are stored for every later step.
    sets = _full_sets(kept.select("node", "doc_id", "text_key"), docs, id_col, text_col)
    roots = staged(wanted.withColumn("root", F.col("node")), "roots")
    release(wanted)

    def stars(rows: DataFrame, salt: int) -> DataFrame:
        """Members meet the hashed centre of each of their buckets if it lies in another component."""
        centre = F.min_by(F.struct("node", "root"), F.xxhash64("node", "key", F.lit(salt)))
        centres = rows.groupBy("key").agg(centre.alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.root").alias("centre_root"))
        return (rows.join(centres, "key").filter(F.col("root") != F.col("centre_root"))
                .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())

    def step(pairs: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs, stored, and the roots after testing them."""
        pairs = staged(pairs, "pairs")
        links = _confirmed(pairs, held, sets, percent)
        after = merged(roots, links)
        release(links, roots)
        return pairs, after

    first, roots = step(stars(members.filter(F.col("band") < STAR_BANDS).withColumn("root", F.col("node")), 1), roots)
    second, roots = step(stars(members.join(roots, "node"), 2).join(first, ["a", "b"], "left_anti"), roots)
    tested = first.unionAll(second)
    apart = staged(_outsiders(members.join(roots, "node").select("key", "node", "root")), "apart")
    release(members)
    ranked = _rare_tokens(apart, sets, percent)
    third, roots = step(_rare_pairs(ranked, percent, stars=True).join(tested, ["a", "b"], "left_anti"), roots)
    tested = tested.unionAll(third)
    ranked = ranked.drop("root").join(roots, "node")
    fourth, roots = step(_rare_pairs(ranked, percent, stars=False).join(tested, ["a", "b"], "left_anti"), roots)
    release(apart, held, sets, first, second, third, fourth)
    return nodes, roots


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id (least doc_id reachable) and kept.

    Null or blank text: an empty set, linked with nothing. Rows with the same doc_id and text each get a row and the
    same answer; a null doc_id is no component id unless the whole component has none, and is kept only then.
    An empty table gives an empty table. Other columns of `docs` are not looked at.
    """
    sketched = staged(sketches(docs, id_col, text_col), "sketches")
    nodes, roots = node_roots(sketched, docs, percent, id_col, text_col)
    named = staged(nodes.select("node", "digest", "doc_id").join(roots, "node", "left")
                   .select("digest", "doc_id", F.coalesce("root", "node").alias("root")), "named")
    release(nodes, roots)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(least, "root").select("digest", "component_id")
    out = sketched.select("doc_id", "text_key", "n", "digest").join(of_node, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) that represent their component; one of repeated rows stays.

    Where several rows carry the kept doc_id and the same text, the row with the least values stays.
    """
    verdict = near_duplicates(docs, percent).filter("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"),
                         F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    kept = packed.join(verdict, packed["id"].eqNullSafe(verdict["doc_id"]) & (packed["key"] == verdict["text_key"]))
    once = kept.filter("copies = 1").select("row")
    rest = kept.filter("copies > 1").groupBy("id", "key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    return once.unionAll(rest).select("row.*")
