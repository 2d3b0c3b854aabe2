"""Coded id files, Merkle manifest and whitening against brute force, on rows with nulls, ties, repeats and odd texts."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_queries import by_row, result
from tokenizers import Tokenizer

from lexweave.llm import huffman, merkle, whitening
from lexweave.llm.registry import QUERIES
from lexweave.llm.store import staged

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- coded id files

@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected_ids(coder, rows):
    """(doc_id, ids) in file order up to rows that are equal in id: their order is by a hash of the ids."""
    held = [(r[0], [*coder.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows]
    return sorted(held, key=lambda x: (x[0] is not None, x[0] or 0))


def test_op11(spark, sf, rows, coder):
    found = result(spark, sf, "op11_huffman_ids")
    want = expected_ids(coder, rows)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert by_row(found, ["doc_id", "n_tokens", "ids_crc32"]) == sorted(((d, len(i), crc(i)) for d, i in want), key=repr)
    once = Counter(d for d, _ in want)
    at = 0
    starts = {r["doc_id"]: r["start"] for r in found}
    for d, ids in want:
        if once[d] == 1:
            assert starts[d] == at
        at += len(ids)
    # Documents of one id stand next to another without a gap.
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert by_row(result(spark, sf, "op11_huffman_ids"), sorted(found[0])) == by_row(found, sorted(found[0]))


def test_words_are_coded_as_in_their_text(coder):
    texts = ["a  b\tc\x0bd\x0ce\rf", "don't'S  x's", "<|endoftext|>x <|startoftext|> y<|endoftext|>", "é ́e Å", "가 ᄀ ᅡ",
             "ΣΑΣ ΣΑΣ.", "İstanbul DŽ", "a b c\x85d\x1ce", "中文 字😀👩‍🚀", "w" * 5000 + " " + "w" * 99 + " " + "w" * 100, " ", ""]
    own = huffman.Coder(public_tokenizers.path("word_bpe_49k.json"))
    for turn in range(4):
        if turn > 1:
            own.pool = own.pool[:100 * turn]
            own.clear()
        assert [np.frombuffer(b, "<u2").tolist() for b in own.batch(pa.array(texts))] == [[*coder.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_documents_go_on_in_later_blocks(spark, rows, coder):
    """Blocks of 100 ids: documents span many, some end just at a block's end; a block alone gives its part of the ids."""
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows if r[0] is not None][:100] + [(-1, "the house " * 49 + "the"), (-2, "the " * 99), (-3, None)],
                                 "doc_id long, text string").repartition(3)
    from lexweave.scale import scratch_path
    folder = scratch_path(spark, "small")
    huffman.write_files(staged(huffman.token_ids(docs), "ids"), folder, block_tokens=100)
    blocks, book = spark.read.parquet(f"{folder}/blocks"), huffman.read_book(spark, folder)
    assert blocks.agg(F.max("tokens"), F.count("*")).first()[0] == 100 and blocks.count() > 50
    want = expected_ids(coder, [tuple(r) for r in docs.collect()])
    found = huffman.documents_of(blocks, book).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want)
    parts = huffman.decoded(blocks.filter("block % 3 = 1"), book).collect()
    whole = defaultdict(list)
    for r in huffman.decoded(blocks, book).orderBy("file", "block").collect():
        whole[(r["file"], r["ordinal"])] += np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    assert sorted(map(tuple, whole.values())) == sorted(tuple(i) for _, i in want)
    starts = {(r["file"], r["ordinal"]): r["at"] for r in huffman.decoded(blocks, book).orderBy("block", ascending=False).collect()}
    for r in parts:
        before = r["at"] - starts[(r["file"], r["ordinal"])]
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert whole[(r["file"], r["ordinal"])][before:before + len(ids)] == ids


def brute_total(counts):
    """Total bits of an unlimited Huffman code."""
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    return total


def least_total(counts, limit):
    """Least total bits over all sets of code lengths up to `limit` that satisfy Kraft's inequality."""
    counts = sorted((c for c in counts if c), reverse=True)
    best = {1 << limit: 0}
    for c in counts:
        new = {}
        for room, cost in best.items():
            for bits in range(1, limit + 1):
                left = room - (1 << limit - bits)
                if left >= 0 and cost + c * bits < new.get(left, 1 << 60):
                    new[left] = cost + c * bits
        best = new
    return min(best.values())


def test_code_lengths():
    rng = random.Random(1)
    for _ in range(60):
        counts = np.array([rng.choice([0, 1, 1, 2, 5, 40, 1000, 10 ** 6]) for _ in range(rng.randint(2, 12))])
        if (counts > 0).sum() < 2:
            continue
        for limit in (4, 5, 20):
            lengths = huffman.code_lengths(counts, limit)
            assert lengths.max() <= limit and ((lengths > 0) == (counts > 0)).all()
            assert int((counts * lengths).sum()) == (brute_total(counts.tolist()) if limit == 20 else least_total(counts.tolist(), limit))
    assert huffman.code_lengths(np.array([0, 7])).tolist() == [0, 1] and huffman.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(17, int), 4)


def test_codes_are_canonical_and_prefix_free():
    lengths = huffman.code_lengths(np.array([1, 1, 2, 3, 5, 8, 13, 21, 0, 34]))
    codes = huffman.canonical(lengths)
    text = sorted((format(int(codes[s]), f"0{lengths[s]}b"), s) for s in np.flatnonzero(lengths))
    assert all(not b.startswith(a) for (a, _), (b, _) in zip(text, text[1:]))
    assert [s for _, s in text] == sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s))


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1000, 5000])
def test_pack_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n), 300) - 1
    lengths = huffman.code_lengths(np.bincount(ids, minlength=300), 12)
    words, offsets = huffman.pack(ids, huffman.canonical(lengths), lengths)
    assert len(offsets) == -(-n // huffman.STRIDE)
    table, longest = huffman.decoding_table(lengths)
    assert (huffman.unpack(words, offsets, n, table, longest) == ids).all()
    # Any checkpoint alone decodes what follows it.
    k = len(offsets) - 1
    rest = n - k * huffman.STRIDE
    assert (huffman.unpack(words, offsets[k:], rest, table, longest) == ids[k * huffman.STRIDE:]).all()


def test_damaged_block():
    lengths = huffman.code_lengths(np.array([3, 2, 1]))
    data = huffman.block_bytes([5], [3], np.array([0, 1, 2]), 0, 0, False, huffman.canonical(lengths), lengths)
    assert huffman.Block(data).ids(*huffman.decoding_table(lengths)).tolist() == [0, 1, 2]
    for bad in (b"", b"xxxx" + data[4:], data[:-1] + bytes([data[-1] ^ 1])):
        with pytest.raises(ValueError):
            huffman.Block(bad)


def test_crc_of_joined_parts():
    a, b = b"abc" * 77, b"\x00\xff" * 1001
    for x, y in ((a, b), (b, a), (a, b""), (b"", b)):
        assert huffman.joined_crc32(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


# ---- Merkle manifest

def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(nodes, fan=16):
    """Root and per leaf a list of (run, slot)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            paths[leaf].append((nodes[i // fan * fan:i // fan * fan + fan], i % fan))
        nodes = [H(*nodes[i:i + fan]) for i in range(0, len(nodes), fan)]
        at = [i // fan for i in at]
    return nodes[0], paths


def brute_manifest(rows, fan=16):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    by_source = defaultdict(list)
    for d, text, lang, source, n in rows:
        leaf = H(*map(field, (d, source, lang, n, text)))
        hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        changed = H(*map(field, (d, source, lang, n, text if text is None else text.translate(low)))) if hit else leaf
        by_source[source].append((d, leaf, changed))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = brute_tree([leaf for _, leaf, _ in by_source[s]], fan)
    root, tops = brute_tree([trees[s][0] for s in names], fan)
    out = []
    for s, above in zip(names, tops):
        for (d, leaf, changed), below in zip(by_source[s], trees[s][1]):
            path = below + above
            fold = changed
            for run, slot in path:
                fold = H(*run[:slot], fold, *run[slot + 1:])
            out.append((d, leaf, trees[s][0], root, H(*[h for run, slot in path for i, h in enumerate(run) if i != slot]), fold, fold == root))
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_op12(spark, sf, rows):
    want = brute_manifest(rows)
    assert by_row(result(spark, sf, "op12_merkle_manifest"), MANIFEST) == sorted(want, key=repr)
    assert {True, False} == {w[-1] for w in want}


@pytest.mark.parametrize("fan", [2, 3])
def test_manifest_of_other_fans(spark, rows, fan):
    """Deep trees, last runs of one node, and sources of 1, fan and fan + 1 rows; fan 2 meets siblings by index XOR 1."""
    few = rows[:40] + [(1000, "Only one", "en", "lone", 8)] + [(2000 + i, "Two", "en", "full", 3) for i in range(fan)] + [(3000 + i, "X", None, "", 1) for i in range(fan + 1)]
    docs = spark.createDataFrame(few, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = merkle.verified(merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], fan=fan)).collect()
    assert by_row([r.asDict() for r in found], MANIFEST) == sorted(brute_manifest(few, fan), key=repr)


def test_manifest_of_one_row(spark):
    one = [(7, "Ab", None, None, None)]
    docs = spark.createDataFrame(one, "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.verified(merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"])).collect()
    assert [tuple(r) for r in found] == brute_manifest(one)
    assert found[0]["root"] == found[0]["leaf"] and found[0]["proof_sha256"] == H("")


# ---- whitening

def brute_points(vectors):
    good = [(v, e) for v, e, _ in vectors if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    dims = max(len(e) for _, e in good)
    f32 = lambda c: float(np.float32(c))
    return [(v, tuple(int(np.floor(256 * f32(c))) for c in e) + (0,) * (dims - len(e))) for v, e in good]


def test_op13(spark, sf, vectors):
    found = result(spark, sf, "op13_whitening")
    points = brute_points(vectors)
    distinct = np.array(sorted({x for _, x in points}))
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = lambda x: int(((n * np.array(x) - sums) ** 2).sum())
    assert Counter((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in found) == Counter((v, k, n, deviation(x)) for v, x in points for k in range(1, 5))
    by_component = defaultdict(list)
    for r in found:
        by_component[r["component"]].append(r)
    for k, rs in by_component.items():
        white = [(v, float((np.array(x) - sums / n) @ axes[:, k - 1] / np.sqrt(values[k - 1]))) for v, x in points]
        key = lambda p: (p[0] is not None, p[0] or 0, p[1])
        got = sorted(((r["vec_id"], r["whitened"]) for r in rs), key=key)
        assert any(np.allclose([w for _, w in got], [w for _, w in sorted(((v, sign * w) for v, w in white), key=key)], rtol=1e-9, atol=1e-9) for sign in (1, -1))
        assert all(abs(r["explained"] - values[k - 1] / values.sum()) < 1e-9 for r in rs)
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-9


def test_whitening_over_many_blocks(spark, monkeypatch):
    """Blocks of 7 rows and several groups of inner blocks give what one block gives."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(100, 5)) * [1, 2, 3, 4, 5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    take = lambda: {r["row"]["vec_id"]: r["whitened"] for r in whitening.whitened(df).collect()}
    one = take()
    monkeypatch.setattr(whitening, "ROWS_PER_BLOCK", 7)
    many = take()
    for k in range(4):
        a, b = np.array([one[i][k] for i in range(100)]), np.array([many[i][k] for i in range(100)])
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-9


def test_whitening_of_few_directions(spark):
    """Vectors on a line have one component; equal vectors have none; sums beyond 64 bits leave no deviation."""
    make = lambda vs: spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    line = whitening.whitened(make([[1.0, 2.0], [2.0, 4.0], [4.0, 8.0]])).collect()
    assert {len(r["whitened"]) for r in line} == {1} and abs(line[0]["explained"][0] - 1) < 1e-9
    assert whitening.whitened(make([[1.0, 2.0]] * 3)).count() == 0
    assert whitening.whitened(make([[], []])).count() == 0
    far = whitening.whitened(make([[1e13, 0.0], [0.0, 1.0], [5.0, 5.0]])).collect()
    assert len(far) == 3 and {r["deviation"] for r in far} == {None}


def test_columns_of_the_three(spark, sf):
    kinds = {name: dict(QUERIES[name](spark, sf).dtypes) for name in ("op11_huffman_ids", "op12_merkle_manifest", "op13_whitening")}
    assert kinds["op11_huffman_ids"] == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert kinds["op12_merkle_manifest"] == {c: "bigint" if c == "doc_id" else "boolean" if c == "verified" else "string" for c in MANIFEST}
    assert kinds["op13_whitening"] == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                       "explained": "double", "identity_error": "double"}
