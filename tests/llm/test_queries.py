"""Every query of the subpackage against a brute-force version, on rows with nulls, ties, repeats and odd texts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexweave.llm import langid, ledger, queries, secrets, templates  # noqa: F401
from lexweave.llm.registry import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


def result(spark, sf, name):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def by_row(found, columns):
    return sorted((tuple(r[c] for c in columns) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, empty_sf, name):
    assert QUERIES[name](spark, empty_sf).count() == 0


def test_op1(spark, sf, rows):
    found = result(spark, sf, "op1_mixture")
    sizes = [(r[0], r[3], len(WORD.findall(r[1] or ""))) for r in rows]
    own = Counter()
    for _, s, n in sizes:
        own[s] += n
    names = sorted((s for s in own if s is not None)) + [None] * (None in own)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(own.values()), set(own), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * own[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in open_})
            break
        target.update({s: 2.0 * own[s] for s in over})
        left -= sum(2.0 * own[s] for s in over)
        open_ -= over
    assert by_row(found, ["doc_id", "size"]) == sorted(((d, n) for d, _, n in sizes), key=repr)
    taken = defaultdict(int)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0)
        taken[(r["source_size"], round(r["target"], 3))] += r["taken"]
    want = defaultdict(float)
    for s in own:
        want[(own[s], round(target[s], 3))] += target[s]
    assert set(taken) == set(want)
    assert all(abs(taken[k] - want[k]) <= 1 for k in want)
    assert by_row(result(spark, sf, "op1_mixture"), sorted(found[0])) == by_row(found, sorted(found[0]))


def test_op1_curriculum(spark, sf):
    """Early positions hold more of the sources whose weight falls over the clock."""
    found = QUERIES["op1_mixture"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    names = sorted({r["source"] for r in found})
    falling = {s for i, s in enumerate(names) if i % 3 == 0}
    early = [r for r in found if r["position"] is not None and r["position"] < 0.2]
    late = [r for r in found if r["position"] is not None and r["position"] > 0.8]
    share = lambda rs: sum(r["size"] for r in rs if r["source"] in falling) / sum(r["size"] for r in rs)
    assert share(early) > share(late)


def test_op2(spark, sf, rows):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in rows:
        ids = coder.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(coder.decode(ids, skip_special_tokens=False).encode())))
    assert by_row(result(spark, sf, "op2_bpe"), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(want, key=repr)


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_op3(spark, sf, rows):
    found = result(spark, sf, "op3_secrets")
    text = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    want = []
    for r in rows:
        spans = base_spans(r[1] or "")
        want.append((r[0], *[sum(k == i for _, k, _ in spans) for i in range(3)], sha(text(spans).encode())))
    assert by_row(found, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]) == sorted(want, key=repr)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    extra = [(r["doc_id"], s) for r in found for s in r["spans"].split(",") if s.startswith("random")]
    planted = {d for d, t in texts.items() if t and "zQ8vN3xK7pW2mR9tY4bL6cF1gH5jD0sA" in t}
    assert planted and {d for d, _ in extra} == planted
    for d, s in extra:
        _, a, b = s.split(":")
        assert texts[d][int(a):int(b)] == "zQ8vN3xK7pW2mR9tY4bL6cF1gH5jD0sA"
    assert all({*text(base_spans(texts[r["doc_id"]] or "")).split(",")} <= {*r["spans"].split(","), ""} for r in found if r["doc_id"] not in (None, 5))


def brute_components(rows, percent=85):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(low))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if sets[i] and r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def test_op4(spark, sf, rows):
    found = result(spark, sf, "op4_near_duplicates")
    assert by_row(found, ["doc_id", "n_shingles", "component_id"]) == sorted(brute_components(rows), key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_op5(spark, sf, rows):
    found = result(spark, sf, "op5_matroska")
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((r[0], len(raw), len(pay), sha(pay), zlib.crc32(pay[-16:])))
    assert by_row(found, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]) == sorted(want, key=repr)
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"], r["media_bytes"]) for r in found}) == len({r["payload_sha256"] for r in found})


def test_op6(spark, sf, rows):
    found = result(spark, sf, "op6_language_id")
    assert Counter((r["doc_id"], r["held_out"]) for r in found) == Counter(
        (r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    und = Counter(r["doc_id"] for r in found if r["lang_pred"] == "und")
    assert und == Counter(r[0] for r in rows if r[1] is None or not any(c.isalpha() for c in r[1]))
    assert all(0 <= r["score"] <= 1 for r in found)
    clear = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 90}
    seen = [(r["lang_pred"], clear[r["doc_id"]]) for r in found if r["doc_id"] in clear and r["held_out"] and r["doc_id"] != 5]
    assert len(seen) > 10 and all(a == b for a, b in seen)


def brute_forward(word, book, prob):
    """log of the sum over all segmentations, by exact fractions so that nothing underflows."""
    place = {p: i for i, p in enumerate(book.pieces)}
    out = []
    for lang in range(prob.shape[1]):
        total = [Fraction(1)] + [Fraction(0)] * len(word)
        for end in range(1, len(word) + 1):
            for at in range(max(0, end - book.longest), end):
                if word[at:end] in place:
                    total[end] += total[at] * Fraction(prob[place[word[at:end]], lang])
        # The logarithm of a fraction beyond the range of doubles.
        top, low = total[-1].numerator, total[-1].denominator
        shift = top.bit_length() - low.bit_length()
        out.append(float(np.log(float(Fraction(top, low << shift) if shift >= 0 else Fraction(top << -shift, low)))) + shift * np.log(2))
    return out


LONG_WORDS = ["water", "internationalization", "responsibilities", "Straßenbahnhaltestelle".lower(), "日本語のテキスト" * 12, "привет" * 30, "abcdefghij" * 60, "é" * 40]


def test_forward_sums_all_segmentations():
    """Pieces of every length count; long runs are neither cut nor lost to rounding, in whatever lanes they stand."""
    book = langid.pieces(public_tokenizers.path(langid.VOCABULARY))
    assert book.longest > 30
    rng = np.random.default_rng(1)
    prob = np.vstack([rng.random((len(book.pieces), 2)) / 1000, np.zeros((1, 2))])
    words = [w.encode() for w in LONG_WORDS]
    ends = np.cumsum([len(w) for w in words])
    got = langid.word_logs(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends, book, prob)
    for w, found in zip(words, got):
        assert np.allclose(found, brute_forward(b" " + w, book, prob), rtol=1e-9)


def test_fit_blocks_keep_characters():
    for word in LONG_WORDS:
        blocks = langid.fit_blocks(word.encode())
        assert b"".join(blocks) == b" " + word.encode() and all(len(b) <= langid.FIT_BYTES for b in blocks)
        assert [b.decode() for b in blocks]


def test_fit_is_expectation_maximisation():
    """One round over words of a few letters against sums over all segmentations."""
    book = langid.pieces(public_tokenizers.path(langid.VOCABULARY))
    words, counts = [b" the", b" water", b"en"], np.array([3.0, 2.0, 5.0])
    place, uniform = {p: i for i, p in enumerate(book.pieces)}, 1.0 / len(book.pieces)

    def cuts(word):
        return [[word[:e], *rest] for e in range(1, len(word) + 1) if word[:e] in place for rest in cuts(word[e:])] if word else [[]]
    expected = np.zeros(len(book.pieces))
    for word, n in zip(words, counts):
        ways = [(uniform ** len(c), c) for c in cuts(word)]
        for p, c in ways:
            for piece in c:
                expected[place[piece]] += n * p / sum(q for q, _ in ways)
    want = (expected + langid.SMOOTH) / (expected.sum() + langid.SMOOTH * len(expected))
    assert np.allclose(langid._fit(book, words, counts, 1), want, rtol=1e-9)


JUNK = ["zxqv zxqv", "Привет мир это текст на русском языке", "日本語のテキストです。これは長い文章です。" * 20, "#### 3 x 4", "xkcdqj vbnmw qrtpz lkjhg", "a" * 3000]


def test_only_texts_of_a_learned_language_are_likely(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    known = langid.identify(docs, model, ["doc_id", "lang"]).filter("lang is not null")
    assert known.filter("not likely").count() == 0 and known.filter("lang <> lang_pred").count() <= 0.01 * known.count()
    junk = spark.createDataFrame([(t,) for t in [*JUNK, "", None]], "text string")
    assert langid.identify(junk, model, ["text"]).filter("likely").count() == 0
    assert langid.identify(docs, langid.fit(docs.filter("false")), ["doc_id"]).filter("likely or lang_pred <> 'und' or score <> 0").count() == 0


def test_too_many_labels(spark, sf):
    with pytest.raises(ValueError):
        langid.fit(spark.read.parquet(f"{sf}/documents.parquet"), max_langs=2)


def test_op7(spark, sf, rows):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    want = [(r[0], len(coder.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert by_row(result(spark, sf, "op7_token_counts"), ["doc_id", "n_tokens"]) == sorted(want, key=repr)


def measures(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = Counter(x for x in text.split("\n") if WORD.search(x))
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": sum(lines.values()),
            "n_dup_lines": sum(n - 1 for n in lines.values()), "n_repeat_words": len(covered),
            "n_letter_words": sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in words),
            "n_ellipsis_lines": sum(x.rstrip(" \t\n\r\v\f").endswith(("...", "…")) for x in lines.elements()),
            "n_bullet_lines": sum(x.lstrip(" \t\n\r\v\f")[0] in "-*•" for x in lines.elements()),
            "max_word_repeat": max(Counter(words).values(), default=0)}


def test_op8(spark, sf, rows):
    found = result(spark, sf, "op8_quality_ledger")
    want = []
    for r in rows:
        m = measures(r[1] or "")
        failed = sum(1 << i for i, rule in enumerate(ledger.RULES) if eval(rule.fails, {}, m))
        base = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        want.append((r[0], *[m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base,
                     not failed & ledger.mask(ledger.POLICIES[ledger.CURRENT]), failed))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"]
    assert by_row(found, columns) == sorted(want, key=repr)


def test_op8_ablations(spark, sf):
    stored = ledger.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    bits = [r["failed"] for r in stored.select("failed").collect()]
    for r in ledger.ablations(stored).collect():
        names = ledger.POLICIES[r["version"]]
        assert r["kept"] == sum(not b & ledger.mask(names) for b in bits)
        assert r["kept_without"] == sum(not b & ledger.mask([n for n in names if n != r["rule"]]) for b in bits)


def brute_lines(texts):
    """Text -> (line, words) pairs that go, by one reading of all distinct texts.

    Templates are taken as all lines of a leaf that a chain of similar lines connects, which is what leaders gather where no
    line lies between two templates.
    """
    masked = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))
    held = {hashlib.md5(t.encode()).digest(): t for t in texts}
    order = lambda k: int.from_bytes(k[:8], "little", signed=True)
    holders, leaf = defaultdict(set), defaultdict(list)
    parsed = {k: [(i, masked(line)) for i, line in enumerate(t.split("\n")) if len(masked(line)) >= 3] for k, t in held.items()}
    for k, lines in parsed.items():
        for _, m in lines:
            if m not in holders:
                leaf[(len(m), m[:3])].append(m)
            holders[m].add(k)
    folded = lambda m: [m[i::templates.PLACES] for i in range(min(len(m), templates.PLACES))]
    root = {m: m for m in holders}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m
    for (n, _), lines in leaf.items():
        for i, a in enumerate(lines):
            for b in lines[:i]:
                if sum(x != y for x, y in zip(folded(a), folded(b))) <= min(n, templates.PLACES) // 5:
                    root[find(a)] = find(b)
    texts_of = defaultdict(set)
    for m, keys in holders.items():
        texts_of[find(m)] |= keys
    out = {}
    for k, t in held.items():
        hits, run, runs = [], [], []
        for i, m in parsed[k]:
            if len(texts_of[find(m)]) > 1:
                run.append((i, m))
                hits.append((i, m))
            else:
                runs.append(run)
                run = []
        passage = {i for r in [*runs, run] if sum(len(m) for _, m in r) >= templates.RUN_WORDS for i, _ in r}
        gone, by_keeper = [], Counter()
        for i, m in hits:
            keys = texts_of[find(m)]
            keeper = min(keys, key=order)
            if keeper != k and (len(m) >= templates.LONG_TOKENS or len(keys) >= templates.SHORT_TEXTS or i in passage):
                gone.append((i, len(m)))
                by_keeper[keeper] += len(m)
        out[t] = gone if max(by_keeper.values(), default=0) < templates.COPY_SHARE * len(WORD.findall(t)) else []
    return out


def without(text, gone):
    drop = {i for i, _ in gone}
    return "\n".join(p for i, p in enumerate(text.split("\n")) if i not in drop)


def test_op9(spark, sf, rows):
    found = result(spark, sf, "op9_line_dedup")
    lost = brute_lines([r[1] or "" for r in rows])
    want = []
    for r in rows:
        t = r[1] or ""
        gone = lost[t]
        want.append((r[0], 0 if r[1] is None else len(t.split("\n")), len(gone), sum(n for _, n in gone), ",".join(str(i) for i, _ in gone),
                     None if r[1] is None else sha(without(t, gone).encode())))
    assert by_row(found, ["doc_id", "n_lines", "n_dropped", "words_dropped", "dropped", "text_sha256"]) == sorted(want, key=repr)
    assert sum(r["n_dropped"] for r in found) > 20


def test_op10(spark, sf, rows):
    found = result(spark, sf, "op10_licences")
    carries = {r[0] for r in rows if r[0] is not None and r[1] and "Apache License" in r[1]}
    assert {r["doc_id"] for r in found if r["via"] == "header" and r["doc_id"] is not None} == carries
    assert all(r["licence"] == "Apache-2.0" for r in found if r["via"] != "none")
    grants = {r["path"].rsplit("/", 1)[0] for r in found if r["via"] == "header" and r["path"].endswith("/LICENSE")}
    for r in found:
        above = [r["path"].rsplit("/", k)[0] for k in range(1, 4)]
        near = next((d for d in above if d in grants), None)
        if r["via"] != "header":
            assert (r["via"], r["inherited_from"]) == (("directory", near) if near else ("none", None))
    assert len(found) == len(rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    from check_oracle import norm
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    assert norm(QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()) == norm(con.sql(ORACLES[name]).df())
