"""Own diff, word segmentation and lexicon check against brute force."""

import difflib
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from lexweave.functions.diffing import matching_blocks, opcodes
from lexweave.functions.lexicon import Automaton, Segmenter
from lexweave.functions.pytext import DiffSteps
from lexweave.operators import catalog as ct
from lexweave.operators import spans as sp
from lexweave.operators.lexicon import MAX_ENTRIES, lexicon_issues, segmented_tokens, shared_lexicon


def longest(a, b, alo, ahi, blo, bhi):
    """The longest common block; of equal ones that which ends first in a, then in b."""
    best = (alo, blo, 0)
    for i in range(alo, ahi):
        for j in range(blo, bhi):
            k = 0
            while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
                k += 1
            if k > best[2] or (k == best[2] and k and (i + k, j + k) < (best[0] + k, best[1] + k)):
                best = (i, j, k)
    return best


def brute_blocks(a, b):
    def go(alo, ahi, blo, bhi):
        i, j, k = longest(a, b, alo, ahi, blo, bhi)
        return [*go(alo, i, blo, j), (i, j, k), *go(i + k, ahi, j + k, bhi)] if k else []
    out = []
    for i, j, k in go(0, len(a), 0, len(b)):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + k)
        else:
            out.append((i, j, k))
    return out


def edited(rng, a, letters):
    b = list(a)
    for _ in range(rng.randint(0, 8)):
        p, o = rng.randint(0, len(b)), rng.random()
        if o < .3:
            b[p:p] = [rng.choice(letters)]
        elif o < .6:
            b[p:p + rng.randint(0, 5)] = []
        elif o < .8:
            b[p:p + 1] = ["z"]
        else:
            b = b[p:] + b[:p]
    return "".join(b)


def test_blocks_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        letters = "abcdefgh"[:rng.choice([1, 2, 3, 8])]
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 25])))
        b = edited(rng, a, letters)
        assert matching_blocks(a, b) == brute_blocks(a, b)


@pytest.mark.parametrize("size", [3, 60, 199, 200, 201, 450])
def test_steps_are_those_of_the_known_matcher(size):
    """From 200 characters on, frequent characters only lengthen blocks."""
    rng = random.Random(size)
    for letters in ("ab", "abcde", "abcdefghijklmnopqrstuvwxy"):
        for _ in range(40):
            a = "".join(rng.choice(letters) for _ in range(size))
            b = edited(rng, a, letters)
            assert opcodes(a, b) == difflib.SequenceMatcher(None, a, b).get_opcodes()


def test_diff_table_function(spark):
    spark.udtf.register("diff_steps", DiffSteps)
    rows = spark.sql("select * from diff_steps('我的明字。', '我的名字！')").collect()
    assert [tuple(r) for r in rows] == [("equal", 0, 2, 0, 2), ("replace", 2, 3, 2, 3), ("equal", 3, 4, 3, 4), ("replace", 4, 5, 4, 5)]
    pairs = spark.createDataFrame([(1, "axb", "ab"), (2, "same", "same"), (3, "", ""), (4, None, "x")], "id int, original string, corrected string")
    got = [(r["id"], r["tag"], r["i1"], r["i2"], r["j1"], r["j2"]) for r in sp.diff_steps(pairs).orderBy("id", "i1").collect()]
    assert got == [(1, "equal", 0, 1, 0, 1), (1, "delete", 1, 2, 1, 1), (1, "equal", 2, 3, 1, 2), (2, "equal", 0, 4, 0, 4)]


def brute_path(weights, text):
    total = sum(weights.values())

    def go(at):
        best = (0.0, []) if at == len(text) else None
        for end in range(len(text), at, -1):
            word = text[at:end]
            if word in weights or end == at + 1:
                score, rest = go(end)
                score += math.log(weights.get(word, 1) / total)
                if best is None or score > best[0]:
                    best = (score, [word, *rest])
        return best
    return go(0)[1]


def test_segments_against_all_paths():
    rng = random.Random(2)
    for _ in range(300):
        weights = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))): rng.choice([1, 2, 5, 50]) for _ in range(8)}
        text = "".join(rng.choice("abcde") for _ in range(10))
        assert Segmenter(list(weights), list(weights.values())).cut(text) == brute_path(weights, text)
    assert Segmenter([], []).cut("ab") == ["a", "b"]


def test_segmented_catalog_tokens(spark):
    words = spark.createDataFrame([("发送", 9.0), ("邮件", 9.0), ("发送", 1.0), (None, 3.0), ("", 2.0), ("送邮", 4.0), ("无", None)], "word string, weight double")
    texts = spark.createDataFrame([("Send_Email 发送邮件 ok 发", ["send", "email", "ok", "发送", "邮件", "发"]), ("plain 7", ["plain", "7"]), ("", [])], "t string, want array<string>")
    tokens = segmented_tokens(words)
    assert texts.filter(~tokens(F.col("t")).eqNullSafe(F.col("want"))).count() == 0
    none = segmented_tokens(words.filter("false"))
    assert texts.select(none(F.col("t"))).first()[0] == ["send", "email", "ok", "发", "送", "邮", "件", "发"]


def test_catalog_search_by_lexicon(spark):
    """With single characters 发件 and 送邮 would match the first tool's description in part; as words only the second does."""
    docs = spark.createDataFrame([("", 1, "发送 邮件", "发送 邮件"), ("", 2, "送邮 服务", "送邮 服务"), ("", 3, "地图", "地图x")], "tenant string, doc_id int, text string, hay string")
    words = spark.createDataFrame([("发送", 5), ("邮件", 5), ("送邮", 50), ("服务", 5), ("地图", 5)], "word string, weight int")
    queries = spark.createDataFrame([("", "a", "送邮"), ("", "b", "图x")], "tenant string, query_id string, text string")
    hits = lambda tokens: {(r["query_id"], r["item_id"]) for r in ct.catalog_scores(docs, queries, tokens=tokens).collect()}
    assert hits(segmented_tokens(words)) == {("a", 2), ("b", 3)}
    from lexweave.functions.text import catalog_tokens
    assert ("a", 1) in hits(catalog_tokens)


def brute_occurrences(entries, text):
    out = set()
    for k, e in enumerate(entries):
        at = text.find(e)
        while at >= 0:
            out.add((k, at))
            at = text.find(e, at + len(e))
    return out


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        entries = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6))})
        text = "".join(rng.choice("abc") for _ in range(30))
        got = list(Automaton(entries).matches(text))
        assert len(got) == len(set(got)) and set(got) == brute_occurrences(entries, text)


def test_automaton_of_many_entries_is_linear_in_the_text():
    rng = random.Random(4)
    entries = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 12))) for _ in range(100_000)})
    automaton = Automaton(entries)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(100_000)) + entries[5]
    known = set(entries)
    want = {text[i:j] for i in range(len(text) - 3) for j in range(i + 4, min(len(text), i + 12) + 1)} & known
    assert {entries[k] for k, _ in automaton.matches(text)} == want

    def seconds(t):
        begin = time.process_time()
        sum(1 for _ in automaton.matches(t))
        return time.process_time() - begin
    once = min(seconds(text) for _ in range(3))
    assert min(seconds(text * 4) for _ in range(3)) < 8 * once


def test_lexicon_issues(spark):
    docs = spark.createDataFrame([(1, "aaa\nbaa ab\n\nab"), (2, ""), (3, None), (4, "none")], "doc_id int, text string")
    lexicon = spark.createDataFrame([("aa", "A"), ("ab", "X"), ("ab", "Y"), ("a\nb", "Z"), ("", "e"), (None, "n")], "wrong string, right string")
    got = sorted((r["doc_id"], r["line"], r["start"], r["end"], r["original"], r["suggestion"]) for r in lexicon_issues(docs, lexicon).collect())
    assert got == [(1, 1, 0, 2, "aa", "A"), (1, 2, 5, 7, "aa", "A"), (1, 2, 8, 10, "ab", "X"), (1, 2, 8, 10, "ab", "Y"), (1, 4, 12, 14, "ab", "X"), (1, 4, 12, 14, "ab", "Y")]
    assert lexicon_issues(docs, lexicon.filter("false")).count() == 0


def test_lexicon_bound(spark):
    with pytest.raises(ValueError):
        shared_lexicon(spark.range(MAX_ENTRIES + 1).select(F.col("id").cast("string").alias("w"), F.lit(1).alias("n")), "w", "n")
