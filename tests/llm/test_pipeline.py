"""The pipeline's stages, each against a brute-force version on what its predecessor kept."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_queries import WORD, brute_components, brute_lines, without
from tokenizers import Tokenizer

import corpus_pipeline
from lexweave.llm.store import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, sf):
    """What goes into each stage and what comes out of the last."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = staged(stage(spark, docs, sf), name)
    return [[r.asDict() for r in d.collect()] for d in [*out, docs]], [d.columns for d in [*out, docs]]


def count(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


def test_stages(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix", "bpe"]
    assert all(c == kept[1][0] for c in kept[1][:-1])


def test_language(kept):
    """What goes has no letter or is no text of a learned language; every labelled prose text stays."""
    before, after = kept[0][0], kept[0][1]
    lettered = count([r for r in before if r["text"] is not None and any(c.isalpha() for c in r["text"])], *COLUMNS)
    stay = count(after, *COLUMNS)
    assert not stay - lettered
    prose = count([r for r in before if r["doc_id"] is not None and 0 <= r["doc_id"] < 90], *COLUMNS)
    assert not prose - stay
    # A script that no labelled row uses.
    assert 5000 in {r["doc_id"] for r in before} and 5000 not in {r["doc_id"] for r in after}


def test_lines(kept):
    before, after = kept[0][1], kept[0][2]
    lost = brute_lines([r["text"] for r in before])
    want = Counter((r["doc_id"], without(r["text"], lost[r["text"]]), len(without(r["text"], lost[r["text"]]))) for r in before)
    assert count(after, "doc_id", "text", "n_chars") == want
    assert want != count(before, "doc_id", "text", "n_chars")


def test_near(kept):
    before, after = kept[0][2], kept[0][3]
    found = brute_components([(r["doc_id"], r["text"]) for r in before])
    stays = {(d, r["text"]) for (d, _, c), r in zip(found, before) if d == c}
    assert count(after, "doc_id", "text") == Counter(stays)
    assert len(after) < len(before)


def test_mix(kept):
    before, after = kept[0][3], kept[0][4]
    size = lambda r: len(WORD.findall(r["text"]))
    own = Counter()
    for r in before:
        own[r["source"]] += size(r)
    names = sorted(s for s in own if s is not None) + [None] * (None in own)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    level = max((x for x in np.linspace(0, 2 * max(own.values()), 200_001)
                 if sum(min(x * weight[s], 2 * own[s]) for s in own) <= 1.5 * sum(own.values())), default=0)
    taken, longest = Counter(), Counter()
    for r in after:
        taken[r["source"]] += size(r)
    for r in before:
        longest[r["source"]] = max(longest[r["source"]], size(r))
    for s in own:
        assert abs(taken[s] - min(level * weight[s], 2 * own[s])) <= longest[s] / 2 + 2
    fits = count(before, *COLUMNS)
    assert all(n <= 2 * fits[k] for k, n in count(after, *COLUMNS).items())


def test_bpe(kept):
    before, after = kept[0][4], kept[0][5]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["text"]: np.array(coder.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes() for r in before}
    assert Counter((r["doc_id"], bytes(r["ids"]), r["n_tokens"]) for r in after) == Counter((r["doc_id"], ids[r["text"]], len(ids[r["text"]]) // 4) for r in before)


def test_empty(spark, empty_sf):
    assert corpus_pipeline.run(spark, empty_sf).count() == 0
