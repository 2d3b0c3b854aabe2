"""Ranking operators against small models in plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions.vectors import vector_topk
from lexweave.operators import catalog as ct
from lexweave.operators import index as ix
from lexweave.operators import retrieve as rt
from lexweave.scale import exact_ranks

DOCS = ["the cat sat on the mat", "a dog and a cat", "birds sing", ""]


def tokens(t):
    return [x for x in re.sub(r"[^\w]+", " ", t.lower()).split(" ") if x]


def model_bm25(docs, query):
    toks = [tokens(d) for d in docs]
    avg = sum(map(len, toks)) / len(toks)
    out = {}
    for i, t in enumerate(toks):
        s = 0.0
        for q in tokens(query):
            df = sum(q in x for x in toks)
            tf = t.count(q)
            if tf:
                s += math.log((len(docs) - df + .5) / (df + .5) + 1) * tf * 2.5 / (tf + 1.5 * (.25 + .75 * len(t) / (avg + 1e-9)))
        if s:
            out[i] = round(s, 6)
    return out


def frame(spark, texts, name):
    return spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], f"tenant string, {name} int, text string")


def test_bm25_matches_model(spark):
    queries = ["the cat", "cat cat dog", "nothing here"]
    got = rt.bm25_scores(frame(spark, DOCS, "doc_id"), frame(spark, queries, "query_id")).collect()
    want = {(q, d): s for q, text in enumerate(queries) for d, s in model_bm25(DOCS, text).items()}
    assert {(r["query_id"], r["item_id"]): r["score"] for r in got} == want


def test_zero_fill_completes_in_id_order(spark):
    got = rt.bm25_topk(frame(spark, DOCS, "doc_id"), frame(spark, ["birds", "zzz"], "query_id"), 3, zero_fill=True)
    rows = sorted((r["query_id"], r["rank"], r["item_id"]) for r in got.collect())
    assert rows == [(0, 1, 2), (0, 2, 0), (0, 3, 1), (1, 1, 0), (1, 2, 1), (1, 3, 2)]


def test_rrf_by_hand(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 1), (1, "c", 2)], "query_id int, item_id string, rank int")
    got = {r["item_id"]: r["score"] for r in rt.rrf(ranked).collect()}
    assert got == {"a": round(1 / 61, 12), "b": round(1 / 62 + 1 / 61, 12), "c": round(1 / 62, 12)}
    assert max(got.values()) <= 2 / 61


def test_weighted_fusion_equals_full_ranks(spark):
    """The bounded pools give the same top m as ranking both whole lists."""
    rnd = random.Random(3)
    sparse, dense = [], []
    for q in range(4):
        for i in range(300):
            if rnd.random() < 0.6:
                sparse.append((q, i, round(rnd.choice([0.5, 1.0, rnd.random() * 3]), 6)))
            if q != 3:
                dense.append((q, i, rnd.random()))
    m = 20
    rank = lambda rows: {(q, i): n for q in range(4) for n, (_, _, i) in enumerate(sorted((a, -s, i) for a, i, s in rows if a == q), 1)}
    sr, dr = rank(sparse), rank(dense)
    want = {}
    for q in range(4):
        items = {i for (a, i) in [*sr, *dr] if a == q}
        s = {i: (round((0.1 / (60 + sr[q, i]) if (q, i) in sr else 0) + (0.9 / (60 + dr[q, i]) if (q, i) in dr else 0), 12) if q != 3 else round(1 / (60 + sr[q, i]), 12)) for i in items}
        want[q] = [i for i, _ in sorted(s.items(), key=lambda x: (-x[1], x[0]))[:m]]
    sp = spark.createDataFrame(sparse, "query_id int, item_id int, score double")
    pool = [(q, i, r) for (q, i), r in dr.items() if r <= rt.dense_pool(m)]
    dn = spark.createDataFrame(pool, "query_id int, item_id int, rank int")
    got = {}
    for r in rt.weighted_fusion(sp, dn, m).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert got == want


def test_exact_ranks(spark):
    rows = [(1, i, float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "query_id int, item_id int, score double")
    order = {i: n for n, (_, i) in enumerate(sorted((-s, i) for _, i, s in rows), 1)}
    picked = [3, 49, 0, 13]
    got = {r["item_id"]: r["rank"] for r in exact_ranks(df, df.filter(F.col("item_id").isin(picked))).collect()}
    assert got == {i: order[i] for i in picked}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block", [1 << 20, 40])
def test_vector_topk_against_numpy(spark, metric, block):
    rng = np.random.default_rng(1)
    items, queries = rng.normal(size=(200, 4)).round(3), rng.normal(size=(5, 4)).round(3)
    mk = lambda m, n: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{n} int, embedding array<double>")
    got = {}
    for r in vector_topk(mk(queries, "query_id"), mk(items, "item_id").repartition(7), 6, metric, block).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    for q, v in enumerate(queries):
        if metric == "l2":
            s = ((items - v) ** 2).sum(axis=1).round(6)
        else:
            s = -(items @ v / np.linalg.norm(items, axis=1) / np.linalg.norm(v)).round(6)
        assert got[q] == [int(i) for i in np.lexsort((np.arange(200), s))[:6]]


TOOLS = [("mcp__github__create_github_issue", "create a github issue", "github", "browser"), ("mcp__github__open_pr", "open a pull request", "github", "browser"),
         ("mcp__bing__search_web", "search the web", "bing", "search"), ("send_email", "发送邮件 email to someone", "", "calendar"), ("add_numbers", "add two numbers", "", "")]


def tool_frame(spark):
    rows = [(i, n, d, {"q": "string"}, s, "", t) for i, (n, d, s, t) in enumerate(TOOLS)]
    return spark.createDataFrame(rows, "ord int, name string, description string, params map<string,string>, service string, service_description string, type_slug string")


def search(spark, text):
    docs = ct.as_documents(tool_frame(spark), "ord")
    q = spark.createDataFrame([("", "q", text)], "tenant string, query_id string, text string")
    return [TOOLS[r["item_id"]][0] for r in rt.rank_hits(ct.catalog_scores(docs, q), 3).orderBy("rank").collect()]


def test_catalog_search(spark):
    assert search(spark, "github issue")[0] == "mcp__github__create_github_issue"
    assert "send_email" in search(spark, "发送邮件 email")
    # No token matches; "mail" is inside "email".
    assert search(spark, "mail") == ["send_email"]
    assert search(spark, "zzz") == []


def test_pool_split_and_gate(spark):
    t = tool_frame(spark)
    assert t.filter("service <> ''").count() == 3
    many = spark.range(323).select(F.concat(F.lit("tool_"), "id").alias("name"), F.repeat(F.lit("does things "), 20).alias("description"), F.create_map(F.lit("q"), F.lit("string")).alias("params"))
    row = ct.estimate_tokens(many).select("tokens", ct.should_activate(F.col("tokens"), None).alias("on")).first()
    assert row["tokens"] >= 20_000 and row["on"]


def test_hybrid_finds_what_words_miss(spark):
    """Lexical search misses the tool, the vectors find it, the fine order puts it first."""
    docs = ct.as_documents(tool_frame(spark), "ord")
    q = spark.createDataFrame([("", "q", "把我最新的改动 合并")], "tenant string, query_id string, text string")
    dense = spark.createDataFrame([("q", 1, 1), ("q", 0, 2)], "query_id string, item_id int, rank int")
    fused = ct.coarse(docs, q, dense, 20)
    assert fused.orderBy("rank").first()["item_id"] == 1
    fine = spark.createDataFrame([("q", 0, 0.2), ("q", 1, 0.9)], "query_id string, item_id int, score double")
    top = ct.fine_order(fused.withColumnRenamed("rank", "coarse_rank").drop("score"), fine, "item_id", 5)
    assert top.orderBy("rank").first()["item_id"] == 1


def test_merged_statistics_equal_rebuild(spark):
    docs = frame(spark, DOCS, "doc_id")
    old, new = docs.filter("doc_id < 2"), docs.filter("doc_id >= 2")
    merged = ix.merge_term_stats(ix.term_stats(ix.postings(old)), ix.postings(new))
    want = {(r["term"], r["df"]) for r in ix.term_stats(ix.postings(docs)).collect()}
    assert {(r["term"], r["df"]) for r in merged.collect()} == want
    back = ix.merge_term_stats(merged, ix.postings(new.limit(0)), ix.postings(new))
    assert {(r["term"], r["df"]) for r in back.collect()} == {(r["term"], r["df"]) for r in ix.term_stats(ix.postings(old)).collect()}


def test_stored_index_gives_the_same_scores(spark, tmp_path):
    from lexweave.operators import index as ix
    docs, queries = frame(spark, DOCS, "doc_id"), frame(spark, ["birds", "a zzz", "the"], "query_id")
    ix.build_index(docs, str(tmp_path / "ix"))
    stored = ix.open_index(spark, str(tmp_path / "ix"))
    scores = lambda source: sorted(tuple(r) for r in rt.bm25_scores(source, queries).collect())
    assert scores(stored) == scores(docs)
    filled = lambda source: sorted(tuple(r) for r in rt.bm25_topk(source, queries, 3, zero_fill=True).collect())
    assert filled(stored) == filled(docs)


def test_scores_are_summed_where_the_documents_lie(spark):
    """Pairs of queries and documents do not move; a task's own best are all that can rank, ties and duplicate ids included."""
    dice = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([("t", i % 290, " ".join(dice.choices(words, k=dice.randint(0, 12)))) for i in range(300)] + [("t", None, "w1 w2")],
                                 "tenant string, doc_id long, text string").repartition(7)
    queries = spark.createDataFrame([("t", f"q{i}", " ".join(dice.choices(words, k=5))) for i in range(9)], "tenant string, query_id string, text string")
    whole = rt.bm25_scores(docs, queries)
    assert "query_id" not in "".join(x for x in whole._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)
    n, terms = 301, {q["query_id"]: q["text"].split() for q in queries.collect()}
    rows = [(r["doc_id"], r["text"].split()) for r in docs.collect()]
    avg = sum(len(t) for _, t in rows) / n
    pairs = {(i, w) for i, t in rows for w in t}
    df = {w: sum(1 for i, t in {(i, tuple(t)) for i, t in rows} if w in t) for w in words}
    got = {(r["query_id"], r["item_id"]): r["score"] for r in whole.collect()}
    single = [(i, t) for i, t in rows if i is not None and 10 <= i < 290]
    for q, asked in terms.items():
        for i, t in single:
            want = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / (avg + 1e-9))) for w in asked if w in t)
            assert got.get((q, i), 0.0) == pytest.approx(want, abs=2e-6)
    assert {i for _, i in got} <= {i for i, _ in pairs}
    ranked = lambda scores: sorted((r["query_id"], r["rank"], str(r["item_id"]), r["score"]) for r in rt.rank_hits(scores, 4).collect())
    assert ranked(rt.bm25_scores(docs, queries, best=4)) == ranked(whole)


def test_substring_hits_are_searched_once(spark):
    """Whoever reads the catalog scores several times reads a written table, not the texts."""
    docs = frame(spark, ["small anvil", "anvils"], "doc_id").withColumn("hay", F.col("text"))
    scores = ct.catalog_scores(docs, frame(spark, ["nvil", "small"], "query_id"))
    assert "Generate" not in scores._jdf.queryExecution().executedPlan().toString()
    assert {(r["query_id"], r["item_id"]) for r in scores.filter("score = 0.1").collect()} == {(r["query_id"], r["item_id"]) for r in scores.filter("score = 0.1").distinct().collect()}
    assert scores.filter("score = 0.1").count() == 2


def test_index_counts_some_documents_at_a_time(spark, tmp_path, monkeypatch):
    """No task holds all its postings; ids that come again, null ids, null texts and several tenants count as in one group by."""
    dice = random.Random(2)
    rows = [(dice.choice(["a", "b", None]), dice.choice([*range(20), None]), dice.choice([None, *(" ".join(dice.choices("uvwxyz", k=n)) for n in (0, 1, 4, 4, 9))])) for _ in range(150)]
    docs = spark.createDataFrame(rows, "tenant string, doc_id long, text string")
    ix.build_index(docs.repartition(3), str(tmp_path / "ix"))
    stored, want = ix.open_index(spark, str(tmp_path / "ix")), {}
    for tenant, doc, text in rows:
        for term in text.split() if text is not None else []:
            key = (tenant, doc, term, len(text.split()))
            want[key] = want.get(key, 0) + 1
    assert {(r["tenant"], r["doc_id"], r["term"], r["dl"]): r["tf"] for r in stored.postings.collect()} == want
    assert stored.postings.count() == len(want)
    lengths = {(t, d, len(x.split())) for t, d, x in rows if x is not None}
    assert stored.docs.count() == len(lengths) and set(map(tuple, stored.docs.collect())) == lengths
    frequent = {(t, w): sum(1 for k in want if k[0] == t and k[2] == w) for t, _, w, _ in want}
    assert {(r["tenant"], r["term"]): r["df"] for r in stored.terms.collect()} == frequent
    monkeypatch.setattr(ix, "COUNTED_TOKENS", 10)
    ordered = docs.filter("text is not null").orderBy("tenant", "doc_id").withColumn("tokens", F.concat(F.regexp_replace("text", "(.) ?", "$1\x1f"))).select("tenant", "doc_id", "tokens").toArrow()
    for size in (1, 7, 1000):
        pieces = list(ix._count(iter(ordered.combine_chunks().to_batches(max_chunksize=size))))
        assert len(pieces) > 10
        got = [((r["tenant"], r["doc_id"], r["term"], r["dl"]), r["tf"]) for p in pieces for r in p.to_pylist() if r["term"]]
        assert len(got) == len(want) and dict(got) == want
