"""Graph, span, layout and window operators against hand values and brute force."""

import os
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions import pytext as pt
from lexweave.operators import evals as ev
from lexweave.operators import graph as gr
from lexweave.operators import layout as ly
from lexweave.operators import spans as sp
from lexweave.operators.lexicon import lexicon_issues
from lexweave.scale import checkpoint_dir, running


def stored(spark):
    """Folders below the checkpoint folder, with their bytes."""
    top = checkpoint_dir(spark).removeprefix("file:")
    return {x: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(os.path.join(top, x)) for f in files) for x in os.listdir(top)}


def model_pagerank(nodes, edges, rounds=200):
    r = {n: 1 / len(nodes) for n in nodes}
    out = {n: sum(w for s, _, w in edges if s == n) for n in nodes}
    for _ in range(rounds):
        loose = sum(r[n] for n in nodes if out[n] == 0)
        r = {n: 0.15 / len(nodes) + 0.85 * (loose / len(nodes) + sum(r[s] * w / out[s] for s, d, w in edges if d == n and out[s])) for n in nodes}
    return r


def graph_frames(spark, edges):
    e = spark.createDataFrame([("t", s, d, "r", w) for s, d, w in edges], "tenant string, src string, dst string, relation string, weight double")
    ids = sorted({x for s, d, _ in edges for x in (s, d)})
    n = spark.createDataFrame([("t", i, "entity", "k", 1) for i in ids], "tenant string, id string, type string, entity_type string, mentions bigint")
    return n, e, ids


def test_pagerank_with_dangling_node(spark, monkeypatch):
    edges = [("USER", "a", 0.5), ("USER", "b", 1.5), ("a", "b", 1.0)]
    n, e, ids = graph_frames(spark, edges)
    monkeypatch.setattr(gr, "LINKS_PER_PIECE", 1)
    got = {r["id"]: r["rank"] for r in gr.pagerank(n, e).collect()}
    want = model_pagerank(ids, edges)
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-9)
    assert got == pytest.approx(want, abs=1e-5)


def test_clustering_two_triangles(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0), ("d", "e", 1.0), ("e", "c", 1.0)]
    n, e, _ = graph_frames(spark, edges)
    got = {r["id"]: r["coefficient"] for r in gr.clustering(n, e).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 1.0, "c": 2 * 2 / 12, "d": 1.0, "e": 1.0})


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_clustering_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(gr, "BROADCAST_LINKS", broadcast, raising=False)
    rng = random.Random(4)
    pairs = {(rng.randint(0, 11), rng.randint(0, 24)) for _ in range(110)}
    rows = [(t, f"n{a}", f"n{b}", "r", 1.0) for t in ("t", "u", None) for a, b in pairs if t != "u" or (a + b) % 3] + [("t", None, "n1", "r", 1.0)]
    e = spark.createDataFrame(rows, "tenant string, src string, dst string, relation string, weight double")
    n = spark.createDataFrame([(t, f"n{i}") for t in ("t", "u", None) for i in range(26)], "tenant string, id string")
    got = {(r["tenant"], r["id"]): (r["degree"], r["triangles"]) for r in gr.clustering(n, e).collect()}
    assert len(got) == 78
    for t in ("t", "u"):
        near = {}
        for x, a, b, *_ in rows:
            if x == t and a and a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        for i in (f"n{i}" for i in range(26)):
            mine = near.get(i, set())
            assert got[t, i] == (len(mine), sum(b in near[a] for a, b in combinations(mine, 2)))


def test_clustering_stores_little(spark):
    """What is stored stays below the links' own size."""
    n, e, _ = graph_frames(spark, [(f"x{a}", f"h{b}", 1.0) for a in range(20) for b in range(400)])
    before = stored(spark)
    assert gr.clustering(n, e).agg(F.sum("triangles")).first()[0] == 0
    assert sum(size for x, size in stored(spark).items() if x not in before) < 40_000


def test_pagerank_keeps_one_state(spark):
    n, e, _ = graph_frames(spark, [("USER", "a", 0.5), ("USER", "b", 1.5), ("a", "b", 1.0)])
    before = stored(spark)
    assert gr.pagerank(n, e, max_iter=8, tol=None).count() == 3
    held = [x for x, size in stored(spark).items() if x not in before and not x.startswith("rdd-")]
    assert len(held) == 1 and held[0].startswith("ranks-")


def test_graph_build_last_wins_and_defaults(spark):
    rel = spark.createDataFrame([("t", "USER", "x", "r1", 0.9, 0), ("t", "USER", "x", "r2", None, 1), ("t", "x", "y", "r", 1.0, 2)],
                                "tenant string, src string, dst string, relation string, weight double, ord int")
    e = gr.build_edges(rel)
    assert {(r["src"], r["dst"], r["relation"], r["weight"]) for r in e.collect()} == {("USER", "x", "r2", 0.5), ("x", "y", "r", 1.0)}
    ent = spark.createDataFrame([("t", "x", None, None, 0)], "tenant string, name string, entity_type string, mentions int, ord int")
    n = {r["id"]: (r["type"], r["entity_type"], r["mentions"]) for r in gr.build_nodes(ent, e).collect()}
    assert n == {"USER": (None, None, None), "x": ("entity", "unknown", 1), "y": (None, None, None)}
    zero = gr.build_nodes(ent.withColumn("mentions", F.lit(0)), e)
    scores = gr.preference_scores(zero, e, gr.pagerank(zero, e))
    assert all(r["score"] >= 0 for r in scores.collect())


def test_running_equals_one_window(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), i, rnd.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = running(df, ["k"], ["i"], F.floor(F.col("i") / 17), {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))})
    seen = {}
    for r in got.orderBy("i").collect():
        past = seen.setdefault(r["k"], [])
        assert (r["s"], r["m"], r["l"]) == (sum(past), max(past, default=None), past[-1] if past else None)
        past.append(r["v"])


def whole_document(issues):
    """The rule over one document at once, without islands."""
    kept = []
    for row in sorted(issues, key=lambda x: (x[0], -x[1], x[3])):
        sp._settle(kept, row, 0, 1, 2)
    return sorted(kept)


@pytest.mark.parametrize("rows,kept", [
    ([(0, 9, "abc", "1"), (2, 4, "b", "2")], ["1"]),                    # contained
    ([(0, 4, "ab", "1"), (0, 9, "abc", "2")], ["2"]),                   # equal start, wider first by order
    ([(0, 6, "x", "1"), (4, 8, "x", "2")], ["2"]),                      # same text overlapping, shorter wins
    ([(0, 4, "x", "1"), (2, 8, "x", "2")], ["1"]),
    ([(0, 4, "x", "1"), (2, 8, "y", "2")], ["1", "2"]),                 # other text may overlap
    ([(0, 4, "x", "1"), (4, 8, "x", "2")], ["1", "2"]),                 # touching
])
def test_resolve_rules(rows, kept):
    assert sorted(r[3] for r in whole_document(rows)) == kept


def test_islands_do_not_change_the_result(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for doc in range(30):
        mine = []
        for n in range(rnd.randint(1, 25)):
            s = rnd.randint(0, 60)
            mine.append((s, s + rnd.randint(0, 8), rnd.choice("xyz"), f"{n:02d}"))
        want[doc] = whole_document(mine)
        rows += [(doc, i, s, e, o) for s, e, o, i in mine]
    df = spark.createDataFrame(rows, "doc_id int, issue_id string, start bigint, end bigint, original string")
    got = {}
    for r in sp.resolve_overlaps(df).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["original"], r["issue_id"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_apply_issues(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, "same")], "doc_id int, text string")
    iss = spark.createDataFrame([(1, 1, 2, "b", "B"), (1, 4, 5, "c", "C"), (1, 3, 4, "zz", "Q"), (1, 6, 6, "", "!")],
                                "doc_id int, start int, end int, original string, suggestion string")
    got = {r["doc_id"]: r["text"] for r in sp.apply_issues(docs, iss).collect()}
    # The second issue's text is not at its span: its first occurrence is used; the third has none.
    assert got == {1: "aBCdef!", 2: "same"}


def test_spans_of_a_diff_rebuild_the_text(spark):
    a, b = "the nation had a relation to them", "the nasion had a relasion to us"
    spans = pt.diff_spans(a, b)
    docs = spark.createDataFrame([(1, a)], "doc_id int, text string")
    iss = spark.createDataFrame([(1, *x) for x in spans], "doc_id int, start int, end int, original string, suggestion string")
    assert sp.apply_issues(docs, iss).first()["text"] == b


def test_align_and_match(spark):
    org = spark.createDataFrame([(1, 0, 0, "我爱北京。"), (1, 0, 1, "天气很好呢"), (1, 0, 2, "完全不同")], "doc_id int, batch bigint, orig_no bigint, text string")
    lines = spark.createDataFrame([(1, 0, 0, "天气真好啊"), (1, 0, 1, "我爱北京")], "doc_id int, batch bigint, line_no bigint, text string")
    got = {r["orig_no"]: (r["corrected"], r["matched"]) for r in sp.align(lines, org).collect()}
    assert got == {0: ("我爱北京", True), 1: ("天气真好啊", True), 2: ("完全不同", False)}
    res = spark.createDataFrame([(1, 0, 0, "", "天气真好啊"), (1, 0, 1, "我爱北京城。", "我爱南京。"), (1, 0, 2, "qqq", "w")], "doc_id int, batch bigint, res_no bigint, original string, corrected string")
    rows = {(r["res_no"], r["original"], r["corrected"]) for r in sp.match_results(res, org).collect()}
    assert rows == {(0, "天气很好呢", "天气真好啊"), (1, "我爱北京。", "我爱南京。"), (None, "完全不同", "完全不同")}


def test_lexicon_positions(spark):
    docs = spark.createDataFrame([(1, "好象\n那里已后那里")], "doc_id int, text string")
    got = sorted((r["line"], r["start"], r["end"], r["suggestion"]) for r in lexicon_issues(docs).collect())
    assert got == [(1, 1, 2, "像"), (2, 3, 5, "哪里"), (2, 5, 7, "以后"), (2, 7, 9, "哪里")]


def test_boxes_touching_and_overlapping(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0), (2, 10.0, 0.0, 20.0, 10.0), (3, 9.0, 9.0, 300.0, 300.0), (4, 250.0, 250.0, 260.0, 260.0)]
    df = spark.createDataFrame([("d", 1, i, "entry", *b) for i, *b in rows], "doc_id string, page int, box_id int, kind string, x0 double, y0 double, x1 double, y1 double")
    got = {(r["a_box_id"], r["b_box_id"]) for r in ly.box_overlaps(df).collect()}
    assert got == {(1, 3), (2, 3), (3, 4)}


def test_remove_unreferenced_follows_chains(spark):
    files = spark.createDataFrame([("p", x, x != "root") for x in ("root", "a", "b", "c", "d")], "package string, path string, removable boolean")
    refs = spark.createDataFrame([("p", "root", "a"), ("p", "b", "c"), ("p", "c", "d"), ("p", "x", "http://q")], "package string, source_path string, target_path string")
    got = {(r["path"], r["round"]) for r in ly.remove_unreferenced(files, refs).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3)}


def model_cleanup(files, refs):
    alive, out, n = list(files), [], 0
    while True:
        n += 1
        met = {(p, t) for p, _, t in refs}
        gone = [(p, x) for p, x, removable in alive if removable and (p, x) not in met]
        if not gone:
            return out
        out += [(*g, n) for g in gone]
        alive = [a for a in alive if a[:2] not in gone]
        refs = [r for r in refs if r[:2] not in gone]


def test_remove_unreferenced_against_rounds(spark):
    """Repeated files, files that may go once and may stay once, loops, references of what is no file, and missing values."""
    rng = random.Random(7)
    files = [(p, f"f{i}", rng.choice([True, True, True, False, None])) for p in "pq" for i in range(60) for _ in range(rng.choice([1, 1, 2]))]
    refs = [(rng.choice("pq"), rng.choice([f"f{rng.randint(0, 59)}", "other", None] + [f"f{rng.randint(0, 59)}"] * 20), f"f{rng.randint(0, 59)}") for _ in range(110)]
    refs += [("p", "f3", "f3"), (None, "f1", "f2"), ("p", "f5", None), ("q", "f4", "missing"), ("p", "f6", "mailto:f7")]
    f = spark.createDataFrame(files, "package string, path string, removable boolean")
    r = spark.createDataFrame(refs, "package string, source_path string, target_path string")
    got = [tuple(x) for x in ly.remove_unreferenced(f, r).select("package", "path", "round").collect()]
    want = model_cleanup(files, refs)
    assert sorted(got) == sorted(want) and max(n for *_, n in want) > 2


def test_remove_unreferenced_stores_no_references_of_others(spark):
    """References of what never goes are read, not written in every round."""
    files = spark.createDataFrame([("p", f"f{i}", True) for i in range(8)], "package string, path string, removable boolean")
    chain = spark.createDataFrame([("p", f"f{i}", f"f{i + 1}") for i in range(5)], "package string, source_path string, target_path string")
    refs = chain.unionByName(spark.range(50_000).select(F.lit("p").alias("package"), F.sha2(F.col("id").cast("string"), 256).alias("source_path"), F.lit("f7").alias("target_path")))
    before = stored(spark)
    got = {(r["path"], r["round"]) for r in ly.remove_unreferenced(files, refs).collect()}
    assert got == {("f6", 1)} | {(f"f{i}", i + 1) for i in range(6)}
    assert sum(size for x, size in stored(spark).items() if x not in before) < 100_000


def test_remove_unreferenced_takes_a_file_without_path_once(spark):
    files = spark.createDataFrame([("p", None, True), (None, "a", True), ("p", "b", True)], "package string, path string, removable boolean")
    refs = spark.createDataFrame([("p", "x", "b"), (None, "x", "a")], "package string, source_path string, target_path string")
    assert sorted(((r["package"], r["path"], r["round"]) for r in ly.remove_unreferenced(files, refs).collect()), key=repr) == sorted([("p", None, 1), (None, "a", 1)], key=repr)


@pytest.mark.parametrize("step", [0.3, 1.5])
def test_near_duplicates_against_scan(spark, step):
    rng = np.random.default_rng(2)
    v = np.cumsum(rng.normal(0, step, size=(120, 3)), axis=0).astype(np.float32)
    keep, last = [], None
    for i, x in enumerate(v):
        if last is None or 1.0 - float(np.mean(np.abs(last - x))) / 100.0 < 0.99:
            keep.append(i)
            last = x
    df = spark.createDataFrame([("k", i, [float(y) for y in x]) for i, x in enumerate(v)], "k string, i int, vector array<float>")
    got = ly.drop_near_duplicates(df, "k", "i", 0.99, 100.0, F.floor(F.col("i") / 9))
    assert sorted(r["i"] for r in got.collect()) == keep


def test_run_summary_by_hand(spark):
    runs = spark.createDataFrame([("a", 1.0, 2.0, 10), ("b", 0.0, 1.0, 4), ("b", 1.0, 3.0, 6), ("b", 0.5, 2.0, 5)], "configuration string, pass_rate double, time_seconds double, tokens int")
    s = {r["configuration"]: r for r in ev.run_summary(runs).collect()}
    assert s["a"]["pass_rate_stddev"] == 0.0 and s["b"]["pass_rate_stddev"] == 0.5 and s["b"]["tokens_mean"] == 5.0
    d = ev.run_delta(ev.run_summary(runs)).first()
    assert (d["delta_pass_rate"], d["delta_time_seconds"], d["delta_tokens"]) == ("+0.50", "+0.0", "+5")
    alone = ev.run_delta(ev.run_summary(runs.filter("configuration = 'a'"))).first()
    assert alone["delta_pass_rate"] == "+1.00"


def test_trigger_threshold_and_empty_ratios(spark):
    runs = spark.createDataFrame([("q", True, True), ("q", True, False), ("n", False, True), ("n", False, False)], "query string, should_trigger boolean, triggered boolean")
    r = {x["query"]: x["pass"] for x in ev.trigger_rates(runs).collect()}
    assert r == {"q": True, "n": False}
    c = ev.confusion(ev.trigger_rates(runs.filter("not should_trigger").withColumn("triggered", F.lit(False)))).first()
    assert (c["precision"], c["recall"], c["accuracy"]) == (1.0, 1.0, 1.0)
    assert ev.confusion(ev.trigger_rates(runs.limit(0))).first()["accuracy"] == 0.0


def test_holdout_sizes(spark):
    df = spark.range(101).select("id", (F.col("id") < 100).alias("y"))
    got = {(r["y"], r["is_test"]): r["count"] for r in ev.holdout(df, "y", "id", 0.4).groupBy("y", "is_test").count().collect()}
    assert got == {(True, True): 40, (True, False): 60, (False, True): 1}


def test_texts_are_compared_by_many_tasks(spark):
    """However small in bytes the input is, and in however few partitions it comes."""
    from lexweave.operators import spans as sp
    pairs = spark.createDataFrame([(i, f"a station {i}", f"a stasion {i}") for i in range(40)], "doc_id long, original string, corrected string").coalesce(1)
    changes = sp.diff_spans(pairs)
    assert changes.rdd.getNumPartitions() == 8
    assert {(r["doc_id"], r["start"], r["end"], r["span_corrected"]) for r in changes.collect()} == {(i, 5, 6, "s") for i in range(40)}
    lines = pairs.select("doc_id", "doc_id", "corrected").toDF("doc_id", "batch", "text").selectExpr("doc_id", "batch", "0L line_no", "text")
    originals = pairs.selectExpr("doc_id", "doc_id batch", "0L orig_no", "original text")
    aligned = sp.align(lines, originals)
    assert aligned.rdd.getNumPartitions() == 8
    assert aligned.filter("matched").count() == 40


def test_matching_blocks_are_those_of_difflib():
    import random
    from difflib import SequenceMatcher
    from lexweave.functions import diffing
    dice = random.Random(7)
    for _ in range(150):
        a = "".join(dice.choices("eeeetttaaoinsrh  bkqx", k=dice.choice([0, 5, 80, 199, 230, 700])))
        b = "".join(c for c in a if dice.random() > .02) + dice.choice(["", "kq"])
        want = [tuple(m) for m in SequenceMatcher(None, a, b).get_matching_blocks()][:-1]
        assert diffing.matching_blocks(a, b) == want
        frequent = diffing.frequent_characters(b)
        assert diffing.longest_in_short(a, b, 0, len(a), 0, len(b), frequent) == diffing.SuffixAutomaton(b, 0, len(b), frequent).longest(a, 0, len(a), frequent)
