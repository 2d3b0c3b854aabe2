"""The maintained index: replaced and deleted documents, compaction, restarts, and what a batch reads."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import index as ix
from lexweave.operators import retrieve as rt
from lexweave.operators import segments as sg

SCHEMA = "tenant string, doc_id int, text string"


def arrivals(n, seed=1, docs=30):
    rng = random.Random(seed)
    words = "ash birch cedar elm fir oak pine yew".split()
    return [[("t" if i % 3 else "u", i, None if rng.random() < 0.2 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 8))))
             for i in rng.sample(range(docs), 8)] for _ in range(n)]


def state(batches):
    out = {}
    for rows in batches:
        out |= {(t, d): text for t, d, text in rows}
    return [(t, d, text) for (t, d), text in out.items() if text is not None]


def holds(spark, path, rows):
    """The index below path says what an index of rows built anew says."""
    fresh = spark.createDataFrame(rows, SCHEMA)
    held = ix.open_index(spark, path)
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    post = ix.postings(fresh)
    assert same(held.postings.select("tenant", "doc_id", "term", "tf"), post.select("tenant", "doc_id", "term", "tf"))
    assert same(held.terms.select("tenant", "term", "df"), ix.term_stats(post).select("tenant", "term", "df"))
    assert same(held.docs.select("tenant", "doc_id", "dl"), ix.doc_stats(fresh).select("tenant", "doc_id", "dl"))
    queries = spark.createDataFrame([("t", 1, "oak elm"), ("t", 2, "fir"), ("u", 3, "pine pine ash")], "tenant string, query_id int, text string")
    assert same(rt.bm25_scores(held, queries), rt.bm25_scores(fresh, queries))


def put(spark, path, n, rows):
    sg.add_batch(spark.createDataFrame(rows, SCHEMA), path, n)


def test_every_version_equals_a_fresh_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sg, "TIER", 2)
    monkeypatch.setattr(sg, "BUCKETS", 4)
    path, batches = str(tmp_path), arrivals(6)
    for n, rows in enumerate(batches):
        put(spark, path, n, rows)
        live = sg.live_segments(spark, path)
        assert len(live) <= 3 and [s.low for s in live][0] == 0
        if n in (1, 4, 5):
            holds(spark, path, state(batches[:n + 1]))
    assert {s.level for s in live} == {1, 2}


def test_stop_in_the_middle_of_a_compaction(spark, tmp_path, monkeypatch):
    """A merge that stops half-way, or before its version is written, leaves the answers; the batch runs again."""
    monkeypatch.setattr(sg, "TIER", 3)
    monkeypatch.setattr(sg, "BUCKETS", 4)
    path, batches = str(tmp_path), arrivals(4, seed=2)
    for n in (0, 1):
        put(spark, path, n, batches[n])

    def stop(*_):
        raise RuntimeError("stopped")
    for place in ("terms_of", "_vacuum"):
        with monkeypatch.context() as m:
            m.setattr(sg, place, stop)
            with pytest.raises(RuntimeError):
                put(spark, path, 2, batches[2])
        holds(spark, path, state(batches[:3]))
    put(spark, path, 2, batches[2])
    assert [s.level for s in sg.live_segments(spark, path)] == [1]
    holds(spark, path, state(batches[:3]))
    put(spark, path, 3, batches[3])
    put(spark, path, 3, batches[3])
    holds(spark, path, state(batches))


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, 0, [("t", i, f"oak w{i}") for i in range(200)])
    live = sg.live_segments(spark, path)
    own = spark.createDataFrame([("t", 7, "x")], SCHEMA).select(sg.bucket()).first()[0]
    all_files = sg.rows_of(spark, path, live, "postings").select(F.input_file_name()).distinct().count()
    read = sg.rows_of(spark, path, live, "postings", [own]).select(F.input_file_name()).distinct()
    assert read.count() == 1 < all_files and f"bucket={own}/" in read.first()[0]
    put(spark, path, 1, [("t", 7, "elm")])
    terms = {r["term"]: r["df"] for r in ix.open_index(spark, path).terms.collect()}
    assert terms["oak"] == 199 and terms["elm"] == 1 and "w7" not in terms


def test_postings_stay_where_they_lie(spark, tmp_path):
    """What is replaced is sent to the postings, also where Spark would not broadcast of its own."""
    path = str(tmp_path)
    put(spark, path, 0, [("t", i, f"oak w{i}") for i in range(40)])
    put(spark, path, 1, [("t", 7, "elm"), ("t", 8, None)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = sg.rows_of(spark, path, sg.live_segments(spark, path), "postings")
        plan = held._jdf.queryExecution().executedPlan().toString()
        terms = {r["term"] for r in held.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {"w7", "w8"}.isdisjoint(terms) and {"w6", "w9", "elm"} <= terms


def test_everything_deleted_and_empty_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sg, "TIER", 2)
    path = str(tmp_path)
    with pytest.raises(ValueError):
        sg.open_segments(spark, path)
    put(spark, path, 0, [("t", 1, "oak"), ("t", 1, "ash")])
    put(spark, path, 1, [])
    put(spark, path, 2, [("t", 1, None)])
    held = ix.open_index(spark, path)
    assert held.postings.count() == held.docs.count() == held.terms.count() == 0
    put(spark, path, 3, [("t", 1, "fir")])
    holds(spark, path, [("t", 1, "fir")])


def test_stored_index_follows_its_table(spark, tmp_path):
    """The index of a table whose file has changed is built anew within one application."""
    from lexweave.plans.retrieval import stored_index
    path = str(tmp_path / "docs.parquet")

    def hits(text):
        spark.createDataFrame([("t", 1, text)], SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
        return {r["term"] for r in stored_index(spark, str(tmp_path), "x", spark.read.parquet(path)).terms.collect()}
    assert hits("oak") == {"oak"} and hits("elm fir") == {"elm", "fir"}
