"""Pruned searches give what full scans give and compute less where there is something to skip."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions.vectors import vector_topk
from lexweave.operators import blocks as bk
from lexweave.operators import index as ix
from lexweave.operators import pivots as pv
from lexweave.operators import retrieve as rt

ROWS = "tenant string, doc_id int, text string"


def same(got, want):
    rows = lambda df: sorted((r["query_id"], r["rank"], r["item_id"], r["score"]) for r in df.collect())
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    text = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=rng.randint(0, 40)))
    docs = spark.createDataFrame([("t" if i % 4 else "u", i, text()) for i in range(800)] + [("u", 900 + i, "w7 w8 same") for i in range(6)], ROWS)
    queries = spark.createDataFrame([("t", 1, "w200 w3"), ("t", 2, "w0 w1 w2 w3 w0"), ("u", 3, "same w8"), ("t", 4, "unknown"), ("u", 5, "w299"), ("v", 6, "w1")],
                                    "tenant string, query_id int, text string")
    folder = str(tmp_path_factory.mktemp("blocks"))
    ix.build_index(docs, f"{folder}/index")
    bk.build_blocks(ix.open_index(spark, f"{folder}/index"), f"{folder}/blocks", range_docs=16)
    return docs, queries, bk.open_blocks(spark, f"{folder}/blocks")


@pytest.mark.parametrize("k,rounds", [(1, (1,)), (3, (1, 4)), (10, ()), (500, (2,))])
def test_pruned_bm25_equals_the_full_scan(corpus, k, rounds):
    docs, queries, held = corpus
    hits, report = bk.pruned_topk(held, queries, k, rounds=rounds)
    same(hits, rt.bm25_topk(docs, queries, k))
    for r in report.collect():
        assert r["ranges_scored"] <= r["ranges"] and r["postings_scored"] <= r["postings"]


def test_pruned_bm25_scores_fewer_postings(corpus):
    docs, queries, held = corpus
    report = {r["query_id"]: r for r in bk.pruned_topk(held, queries, 2, rounds=(1, 4))[1].collect()}
    assert report[1]["postings_scored"] < 0.7 * report[1]["postings"]
    assert sum(r["postings_scored"] for r in report.values()) < 0.8 * sum(r["postings"] for r in report.values())


def test_blocks_move_postings_once(spark, tmp_path, monkeypatch):
    """Equal lengths by the hundred and a range of many batches; a file holds whole ranges, in order."""
    rng = random.Random(3)
    docs = spark.createDataFrame([("t", i, " ".join(f"w{rng.randint(0, 40)}" for _ in range(5 if i % 3 else i % 17))) for i in range(600)], ROWS).repartition(4)
    queries = spark.createDataFrame([("t", 1, "w1 w2 w3"), ("t", 2, "w40")], "tenant string, query_id int, text string")
    ix.build_index(docs, f"{tmp_path}/index")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        bk.build_blocks(ix.open_index(spark, f"{tmp_path}/index"), f"{tmp_path}/blocks", range_docs=16)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = bk.open_blocks(spark, f"{tmp_path}/blocks")
    assert held.blocks.groupBy("tenant", "term", "range").count().filter("count > 1").count() == 0
    entries = held.blocks.select("tenant", "term", "range", "most", F.explode("entries").alias("e")).select("*", "e.*")
    assert entries.count() == ix.postings(docs).count()
    assert entries.groupBy("tenant", "term", "range").agg(F.max("impact").alias("top"), F.first("most").alias("most")).filter("top <> most").count() == 0
    files = held.blocks.select("range", F.input_file_name().alias("file")).distinct().groupBy("range").count()
    assert files.filter("count > 1").count() == 0 and files.count() >= 30
    for bound in (0, 500_000):
        monkeypatch.setattr(ix, "BROADCAST_TERMS", bound)
        same(bk.pruned_topk(held, queries, 5, rounds=(2,))[0], rt.bm25_topk(docs, queries, 5))


def clustered(spark, n, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 5)) * 20
    points = np.round(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 5)), 3)
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(n + i, points[0].tolist()) for i in range(4)], "item_id int, embedding array<double>")


@pytest.mark.parametrize("k", [1, 7])
def test_pivots_equal_the_full_scan(spark, tmp_path, k):
    items = clustered(spark, 1500).repartition(3)
    queries = items.filter("item_id % 97 = 0").withColumnRenamed("item_id", "query_id")
    pv.build_pivots(items, str(tmp_path))
    hits, report = pv.pivot_topk(queries, str(tmp_path), k)
    same(hits, vector_topk(queries, items, k))
    r = report.first()
    assert r["pairs"] == queries.count() * 1504 and r["computed"] < 0.5 * r["pairs"]


def test_pivots_of_few_or_equal_items(spark, tmp_path):
    few = spark.createDataFrame([(f"i{i}", [1.0, 2.0]) for i in range(5)], "item_id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, embedding array<double>")
    pv.build_pivots(few, f"{tmp_path}/few")
    same(pv.pivot_topk(queries, f"{tmp_path}/few", 10)[0], vector_topk(queries, few, 10))
    pv.build_pivots(few.filter("false"), f"{tmp_path}/none")
    assert pv.pivot_topk(queries, f"{tmp_path}/none", 3)[0].count() == 0
    assert pv.pivot_topk(queries.filter("false"), f"{tmp_path}/few", 3)[0].count() == 0
