"""Readers, writers, accounts and stream state."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexweave.functions import tools as tl
from lexweave.operators import accounts as ac
from lexweave.sources import readers as rd
from lexweave.sources import sinks as sk
from lexweave.streaming import jobs


def test_text_csv_and_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\rz")
    (tmp_path / "sub" / "B.csv").write_text('n,v\n1,"a, ""q"""\n')
    assert rd.read_texts(spark, str(tmp_path / "a.txt")).first()["text"] == "x\ny\nz"
    assert rd.read_csv_as_text(spark, str(tmp_path / "sub" / "B.csv")).first()["text"] == 'n v\n1 a, "q"'
    inv = [(r["name"], r["path"], r["size"], r["is_directory"]) for r in rd.file_inventory(spark, str(tmp_path)).collect()]
    assert inv == [("sub", "sub", 0, True), ("a.txt", "a.txt", 6, False), ("B.csv", "sub/B.csv", 17, False)]


def test_likely_text(spark):
    rows = [(b"plain text\n", True), (b"a\x00b", False), (b"", False), (bytes(range(200, 250)), False)]
    df = spark.createDataFrame([(bytearray(b), w) for b, w in rows], "content binary, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", rd.likely_text(F.col("content"))).collect())


def test_session_files(spark, tmp_path):
    doc = {"session_id": "s1", "tenant_uuid": None, "title": "t", "conversations": [{"user_content": "hi", "ai_content": "yo", "metadata": {"k": "v"}}]}
    (tmp_path / "session_1.json").write_text(json.dumps(doc))
    (tmp_path / "session_2.json").write_text("{broken")
    (tmp_path / "session_3.json").write_text(json.dumps({**doc, "session_id": "s3", "tenant_uuid": "other"}))
    got = rd.session_turns(rd.read_sessions(spark, str(tmp_path), "default")).collect()
    assert [(r["session_id"], r["user_content"], r["metadata"]) for r in got] == [("s1", "hi", {"k": "v"})]


def test_catalog_files(spark, tmp_path):
    def put(folder, text):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "SKILL.md").write_text(text)
    put("docs/pdf", "---\nname: pdf\ndescription: >\n  reads\n  pages\n---\n# x\n")
    put("plain", "# head\n- item\nFirst body line\n")
    put("odd", '---\nname: "odd\ndescription: it\'s: fine\n---\nbody\n')
    put("long", "---\nname: long\ndescription: " + "d" * 1100 + "\n---\n")
    got = {r["name"]: (r["description"], r["category"]) for r in rd.read_catalog(spark, str(tmp_path)).collect()}
    assert got["pdf"] == ("reads pages", "docs")
    assert got["plain"] == ("First body line", None)
    assert got["odd"] == ("it's: fine", None)
    assert len(got["long"][0]) == 1024 and got["long"][0].endswith("...")


def test_eval_tree(spark, tmp_path):
    run = tmp_path / "eval-3" / "with_skill" / "run-2"
    run.mkdir(parents=True)
    (run / "grading.json").write_text(json.dumps({"summary": {"pass_rate": 0.5, "passed": 1, "failed": 1, "total": 2}, "expectations": [{"text": "e", "passed": True, "evidence": "x"}],
                                                  "user_notes_summary": {"needs_review": ["n"]}}))
    (run / "timing.json").write_text(json.dumps({"total_duration_seconds": 4.5, "total_tokens": 9}))
    r = rd.read_eval_runs(spark, str(tmp_path)).first()
    assert (r["eval_id"], r["configuration"], r["run_number"], r["pass_rate"], r["time_seconds"], r["tokens"], r["notes"]) == (3, "with_skill", 2, 0.5, 4.5, 9, ["n"])


def test_qa_pairs(spark, tmp_path):
    (tmp_path / "q.xml").write_text("<evaluation><qa_pair><question> a? </question><answer> b </answer></qa_pair><qa_pair><question>only</question></qa_pair></evaluation>")
    assert [tuple(r) for r in rd.read_qa_pairs(spark, str(tmp_path / "q.xml")).collect()] == [("a?", "b")]


def test_chunks_append_delete(spark, tmp_path):
    path = str(tmp_path / "chunks")
    sk.append_chunks(spark.createDataFrame([("t1", "a", 0, "x"), ("t1", "b", 0, "y"), ("t2", "c", 0, "z")], "tenant string, doc_id string, chunk_index int, text string"), path)
    gone = lambda *rows: spark.createDataFrame(list(rows), "tenant string, doc_id string")
    with pytest.raises(ValueError, match="unknown"):
        sk.delete_documents(spark, path, gone(("t1", "nope")))
    sk.delete_documents(spark, path, gone(("t1", "a"), ("t2", "c")))
    assert [(r["tenant"], r["doc_id"]) for r in rd.read_chunks(spark, path).collect()] == [("t1", "b")]
    assert rd.read_chunks(spark, path, "t2").count() == 0


def test_other_sinks(spark, tmp_path):
    sk.append_memories(spark.createDataFrame([(None, "likes short answers", ["selftest"], datetime(2024, 1, 1))], "tenant string, content string, tags array<string>, created_at timestamp"), str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m")).first()
    assert m["tenant"] == "default" and len(m["id"]) == 8
    sk.save_texts(spark.createDataFrame([("../../etc/n.txt", "hello")], "name string, text string"), str(tmp_path / "t"))
    assert [(r["file"], r["value"]) for r in spark.read.text(str(tmp_path / "t")).collect()] == [("n.txt", "hello")]


def test_benchmark_report(spark):
    from lexweave.operators import evals as ev
    runs = spark.createDataFrame([("new_skill", 1.0, 2.0, 10), ("old_skill", 0.5, 1.0, 4)], "configuration string, pass_rate double, time_seconds double, tokens int")
    s = ev.run_summary(runs)
    lines = [r["value"] for r in sk.benchmark_markdown(s, ev.run_delta(s), "demo", "m", "d", [1, 2]).orderBy("line_no").collect()]
    assert "| Metric | New Skill | Old Skill | Delta |" in lines
    assert "| Pass Rate | 100% ± 0% | 50% ± 0% | +0.50 |" in lines
    assert "| Time | 2.0s ± 0.0s | 1.0s ± 0.0s | +1.0s |" in lines


def test_profiles(spark, tmp_path):
    nodes = spark.createDataFrame([("t", "x", 1)], "tenant string, id string, mentions int")
    edges = spark.createDataFrame([("t", "USER", "x", 0.5)], "tenant string, src string, dst string, weight double")
    pref = spark.createDataFrame([("t", 1, "x", 9.0)], "tenant string, rank int, id string, score double")
    stat = spark.createDataFrame([("t", 2)], "tenant string, total_nodes int")
    sk.write_profiles(nodes, edges, pref, stat, str(tmp_path / "p"))
    assert sorted(r["kind"] for r in spark.read.json(str(tmp_path / "p")).collect()) == ["edge", "node", "preferences", "statistics"]
    files = list((tmp_path / "p" / "tenant=t").glob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)


def test_registrations_are_settled_in_order(spark):
    new = spark.createDataFrame([(1, "a", "m1"), (2, "a", "m2"), (3, "b", "m2"), (4, "c", "m1"), (5, "b", "m5"), (6, "old", "m6")], "seq int, username string, email string")
    users = spark.createDataFrame([(1, "old", "o@x")], "id int, username string, email string")
    assert sorted(r["seq"] for r in ac.admit_registrations(new, users).collect()) == [1, 3]


def test_server_layers(spark):
    from lexweave.operators import catalog as ct
    mk = lambda rows: spark.createDataFrame(rows, "ord int, name string, command string, disabled boolean")
    merged = ct.layered([("global", False, mk([(0, "g", "run", None), (1, "x", "run", None)])), ("tenant", True, mk([(0, "x", "mine", True)]))])
    got = {r["name"]: (r["source"], r["on"]) for r in merged.withColumn("on", ct.enabled(F.col("disabled"), F.lit(None).cast("boolean"))).collect()}
    assert got == {"g": ("global", True), "x": ("tenant", False)}


def test_memory_search(spark):
    from lexweave.operators.sessions import search_memories
    m = spark.createDataFrame([(0, "自测：用户喜欢简洁回答", ["selftest"]), (1, "other", [])], "ord int, content string, tags array<string>")
    assert [r["ord"] for r in search_memories(m, "简洁").collect()] == [0]
    assert [r["ord"] for r in search_memories(m, "").collect()] == [1, 0]


def test_token_buffer(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    ms = lambda n: t0 + timedelta(milliseconds=n)
    rows = [("s", 1, ms(0), "token", "a" * 20), ("s", 2, ms(5), "token", "b" * 20), ("s", 3, ms(6), "token", "c" * 20),
            ("s", 4, ms(10), "token", "d"), ("s", 5, ms(50), "token", "e"), ("s", 6, ms(51), "step", "S"), ("s", 7, ms(52), "done", "D")]
    df = spark.createDataFrame(rows, "session_id string, seq bigint, ts timestamp, event_type string, payload string")
    df.write.parquet(str(tmp_path / "in"))
    out = jobs.run_to_folder(spark, jobs.coalesce_tokens(jobs.read_events(spark, str(tmp_path / "in"), df.schema)), "t", idle_batches=False)
    got = [(r["first_seq"], r["event_type"], r["content"]) for r in spark.read.parquet(out).orderBy("first_seq").collect()]
    assert got == [(1, "token", "a" * 20 + "b" * 20 + "c" * 20), (4, "token", "d"), (5, "token", "e"), (6, "step", "S"), (7, "done", "D")]


def test_index_upkeep_over_several_batches(spark, tmp_path):
    from lexweave.operators import index as ix
    docs = spark.createDataFrame([("t", i, f"w{i % 3} w{i % 5} common") for i in range(20)], "tenant string, doc_id int, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "index")
    jobs.maintain_index(spark, jobs.read_events(spark, str(tmp_path / "in"), docs.schema, files_per_trigger=1), path)
    got = {(r["term"], r["df"]) for r in jobs.index_terms(spark, path).collect()}
    assert got == {(r["term"], r["df"]) for r in ix.term_stats(ix.postings(docs)).collect()}
    assert jobs.index_corpus(spark, path).first()["n"] == 20
    assert spark.read.parquet(jobs.compact_terms(spark, path)).count() == len(got)


def test_tool_description():
    def greet(name: str, times: int | None = 2, loud: bool = False) -> str:
        """Say hello."""
        return name * times
    d = tl.describe(greet)
    assert d["params"] == {"name": {"type": "string", "required": True}, "times": {"type": "integer", "required": False}, "loud": {"type": "boolean", "required": False}}
    assert tl.call(greet, {"name": "x", "times": None}) == "xx"
    with pytest.raises(ValueError):
        tl.describe(lambda x: x)


def test_index_goes_on_after_a_restart(spark, tmp_path):
    from lexweave.streaming import jobs
    schema = "tenant string, doc_id string, text string"
    arrive = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: jobs.maintain_index(spark, jobs.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), str(tmp_path / "ix"))
    df = lambda: {r["term"]: r["df"] for r in jobs.index_terms(spark, str(tmp_path / "ix")).collect()}
    corpus = lambda: jobs.index_corpus(spark, str(tmp_path / "ix")).first()["n"]
    arrive([("t", f"d{i}", "common word") for i in range(20)])
    run()
    assert df()["common"] == 20 and corpus() == 20
    arrive([("t", "d20", "common other")])
    run()
    assert df() == {"common": 21, "word": 20, "other": 1} and corpus() == 21
    arrive([("t", "d0", None), ("t", "d1", "other text")])
    run()
    assert df() == {"common": 19, "word": 18, "other": 2, "text": 1} and corpus() == 20


def test_writers_keep_earlier_data(spark, tmp_path):
    from lexweave.sources import sinks as sk
    for name in ("a.txt", "b.txt"):
        sk.save_texts(spark.createDataFrame([(name, name * 2)], "name string, text string"), str(tmp_path / "t"))
    assert {(r["file"], r["value"]) for r in spark.read.text(str(tmp_path / "t")).collect()} == {("a.txt", "a.txta.txt"), ("b.txt", "b.txtb.txt")}
    log = lambda turn, version: spark.createDataFrame(
        [("t", "s", turn, version, f"2024-01-0{turn + version} 00:00:00", f"u{turn}{version}")], "tenant string, session_id string, turn int, version int, ts string, user_content string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    for turn, version in ((0, 1), (1, 1), (1, 2)):
        sk.write_sessions(log(turn, version), str(tmp_path / "s"))
    got = {(r["turn"], r["user_content"]) for r in spark.read.parquet(str(tmp_path / "s/turns")).collect()}
    assert got == {(0, "u01"), (1, "u12")}


def test_a_table_that_is_a_folder_of_files_is_streamed(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "doc_id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows.toPandas().to_parquet(tmp_path / "events.parquet")
    for name in ("documents", "events"):
        out = jobs.run_to_folder(spark, jobs.read_table_events(spark, str(tmp_path), name, rows.schema), name)
        assert spark.read.parquet(out).count() == 6


def test_a_lot_arrives_in_as_many_files_as_its_table_has(spark, tmp_path, monkeypatch):
    from lexweave.plans import streams
    docs = spark.createDataFrame([(i, f"les eaux {i}\nun") for i in range(24)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(streams, "scratch_path", lambda s, label: str(tmp_path / label))
    got = streams.stm6_batches(spark, str(tmp_path)).orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(n, 16, 8, 16 * (n + 1), 48, 8 * (n + 1)) for n in range(3)]
    assert len(list((tmp_path / "arrivals").glob("*.parquet"))) > 3


def test_catalog_files_of_one_input_file_are_read_by_many_tasks(spark):
    files = spark.createDataFrame([(f"a/s{i}/SKILL.md", f"---\nname: n{i}\n---\n") for i in range(40)], "path string, text string").coalesce(1)
    parsed = rd.parse_catalog(files)
    assert parsed.rdd.getNumPartitions() == 8
    assert {r["name"] for r in parsed.collect()} == {f"n{i}" for i in range(40)}
