"""Reader and writer queries: a table is written to the shared folder in the format at hand and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.plans.graph import REL_SQL
from lexweave.plans.registry import query, table
from lexweave.scale import release, scratch_path, staged
from lexweave.sources import readers as rd
from lexweave.sources import sinks as sk


@query("src2_csv_text", "select s_nationkey, string_agg(s_suppkey || ' ' || s_name || ' x,\"' || s_suppkey || '\"', chr(10) order by s_suppkey) body from supplier group by 1")
def src2(spark, d):
    """One CSV folder per nation, header and quoted cells included; a nation's suppliers are one file."""
    path = scratch_path(spark, "csv")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.concat(F.lit('x,"'), "s_suppkey", F.lit('"')).alias("note"), "s_nationkey")
    (s.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey").write.partitionBy("s_nationkey")
     .option("header", "true").option("escape", '"').csv(path))
    t = rd.read_csv_as_text(spark, path)
    key = F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("int")
    return t.select(key.alias("s_nationkey"), F.regexp_replace("text", r"^[^\n]*\n", "").alias("body"))


@query("src6_catalog_files", """select p_partkey, case when p_size < 25 then p_name else 'skill' || p_partkey end as "name", case when p_size < 25 then p_type || ' and more' else 'Body of ' || p_brand end description, p_brand category from part""")
def src6(spark, d):
    """Parts as skill files; the large ones have no front matter."""
    p = table(spark, d, "part")
    text = F.when(F.col("p_size") < 25, F.concat(F.lit("---\nname: "), "p_name", F.lit("\ndescription: >\n  "), "p_type", F.lit("\n  and more\n---\n# x\n"))) \
        .otherwise(F.concat(F.lit("# head\n- item\n\nBody of "), "p_brand", F.lit("\n")))
    files = p.select(F.concat("p_brand", F.lit("/skill"), "p_partkey", F.lit("/SKILL.md")).alias("path"), text.alias("text"))
    c = rd.parse_catalog(files)
    return c.select(F.regexp_extract("path", r"skill(\d+)/", 1).cast("bigint").alias("p_partkey"), "name", "description", "category")


def _inventory(spark, d):
    path = scratch_path(spark, "inventory")
    table(spark, d, "customer").write.partitionBy("c_mktsegment").parquet(path)
    return rd.file_inventory(spark, path)


@query("src9_file_inventory")
def src9(spark, d):
    return _inventory(spark, d).select("name", "path", "size", "is_directory")


@query("agg24_folder_rollup")
def agg24(spark, d):
    return rd.entry_folders(_inventory(spark, d)).select("entry", "file_count", "size_bytes", "script_names")


@query("src11_qa_pairs", "select md5(trim(text)) question_md5, 'a' || item_id answer from benchmark")
def src11(spark, d):
    esc = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit("<qa_pair><question> "), esc, F.lit(" </question><answer>\n a"), "item_id", F.lit("</answer></qa_pair>"))
    return rd.parse_qa_pairs(table(spark, d, "benchmark").select(xml.alias("value"))).select(F.md5("question").alias("question_md5"), "answer")


@query("snk1_append_delete", "select source tenant, doc_id::varchar doc_id, md5(text) text_md5 from documents where lang <> 'de'")
def snk1(spark, d):
    path = scratch_path(spark, "chunks")
    docs = table(spark, d, "documents").select(F.col("source").alias("tenant"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_index"), "text", "lang")
    sk.append_chunks(docs, path)
    sk.delete_documents(spark, path, docs.filter("lang = 'de'").select("tenant", "doc_id"))
    return rd.read_chunks(spark, path).select("tenant", "doc_id", F.md5("text").alias("text_md5"))


@query("snk3_profiles", f"""with {REL_SQL}, t as (select distinct tenant from ed)
select tenant, 'node' kind, count(*) lines from nd group by 1 union all select tenant, 'edge', count(*) from ed group by 1
union all select tenant, 'preferences', 1 from t union all select tenant, 'statistics', 1 from t""")
def snk3(spark, d):
    from lexweave.operators import graph as gr
    from lexweave.plans.graph import graph
    path = scratch_path(spark, "profiles")
    nodes, edges = graph(spark, d)
    pref = gr.top_preferences(gr.preference_scores(nodes, edges, gr.pagerank(nodes, edges, max_iter=3, tol=None))).withColumnRenamed("rank", "pagerank").withColumnRenamed("pos", "rank")
    # Stored first, so that the files of their steps are gone when the graph is written.
    pref, stat = staged(pref, "preferences"), staged(gr.statistics(nodes, edges), "statistics")
    sk.write_profiles(nodes, edges, pref, stat, path)
    release(nodes, edges, pref, stat)
    return spark.read.schema("kind string, body string, tenant int").json(path).groupBy("tenant", "kind").agg(F.count("*").alias("lines"))


@query("snk4_benchmark_report")
def snk4(spark, d):
    from lexweave.operators import evals as ev
    from lexweave.plans.evals import runs
    s = ev.run_summary(runs(spark, d))
    return sk.benchmark_markdown(s, ev.run_delta(s), "demo", "model", "2024-01-01", [1])


@query("snk4_benchmark_json", """select doc_id run_number, case when n_chars > 900 then 'with_skill' else 'without_skill' end configuration, quality::double pass_rate from labels join documents using(doc_id)""")
def snk4_json(spark, d):
    from lexweave.plans.evals import runs
    zero = F.lit(0)
    r = runs(spark, d).select("eval_id", "configuration", "run_number", "pass_rate", zero.alias("passed"), zero.alias("failed"), zero.alias("total"), "time_seconds", "tokens",
                              zero.alias("tool_calls"), zero.alias("errors"), F.array("eval_id").alias("expectations"), F.array("lang").alias("notes"))
    v = sk.benchmark_json(r)
    return v.select(F.get_json_object("value", "$.run_number").cast("bigint").alias("run_number"), F.get_json_object("value", "$.configuration").alias("configuration"),
                    F.get_json_object("value", "$.result.pass_rate").cast("double").alias("pass_rate"))


@query("snk5_save_texts", "select 'n' || r_regionkey || '.txt' file, r_name as \"value\" from region")
def snk5(spark, d):
    path = scratch_path(spark, "texts")
    names = table(spark, d, "region").select("r_regionkey", F.concat(F.lit("../up\\n"), "r_regionkey", F.lit(".txt")).alias("name"), F.col("r_name").alias("text"))
    for odd in (0, 1):  # the second call leaves the files of the first
        sk.save_texts(names.filter(F.col("r_regionkey") % 2 == odd).drop("r_regionkey"), path)
    return spark.read.text(path).select("file", "value")


@query("snk6_memories", "select conv_id::varchar tenant, md5(text) content_md5, role tag, true id_ok from conversations")
def snk6(spark, d):
    path = scratch_path(spark, "memories")
    c = table(spark, d, "conversations")
    sk.append_memories(c.select(F.col("conv_id").cast("string").alias("tenant"), F.col("text").alias("content"), F.array("role").alias("tags"), F.lit("2024-01-01").cast("timestamp").alias("created_at")), path)
    m = spark.read.parquet(path)
    return m.select(F.col("tenant").cast("string").alias("tenant"), F.md5("content").alias("content_md5"), F.col("tags")[0].alias("tag"), (F.length("id") == 8).alias("id_ok"))


@query("flt14_likely_text", """with h as (select doc_id, left(hex(encode(case when lang = 'es' then chr(0) || text else text end)), 1024) x from documents),
p as (select doc_id, length(x) / 2 n, ' ' || regexp_replace(x, '(..)', '\\1 ', 'g') y from h)
select doc_id, n > 0 and not contains(y, ' 00 ') and len(regexp_extract_all(y, '(?:[2-6][0-9A-F]|7[0-9A-E]|0A|0D|09|08) ')) / n > 0.7 is_text from p""")
def flt14(spark, d):
    """Document texts as bytes; a third kind carries a NUL."""
    raw = F.encode(F.when(F.col("lang") == "es", F.concat(F.lit("\x00"), "text")).otherwise(F.col("text")), "UTF-8")
    return table(spark, d, "documents").select("doc_id", rd.likely_text(raw).alias("is_text"))
