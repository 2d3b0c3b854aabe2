"""Document queries. File name and extension come from source, doc_id and lang."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions.text import BLANK, NOT_BLANK, window_count
from lexweave.operators import documents as dc
from lexweave.plans.registry import query, table

NAME = "source || '_' || doc_id || case lang when 'en' then '.txt' when 'fr' then '.MD' when 'de' then '.docx' else '.exe' end"
META_SQL = f"""m as (select doc_id, {NAME} filename, case lang when 'en' then '.txt' when 'fr' then '.md' when 'de' then '.docx' else '.exe' end file_extension,
 n_chars size_bytes, timestamp '2024-01-01' + to_minutes(doc_id) added_at, source title, text from documents)"""


def meta(spark, d):
    docs = table(spark, d, "documents").withColumn("filename", F.expr(NAME))
    return dc.admit(docs).select(
        "doc_id", "filename", F.col("filename").alias("name"), "file_extension", "success", "message", F.col("n_chars").alias("size_bytes"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,doc_id,0)").alias("added_at"), F.col("source").alias("title"), "text")


@query("flt1_admit", f"with {META_SQL} select doc_id, file_extension, file_extension <> '.exe' success, case file_extension when '.exe' then '不支持的文件类型: .exe' else '' end message from m")
def flt1(spark, d):
    return meta(spark, d).select("doc_id", "file_extension", "success", "message")


@query("agg23_upload_outcome", f"with {META_SQL} select count(*) total_files, count(*) filter (file_extension <> '.exe') success_count, count(*) filter (file_extension = '.exe') failure_count, count(*) filter (file_extension = '.exe') = 0 success, case when count(*) filter (file_extension = '.exe') = 0 then '批量上传完成' else '部分文件上传失败' end message from m")
def agg23(spark, d):
    return dc.upload_outcome(meta(spark, d))


@query("flt2_document_filter", f"with {META_SQL} select doc_id, filename from m where (contains(lower(filename), 'src1') or contains(lower(title), 'src1')) and file_extension in ('.doc','.docx')")
def flt2(spark, d):
    return meta(spark, d).filter(dc.document_filter(" SRC1", "word")).select("doc_id", "filename")


@query("flt4_tenant_scope", "select doc_id, source tenant, case when lang = 'es' then 'default' when lang = 'de' then 'other' else source end own_tenant, case when lang in ('es','de') then false else true end admitted from documents")
def flt4(spark, d):
    own = F.when(F.col("lang") == "de", F.lit("other")).when(F.col("lang") != "es", F.col("source"))
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("tenant"), dc.tenant_of(own).alias("own_tenant"),
                                               dc.in_tenant(own, F.col("source")).alias("admitted"))


@query("flt6_not_blank", f"select conv_id, turn, role from (select *, case role when 'system' then chr(12288) || chr(10) || ' ' else text end t from conversations) where length(regexp_replace(t, '{BLANK}', '', 'g')) > 0")
def flt6(spark, d):
    t = F.when(F.col("role") == "system", F.lit("　\n ")).otherwise(F.col("text"))
    return table(spark, d, "conversations").filter(dc.not_blank(t)).select("conv_id", "turn", "role")


TOKS = f"regexp_extract_all(text, '{NOT_BLANK}+{BLANK}*|^{BLANK}+')"


@query("win1_token_windows", f"""with t as (select doc_id, {TOKS} toks from documents),
s as (select doc_id, toks, unnest(range(0, len(toks), 500)) st from t)
select doc_id, (st//500)::int chunk_index, doc_id || ':' || st//500 chunk_uid, least(600, len(toks)-st)::int n_tokens, md5(array_to_string(list_slice(toks, st+1, st+600), '')) text_md5 from s""")
def win1(spark, d):
    c = dc.chunk(table(spark, d, "documents").select("doc_id", "text"))
    return c.select("doc_id", "chunk_index", "chunk_uid", "n_tokens", F.md5("text").alias("text_md5"))


def with_chunks(spark, d):
    return meta(spark, d).withColumn("chunks_count", window_count(F.col("text")))


@query("agg2_index_status", f"""with {META_SQL} select count(*) document_count, sum(ceil(len({TOKS})/500.0))::bigint chunks_count, sum(size_bytes)::bigint total_size_bytes, strftime(max(added_at),'%Y-%m-%d %H:%M:%S') last_updated,
 case when sum(size_bytes) < 1048576 then printf('%.1f KB', sum(size_bytes)/1024.0::double) when sum(size_bytes) < 1073741824 then printf('%.1f MB', sum(size_bytes)/1048576.0::double) else printf('%.1f GB', sum(size_bytes)/1073741824.0::double) end total_size, 'Indexed' state from m""")
def agg2(spark, d):
    return dc.index_status(with_chunks(spark, d)).withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss"))


@query("agg2_type_counts", f"with {META_SQL} select upper(ltrim(file_extension,'.')) file_type, count(*) files from m group by 1")
def agg2_types(spark, d):
    return dc.type_counts(meta(spark, d))


@query("agg2_recent_documents", f"with {META_SQL} select doc_id, filename, strftime(added_at,'%Y-%m-%d %H:%M:%S') added_at from m order by m.added_at desc, doc_id limit 5")
def agg2_recent(spark, d):
    return dc.recent(meta(spark, d)).select("doc_id", "filename", F.date_format("added_at", "yyyy-MM-dd HH:mm:ss").alias("added_at"))


@query("agg3_index_state", f"with {META_SQL} select title tenant, case when sum(ceil(len({TOKS})/500.0)) > 0 then 'Indexed' else 'Empty' end state, count(*) documents, sum(ceil(len({TOKS})/500.0))::bigint chunks from m group by 1")
def agg3(spark, d):
    g = with_chunks(spark, d).groupBy(F.col("title").alias("tenant")).agg(F.count("*").alias("documents"), F.sum("chunks_count").alias("chunks"))
    return g.withColumn("state", F.when(F.col("chunks") > 0, F.lit("Indexed")).otherwise(F.lit("Empty")))


@query("agg4_top_file_types", f"with {META_SQL} select upper(ltrim(file_extension,'.')) file_type, count(*) files from m group by 1 order by files desc, file_type limit 4")
def agg4(spark, d):
    return dc.type_counts(meta(spark, d)).orderBy(F.col("files").desc(), "file_type").limit(4)


@query("top4_document_order", f"with {META_SQL} select doc_id, row_number() over (order by added_at desc nulls last, doc_id)::bigint pos from m")
def top4(spark, d):
    from lexweave.scale import positions
    dated = meta(spark, d).select("doc_id", F.coalesce(-F.unix_micros(F.col("added_at").cast("timestamp")), F.lit(2 ** 62)).alias("_down"))
    return positions(dated, [], ["_down", "doc_id"], F.floor(F.col("_down") / 3_600_000_000)).select("doc_id", "pos")


@query("src4_chunk_scan", f"""with t as (select doc_id, source tenant, {TOKS} toks from documents), s as (select tenant, unnest(range(0, len(toks), 500)) st, len(toks) n from t)
select tenant, count(*) chunks, sum(least(600, n-st))::bigint tokens from s group by 1""")
def src4(spark, d):
    """Chunks written by tenant folder and scanned back with the fixed schema."""
    from lexweave.scale import scratch_path
    from lexweave.sources.readers import read_chunks
    from lexweave.sources.sinks import append_chunks
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("tenant"), "text", F.lit("doc").alias("source"))
    path = scratch_path(spark, "chunks")
    append_chunks(dc.chunk(docs, keep=("tenant", "source")), path)
    back = read_chunks(spark, path)
    n = F.size(F.regexp_extract_all("text", F.lit(f"{NOT_BLANK}+{BLANK}*|^{BLANK}+"), F.lit(0)))
    return back.groupBy("tenant").agg(F.count("*").alias("chunks"), F.sum(n).alias("tokens"))
