"""Span queries. A correction is a fixed rewrite of a paragraph; five paragraphs are one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions.pytext import sanitize_udf, similarity_udf
from lexweave.operators import spans as sp
from lexweave.operators.lexicon import lexicon_issues
from lexweave.plans.registry import query, table
from lexweave.plans.scalars import strip_sql

PAR_SQL = f"""pl as (select doc_id, string_split(replace(regexp_replace(text,'[\\x{{a0}}\\x{{3000}}]+',' ','g'),'|',chr(10)), chr(10)) a from documents),
pe as (select doc_id, unnest(a) "text", (generate_subscripts(a,1)-1)::int par_no from pl),
pa as materialized (select *, offset_compact + par_no offset_source from (select *, coalesce(sum(length("text")) over (partition by doc_id order by par_no rows between unbounded preceding and 1 preceding),0)::bigint offset_compact from pe) where length({strip_sql('"text"')}) > 0)"""


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("win2_offsets", f"with {PAR_SQL} select doc_id, par_no, offset_compact, offset_source, md5(\"text\") text_md5 from pa")
def win2(spark, d):
    return sp.paragraphs(docs(spark, d)).select("doc_id", "par_no", "offset_compact", "offset_source", F.md5("text").alias("text_md5"))


@query("str18_segments")
def str18(spark, d):
    return sp.segments(docs(spark, d))


def rewritten(spark, d):
    """Paragraphs and their fixed rewrite; some marks only change at the edge."""
    new = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "tion", "sion"), "the ", "a "), r"\.$", "!")
    return sp.paragraphs(docs(spark, d)).select("doc_id", "par_no", "offset_source", F.col("text").alias("original"), new.alias("corrected"))


@query("str19_diff_spans")
def str19(spark, d):
    return sp.diff_spans(rewritten(spark, d)).select("doc_id", "par_no", "start", "end", "span_original", "span_corrected")


@query("str19_diff_steps", f"""with {PAR_SQL}, r as (select doc_id, par_no, "text" a, regexp_replace(replace(replace("text", 'tion', 'sion'), 'the ', 'a '), '[.]$', '!') b from pa)
select doc_id, par_no, length(a) taken, length(b) given, md5(b) rebuilt from r""")
def str19_steps(spark, d):
    """The steps of every pair, put together again: they cover the original and give the corrected text."""
    steps = sp.diff_steps(rewritten(spark, d))
    piece = F.struct("i1", "j1", F.when(F.col("tag") == "equal", F.expr("substr(original, i1 + 1, i2 - i1)")).otherwise(F.expr("substr(corrected, j1 + 1, j2 - j1)")).alias("text"))
    joined = F.array_join(F.array_sort(F.collect_list(piece))["text"], "")
    return steps.groupBy("doc_id", "par_no").agg(F.sum(F.col("i2") - F.col("i1")).cast("bigint").alias("taken"), F.sum(F.col("j2") - F.col("j1")).cast("bigint").alias("given"), F.md5(joined).alias("rebuilt"))


@query("flt7_sanity_gate", """select conv_id, turn, case when role = 'system' then false when length(c) > 2*length(text) then false when length(c) < 0.5*length(text) and length(text) > 10 then false else true end passes
 from (select *, case when contains(text,'the') then replace(text,'e','eee') when contains(text,'sch') then regexp_replace(text,'[a-m]','','g') else text || text || '.' end c from conversations)""")
def flt7(spark, d):
    c = table(spark, d, "conversations").withColumn("c", F.when(F.col("text").contains("the"), F.replace(F.col("text"), F.lit("e"), F.lit("eee")))
                                                    .when(F.col("text").contains("sch"), F.regexp_replace("text", "[a-m]", "")).otherwise(F.concat("text", "text", F.lit("."))))
    kind = F.when(F.col("role") == "system", F.lit("无误")).otherwise(F.lit("错别字"))
    return c.select("conv_id", "turn", sp.passes_gate(F.col("text"), F.col("c"), kind).alias("passes"))


@query("flt8_valid_spans", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_quantity::int - 5 >= 0 and l_linenumber*10 >= l_quantity::int - 5 and (l_returnflag = 'A' or l_linenumber*10 <= 40)")
def flt8(spark, d):
    original = F.when(F.col("l_returnflag") == "A", F.lit("")).otherwise(F.lit("x"))
    ok = sp.valid_span(F.col("l_quantity").cast("int") - 5, F.col("l_linenumber") * 10, original, F.lit(40))
    return table(spark, d, "lineitem").filter(ok).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


ISS = [("tion", "sion"), ("eaux", "eau"), ("keit", "heit")]
ISS_SQL = """w(wrong, suggestion) as (values ('tion','sion'),('eaux','eau'),('keit','heit')),
ip as (select doc_id, text, wrong, suggestion, string_split(text, wrong) p from documents, w where contains(text, wrong)),
io as (select *, unnest(generate_series(1, len(p)-1)) i from ip),
iz as materialized (select doc_id, text, wrong, suggestion, (list_sum(list_transform(list_slice(p,1,i), lambda x: length(x))) + (i-1)*length(wrong))::bigint st from io)"""


def issues(spark, d):
    return lexicon_issues(docs(spark, d), ISS)


@query("win13_context", f"with {ISS_SQL} select doc_id, st \"start\", wrong, substr(text, greatest(0,st-8)+1, st-greatest(0,st-8)) context_before, substr(text, st+length(wrong)+1, 8) context_after from iz")
def win13(spark, d):
    j = issues(spark, d).select("doc_id", "start", "end", F.col("original").alias("wrong")).join(docs(spark, d), "doc_id")
    return sp.add_context(j, "text", "start", "end").select("doc_id", "start", "wrong", "context_before", "context_after")


@query("str20_apply_issues", "select doc_id, md5(replace(replace(replace(text,'tion','sion'),'eaux','eau'),'keit','heit')) text_md5 from documents")
def str20(spark, d):
    return sp.apply_issues(docs(spark, d), issues(spark, d)).select("doc_id", F.md5("text").alias("text_md5"))


@query("agg7_issue_summary", f"""with {ISS_SQL}, s as (select doc_id, count(*) total_issues, count(*) filter (wrong='tion') errors, count(*) filter (wrong='eaux') warnings, count(*) filter (wrong='keit') suggestions from iz group by 1)
select *, case when errors > 0 then '检测到 ' || errors || ' 个错误需要修正，建议优先处理。' when warnings > 0 then '检测到 ' || warnings || ' 个警告，建议检查。' else '检测到 ' || suggestions || ' 个改进建议。' end overall from s""")
def agg7(spark, d):
    kinds = F.create_map(F.lit("tion"), F.lit("error"), F.lit("eaux"), F.lit("warning"), F.lit("keit"), F.lit("suggestion"))
    return sp.issue_summary(issues(spark, d).withColumn("type", F.element_at(kinds, F.col("original"))))


@query("win10_resolve_overlaps")
def win10(spark, d):
    """Lexicon hits of nested and overlapping forms."""
    lex = [("tion", "sion"), ("ti", "si"), ("ion", "on"), ("onen", "on"), ("sch", "sh"), ("chsch", "ch"), ("eaux", "eau"), ("eauxe", "eau")]
    i = lexicon_issues(docs(spark, d), lex).withColumn("issue_id", F.concat_ws("-", "start", "original"))
    return sp.resolve_overlaps(i.select("doc_id", "issue_id", "start", "end", "original", "suggestion"))


@query("str21_similarity")
def str21(spark, d):
    """Similarity of each paragraph with its rewrite."""
    r = rewritten(spark, d)
    return r.select("doc_id", "par_no", similarity_udf("original", "corrected").alias("similarity"))


def batches(spark, d):
    p = sp.paragraphs(docs(spark, d))
    return p.select("doc_id", F.floor(F.col("par_no") / 5).alias("batch"), F.col("par_no").cast("bigint").alias("par_no"), "text", "offset_source")


@query("join13_align")
def join13(spark, d):
    b = batches(spark, d)
    lines = b.filter(~F.col("text").contains("ouou")).select("doc_id", "batch", F.col("par_no").alias("line_no"), F.regexp_replace("text", "tion", "sion").alias("text"))
    return sp.align(lines, b.select("doc_id", "batch", F.col("par_no").alias("orig_no"), "text"))


@query("join14_match_results")
def join14(spark, d):
    b = batches(spark, d)
    new = F.regexp_replace("text", "tion", "sion")
    res = b.filter(~F.col("text").contains("ouou")).select("doc_id", "batch", F.col("par_no").alias("res_no"), F.when(F.col("text").contains("the"), F.lit("")).otherwise(new).alias("original"), new.alias("corrected"))
    return sp.match_results(res, b.select("doc_id", "batch", F.col("par_no").alias("orig_no"), "text"))


@query("join15_locate", f"""with {PAR_SQL}, s as (select doc_id, par_no//5 batch, par_no, "text" t, offset_source from pa),
c as (select doc_id, batch, par_no corr_id, case when contains(t, 'the') then regexp_replace(t, '[.]$', '') else t end o from s),
e as (select c.doc_id, c.corr_id, max(s.par_no) m from c join s on s.doc_id = c.doc_id and s.batch = c.batch and s.t = c.o group by 1, 2),
l as (select c.doc_id, c.corr_id, min(s.par_no) m from c join s on s.doc_id = c.doc_id and s.batch = c.batch and (contains(s.t, c.o) or contains(c.o, s.t) or {strip_sql('s.t')} = {strip_sql('c.o')}) where not exists (select 1 from e where e.doc_id = c.doc_id and e.corr_id = c.corr_id) group by 1, 2)
select u.doc_id, corr_id::bigint corr_id, m seg_no, offset_source "offset" from (select * from e union all select * from l) u join s on s.doc_id = u.doc_id and s.par_no = u.m""")
def join15(spark, d):
    b = batches(spark, d)
    segs = b.select("doc_id", "batch", F.col("par_no").cast("int").alias("seg_no"), "text", F.col("offset_source").alias("offset"))
    corr = b.select("doc_id", "batch", F.col("par_no").alias("corr_id"), F.when(F.col("text").contains("the"), F.regexp_replace("text", "[.]$", "")).otherwise(F.col("text")).alias("original"))
    return sp.locate(corr, segs).drop("batch")


REC = """'[纠错结果]' || chr(10) || '原句: ' || replace(text, chr(10), ' ') || chr(10) || '错情: 错误类型：' || case when contains(text,'the') then '标点使用' when contains(text,'que') then '语序' else '错别字' end || '，修改原因：x\\\\ny' || chr(10)
 || case when contains(text, 'ou') then '起始位置=3，终止位置=9' || chr(10) else '' end || '正确建议：' || case when contains(text,'sch') then '无' else replace(text, chr(10), ' ') || '+' end || chr(10) || '[纠错结果]' || chr(10) || '原句: 没事 无误'"""


@query("str23_parse_labelled", f"""with r as (select conv_id*1000+turn doc_id, {strip_sql("replace(text, chr(10), ' ')")} o, text, {REC.replace('x' + chr(92) * 4 + 'ny', 'x' + chr(92) + 'ny').replace(chr(92) * 2, chr(92))} c from conversations)
select doc_id, md5(o) original_md5, case when contains(text,'the') then '标点' when contains(text,'que') then '语序' else '错别字' end category, case when contains(text,'ou') then 3 else 0 end start_pos,
 (case when contains(text,'ou') then 9 else length(o) end)::int end_pos, case when contains(text,'sch') then '-' else md5({strip_sql("replace(text, chr(10), ' ') || '+'")}) end suggestion_md5 from r where not contains(text, '无误')""")
def str23(spark, d):
    c = table(spark, d, "conversations")
    raw = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.expr(REC).alias("content"))
    p = sp.parse_labelled(raw)
    return p.select("doc_id", F.md5("original").alias("original_md5"), "category", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"),
                    F.coalesce(F.md5("suggestion"), F.lit("-")).alias("suggestion_md5"))


@query("str23_corrected_body", f"""select conv_id*1000+turn doc_id, 'why ' || role think, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '[ ]+$', '')), lambda s: {strip_sql('s')} <> ''), chr(10))) body_md5,
 case role when 'user' then '语序错误' else '错别字' end error_type, '说' || turn explanation from conversations""")
def str23_body(spark, d):
    c = table(spark, d, "conversations")
    raw = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat(
        F.lit("<think> why "), "role", F.lit(" </think>\n错误类型："), F.when(F.col("role") == "user", "语序错误").otherwise("别的"), F.lit("，\n修改说明：说"), "turn", F.lit("\n\n"), "text").alias("content"))
    return sp.parse_corrected_body(raw).select("doc_id", "think", F.md5("body").alias("body_md5"), "error_type", "explanation")


@query("str16_sanitize")
def str16(spark, d):
    """Replies with a table row, a path and a fenced block around each conversation text."""
    raw = F.concat("text", F.lit("\n| a | b |\nsee /tmp/x.py now\n\n\n\n```\n| kept |\n```\n\x01"), F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", sanitize_udf(raw).alias("clean"))
