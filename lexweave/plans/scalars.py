"""Scalar function queries, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import numbers as nm
from lexweave.functions import text as tx
from lexweave.plans.registry import query, table
from lexweave.plans.retrieval import TOK

BLANK = tx.BLANK
CAT_TOK = ("list_concat(list_transform(regexp_extract_all({c},'[a-zA-Z0-9]+'), lambda t: lower(t)), "
           "regexp_extract_all({c},'[一-鿿]'))")


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def docs(spark, d):
    return table(spark, d, "documents")


@query("str1_rag_tokens", f"select doc_id, len(t)::bigint n, md5(array_to_string(t,' ')) tokens_md5 from (select doc_id, {TOK.format(c='text')} t from documents)")
def str1(spark, d):
    t = docs(spark, d).select("doc_id", tx.rag_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("str2_catalog_tokens", f"select doc_id, len(t)::bigint n, md5(array_to_string(t,' ')) tokens_md5 from (select doc_id, {CAT_TOK.format(c='text')} t from documents)")
def str2(spark, d):
    t = docs(spark, d).select("doc_id", tx.catalog_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


WORD_CHARS = ("etaoinshrdl", "的一是不了人我在有他这")
WORDS = [("的一", 40), ("一是", 12), ("一是不", 9), ("不了", 30), ("人我", 5), ("我在", 25), ("在有", 7), ("有他", 3), ("的", 80), ("在", 2), ("他这的", 6), ("了人", 30)]
#: Best paths from each run's end: scores and joined words of the three suffixes behind a place, words of up to three characters.
WORDS_SQL = f"""
with recursive c as (select conv_id, turn, translate(lower(text), '{WORD_CHARS[0]}', '{WORD_CHARS[1]}') t from conversations),
runs as (select conv_id, turn, unnest(r) run, generate_subscripts(r, 1) k from (select *, regexp_extract_all(t, '[一-鿿]+') r from c)),
lx as (select [{", ".join(f"'{w}'" for w, _ in WORDS)}] ws, [{", ".join(f"ln({n} / {sum(n for _, n in WORDS)}.0)" for _, n in WORDS)}]::double[] ls, ln(1 / {sum(n for _, n in WORDS)}.0)::double alone),
p as (
  select conv_id, turn, k, run, length(run) i, 0::double s0, null::double s1, null::double s2, '' t0, '' t1, '' t2 from runs
  union all
  select conv_id, turn, k, run, i - 1, case when c3 >= greatest(c1, coalesce(c2, c1)) then c3 when c2 >= c1 then c2 else c1 end, s0, s1,
    case when c3 >= greatest(c1, coalesce(c2, c1)) then run[i:i+2] || ' ' || t2 when c2 >= c1 then run[i:i+1] || ' ' || t1 else run[i] || ' ' || t0 end, t0, t1
  from (select p.*, coalesce(ls[list_position(ws, run[i])], alone) + s0 c1, ls[list_position(ws, run[i:i+1])] + s1 c2, ls[list_position(ws, run[i:i+2])] + s2 c3 from p, lx where i > 0)),
w as (select conv_id, turn, string_agg(t0, '' order by k) words from p where i = 0 group by all)
select conv_id, turn, md5(trim(array_to_string(list_transform(regexp_extract_all(t, '[a-zA-Z0-9]+'), lambda x: x || ' '), '') || coalesce(words, ''))) tokens_md5 from c left join w using (conv_id, turn)"""


@query("str2_segmented_tokens", WORDS_SQL)
def str2_segmented(spark, d):
    from lexweave.operators.lexicon import segmented_tokens
    tokens = segmented_tokens(spark.createDataFrame(WORDS, "word string, weight int"))
    t = table(spark, d, "conversations").select("conv_id", "turn", F.translate(F.lower("text"), *WORD_CHARS).alias("t"))
    return t.select("conv_id", "turn", F.md5(F.array_join(tokens(F.col("t")), " ")).alias("tokens_md5"))


TERMS_SQL = "(select conv_id, turn, lower(text) low, ['the','de','und'] terms from conversations)"


@query("str3_term_hits", f"select conv_id, turn, list_sum(list_transform(terms, lambda t: (length(low)-length(replace(low,t,'')))//length(t)))::bigint score from {TERMS_SQL}")
def str3(spark, d):
    terms = tx.query_terms(F.lit(" the  de\tUND "))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.term_hits(F.col("text"), terms).alias("score"))


TOOL_NAME = "case when p_size > 25 then 'mcp__' || p_brand || '__' || replace(p_name,' ','_') when p_size > 12 then 'mcp__' || p_name else replace(p_name,' ','.') end"


def tools(spark, d):
    p = table(spark, d, "part")
    name = F.expr(TOOL_NAME)
    return p.select("p_partkey", name.alias("name"), F.col("p_type").alias("description"),
                    F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("price"),
                                 F.col("p_retailprice").cast("string")).alias("params"))


@query("str4_tool_search_text", f"select p_partkey, regexp_replace(name, '[_.:\\-]+', ' ', 'g') || ' ' || description || ' size price' coarse_text from (select p_partkey, {TOOL_NAME} \"name\", p_type description from part)")
def str4(spark, d):
    return tools(spark, d).select("p_partkey", tx.tool_search_text(F.col("name"), F.col("description"), F.col("params")).alias("coarse_text"))


@query("str5_leaf_and_service", f"""select p_partkey,
 case when name like 'mcp\\_\\_%\\_\\_%' escape '\\' then regexp_extract(name, '^mcp__(.*?)__(.*)$', 2) else name end leaf,
 case when name like 'mcp\\_\\_%\\_\\_%' escape '\\' then regexp_extract(name, '^mcp__(.*?)__(.*)$', 1) when name like 'mcp\\_\\_%' escape '\\' then 'mcp' else '' end service
 from (select p_partkey, {TOOL_NAME} "name" from part)""")
def str5(spark, d):
    return tools(spark, d).select("p_partkey", tx.leaf_name(F.col("name")).alias("leaf"),
                                  tx.service_of(F.col("name"), F.lit(None).cast("string")).alias("service"))


RAW_TYPE = ("case p_type when 'STANDARD' then '  FILE-SYSTEMS ' when 'ECONOMY' then '搜索' when 'MEDIUM' then 'nonsense' "
            "when 'PROMO' then '' when 'LARGE' then 'Research' else null end")


@query("str6_type_normalise", f"""select p_partkey, case trim(lower(raw)) when 'file-systems' then 'file-systems' when '搜索' then 'search' when 'research' then 'research' else '' end slug,
 case trim(lower(raw)) when 'file-systems' then '文件系统' when '搜索' then '搜索' when 'research' then '研究' when 'nonsense' then 'nonsense' else '未分类' end as label
 from (select p_partkey, {RAW_TYPE} raw from part)""")
def str6(spark, d):
    raw = table(spark, d, "part").select("p_partkey", F.expr(RAW_TYPE).alias("raw"))
    return raw.select("p_partkey", tx.normalize_type(F.col("raw")).alias("slug"), tx.type_label(F.col("raw")).alias("label"))


@query("str7_slug", "select p_partkey, trim(regexp_replace(lower('_' || p_brand || ' / ' || p_name || '!'),'[^a-z0-9]+','-','g'),'-') slug from part")
def str7(spark, d):
    raw = F.concat(F.lit("_"), F.col("p_brand"), F.lit(" / "), F.col("p_name"), F.lit("!"))
    return table(spark, d, "part").select("p_partkey", tx.slug(raw).alias("slug"))


@query("str8_text_stats", f"""select doc_id, length(text)::bigint chars, length(regexp_replace(text,'{BLANK}','','g'))::bigint chars_no_space,
 len(regexp_extract_all(text,'[一-鿿]'))::bigint chinese_chars, len(regexp_extract_all(text,'[\\p{{L}}\\p{{N}}_]+'))::bigint words,
 case when text='' then 0 else length(text)-length(replace(text,chr(10),''))+1 end::bigint as lines from documents""")
def str8(spark, d):
    return docs(spark, d).select("doc_id", *[c.alias(n) for n, c in tx.text_stats(F.col("text")).items()])


HTML_SQL = "html"
for _p, _r in [(r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>", " "),
               (r"(?s)<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), (r"[ \t]+", " "),
               (rf"\n{BLANK}*\n{BLANK}*", "\n\n")]:
    HTML_SQL = f"regexp_replace({HTML_SQL}, '{_p}', '{_r}', 'g')"


@query("str9_strip_html", f"select page_id, {strip_sql(HTML_SQL)} text from pages")
def str9(spark, d):
    return table(spark, d, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query("str10_truncate", "select doc_id, md5(case when length(text) > 12000 then left(text,12000) || chr(10) || '…（已截断，共 ' || length(text) || ' 字符）' else text end) out_md5 from documents")
def str10(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.truncate_note(F.col("text"))).alias("out_md5"))


@query("str11_regex_extract", r"select doc_id, len(m)::bigint n, array_to_string(m,'|') found from (select doc_id, list_slice(regexp_extract_all(text,'([A-Za-z]+)tion',1),1,50) m from documents)")
def str11(spark, d):
    m = docs(spark, d).select("doc_id", tx.regex_matches(F.col("text"), "([A-Za-z]+)tion", 1, 50).alias("m"))
    return m.select("doc_id", F.size("m").cast("bigint").alias("n"), F.array_join("m", "|").alias("found"))


@query("str12_json_path", "select event_id, json_extract_string(props,'$.k') k, case when json_extract_string(props,'$.k') is null then '路径 ''k'' 无法解析' end k_error, json_extract_string(props,'$.z[0].q') z, case when json_extract_string(props,'$.z[0].q') is null then '路径 ''z[0].q'' 无法解析' end z_error from events")
def str12(spark, d):
    k, ke = tx.json_path(F.col("props"), "k")
    z, ze = tx.json_path(F.col("props"), "z[0].q")
    return table(spark, d, "events").select("event_id", k.alias("k"), ke.alias("k_error"), z.alias("z"), ze.alias("z_error"))


@query("str13_math", """select o_orderkey, round(sqrt(o_totalprice),6) r_sqrt, round(ln(o_totalprice),6) r_log, round(log10(o_totalprice),6) r_log10,
 round(exp(o_totalprice/1000000),6) r_exp, round(sin(o_totalprice),6) r_sin, round(cos(o_totalprice),6) r_cos, round(tan(o_custkey/100.0),4) r_tan,
 floor(o_totalprice)::bigint r_floor, ceil(o_totalprice)::bigint r_ceil, abs(100000-o_totalprice) r_abs, round(pow(o_totalprice,0.5)*pi()*2,4) r_tau,
 factorial((o_custkey%13)::int)::double r_fact, floor((100000-o_totalprice)/7)::bigint r_floordiv,
 round((100000-o_totalprice)-7*floor((100000-o_totalprice)/7),4) r_mod from orders""")
def str13(spark, d):
    o, x = table(spark, d, "orders"), F.col("o_totalprice")
    f, op, y = nm.FUNCTIONS, nm.OPERATORS, F.lit(100000) - x
    return o.select(
        "o_orderkey", F.round(f["sqrt"](x), 6).alias("r_sqrt"), F.round(f["log"](x), 6).alias("r_log"),
        F.round(f["log10"](x), 6).alias("r_log10"), F.round(f["exp"](x / 1000000), 6).alias("r_exp"),
        F.round(f["sin"](x), 6).alias("r_sin"), F.round(f["cos"](x), 6).alias("r_cos"),
        F.round(f["tan"](F.col("o_custkey") / 100.0), 4).alias("r_tan"),
        f["floor"](x).alias("r_floor"), f["ceil"](x).alias("r_ceil"), f["abs"](y).alias("r_abs"),
        F.round(f["pow"](x, F.lit(0.5)) * nm.CONSTANTS["tau"](), 4).alias("r_tau"),
        f["factorial"]((F.col("o_custkey") % 13).cast("int")).alias("r_fact"),
        op["//"](y, F.lit(7)).alias("r_floordiv"), F.round(op["%"](y, F.lit(7)), 4).alias("r_mod"))


@query("str14_date_parts", """select event_id, case when extract(microsecond from l)%1000000=0 then strftime(l,'%Y-%m-%dT%H:%M:%S') else strftime(l,'%Y-%m-%dT%H:%M:%S.%f') end || '+05:30' iso,
 strftime(l,'%Y-%m-%d') "date", strftime(l,'%H:%M:%S') "time", strftime(l,'%A') weekday, '+0530' tz from (select event_id, ts + interval 330 minute l from events)""")
def str14(spark, d):
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in nm.date_parts(F.col("ts"), 5.5).items()])


@query("str15_format_bytes", """select doc_id, case when n<1024 then printf('%.1f B', n::double) when n<1048576 then printf('%.1f KB', n/1024.0::double) when n<1073741824 then printf('%.1f MB', n/1048576.0::double) else printf('%.1f GB', n/1073741824.0::double) end size
 from (select doc_id, n_chars*n_chars n from documents)""")
def str15(spark, d):
    return docs(spark, d).select("doc_id", nm.format_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("str17_normalise_blanks", r"select page_id, md5(regexp_replace(replace(html,' ',chr(160)||chr(12288)),'[\x{a0}\x{3000}]+',' ','g')) out_md5 from pages")
def str17(spark, d):
    raw = F.replace(F.col("html"), F.lit(" "), F.lit(" 　"))
    return table(spark, d, "pages").select("page_id", F.md5(tx.normalize_blanks(raw)).alias("out_md5"))


@query("str22_category", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when contains(t,'错别字') then '错别字' when contains(t,'标点') then '标点' when contains(t,'用词') or contains(t,'词不当') or contains(t,'词语搭配') then '用词'
 when contains(t,'语法') then '语法' when contains(t,'语义') or contains(t,'逻辑') then '语义逻辑' else '错别字' end category,
 case when contains(t,'词语搭配错误') then '词语搭配错误' when contains(t,'语义逻辑不通') then '语义逻辑不通' else '错别字' end error_type
 from (select *, case l_returnflag when 'A' then '属于词语搭配错误' when 'R' then '语义逻辑不通,标点' else l_linestatus || '语法' end t from lineitem)""")
def str22(spark, d):
    t = F.expr("case l_returnflag when 'A' then '属于词语搭配错误' when 'R' then '语义逻辑不通,标点' else l_linestatus || '语法' end")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                              tx.map_category(t).alias("category"), tx.map_error_type(t).alias("error_type"))


@query("str24_last_tag", f"select page_id, {strip_sql(chr(114) + 'egexp_extract_all(html, ' + chr(39) + '(?s)<p>(.*?)</p>' + chr(39) + ', 1)[-1]')} para, {strip_sql('regexp_extract_all(html, ' + chr(39) + '(?s)<answer>(.*?)</answer>' + chr(39) + ', 1)[-1]')} answer from pages")
def str24(spark, d):
    return table(spark, d, "pages").select("page_id", tx.last_tag(F.col("html"), "p").alias("para"),
                                           tx.last_tag(F.col("html"), "answer").alias("answer"))


NUMBERED = "'intro' || chr(10) || '1. ' || replace(text, '. ', chr(10) || '2、') || chr(10) || '3.   '"


@query("str25_numbered_items", f"select conv_id, turn, array_to_string(list_slice(list_filter(list_transform(regexp_extract_all(raw,'(?m)\\d+[.、](.+?)$',1), lambda s: {strip_sql('s')}), lambda s: s <> ''),1,3),'|') subs from (select conv_id, turn, {NUMBERED} raw from conversations)")
def str25(spark, d):
    raw = F.expr(NUMBERED)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(tx.numbered_items(raw, 3), "|").alias("subs"))


@query("str28_expand_env", """select c_custkey, 'run ' || c_mktsegment || '/bin:' || c_name || '-' || c_mktsegment || ' $HOME ${NOPE} end' out,
 'x' || c_name || '|' || c_mktsegment args, 'in ' || c_name env_value from customer""")
def str28(spark, d):
    env = F.create_map(F.lit("SEG"), F.col("c_mktsegment"), F.lit("NAME"), F.col("c_name"))
    server = F.struct(F.array(F.lit("x${NAME}"), F.lit("$SEG")).alias("args"), F.create_map(F.lit("K"), F.lit("in $NAME")).alias("env"))
    c = table(spark, d, "customer").withColumn("server", server)
    expanded = tx.expand_env_in(F.col("server"), c.schema["server"].dataType, env)
    return c.select("c_custkey", tx.expand_env(F.lit("run ${SEG}/bin:$NAME-${SEG} $HOME ${NOPE} end"), env).alias("out"), expanded.alias("e")).select(
        "c_custkey", "out", F.array_join("e.args", "|").alias("args"), F.col("e.env")["K"].alias("env_value"))


@query("str30_keys", "select page_id, page_id || ':' || length(html) uid, 'rag_chunks_' || replace(coalesce(t,'default'),'-','_') coll, coalesce(u, length(html)::varchar) hit_key from (select *, regexp_extract(url,'http://([a-z.]+)/',1) || '-x-' || page_id t, case when length(html) > 5000 then url end u from pages)")
def str30(spark, d):
    p = table(spark, d, "pages")
    tenant = F.concat(F.regexp_extract("url", "http://([a-z.]+)/", 1), F.lit("-x-"), F.col("page_id"))
    return p.select("page_id", tx.chunk_uid(F.col("page_id"), F.length("html")).alias("uid"),
                    tx.collection_name(tenant).alias("coll"),
                    tx.hit_key(F.when(F.length("html") > 5000, F.col("url")), F.length("html")).alias("hit_key"))


@query("str31_fingerprint", "select c_custkey, md5(c_name || '|' || c_nationkey || '|None|' || c_mktsegment) fp from customer")
def str31(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.fingerprint(F.col("c_name"), F.col("c_nationkey"), F.lit(None), F.col("c_mktsegment")).alias("fp"))


@query("src8_page_text", f"select page_id, {strip_sql(HTML_SQL)} text from pages where url like 'http://%' or url like 'https://%'")
def src8(spark, d):
    from lexweave.sources.readers import page_text
    return page_text(table(spark, d, "pages"))


@query("src1_normalise_newlines", "select doc_id, md5(replace(replace(t, chr(13)||chr(10), chr(10)), chr(13), chr(10))) out_md5 from (select doc_id, replace(replace(text, chr(10), chr(13)||chr(10)), '. ', '.'||chr(13)) t from documents)")
def src1(spark, d):
    raw = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit(". "), F.lit(".\r"))
    return docs(spark, d).select("doc_id", F.md5(tx.normalize_newlines(raw)).alias("out_md5"))


@query("str26_lexicon", """with w(wrong, suggestion) as (values ('thst','that'),('eaux','eau'),('sch','sh')),
ln as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)),1) line_no from documents),
st as (select *, coalesce(sum(length(line)+1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding),0)::bigint line_start from ln),
pp as (select doc_id, line_no, line_start, wrong, suggestion, string_split(line, wrong) p from st, w where contains(line, wrong)),
oc as (select *, unnest(generate_series(1, len(p)-1)) i from pp)
select doc_id, line_no, wrong, suggestion, line_start + list_sum(list_transform(list_slice(p,1,i), lambda x: length(x)))::bigint + (i-1)*length(wrong) start_pos,
 line_start + list_sum(list_transform(list_slice(p,1,i), lambda x: length(x)))::bigint + i*length(wrong) end_pos from oc""")
def str26(spark, d):
    from lexweave.operators.lexicon import lexicon_issues
    lex = [("thst", "that"), ("eaux", "eau"), ("sch", "sh")]
    out = lexicon_issues(docs(spark, d).select("doc_id", "text"), lex)
    return out.select("doc_id", F.col("line").alias("line_no"), F.col("original").alias("wrong"), "suggestion",
                      F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))
