"""Catalog queries: documents are tools, their source the service, their language the type."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.functions.vectors import cosine, vector_topk
from lexweave.operators import catalog as ct
from lexweave.operators import retrieve as rt
from lexweave.plans.registry import query, table
from lexweave.plans.retrieval import VEC_SQL, bm25_sql, doc_vectors, item_vectors, stored_index, topk_sql
from lexweave.plans.scalars import CAT_TOK

TYPE_CASE = "case lang when 'en' then 'search' when 'fr' then 'research' when 'de' then 'media' else '' end"


def doc_tools(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"), F.col("doc_id").alias("item_id"),
        F.concat(F.lit("mcp__"), "source", F.lit("__tool_"), "doc_id").alias("name"),
        F.col("text").alias("description"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("params"), F.col("source").alias("service"),
        F.when(F.col("lang") == "en", F.concat(F.lit("about "), "source")).otherwise(F.lit("")).alias("service_description"),
        F.expr(TYPE_CASE).alias("type_slug"))


TOOLS_SQL = f"""tools as materialized (select doc_id item_id, 'mcp__' || source || '__tool_' || doc_id as "name", text description, lang, source service,
 case when lang='en' then 'about ' || source else '' end service_description, {TYPE_CASE} type_slug,
 'mcp ' || source || ' tool ' || doc_id || ' ' || text || ' lang' coarse, lower('mcp__' || source || '__tool_' || doc_id || ' ' || text) hay from documents)"""


def name_queries(spark, d):
    """Benchmark items, region names and part names: the short names exercise the substring fallback."""
    items = table(spark, d, "benchmark").select(F.concat(F.lit("i"), "item_id").alias("query_id"), "text")
    regions = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("query_id"), F.col("r_name").alias("text"))
    parts = table(spark, d, "part").select(F.concat(F.lit("p"), "p_name").alias("query_id"), F.col("p_name").alias("text")).distinct()
    return items.unionByName(regions).unionByName(parts).withColumn("tenant", F.lit(""))


NAMES_SQL = """nq as materialized (select 'i' || item_id query_id, text from benchmark union all select 'r' || r_regionkey, r_name from region
 union all select distinct 'p' || p_name, p_name from part)"""


# --- layers and servers -------------------------------------------------------------------------

SERVER_SQL = """g as (select n_name as "name", 'run-' || n_nationkey command, null url, n_nationkey::bigint ord, 1 layer from nation),
f as (select 'NATION_' || c_nationkey as "name", null command, 'http://' || c_name url, c_custkey ord, 2 layer from customer),
t as (select 'NATION_' || (s_nationkey + 10) as "name", null command, 'http://' || s_name url, s_suppkey ord, 3 layer from supplier),
u as (select * from g union all select * from f union all select * from t)"""


@query("join1_layered_servers", f"""with {SERVER_SQL}
select name, command, url, ord, case layer when 1 then 'global' when 2 then 'field' else 'tenant' end source, layer > 1 editable
from (select *, row_number() over (partition by name order by layer desc, ord desc) rn from u) where rn = 1""")
def join1(spark, d):
    none = F.lit(None).cast("string")
    g = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("run-"), "n_nationkey").alias("command"), none.alias("url"), F.col("n_nationkey").cast("bigint").alias("ord"))
    f = (table(spark, d, "customer")
         .select(F.concat(F.lit("NATION_"), "c_nationkey").alias("name"), none.alias("command"), F.concat(F.lit("http://"), "c_name").alias("url"), F.col("c_custkey").alias("ord")))
    t = table(spark, d, "supplier").select(F.concat(F.lit("NATION_"), F.col("s_nationkey") + 10).alias("name"), none.alias("command"), F.concat(F.lit("http://"), "s_name").alias("url"), F.col("s_suppkey").alias("ord"))
    return ct.layered([("global", False, g), ("field", True, f), ("tenant", True, t)]).select("name", "command", "url", "ord", "source", "editable")


@query("join2_catalog_override", """with u as (select p_name as "name", p_brand, p_partkey ord, case when p_size > 25 then 1 else 0 end layer from part)
select name, p_brand, ord, case layer when 0 then 'builtin' else 'user' end source, layer = 1 editable from (select *, row_number() over (partition by name order by layer desc, ord desc) rn from u) where rn = 1""")
def join2(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), "p_brand", F.col("p_partkey").alias("ord"), "p_size")
    return ct.layered([("builtin", False, p.filter("p_size <= 25").drop("p_size")), ("user", True, p.filter("p_size > 25").drop("p_size"))])


BLOB_CASE = """case c_mktsegment
 when 'BUILDING' then '{"mcpServers":{"' || c_name || '":{"command":"run","args":["-x"],"type":"search"},"bad":7}}'
 when 'MACHINERY' then '{"MCP_SERVERS":{"' || c_name || '":{"url":"http://h","disabled":true}}}'
 when 'HOUSEHOLD' then '{"' || c_name || '":{"url":"http://f"},"note":"x","other":{"k":1}}'
 when 'AUTOMOBILE' then '[1,2]' else '{broken' end"""


@query("src5_server_configs", """select c_custkey, c_name as "name", case c_mktsegment when 'BUILDING' then 'run' end command,
 case c_mktsegment when 'MACHINERY' then 'http://h' when 'HOUSEHOLD' then 'http://f' end url, case c_mktsegment when 'MACHINERY' then true end disabled
 from customer where c_mktsegment in ('BUILDING','MACHINERY','HOUSEHOLD')""")
def src5(spark, d):
    from lexweave.sources.readers import parse_server_blobs
    blobs = table(spark, d, "customer").select("c_custkey", F.expr(BLOB_CASE).alias("value"))
    return parse_server_blobs(blobs, keep=("c_custkey",)).select("c_custkey", "name", "command", "url", "disabled")


CONN_SQL = """select c_custkey, case when c_acctbal < 0 then 'bad name' else c_name end as "name", case when c_mktsegment in ('BUILDING','FURNITURE') then 'run' end command,
 case when c_mktsegment in ('MACHINERY','FURNITURE') then 'http://h' when c_mktsegment = 'HOUSEHOLD' then '' end url, case when c_nationkey < 5 then 'sse' end transport,
 case when c_nationkey = 7 then true end disabled, case when c_nationkey = 8 then false end enabled from customer"""


def conns(spark, d):
    return table(spark, d, "customer").selectExpr(
        "c_custkey", "replace(case when c_acctbal < 0 then 'bad name' else c_name end, '#', case when c_nationkey = 3 then '#' else '-' end) name",
        "case when c_mktsegment in ('BUILDING','FURNITURE') then 'run' end command",
        "case when c_mktsegment in ('MACHINERY','FURNITURE') then 'http://h' when c_mktsegment = 'HOUSEHOLD' then '' end url",
        "case when c_nationkey < 5 then 'sse' end transport", "case when c_nationkey = 7 then true end disabled",
        "case when c_nationkey = 8 then false end enabled")


@query("str29_connections", f"""with c as ({CONN_SQL}), n as (select * replace (replace("name", '#', case when c_custkey in (select c_custkey from customer where c_nationkey = 3) then '#' else '-' end) as "name") from c),
t as (select *, case when command is not null then 'stdio' when coalesce(url,'') <> '' then coalesce(transport,'streamable_http') end tr from n)
select c_custkey, tr transport, case when not regexp_full_match(trim("name"), '[A-Za-z0-9_-]+') then 'bad_name' when coalesce(disabled,false) or not coalesce(enabled,true) then 'disabled' when tr is null then 'invalid' else 'ok' end status from t""")
def str29(spark, d):
    return ct.normalize_connection(conns(spark, d)).select("c_custkey", "transport", "status")


@query("flt5_enabled", "select c_custkey, not (c_nationkey = 7 or c_nationkey = 8) is_enabled from customer")
def flt5(spark, d):
    return conns(spark, d).select("c_custkey", ct.enabled(F.col("disabled"), F.col("enabled")).alias("is_enabled"))


CFG = ("map('command', c_name, 'args', '[]', 'env', '{}', 'cwd', cast(null as string), 'url', if(c_acctbal < 0, '', 'u'), 'secret', 'x', "
       "'type', if(c_nationkey < 10, ' Search ', 'odd'), 'description', concat('  ', c_mktsegment), 'disabled', 'true', 'DEBUG', '1')")


@query("flt13_config_projection", """select c_custkey, c_name command, case when c_acctbal < 0 then null else 'u' end url, case when c_nationkey < 10 then 'search' end "type", c_mktsegment description, 'true' disabled,
 case when c_acctbal < 0 then 4 else 5 end - 1 - case when c_nationkey < 10 then 0 else 1 end + 1 n_keys, 9::int saved_keys from customer""")
def flt13(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr(CFG).alias("m"))
    out = c.select("c_custkey", ct.clean_config(F.col("m")).alias("k"), F.size(ct.saved_settings(F.col("m"))).alias("saved_keys"))
    return out.select("c_custkey", *[F.try_element_at("k", F.lit(x)).alias(x) for x in ("command", "url", "type", "description", "disabled")],
                      F.size("k").alias("n_keys"), "saved_keys")


@query("flt12_redact", "select c_custkey, c_name home, 2::int n_left, null::varchar openai from customer")
def flt12(spark, d):
    m = F.expr("map('HOME', c_name, 'OPENAI_API_KEY', 'x', 'MyToken', 'y', 'PATH', c_mktsegment, 'db_passwd', 'z', 'Credentials', 'c')")
    k = table(spark, d, "customer").select("c_custkey", tx.redact(m).alias("k"))
    return k.select("c_custkey", F.try_element_at("k", F.lit("HOME")).alias("home"), F.size("k").alias("n_left"),
                    F.try_element_at("k", F.lit("OPENAI_API_KEY")).alias("openai"))


@query("join19_annotate_tools", """select doc_id, case when lang = 'en' then 'mcp__' || source || '__' || doc_id else 'mcp__' || source || '__' || doc_id end as "name", source mcp_service,
 coalesce(r_name, '') mcp_type, coalesce(lower(r_name), '') mcp_service_description from documents left join region on source = 'src' || r_regionkey""")
def join19(spark, d):
    tools = table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("server"),
        F.when(F.col("lang") == "en", F.concat(F.lit("mcp__"), "source", F.lit("__"), "doc_id")).otherwise(F.col("doc_id").cast("string")).alias("name"))
    servers = table(spark, d, "region").select(F.concat(F.lit("src"), "r_regionkey").alias("name"), F.col("r_name").alias("type"), F.lower("r_name").alias("description"))
    return ct.annotate_tools(tools, servers).select("doc_id", "name", "mcp_service", "mcp_type", "mcp_service_description")


# --- roll-ups -----------------------------------------------------------------------------------

@query("agg17_services", f"""with {TOOLS_SQL} select service, coalesce(arg_min(type_slug, item_id) filter (type_slug <> ''), '') type_slug,
 coalesce(arg_min(service_description, item_id) filter (service_description <> ''), '') description, count(*) n_tools,
 sum(length('tool_' || item_id || ': ' || description))::bigint text_chars from tools group by service""")
def agg17(spark, d):
    return ct.services(doc_tools(spark, d))


@query("agg17_service_text", f"""with {TOOLS_SQL}, s as (select service, coalesce(arg_min(type_slug, item_id) filter (type_slug <> ''), '') ts, coalesce(arg_min(service_description, item_id) filter (service_description <> ''), '') ds from tools group by service)
select service, 0::int part, -1::bigint ord, md5(case ts when 'search' then '搜索' when 'research' then '研究' else '多媒体' end) line_md5 from s where ts <> '' union all
select service, 1, -1, md5(ds) from s where ds <> '' union all select service, 2, item_id, md5('tool_' || item_id || ': ' || description) from tools""")
def agg17_text(spark, d):
    return ct.service_text(doc_tools(spark, d)).select("service", "part", "ord", F.md5("line").alias("line_md5"))


@query("agg18_categories", """with s as (select p_brand category, p_size % 4 script_count, case when p_retailprice > 950 then 'builtin' else 'user' end source from part where p_type <> 'PROMO'
 union all select null, p_size % 4, 'user' from part where p_type = 'PROMO')
select coalesce(coalesce(category,''), k) category, coalesce(summary,'') summary, count(source) entries, coalesce(sum(script_count),0)::bigint scripts, count(*) filter (source='builtin') builtin
from s full join (select 'Brand#' || n_nationkey k, n_name summary from nation where n_nationkey > 20) on coalesce(category,'') = k group by 1, 2""")
def agg18(spark, d):
    s = table(spark, d, "part").select(F.when(F.col("p_type") != "PROMO", F.col("p_brand")).alias("category"), (F.col("p_size") % 4).alias("script_count"),
                                       F.when((F.col("p_type") != "PROMO") & (F.col("p_retailprice") > 950), F.lit("builtin")).otherwise(F.lit("user")).alias("source"))
    desc = table(spark, d, "nation").filter("n_nationkey > 20").select(F.concat(F.lit("Brand#"), "n_nationkey").alias("category"), F.col("n_name").alias("summary"))
    return ct.category_counts(s, desc)


GATE_SQL = """select ceil(sum(length(to_json({'name': p_name, 'description': p_type, 'parameters': {'type': 'object', 'properties': {'size': p_size::varchar}}})))/4.0)::bigint tokens from part"""


@query("agg19_token_gate", f"with g as ({GATE_SQL}) select tokens, tokens >= 20000 auto_fallback, tokens >= 12800 auto_128k, false mode_off, tokens > 0 mode_on from g")
def agg19(spark, d):
    tools = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("params"))
    t = F.col("tokens")
    return ct.estimate_tokens(tools).select(
        "tokens", ct.should_activate(t, None).alias("auto_fallback"), ct.should_activate(t, 128_000).alias("auto_128k"),
        ct.should_activate(t, None, mode="off").alias("mode_off"), ct.should_activate(t, None, mode="on").alias("mode_on"))


@query("ret12_partition", f"""with p as (select case when p_size > 25 then p_brand else '' end service, length(to_json({{'name': p_name, 'description': p_type, 'parameters': {{'type': 'object', 'properties': {{'size': p_size::varchar}}}}}})) n from part)
select service <> '' has_service, count(*) entries, ceil(sum(n)/4.0)::bigint tokens, ceil(sum(n)/4.0) >= 20000 active from p group by 1""")
def ret12(spark, d):
    tools = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("params"),
                                           F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.lit("")).alias("service"))
    out = None
    for has in (True, False):
        part = tools.filter((F.col("service") != "") == F.lit(has))
        one = (part.agg(F.count("*").alias("entries")).withColumn("_k", F.lit(0))
               .join(ct.estimate_tokens(part).withColumn("_k", F.lit(0)), "_k"))
        one = one.select(F.lit(has).alias("has_service"), "entries", "tokens", ct.should_activate(F.col("tokens"), None).alias("active"))
        out = one if out is None else out.unionByName(one)
    return out


@query("set1_catalog_union", """select p_partkey, p_name, case when p_size > 25 then 'user' else 'builtin' end source, p_size > 25 editable from part""")
def set1(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return ct.catalog_union([("builtin", False, p.filter("p_size <= 25")), ("user", True, p.filter("p_size > 25"))]).drop("p_size")


def skills(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("author"),
        F.lit(None).cast("string").alias("summary"), F.split("p_name", " ").alias("tags"), F.array(F.concat("p_brand", F.lit(".py"))).alias("script_names"),
        F.when(F.col("p_size") > 25, F.lit("user")).otherwise(F.lit("builtin")).alias("source"), F.col("p_size").alias("script_count"))


@query("flt3_catalog_filter", """select p_partkey::varchar id from part where contains(lower(concat_ws(' ', p_name, p_type, p_brand, '', p_name, p_brand || '.py')), 'brand#1') and p_size > 25""")
def flt3(spark, d):
    return skills(spark, d).filter(ct.catalog_filter(" BRAND#1 ", "custom")).select("id")


@query("top5_catalog_sort", """select p_partkey::varchar id, row_number() over (order by p_size desc, p_partkey::varchar)::bigint by_scripts from part""")
def top5(spark, d):
    from lexweave.scale import positions
    counted = skills(spark, d).withColumn("_down", -F.col("script_count"))
    return positions(counted, [], ["_down", "id"], F.col("_down"), "by_scripts").select("id", "by_scripts")


@query("flt10_validate_skill", """select p_partkey, array_to_string(list_filter([case when p_size = 1 then 'SKILL.md 内容不能为空' end, case when p_size <> 1 and p_size < 10 then 'SKILL.md 缺少 name 字段' end,
 case when p_size between 30 and 40 then '脚本 run.py 内容为空' end], lambda x: x is not null), '|') errors,
 array_to_string(list_filter([case when p_size <> 1 and p_type = 'PROMO' then '建议添加 description 字段' end, case when p_size > 40 then '建议至少提供一个脚本' end], lambda x: x is not null), '|') warnings from part""")
def flt10(spark, d):
    p = table(spark, d, "part")
    scripts = F.when(F.col("p_size") > 40, F.expr("map_from_entries(array_remove(array(struct('', '')), struct('', '')))")).otherwise(
        F.create_map(F.lit("run.py"), F.when(F.col("p_size") >= 30, F.lit(" \n")).otherwise(F.col("p_name"))))
    e, w = ct.validate_skill(F.when(F.col("p_size") >= 10, F.col("p_name")), F.when(F.col("p_type") != "PROMO", F.col("p_type")), scripts,
                             F.when(F.col("p_size") == 1, F.lit("  ")).otherwise(F.col("p_name")))
    return p.select("p_partkey", F.array_join(e, "|").alias("errors"), F.array_join(w, "|").alias("warnings"))


@query("ret13_skill_lookup", """with s as (select n_name as "name", r_name category, n_nationkey from nation join region on n_regionkey = r_regionkey),
q as (select distinct case when s_acctbal > 5000 then 'NATION_' || s_nationkey else 'ASIA/NATION_' || (s_nationkey+1) end query from supplier)
select query, coalesce(n_nationkey, -1) n_nationkey from q left join s on case when contains(query,'/') then split_part(query,'/',2) else query end = name and (not contains(query,'/') or split_part(query,'/',1) = category)""")
def ret13(spark, d):
    s = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("category"), "n_nationkey")
    q = table(spark, d, "supplier").select(F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("NATION_"), "s_nationkey")).otherwise(F.concat(F.lit("ASIA/NATION_"), F.col("s_nationkey") + 1)).alias("query")).distinct()
    return ct.resolve_names(q, s).select("query", F.coalesce("entry.n_nationkey", F.lit(-1)).alias("n_nationkey"))


@query("ret11_describe", """select l_orderkey, l_linenumber, l_suppkey, l_partkey + 100 lookup, p_name, case when p_partkey is null then '未找到工具 ''' || (l_partkey + 100) || '''，请先用 tool_search / mcp_search 检索' end error from lineitem left join part on p_partkey = l_partkey + 100""")
def ret11(spark, d):
    names = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") + 100).cast("string").alias("name"))
    tools = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), "p_name")
    return ct.describe(names, tools).select("l_orderkey", "l_linenumber", "l_suppkey", F.col("name").cast("bigint").alias("lookup"), "p_name", "error")


# --- tiered search ------------------------------------------------------------------------------

CAT_SQL = bm25_sql("nq", "(select item_id doc_id, coarse text from tools)", tok=CAT_TOK, catalog=True)
FALL_SQL = """ms as (select query_id, unnest(list_distinct(""" + CAT_TOK.format(c="text") + """)) term from nq where query_id not in (select query_id from sc)),
fb as (select distinct query_id, item_id, 0.1::double score from ms join tools on contains(hay, term)),
sp as materialized (select query_id, item_id, score from sc union all select * from fb)"""


def tool_index(spark, d, docs):
    return stored_index(spark, d, "tools", docs, tx.catalog_tokens)


@query("ret2_catalog_bm25", f"with {TOOLS_SQL}, {NAMES_SQL}, {CAT_SQL}, {FALL_SQL} {topk_sql('sp', 20)}")
def ret2(spark, d):
    docs = ct.as_documents(doc_tools(spark, d), "item_id")
    return rt.rank_hits(ct.catalog_scores(docs, name_queries(spark, d), tool_index(spark, d, docs)), 20)


COARSE = f"""{TOOLS_SQL}, {NAMES_SQL}, {CAT_SQL}, {FALL_SQL}, {VEC_SQL},
cd as (select 'i' || query_id query_id, item_id, score from cosd where score > 0),
dr as (select query_id, item_id, row_number() over (partition by query_id order by score desc, item_id) dr from cd),
sr as (select query_id, item_id, row_number() over (partition by query_id order by score desc, item_id) sr from sp),
fz as materialized (select query_id, item_id, round(case when query_id in (select query_id from cd) then coalesce(0.1/(60+sr),0)+coalesce(0.9/(60+dr),0) else 1.0/(60+sr) end,12) score
 from sr full join dr using(query_id, item_id))"""


def coarse_hits(spark, d, pool):
    docs = ct.as_documents(doc_tools(spark, d), "item_id")
    qv = item_vectors(spark, d).withColumn("query_id", F.concat(F.lit("i"), "query_id"))
    dense = vector_topk(qv, doc_vectors(spark, d), rt.dense_pool(pool), metric="cosine")
    return ct.coarse(docs, name_queries(spark, d), dense, pool, tool_index(spark, d, docs)), qv


@query("ret5_weighted_rrf", f"with {COARSE} {topk_sql('fz', 20)}")
def ret5(spark, d):
    return coarse_hits(spark, d, 20)[0]


LIMIT, POOL = rt.tool_limits(5)
FINE_CENTROID = """cen as materialized (select label, list(m order by p) c from (select label, p, avg(embedding[p]::double) m from embeddings, generate_series(1,64) g(p) group by all) group by all)"""


@query("ret9_tool_search", f"""with {COARSE}, {FINE_CENTROID}, co as ({topk_sql('fz', POOL)}),
fs as (select co.query_id, co.item_id, round(list_cosine_similarity(q, c),6) score from co join qv on 'i' || qv.query_id = co.query_id join embeddings on vec_id = item_id join cen using(label)),
fo as (select co.query_id, co.item_id, rank coarse_rank, case when co.query_id in (select query_id from fs) then coalesce(fs.score, 0.0) end fine from co left join fs using(query_id, item_id))
{topk_sql('fo', LIMIT, 'fine desc nulls last, coarse_rank')}""")
def ret9(spark, d):
    from lexweave.functions.vectors import centroid
    hits, qv = coarse_hits(spark, d, POOL)
    emb = table(spark, d, "embeddings")
    fine = emb.select(F.col("vec_id").alias("item_id"), "label").join(centroid(emb, "label", "embedding", "c"), "label")
    scores = (hits.join(qv, "query_id").join(fine, "item_id")
              .select("query_id", "item_id", F.round(cosine(F.col("embedding"), F.col("c")), 6).alias("score")))
    cand = hits.select("query_id", "item_id", F.col("rank").alias("coarse_rank"))
    return ct.fine_order(cand, scores, "item_id", LIMIT)


S_LIMIT, S_POOL = rt.service_limits(5)


@query("ret10_service_search", f"""with {COARSE}, co as ({topk_sql('fz', S_POOL)}),
sv as (select query_id, service, min(rank) coarse_rank from co join tools using(item_id) group by all),
sc2 as materialized (select source service, list(m order by p) c from (select source, p, avg(embedding[p]::double) m from embeddings join documents on doc_id = vec_id, generate_series(1,64) g(p) group by all) group by all),
fs as (select sv.query_id, service, round(list_cosine_similarity(q, c),6) score from sv join qv on 'i' || qv.query_id = sv.query_id join sc2 using(service)),
fo as (select sv.query_id, service, coarse_rank, case when sv.query_id in (select query_id from fs) then coalesce(fs.score, 0.0) end fine from sv left join fs using(query_id, service)),
tp as ({topk_sql('fo', S_LIMIT, 'fine desc nulls last, coarse_rank')}), mt as (select service, count(*) tools from tools group by 1)
select query_id, service, rank, tools from tp join mt using(service)""")
def ret10(spark, d):
    from lexweave.functions.vectors import centroid
    tools = doc_tools(spark, d)
    hits, qv = coarse_hits(spark, d, S_POOL)
    svc = ct.roll_up(hits, tools, "item_id")
    vec = centroid(table(spark, d, "embeddings").withColumnRenamed("vec_id", "item_id").join(tools.select("item_id", "service"), "item_id"), "service", "embedding", "c")
    scores = svc.join(qv, "query_id").join(vec, "service").select("query_id", "service", F.round(cosine(F.col("embedding"), F.col("c")), 6).alias("score"))
    top = ct.fine_order(svc, scores, "service", S_LIMIT)
    # Member tools stay in their own table; a result row names the service and how many it has.
    return top.select("query_id", "service", "rank").join(tools.groupBy("service").agg(F.count("*").alias("tools")), "service")


@query("top9_limits", """select n_nationkey, greatest(1, least(case n_nationkey when 0 then 5 else n_nationkey end, 20))::int tool_limit, greatest(20, 4*greatest(1, least(case n_nationkey when 0 then 5 else n_nationkey end, 20)))::int tool_pool,
 greatest(1, least(case n_nationkey when 0 then 5 else n_nationkey end, 10))::int svc_limit, greatest(30, 8*greatest(1, least(case n_nationkey when 0 then 5 else n_nationkey end, 10)))::int svc_pool from nation""")
def top9(spark, d):
    asked = F.when(F.col("n_nationkey") == 0, F.lit(5)).otherwise(F.col("n_nationkey"))
    t, s = rt.tool_limits(asked), rt.service_limits(asked)
    return table(spark, d, "nation").select("n_nationkey", t[0].alias("tool_limit"), t[1].alias("tool_pool"), s[0].alias("svc_limit"), s[1].alias("svc_pool"))
