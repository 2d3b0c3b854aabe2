"""Tool and skill catalogs: layered overrides, roll-ups, gates and tiered search.

tools(name, description, params map, service, service_description, type_slug, ord)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.operators import index as ix
from lexweave.operators import retrieve as rt
from lexweave.scale import bounded_broadcast, cut, exploded, last_wins, top_k

FALLBACK_TOKENS = 20_000
CHARS_PER_TOKEN = 4.0
FALLBACK_SCORE = 0.1


def layered(layers: list[tuple[str, bool, DataFrame]], key: str = "name", order: str = "ord") -> DataFrame:
    """Merge (source, editable, rows) layers, later layers and later rows win by key."""
    union = None
    for i, (source, editable, df) in enumerate(layers):
        part = (df.withColumn("source", F.lit(source)).withColumn("editable", F.lit(editable)).withColumn("_layer", F.lit(i)))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return last_wins(union, [key], ["_layer", order]).drop("_layer")


def enabled(disabled: Column, enabled_: Column) -> Column:
    """Only an explicit disabled=true or enabled=false switches an entry off."""
    return ~F.coalesce(disabled, F.lit(False)) & F.coalesce(enabled_, F.lit(True))


def normalize_connection(servers: DataFrame) -> DataFrame:
    """Adds `transport` and `status` (ok / disabled / invalid / bad_name)."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    given = F.when(has("transport"), F.col("transport"))
    return (servers
            .withColumn("transport", F.when(has("command"), F.lit("stdio"))
                        .when(has("url"), F.coalesce(given, F.lit("streamable_http"))))
            .withColumn("status", F.when(~F.trim("name").rlike("^[A-Za-z0-9_-]+$"), F.lit("bad_name"))
                        .when(~enabled(F.col("disabled"), F.col("enabled")), F.lit("disabled"))
                        .when(F.col("transport").isNull(), F.lit("invalid")).otherwise(F.lit("ok"))))


CONFIG_KEYS = ("command", "args", "env", "cwd", "url", "headers", "transport")
# Settings that are never saved.
EXCLUDED_KEYS = (
    "PROJECT_ROOT", "DATA_DIR", "HISTORY_DIR", "UPLOAD_DIR", "CHROMA_DIR", "SKILL_DIR", "USER_SKILL_DIR", "CONFIG_FILE",
    "PERSON_LIKE_FILE", "API_BASE", "WS_BASE", "FRONTEND_BASE", "server_info", "config_hash", "RAG_API_URL", "APP_NAME",
    "APP_VERSION", "DEBUG", "LOG_LEVEL", "LOG_FORMAT", "CORS_ORIGINS", "SESSION_TIMEOUT", "MAX_SESSIONS", "SQLITE_DB_PATH",
)


def clean_config(config: Column) -> Column:
    """Known keys with a value; type normalised and dropped if unknown; disabled kept."""
    typed = F.map_concat(
        F.map_filter(config, lambda k, v: k.isin(*CONFIG_KEYS) & F.coalesce(~v.isin("", "[]", "{}"), F.lit(False))),
        F.map_filter(F.create_map(F.lit("type"), tx.normalize_type(F.try_element_at(config, F.lit("type")))), lambda k, v: v != ""),
        F.map_filter(F.create_map(F.lit("description"), tx.strip_blank(F.coalesce(F.try_element_at(config, F.lit("description")), F.lit("")))), lambda k, v: v != ""),
        F.map_filter(config, lambda k, v: k == "disabled"))
    return typed


def saved_settings(config: Column) -> Column:
    return F.map_filter(config, lambda k, v: ~k.isin(*EXCLUDED_KEYS))


def annotate_tools(tools: DataFrame, servers: DataFrame) -> DataFrame:
    """tools(server, name, ...) + servers(name, type, description): prefix once, carry type and description."""
    meta = servers.select(F.col("name").alias("server"), F.col("type").alias("_t"), F.col("description").alias("_d"))
    prefix = F.concat(F.lit("mcp__"), F.col("server"), F.lit("__"))
    return (tools.join(meta, "server", "left")
            .withColumn("name", F.when(F.startswith("name", prefix), F.col("name")).otherwise(F.concat(prefix, "name")))
            .withColumn("mcp_service", F.col("server"))
            .withColumn("mcp_type", F.coalesce("_t", F.lit("")))
            .withColumn("mcp_service_description", F.coalesce("_d", F.lit(""))).drop("_t", "_d"))


def services(tools: DataFrame) -> DataFrame:
    """One row per service: first non-empty type and description in entry order, number of tools, text length."""
    s = tools.filter(F.col("service") != "")
    line = F.length(F.concat(tx.leaf_name(F.col("name")), F.lit(": "), F.coalesce("description", F.lit(""))))
    return s.groupBy("service").agg(
        F.coalesce(F.expr("min_by(type_slug, ord) filter (where type_slug <> '')"), F.lit("")).alias("type_slug"),
        F.coalesce(F.expr("min_by(service_description, ord) filter (where service_description <> '')"), F.lit("")).alias("description"),
        F.count("*").alias("n_tools"), F.sum(line).alias("text_chars"))


def service_text(tools: DataFrame) -> DataFrame:
    """The text of a service in order, as rows (service, part, ord, line): no group is ever collected.

    Part 0 is the type label, 1 the description, 2 one line per tool.
    """
    svc = services(tools)
    label = svc.filter("type_slug <> ''").select("service", F.lit(0).alias("part"), F.lit(-1).cast("bigint").alias("ord"), tx.type_label(F.col("type_slug")).alias("line"))
    desc = svc.filter("description <> ''").select("service", F.lit(1).alias("part"), F.lit(-1).cast("bigint").alias("ord"), F.col("description").alias("line"))
    lines = tools.filter("service <> ''").select(
        "service", F.lit(2).alias("part"), F.col("ord").cast("bigint").alias("ord"),
        F.concat(tx.leaf_name(F.col("name")), F.lit(": "), F.coalesce("description", F.lit(""))).alias("line"))
    return label.unionByName(desc).unionByName(lines)


def estimate_tokens(tools: DataFrame) -> DataFrame:
    """ceil(total schema characters / 4) as one row."""
    schema = F.to_json(F.struct(
        F.col("name"), F.coalesce("description", F.lit("")).alias("description"),
        F.struct(F.lit("object").alias("type"), F.col("params").alias("properties")).alias("parameters")))
    return tools.agg(F.coalesce(F.ceil(F.sum(F.length(schema)) / CHARS_PER_TOKEN), F.lit(0)).cast("bigint").alias("tokens"))


def should_activate(tokens: Column, context_length: int | None, threshold_pct: float = 10.0, mode: str = "auto") -> Column:
    if mode == "off":
        return F.lit(False)
    if mode == "on":
        return tokens > 0
    limit = FALLBACK_TOKENS if not context_length or context_length <= 0 else int(context_length * (threshold_pct / 100.0))
    return (tokens > 0) & (tokens >= limit)


def category_counts(skills: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Every category with its entries, scripts and builtin entries; described ones appear even if empty."""
    counted = skills.groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(
        F.count("*").alias("entries"), F.sum("script_count").cast("bigint").alias("scripts"),
        F.count_if(F.col("source") == "builtin").alias("builtin"))
    zero = F.lit(0).cast("bigint")
    return counted.join(descriptions.select("category", "summary"), "category", "full").select(
        "category", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("entries", zero).alias("entries"),
        F.coalesce("scripts", zero).alias("scripts"), F.coalesce("builtin", zero).alias("builtin"))


def catalog_filter(keyword: str, kind: str = "all") -> Column:
    """Keyword over the joined texts of an entry, plus builtin / custom."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("name", "description", "author", "summary")],
                              F.array_join("tags", " "), F.array_join("script_names", " ")))
    key = keyword.strip().lower()
    # Ids that always count as builtin.
    builtin = F.col("id").isin("pdf-processing", "rag-query", "web-search") | (F.col("source") == "builtin")
    ok = hay.contains(key) if key else F.lit(True)
    return ok & {"all": F.lit(True), "builtin": builtin, "custom": ~builtin}[kind]


def catalog_sort(by: str) -> list[Column]:
    return {"name": [F.collate(F.coalesce("name", F.lit("")), "zh"), F.col("id")],
            "scripts": [F.coalesce("script_count", F.lit(0)).desc(), F.col("id")],
            "modified": [F.coalesce("modified_at", "created_at").desc_nulls_last(), F.col("id")],
            "builtin_first": [(F.col("source") == "builtin").desc(), F.col("name"), F.col("id")]}[by]


def validate_skill(name: Column, description: Column, scripts: Column, content: Column) -> tuple[Column, Column]:
    """(errors, warnings) arrays for one record; scripts is a map name -> text."""
    empty = tx.strip_blank(F.coalesce(content, F.lit(""))) == ""
    blank = F.map_filter(scripts, lambda k, v: tx.strip_blank(v) == "")
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    errors = F.concat(
        F.array(F.when(empty, F.lit("SKILL.md 内容不能为空")), F.when(~empty & ~has(name), F.lit("SKILL.md 缺少 name 字段"))),
        F.transform(F.map_keys(blank), lambda k: F.concat(F.lit("脚本 "), k, F.lit(" 内容为空"))))
    warnings = F.array(F.when(~empty & ~has(description), F.lit("建议添加 description 字段")),
                       F.when(F.size(scripts) == 0, F.lit("建议至少提供一个脚本")))
    keep = lambda a: F.filter(a, lambda x: x.isNotNull())
    return keep(errors), keep(warnings)


def resolve_names(names: DataFrame, skills: DataFrame) -> DataFrame:
    """names(query) of `name` or `category/name` -> the entry, if there is one."""
    q = names.withColumn("_n", tx.strip_blank(F.col("query")))
    q = (q.withColumn("_cat", F.when(F.col("_n").contains("/"), F.substring_index("_n", "/", 1)))
         .withColumn("_bare", F.when(F.col("_n").contains("/"), F.expr("substring(_n, position('/' in _n) + 1)")).otherwise(F.col("_n"))))
    s = skills.select(F.col("name").alias("_bare"), F.col("category").alias("_c"), F.struct(*skills.columns).alias("entry"))
    hit = q.join(s, "_bare").filter(F.col("_cat").isNull() | (F.col("_cat") == F.col("_c")))
    return q.select("query").join(hit.select("query", "entry"), "query", "left")


def describe(names: DataFrame, tools: DataFrame) -> DataFrame:
    """names(name) -> tool columns, or an error text for an unknown name."""
    t = tools.withColumn("_known", F.lit(True))
    return (names.join(t, "name", "left")
            .withColumn("error", F.when(F.col("_known").isNull(), F.concat(F.lit("未找到工具 '"), "name", F.lit("'，请先用 tool_search / mcp_search 检索"))))
            .drop("_known"))


# --- tiered search ------------------------------------------------------------------------------

def as_documents(tools: DataFrame, item: str) -> DataFrame:
    return tools.select(F.lit("").alias("tenant"), F.col(item).alias("doc_id"),
                        tx.tool_search_text(F.col("name"), F.col("description"), F.col("params")).alias("text"),
                        F.lower(F.concat_ws(" ", "name", F.coalesce("description", F.lit("")))).alias("hay"))


def catalog_union(sources: list[tuple[str, bool, DataFrame]]) -> DataFrame:
    """Rows of all sources (name, editable, rows) with where they come from and whether they may be changed."""
    marked = [df.withColumn("source", F.lit(name)).withColumn("editable", F.lit(editable)) for name, editable, df in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def substring_hits(docs: DataFrame, terms: DataFrame, tokens=tx.catalog_tokens) -> DataFrame:
    """Documents whose `hay` contains one of a query's terms: (query_id, item_id).

    A term is an ASCII word, a CJK character or a word of the tokenizer's lexicon, so it lies inside one run of the hay.
    Runs are made distinct first and cut into pieces of the wanted lengths, which turns the search into an equi join.
    """
    hay_runs = tx.catalog_tokens if tokens is tx.catalog_tokens else tx.catalog_runs
    vocab = exploded(docs, ["doc_id"], F.array_distinct(hay_runs(F.col("hay"))), "token")
    # The pieces are cut per distinct run, never per document; the wanted lengths are one value of the plan.
    lens = F.lit(sorted(r[0] for r in terms.select(F.length("term")).distinct().collect())).cast("array<int>")
    runs = vocab.select("token").distinct()
    fits = F.filter(lens, lambda n: n <= F.length("token"))
    pieces = F.array_distinct(F.flatten(F.transform(fits, lambda n: F.transform(
        F.sequence(F.lit(1), F.length("token") - n + 1), lambda i: F.substring("token", i, n)))))
    inside = exploded(runs, ["token"], pieces, "term")
    match = inside.join(terms.select("query_id", "term").distinct(), "term").select("query_id", "token").distinct()
    return vocab.join(bounded_broadcast(cut(match), 1_000_000), "token").select("query_id", F.col("doc_id").alias("item_id")).distinct()


def catalog_scores(docs: DataFrame, queries: DataFrame, index: ix.Index | None = None, tokens=tx.catalog_tokens) -> DataFrame:
    """Catalog BM25, positive scores only; a query without any gets 0.1 for every substring hit.

    `index`, if given, is the stored index of docs by the same `tokens` (`catalog_tokens`, or `segmented_tokens` of a lexicon).
    """
    # Read twice below: once for the result, once to find the queries without a hit.
    scored = cut(rt.bm25_scores(index or docs, queries, tokens, catalog=True))
    missed = queries.join(scored.select("query_id").distinct(), "query_id", "left_anti")
    terms = cut(ix.query_terms(missed, tokens))
    if terms.isEmpty():
        return scored
    # Read as often as the other hits: the texts are searched once.
    loose = cut(substring_hits(docs, terms, tokens).withColumn("score", F.lit(FALLBACK_SCORE)).select(*scored.columns))
    return scored.unionByName(loose)


def coarse(docs: DataFrame, queries: DataFrame, dense: DataFrame, pool: int, index: ix.Index | None = None,
           tokens=tx.catalog_tokens) -> DataFrame:
    """Fused coarse list; `dense` must be `retrieve.dense_pool(pool)` deep.

    The inputs are read several times by the fusion and the result by the tiers behind it, so each is
    written once to the shared checkpoint folder.
    """
    scores = catalog_scores(docs, queries, index, tokens)
    return cut(rt.weighted_fusion(scores, cut(dense), pool))


def fine_order(candidates: DataFrame, scores: DataFrame, item: str, limit: int) -> DataFrame:
    """Order by fine score; a query without any fine score keeps the coarse order."""
    joined = candidates.join(scores.select("query_id", item, F.col("score").alias("fine")), ["query_id", item], "left")
    known = scores.select("query_id").distinct().withColumn("_has", F.lit(True))
    joined = joined.join(known, "query_id", "left").withColumn(
        "fine", F.when(F.col("_has"), F.coalesce("fine", F.lit(0.0)))).drop("_has")
    return top_k(joined, ["query_id"], [F.col("fine").desc_nulls_last(), F.col("coarse_rank")], limit)


def roll_up(candidates: DataFrame, tools: DataFrame, item: str) -> DataFrame:
    """Coarse tools -> services in first-hit order: (query_id, service, coarse_rank)."""
    svc = tools.filter("service <> ''").select(F.col(item).alias("item_id"), "service")
    return (candidates.join(svc, "item_id").groupBy("query_id", "service").agg(F.min("rank").alias("coarse_rank")))
