"""Retrieval queries: documents are the chunks, benchmark items the queries.

An item's query vector is the embedding whose vec_id equals its item_id, a document's vector the one
whose vec_id equals its doc_id; items and documents without one use the lexical route only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import query_variants, rag_tokens
from lexweave.functions.vectors import centroid, cosine, vector_topk
from lexweave.operators import blocks as bk
from lexweave.operators import index as ix
from lexweave.operators import pivots as pv
from lexweave.operators import retrieve as rt
from lexweave.operators.segments import folder_of
from lexweave.plans.registry import query, table
from lexweave.scale import cut, scratch_path

TOK = r"list_filter(string_split(regexp_replace(lower({c}),'[^\p{{L}}\p{{N}}_]+',' ','g'),' '), lambda t: t <> '')"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.lit("default").alias("tenant"), "doc_id", "text", "source")


_BUILT: dict[tuple, str] = {}


def stored_index(spark: SparkSession, d: str, name: str, docs: DataFrame, tokenizer=rag_tokens) -> ix.Index:
    """The index of a table's documents: built at the first search of an application, opened by all later ones.

    It belongs to the files that docs reads, by name, size and time: a table that has changed since gets a new one.
    """
    files = []
    for file in docs.inputFiles():
        fs, place = folder_of(spark, file)
        status = fs.getFileStatus(place)
        files.append(f"{file}:{status.getLen()}:{status.getModificationTime()}")
    key = (spark.sparkContext.applicationId, name, hashlib.md5("|".join(sorted(files)).encode()).hexdigest())
    if key not in _BUILT:
        path = scratch_path(spark, f"index-{name}")
        ix.build_index(docs, path, tokenizer)
        _BUILT[key] = path
    return ix.open_index(spark, _BUILT[key])


def chunk_index(spark: SparkSession, d: str) -> ix.Index:
    return stored_index(spark, d, "chunks", chunks(spark, d))


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.lit("default").alias("tenant"), F.col("item_id").alias("query_id"), "text")


def doc_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return docs.join(emb, "item_id")


def item_vectors(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return items(spark, d).select("query_id").join(emb, "query_id")


def bm25_sql(qtable: str = "(select item_id query_id, text from benchmark)",
             dtable: str = "(select doc_id, text from documents)", prefix: str = "", tok: str = TOK,
             catalog: bool = False) -> str:
    """CTE list ending in {prefix}sc(query_id, item_id, score)."""
    p = prefix
    norm = "greatest(avgdl,1.0)" if catalog else "(avgdl+1e-9)"
    return f"""
{p}dt as materialized (select doc_id, {tok.format(c='text')} toks from {dtable}),
{p}ds as materialized (select doc_id, len(toks) dl from {p}dt),
{p}cs as materialized (select count(*) n, avg(dl) avgdl from {p}ds),
{p}po as materialized (select doc_id, term, count(*) tf from (select doc_id, unnest(toks) term from {p}dt) group by all),
{p}df as materialized (select term, count(*) df from {p}po group by all),
{p}qt as materialized (select query_id, term, count(*) qtf from (select query_id, unnest({tok.format(c='text')}) term from {qtable}) group by all),
{p}sc as materialized (select query_id, doc_id item_id, score from (
  select query_id, doc_id, round(sum(qtf*ln((n-df+0.5)/(df+0.5)+1)*tf*2.5/(tf+1.5*(0.25+0.75*dl/{norm}))),6) score
  from {p}qt join {p}po using(term) join {p}df using(term) join {p}ds using(doc_id), {p}cs group by all) where score > 0)"""


def topk_sql(src: str, k: int, order: str = "score desc, item_id", cols: str = "*") -> str:
    return (f"select {cols} from (select *, row_number() over (partition by query_id order by {order})::int as rank "
            f"from {src}) where rank <= {k}")


VEC_SQL = """
qv as materialized (select item_id query_id, embedding::double[] q from benchmark join embeddings on vec_id = item_id),
dv as materialized (select doc_id item_id, embedding::double[] v from documents join embeddings on vec_id = doc_id),
l2 as materialized (select query_id, item_id, round(list_sum(list_transform(list_zip(q,v), lambda z: (z[1]-z[2])*(z[1]-z[2]))),6) score from qv, dv),
cosd as materialized (select query_id, item_id, round(list_cosine_similarity(q,v),6) score from qv, dv)"""


# --- index ------------------------------------------------------------------------------------

@query("agg1_postings", f"""
with dt as (select doc_id, {TOK.format(c='text')} toks from documents)
select doc_id, term, count(*) tf from (select doc_id, unnest(toks) term from dt) group by all""")
def agg1_postings(spark, d):
    return ix.postings(chunks(spark, d)).select("doc_id", "term", "tf")


@query("agg1_term_stats", f"""
with dt as (select doc_id, {TOK.format(c='text')} toks from documents)
select term, count(*) df from (select distinct doc_id, unnest(toks) term from dt) group by all""")
def agg1_term_stats(spark, d):
    return ix.term_stats(ix.postings(chunks(spark, d))).select("term", "df")


@query("agg1_corpus_stats", f"""
select count(*) n, round(avg(len({TOK.format(c='text')})),6) avgdl from documents""")
def agg1_corpus_stats(spark, d):
    return ix.corpus_stats(ix.doc_stats(chunks(spark, d))).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("join7_term_match", f"with {bm25_sql()} select query_id, term, count(*) docs, sum(tf)::bigint total_tf, any_value(df) df"
       " from qt join po using(term) join df using(term) join ds using(doc_id) group by query_id, term")
def join7_term_match(spark, d):
    terms = cut(ix.query_terms(items(spark, d)))
    # Read twice: for the counts of terms and for the matches.
    post = cut(ix.matching_postings(chunks(spark, d), terms))
    return (post.join(terms, ["tenant", "term"]).join(ix.term_stats(post), ["tenant", "term"])
            .groupBy("query_id", "term").agg(F.count("*").alias("docs"), F.sum("tf").alias("total_tf"),
                                             F.first("df").alias("df")))


# --- BM25 -------------------------------------------------------------------------------------

@query("ret1_bm25_scores", f"with {bm25_sql()} select item_id, count(*) queries, max(score) best, sum(score::decimal(18,6))::double total from sc group by 1")
def ret1_bm25_scores(spark, d):
    """What the full list of scores says of each document; the list of pairs itself is not given out."""
    scores = rt.bm25_scores(chunk_index(spark, d), items(spark, d))
    return scores.groupBy("item_id").agg(F.count("*").alias("queries"), F.max("score").alias("best"),
                                         F.sum(F.col("score").cast("decimal(18,6)")).cast("double").alias("total"))


@query("ret1_bm25_topk", f"with {bm25_sql()} {topk_sql('sc', 10)}")
def ret1_bm25_topk(spark, d):
    return rt.bm25_topk(chunk_index(spark, d), items(spark, d), 10)


@query("ret1_pruned_topk", f"with {bm25_sql()} {topk_sql('sc', 10)}")
def ret1_pruned_topk(spark, d):
    """The same hits from blocks with bounds; ranges that cannot reach the top ten are not scored."""
    path = scratch_path(spark, "blocks")
    bk.build_blocks(chunk_index(spark, d), path)
    return bk.pruned_topk(bk.open_blocks(spark, path), items(spark, d), 10)[0]


@query("top1_bm25_zero_fill", f"""with {bm25_sql()},
al as (select b.item_id query_id, doc_id item_id, coalesce(score, 0.0) score
       from benchmark b cross join documents left join sc on sc.query_id = b.item_id and sc.item_id = doc_id)
{topk_sql('al', 25)}""")
def top1_bm25_zero_fill(spark, d):
    return rt.bm25_topk(chunk_index(spark, d), items(spark, d), 25, zero_fill=True)


@query("top3_pool_size", f"with {bm25_sql()} select query_id, count(*) pool from ({topk_sql('sc', 20)}) group by all")
def top3_pool_size(spark, d):
    pool = rt.bm25_topk(chunk_index(spark, d), items(spark, d), rt.keyword_pool(5))
    return pool.groupBy("query_id").agg(F.count("*").alias("pool"))


@query("win3_top_ranks", f"with {bm25_sql()} {topk_sql('sc', 60, cols='query_id, item_id, rank')}")
def win3_ranks(spark, d):
    return rt.rank_hits(rt.bm25_scores(chunk_index(spark, d), items(spark, d), best=60), 60).select("query_id", "item_id", "rank")


# --- vectors ----------------------------------------------------------------------------------

@query("top2_vector_topk", f"with {VEC_SQL} {topk_sql('l2', 10, 'score, item_id')}")
def top2_vector_topk(spark, d):
    return vector_topk(item_vectors(spark, d), doc_vectors(spark, d), 10)


@query("top2_pivot_topk", f"with {VEC_SQL} {topk_sql('l2', 10, 'score, item_id')}")
def top2_pivot_topk(spark, d):
    """The same hits with the packs left out that the triangle inequality rules out."""
    path = scratch_path(spark, "pivots")
    pv.build_pivots(doc_vectors(spark, d), path)
    return pv.pivot_topk(item_vectors(spark, d), path, 10)[0]


@query("ret3_vector_search", f"with {VEC_SQL}, h as ({topk_sql('l2', 10, 'score, item_id')}) "
       "select query_id, item_id, rank, score, source, n_chars, md5(text) text_md5 from h join documents on doc_id = item_id")
def ret3_vector_search(spark, d):
    hits = cut(vector_topk(item_vectors(spark, d), doc_vectors(spark, d), 10))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "source", "n_chars", F.md5("text").alias("text_md5"))
    return hits.join(rt.pick_items(docs, hits), "item_id").select("query_id", "item_id", "rank", "score", "source", "n_chars", "text_md5")


CENTROID_SQL = """
cen as materialized (select label, list(m order by p) c from (
  select label, p, avg(embedding[p]::double) m from embeddings, generate_series(1,64) g(p) group by all) group by all)"""


@query("ret3_label_centroids", f"with {CENTROID_SQL}, s as (select c.label query_id, vec_id item_id, "
       "round(list_sum(list_transform(list_zip(c.c, e.embedding::double[]), lambda z: (z[1]-z[2])*(z[1]-z[2]))),6) score "
       f"from cen c, embeddings e) {topk_sql('s', 10, 'score, item_id')}")
def ret3_label_centroids(spark, d):
    emb = table(spark, d, "embeddings")
    cen = centroid(emb, "label", "embedding", "embedding").withColumnRenamed("label", "query_id")
    return vector_topk(cen, emb.select(F.col("vec_id").alias("item_id"), "embedding"), 10)


@query("str32_cosine", f"with {CENTROID_SQL} select vec_id, label, round(list_cosine_similarity(c, embedding::double[]),6) cosine "
       "from embeddings join cen using(label)")
def str32_cosine(spark, d):
    emb = table(spark, d, "embeddings")
    cen = centroid(emb, "label", "embedding", "c")
    return emb.join(cen, "label").select("vec_id", "label", F.round(cosine(F.col("c"), F.col("embedding")), 6).alias("cosine"))


# --- fusion -----------------------------------------------------------------------------------

LEX20 = topk_sql('sc', 20)
VEC10 = topk_sql('l2', 10, 'score, item_id')
FUSE_SQL = f"""{bm25_sql()}, {VEC_SQL}, lx as materialized ({LEX20}), vx as materialized ({VEC10}),
ro as materialized (select query_id, item_id, rank from lx union all select query_id, item_id, rank from vx),
fu as materialized (select query_id, item_id, round(sum(1.0/(60+rank)),12) score from ro group by all),
fi as materialized ({topk_sql('fu', 10)})"""


def routes(spark, d):
    lexical = rt.bm25_topk(chunk_index(spark, d), items(spark, d), rt.keyword_pool(10))
    vector = cut(vector_topk(item_vectors(spark, d), doc_vectors(spark, d), 10))
    return lexical, vector


@query("ret4_rrf", f"with {FUSE_SQL} select query_id, item_id, score from fu")
def ret4_rrf(spark, d):
    lexical, vector = routes(spark, d)
    return rt.rrf(lexical.select("query_id", "item_id", "rank").unionByName(vector.select("query_id", "item_id", "rank")))


@query("set3_ranked_union", f"with {FUSE_SQL} select query_id, item_id, count(*) lists, min(rank) best_rank from ro group by all")
def set3_ranked_union(spark, d):
    lexical, vector = routes(spark, d)
    u = lexical.select("query_id", "item_id", "rank").unionByName(vector.select("query_id", "item_id", "rank"))
    return u.groupBy("query_id", "item_id").agg(F.count("*").alias("lists"), F.min("rank").alias("best_rank"))


@query("ret6_hybrid", f"with {FUSE_SQL} select * from fi")
def ret6_hybrid(spark, d):
    vector = vector_topk(item_vectors(spark, d), doc_vectors(spark, d), 10)
    return rt.retrieve(chunk_index(spark, d), items(spark, d), vector, 10)


@query("ret6_stage_counts", f"""with {FUSE_SQL}
select query_id, stage, count(*) hits from (select query_id, 'bm25_hits' stage from lx union all select query_id, 'vector_hits' from vx
 union all select query_id, 'fused_hits' from fu union all select query_id, 'final_hits' from fi) group by all""")
def ret6_stage_counts(spark, d):
    lexical, vector = routes(spark, d)
    fused = rt.fuse_routes(lexical, vector)
    return rt.stage_counts(lexical, vector, fused, rt.rank_hits(fused, 10))


@query("join9_hit_payload", f"""with {FUSE_SQL}
select fi.query_id, fi.item_id, fi.rank, md5(text) text_md5, case when vx.item_id is null then '' else source end source
from fi left join documents on doc_id = fi.item_id left join vx on vx.query_id = fi.query_id and vx.item_id = fi.item_id""")
def join9_hit_payload(spark, d):
    lexical, vector = routes(spark, d)
    final = rt.rank_hits(rt.fuse_routes(lexical, vector), 10)
    full = rt.attach_payload(final, chunks(spark, d), vector)
    return full.select("query_id", "item_id", "rank", F.md5("text").alias("text_md5"), "source")


@query("str27_context", f"""with {FUSE_SQL}
select b.item_id query_id, md5(coalesce(string_agg(d.text, chr(10)||chr(10)||'---'||chr(10)||chr(10) order by fi.rank), '未找到相关文档信息。')) context_md5
from benchmark b left join fi on fi.query_id = b.item_id left join documents d on d.doc_id = fi.item_id group by all""")
def str27_context(spark, d):
    lexical, vector = routes(spark, d)
    final = rt.rank_hits(rt.fuse_routes(lexical, vector), 10)
    full = rt.attach_payload(final, chunks(spark, d), vector)
    return rt.context_text(full, items(spark, d)).select("query_id", F.md5("context").alias("context_md5"))


# --- rerank and vote --------------------------------------------------------------------------

@query("ret7_rerank", f"""with {FUSE_SQL}, f20 as ({topk_sql('fu', 20)}),
rr as (select f20.query_id, f20.item_id, f20.rank old_rank, coalesce(c.score, 0.0) score from f20 left join cosd c using(query_id, item_id))
{topk_sql('rr', 5, 'score desc, old_rank')}""")
def ret7_rerank(spark, d):
    lexical, vector = routes(spark, d)
    pool = rt.rank_hits(rt.fuse_routes(lexical, vector), rt.RERANK_BATCH)
    qv = item_vectors(spark, d).withColumnRenamed("embedding", "q")
    # Scores only for the pool's pairs: the pool is joined to both vectors, never all pairs.
    scores = (pool.join(qv, "query_id").join(doc_vectors(spark, d), "item_id")
              .select("query_id", "item_id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("score")))
    return rt.rerank(pool, scores).select("query_id", "item_id", "old_rank", "score", "rank")


VARIANT_SQL = """
vs0 as (select item_id query_id, unnest(a) v, generate_subscripts(a, 1) pos from (
  select item_id, list_concat([text], list_filter(list_transform(string_split(text, '.'), lambda s: trim(s, ' ')), lambda s: s <> '')) a from benchmark)),
va as materialized (select query_id, v text, (row_number() over (partition by query_id order by min(pos)) - 1)::int variant from vs0 group by query_id, v)"""


def variants(spark, d):
    """Sub-queries are the item's sentences; the item itself is variant 0."""
    subs = F.transform(F.split("text", r"\."), lambda s: F.trim(s))
    return (items(spark, d)
            .select("tenant", "query_id", F.posexplode(query_variants(F.col("text"), subs)).alias("variant", "text")))


@query("set2_query_variants", f"with {VARIANT_SQL} select query_id, variant, text from va")
def set2_query_variants(spark, d):
    return variants(spark, d).select("query_id", "variant", "text")


@query("ret8_multi_query_vote", f"""with {VARIANT_SQL},
vq as (select query_id*1000+variant query_id, text from va),
{bm25_sql('vq')}, {VEC_SQL},
lx as ({topk_sql('sc', 20)}),
vv as materialized (select va.query_id*1000+variant query_id, embedding::double[] q from va join embeddings on vec_id = va.query_id + variant),
v2 as materialized (select query_id, item_id, round(list_sum(list_transform(list_zip(q,v), lambda z: (z[1]-z[2])*(z[1]-z[2]))),6) score from vv, dv),
vx as ({topk_sql('v2', 10, 'score, item_id')}),
ro as (select query_id, item_id, rank from lx union all select query_id, item_id, rank from vx),
fu as (select query_id, item_id, round(sum(1.0/(60+rank)),12) score from ro group by all),
fi as ({topk_sql('fu', 10)}),
vo as (select query_id//1000 query_id, item_id, round(sum(1.0/(60+rank)),12) score, min(query_id%1000)::int first_variant from fi group by query_id//1000, item_id)
{topk_sql('vo', 10)}""")
def ret8_multi_query_vote(spark, d):
    """A variant's vector is the embedding its number further on from the item's own."""
    v = variants(spark, d)
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    vectors = v.join(emb, F.col("query_id") + F.col("variant") == F.col("vec_id")).select(F.struct("query_id", "variant").alias("query_id"), "embedding")
    hits = vector_topk(vectors, doc_vectors(spark, d), 10).select("query_id.query_id", "query_id.variant", "item_id", "rank")
    return rt.multi_query(chunk_index(spark, d), v, hits, 10)
