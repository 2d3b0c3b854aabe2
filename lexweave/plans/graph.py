"""Graph queries. Per nation: USER -> customer -> brand -> part type, and customer -> type, weighted by quantity."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import graph as gr
from lexweave.plans.registry import query, table

REL_SQL = """sa as materialized (select c_nationkey tenant, 'c' || c_custkey cust, p_brand brand, p_type ptype, sum(l_quantity) q, count(*) n from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join part on p_partkey = l_partkey group by all),
ed as materialized (
 select tenant, 'USER' src, cust dst, 'buys' relation, sum(q)/1000.0 weight from sa group by tenant, cust union all
 select tenant, cust, brand, 'likes', sum(q) from sa group by tenant, cust, brand union all
 select tenant, brand, ptype, 'makes', sum(q) from sa group by tenant, brand, ptype union all
 select tenant, cust, ptype, 'uses', sum(q) from sa group by tenant, cust, ptype),
en as materialized (select tenant, brand id, 'brand' entity_type, sum(n)::bigint mentions from sa group by 1, 2 union all select tenant, ptype, 'type', sum(n)::bigint from sa group by 1, 2),
nd as materialized (select tenant, id, entity_type, mentions from en union all select tenant, id, null, null from (select distinct tenant, unnest([src, dst]) id from ed) x where not exists (select 1 from en where en.tenant = x.tenant and en.id = x.id))"""


def sales(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    j = (li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).join(p, F.col("p_partkey") == F.col("l_partkey")))
    return j.groupBy(F.col("c_nationkey").alias("tenant"), F.concat(F.lit("c"), "c_custkey").alias("cust"), F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype")) \
        .agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))


def graph(spark, d):
    from lexweave.scale import release, staged
    rows = sales(spark, d)
    s = staged(rows, "sales")
    release(rows)
    def rel(src, dst, name, factor=1.0):
        return (s.withColumn("src", src).withColumn("dst", dst).groupBy("tenant", "src", "dst")
                .agg((F.sum("q") / factor).alias("weight")).withColumn("relation", F.lit(name)))
    r = (rel(F.lit("USER"), F.col("cust"), "buys", 1000.0).unionByName(rel(F.col("cust"), F.col("brand"), "likes"))
         .unionByName(rel(F.col("brand"), F.col("ptype"), "makes")).unionByName(rel(F.col("cust"), F.col("ptype"), "uses")))
    def ent(c, kind):
        return s.groupBy("tenant", F.col(c).alias("name")).agg(F.sum("n").alias("mentions")).withColumn("entity_type", F.lit(kind)).withColumn("ord", F.lit(0))
    edges = staged(gr.build_edges(r.withColumn("ord", F.lit(0))), "edges")
    release(r)
    # Every reader of the nodes would else gather them from all edges again.
    nodes = staged(gr.build_nodes(ent("brand", "brand").unionByName(ent("ptype", "type")), edges), "nodes")
    release(s)
    return nodes, edges


def pr_sql(rounds: int) -> str:
    out = f"""{REL_SQL}, nn as materialized (select tenant, count(*) n from nd group by 1), ow as (select tenant, src, sum(weight) w from ed group by 1, 2),
lk as materialized (select ed.tenant, src, dst, weight/w share from ed join ow using(tenant, src) where w > 0),
dg as materialized (select tenant, id from nd where not exists (select 1 from lk where lk.tenant = nd.tenant and lk.src = nd.id)),
p0 as materialized (select tenant, id, 1.0/n r from nd join nn using(tenant))"""
    for i in range(1, rounds + 1):
        out += f""",
p{i} as materialized (select nd.tenant, nd.id, 0.85*(coalesce(g,0)+coalesce(lo,0)/n)+0.15/n r from nd join nn using(tenant)
 left join (select lk.tenant, dst id, sum(r*share) g from lk join p{i-1} p on p.tenant = lk.tenant and p.id = lk.src group by 1, 2) x on x.tenant = nd.tenant and x.id = nd.id
 left join (select tenant, sum(r) lo from p{i-1} join dg using(tenant, id) group by 1) z on z.tenant = nd.tenant)"""
    return out


@query("gr1_nodes", f"with {REL_SQL} select tenant, id, coalesce(entity_type,'-') entity_type, coalesce(mentions,-1) mentions from nd")
def gr1_nodes(spark, d):
    return graph(spark, d)[0].select("tenant", "id", F.coalesce("entity_type", F.lit("-")).alias("entity_type"), F.coalesce("mentions", F.lit(-1)).alias("mentions"))


@query("gr1_edges", f"with {REL_SQL} select tenant, src, dst, relation, round(weight,6) weight from ed")
def gr1_edges(spark, d):
    return graph(spark, d)[1].withColumn("weight", F.round("weight", 6))


ROUNDS = 20


@query("gr2_pagerank", f"with {pr_sql(ROUNDS)} select tenant, id, round(r,6) as \"rank\" from p{ROUNDS}")
def gr2(spark, d):
    nodes, edges = graph(spark, d)
    return gr.pagerank(nodes, edges, max_iter=ROUNDS, tol=None).withColumn("rank", F.round("rank", 6))


@query("gr3_neighbours", f"with {REL_SQL} select tenant, dst id, round(weight,3) weight, row_number() over (partition by tenant order by weight desc, dst)::bigint pos from ed where src = 'USER'")
def gr3(spark, d):
    from lexweave.scale import positions
    n = gr.neighbours(graph(spark, d)[1]).withColumn("_down", -F.col("weight"))
    ranked = positions(n, ["tenant"], ["_down", "id"], F.floor(F.col("_down") * 1000))
    return ranked.drop("_down").withColumn("weight", F.round("weight", 3))


SCORE_SQL = f"""{pr_sql(10)}, mx as (select tenant, max(mentions) m from nd group by 1),
pf as (select p.tenant, p.id, coalesce(entity_type,'unknown') entity_type, coalesce(mentions,0) mentions, round(r*40 + coalesce(weight,0)*30 + case when m > 0 then coalesce(mentions,0)/m else 0 end*30, 3) score, r
 from p10 p left join nd on nd.tenant = p.tenant and nd.id = p.id left join ed on ed.tenant = p.tenant and src = 'USER' and dst = p.id left join mx on mx.tenant = p.tenant where p.id <> 'USER')"""


def scores(spark, d):
    nodes, edges = graph(spark, d)
    return gr.preference_scores(nodes, edges, gr.pagerank(nodes, edges, max_iter=10, tol=None))


@query("gr4_preference_scores", f"with {SCORE_SQL} select tenant, id, entity_type, mentions, score from pf")
def gr4(spark, d):
    return scores(spark, d).select("tenant", "id", "entity_type", "mentions", "score")


@query("top8_preferences", f"with {SCORE_SQL} select tenant, id, score, row_number() over (partition by tenant order by score desc, id)::int pos from pf qualify row_number() over (partition by tenant order by score desc, id) <= 10")
def top8(spark, d):
    return gr.top_preferences(scores(spark, d)).select("tenant", "id", "score", "pos")


@query("top8_mentions", f"with {REL_SQL} select tenant, id, mentions, row_number() over (partition by tenant order by mentions desc, id)::int pos from en qualify row_number() over (partition by tenant order by mentions desc, id) <= 10")
def top8_mentions(spark, d):
    n = graph(spark, d)[0].filter("type = 'entity'")
    return gr.top_preferences(n, by="mentions").select("tenant", "id", "mentions", "pos")


@query("gr5_statistics", f"""with {REL_SQL}, un as materialized (select distinct tenant, least(src,dst) a, greatest(src,dst) b from ed where src <> dst),
nb as materialized (select tenant, a x, b y from un union all select tenant, b, a from un), dg as (select tenant, x, count(*) d from nb group by 1, 2),
tr as (select p.tenant, p.x, count(*) t from nb p join nb q on p.tenant = q.tenant and p.y = q.x join nb r on r.tenant = q.tenant and r.x = q.y and r.y = p.x group by 1, 2),
cl as (select nd.tenant, case when d > 1 then coalesce(t,0)/(d*(d-1))::double else 0 end c from nd left join dg on dg.tenant = nd.tenant and dg.x = nd.id left join tr on tr.tenant = nd.tenant and tr.x = nd.id),
es as (select tenant, count(*) total_edges, count(*) filter (src = 'USER') user_connections from ed group by 1)
select tenant, count(*) total_nodes, any_value(total_edges) total_edges, any_value(user_connections) user_connections, round(avg(c),3) avg_clustering from cl join es using(tenant) group by 1""")
def gr5(spark, d):
    nodes, edges = graph(spark, d)
    return gr.statistics(nodes, edges)


LEX = [("the", "article", "en"), ("thst", "thing", "en"), ("die", "article", "de"), ("de", "prep", "fr"), ("que", "prep", "fr")]


@query("gr6_lexicon_entities", """with t as (select conv_id tenant, turn, list_filter(string_split(regexp_replace(lower(text),'[^\\p{L}\\p{N}_]+',' ','g'),' '), lambda t: t <> '') k from conversations where role = 'user'),
lx(term, entity, entity_type) as (values ('the','article','en'),('thst','thing','en'),('die','article','de'),('de','prep','fr'),('que','prep','fr')),
h as (select tenant, turn, entity, entity_type, count(*) m from (select tenant, turn, unnest(k) term from t) join lx using(term) group by all), n as (select tenant, count(*) n from t group by 1)
select tenant, entity as "name", entity_type, sum(m)::bigint mentions, round(count(*)/any_value(n)::double,6) weight from h join n using(tenant) group by 1, 2, 3""")
def gr6(spark, d):
    t = table(spark, d, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("tenant"), F.col("turn").alias("turn_id"), "text")
    lex = spark.createDataFrame(LEX, "term string, entity string, entity_type string")
    return gr.lexicon_entities(t, lex).withColumn("weight", F.round("weight", 6))
