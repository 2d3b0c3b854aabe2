"""Session queries: a conversation is a session; a row is a turn with one side filled."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions.text import BLANK
from lexweave.operators import sessions as ss
from lexweave.plans.registry import query, table

TURNS_SQL = """tu as (select 'default' tenant, conv_id session_id, turn, case when role = 'user' then text else '' end user_content, case when role = 'assistant' then text else '' end ai_content,
 timestamp '2024-01-01' + to_seconds(conv_id*100+turn) ts from conversations)"""


def turns(spark, d):
    t = table(spark, d, "conversations")
    return t.select(F.lit("default").alias("tenant"), F.col("conv_id").alias("session_id"), "turn",
                    F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit("")).alias("user_content"),
                    F.when(F.col("role") == "assistant", F.col("text")).otherwise(F.lit("")).alias("ai_content"),
                    F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,conv_id*100+turn)").alias("ts"))


TS = "strftime({0},'%Y-%m-%d %H:%M:%S')"


@query("src3_session_files", f"""select conv_id session_id, 'default' tenant_uuid, 't' || turn title, 0::int turn, text user_content, md5('re: ' || text) ai_md5, role kind from conversations where role <> 'system'""")
def src3(spark, d):
    """Session documents as JSON text, one in ten kinds broken or foreign, parsed with the fixed schema."""
    from lexweave.sources.readers import parse_sessions, session_turns
    c = table(spark, d, "conversations")
    turn = F.struct(F.col("text").alias("user_content"), F.concat(F.lit("re: "), "text").alias("ai_content"), F.create_map(F.lit("kind"), F.col("role")).alias("metadata"))
    doc = F.to_json(F.struct(F.col("conv_id").cast("string").alias("session_id"), F.when(F.col("role") == "user", F.lit("default")).alias("tenant_uuid"),
                             F.concat(F.lit("t"), "turn").alias("title"), F.array(turn).alias("conversations")))
    blobs = c.select(F.when(F.col("role") == "system", F.concat(F.lit("{oops "), doc)).otherwise(doc).alias("value"))
    t = session_turns(parse_sessions(blobs, "default"))
    return t.select(F.col("session_id").cast("bigint").alias("session_id"), F.col("tenant").alias("tenant_uuid"), "title", "turn", "user_content",
                    F.md5("ai_content").alias("ai_md5"), F.col("metadata")["kind"].alias("kind"))


@query("agg5_session_listing", f"""with {TURNS_SQL} select session_id, coalesce(arg_min(left(user_content,50), turn) filter (user_content <> ''), '新对话') title, count(*) conversation_count, {TS.format('max(ts)')} updated_at from tu group by session_id""")
def agg5(spark, d):
    return ss.listing(turns(spark, d)).select("session_id", "title", "conversation_count", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("top4_session_order", f"""with {TURNS_SQL}, l as (select session_id, max(ts) u from tu group by 1) select session_id, {TS.format('u')} updated_at, row_number() over (order by u desc nulls last, session_id) pos from l""")
def top4(spark, d):
    from lexweave.scale import positions
    never = F.lit(2 ** 62)
    listed = ss.listing(turns(spark, d)).withColumn("_down", F.coalesce(-F.unix_micros("updated_at"), never))
    ranked = positions(listed, [], ["_down", "session_id"], F.floor(F.col("_down") / 3_600_000_000))
    return ranked.select("session_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "pos")


@query("agg6_messages", f"with {TURNS_SQL} select session_id, turn, 0::int side, 'user' as role, user_content as content from tu where user_content <> '' union all select session_id, turn, 1, 'assistant', ai_content from tu where ai_content <> ''")
def agg6(spark, d):
    return ss.messages(turns(spark, d)).select("session_id", "turn", "side", "role", "content")


CLEAN = f"regexp_replace(replace(user_content, chr(10), ' '), '^{BLANK}+|{BLANK}+$', '', 'g')"


@query("win6_titles", f"""with {TURNS_SQL}, f as (select session_id, arg_min(user_content, turn) filter (user_content <> '') user_content from tu group by 1)
select session_id, case when user_content is null then '新对话' when length({CLEAN}) > 30 then left({CLEAN}, 30) || '...' else {CLEAN} end title from f""")
def win6(spark, d):
    has = F.col("user_content") != ""
    first = turns(spark, d).groupBy("session_id").agg(F.min_by(F.when(has, F.col("user_content")), F.when(has, F.col("turn"))).alias("m"))
    return first.select("session_id", ss.title_of(F.col("m")).alias("title"))


LOG_SQL = TURNS_SQL + """, lg as (select tenant, session_id, turn, 1 as version, user_content, ai_content, ts from tu union all
 select tenant, session_id, turn, 2, 'v2 ' || user_content, ai_content, ts + interval 1 hour from tu where ai_content = '')"""


def turn_log(spark, d):
    t = turns(spark, d)
    again = t.filter("ai_content = ''").withColumn("user_content", F.concat(F.lit("v2 "), "user_content")).withColumn("ts", F.expr("ts + interval 1 hour"))
    return t.withColumn("version", F.lit(1)).unionByName(again.withColumn("version", F.lit(2)))


@query("win5_latest_turn", f"with {LOG_SQL} select session_id, turn, version, md5(user_content) user_md5 from (select *, row_number() over (partition by session_id, turn order by version desc) rn from lg) where rn = 1")
def win5(spark, d):
    from lexweave.sources.sinks import compact_turns
    return compact_turns(turn_log(spark, d)).select("session_id", "turn", "version", F.md5("user_content").alias("user_md5"))


@query("snk2_session_upsert", f"""with {LOG_SQL}, s2 as (select session_id, min(ts) sec_ts from lg where turn > 0 group by 1),
fm as (select session_id, arg_max(user_content, version) user_content from lg left join s2 using(session_id) where turn = 0 and (sec_ts is null or ts <= sec_ts) group by 1),
hd as (select session_id, count(distinct turn) turns, {TS.format('min(ts)')} created_at, {TS.format('max(ts)')} updated_at from lg group by 1)
select session_id, turns, created_at, updated_at, case when coalesce(user_content,'') = '' then '新对话' when length({CLEAN}) > 30 then left({CLEAN},30) || '...' else {CLEAN} end title
from hd left join fm using(session_id)""")
def snk2(spark, d):
    """The log arrives in two calls; the second replaces turns of sessions that the first wrote."""
    from lexweave.scale import scratch_path
    from lexweave.sources.sinks import session_heads, write_sessions
    path, log = scratch_path(spark, "sessions"), turn_log(spark, d)
    for version in (1, 2):
        write_sessions(log.filter(F.col("version") == version), path)
    h = spark.read.schema(session_heads(log).schema).parquet(f"{path}/sessions")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return h.select("session_id", "turns", fmt("created_at"), fmt("updated_at"), "title")


SCORE = "list_sum(list_transform(['the','que','sch'], lambda t: (length({x})-length(replace({x},t,'')))//length(t)))::bigint"


@query("top6_memory_search", f"with m as (select conv_id*1000+turn ord, {SCORE.format(x='lower(text || chr(32) || role)')} score from conversations) select ord, score from m where score > 0 order by score desc, ord limit 15")
def top6(spark, d):
    m = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("text").alias("content"), F.array("role").alias("tags"))
    return ss.search_memories(m, "THE que\tsch", 15).select("ord", "score")


@query("top6_memory_newest", "select conv_id*1000+turn ord, 0::bigint score from conversations order by ord desc limit 1")
def top6_new(spark, d):
    m = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("text").alias("content"), F.array("role").alias("tags"))
    return ss.search_memories(m, "  ", 0).select("ord", "score")


@query("top7_turn_search", f"with {TURNS_SQL}, s as (select *, {SCORE.format(x='lower(user_content || chr(10) || ai_content)')} score from tu) select session_id, turn, score, left(user_content,200) as \"user\", left(ai_content,300) ai from s where score > 0 order by score desc, session_id, turn limit 12")
def top7(spark, d):
    return ss.search_turns(turns(spark, d), "the QUE sch", 12)
