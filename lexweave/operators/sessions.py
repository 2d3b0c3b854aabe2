"""Chat sessions and memories.

turns(tenant, session_id, turn, user_content, ai_content, ts)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import strip_blank, term_hits

NO_TITLE = "新对话"


def title_of(message: Column) -> Column:
    """First 30 characters of the message on one line."""
    clean = strip_blank(F.replace(message, F.lit("\n"), F.lit(" ")))
    return F.when(F.coalesce(message, F.lit("")) == "", F.lit(NO_TITLE)).otherwise(
        F.when(F.length(clean) > 30, F.concat(F.left(clean, F.lit(30)), F.lit("..."))).otherwise(clean))


def listing(turns: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(tenant, session_id, title, conversation_count, updated_at); the title falls back to the first words."""
    has = F.coalesce("user_content", F.lit("")) != ""
    g = turns.groupBy("tenant", "session_id").agg(
        F.count("*").alias("conversation_count"), F.max("ts").alias("updated_at"),
        F.min_by(F.when(has, F.left("user_content", F.lit(50))), F.when(has, F.col("turn"))).alias("_first"))
    g = g.join(titles, ["tenant", "session_id"], "left") if titles is not None else g.withColumn("title", F.lit(None).cast("string"))
    return g.select("tenant", "session_id", F.coalesce(F.nullif(F.col("title"), F.lit("")), "_first", F.lit(NO_TITLE)).alias("title"),
                    "conversation_count", "updated_at")


def messages(turns: DataFrame) -> DataFrame:
    """User and assistant messages of each turn in order, empty sides left out."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.lit("user").alias("role"), F.col("user_content").alias("content")),
                    F.struct(F.lit(1).alias("side"), F.lit("assistant").alias("role"), F.col("ai_content").alias("content")))
    return (turns.select("tenant", "session_id", "turn", F.explode(sides).alias("m"))
            .select("tenant", "session_id", "turn", "m.side", "m.role", "m.content")
            .filter(F.coalesce("content", F.lit("")) != ""))


def search_memories(memories: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """memories(ord, content, tags): best by term hits, or the newest for a blank query."""
    terms, n = query.lower().split(), max(1, limit)
    if not terms:
        return memories.withColumn("score", F.lit(0).cast("bigint")).orderBy(F.col("ord").desc()).limit(n)
    text = F.concat("content", F.lit(" "), F.array_join("tags", " "))
    scored = memories.withColumn("score", term_hits(text, F.array(*[F.lit(t) for t in terms])))
    return scored.filter("score > 0").orderBy(F.col("score").desc(), "ord").limit(n)


def search_turns(turns: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Best turns by term hits over both sides, with excerpts of 200 and 300 characters."""
    terms = query.lower().split()
    if not terms:
        raise ValueError("请提供检索关键词")
    user, ai = F.coalesce("user_content", F.lit("")), F.coalesce("ai_content", F.lit(""))
    score = term_hits(F.concat(user, F.lit("\n"), ai), F.array(*[F.lit(t) for t in terms]))
    return (turns.withColumn("score", score).filter("score > 0")
            .orderBy(F.col("score").desc(), "session_id", "turn").limit(max(1, limit))
            .select("session_id", "turn", "score", F.left(user, F.lit(200)).alias("user"), F.left(ai, F.lit(300)).alias("ai")))
