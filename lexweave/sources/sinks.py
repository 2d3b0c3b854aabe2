"""Writers. Partitioned by tenant so a change touches only the tenant's own folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.scale import last_wins, scratch_path


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _chunk_columns(chunks: DataFrame) -> DataFrame:
    have = set(chunks.columns)
    return chunks.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.struct(schemas.CHUNK).fields])


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks under tenant=<tenant>/. One large tenant is written by many tasks."""
    _chunk_columns(chunks).write.mode("append").partitionBy("tenant").parquet(path)


def delete_documents(spark, path: str, doomed: DataFrame) -> None:
    """Remove doomed(tenant, doc_id); an unknown pair is an error and leaves the table as it is.

    Only the touched tenants are rewritten. The survivors are staged first because a table cannot be
    overwritten while it is read. A tenant without survivors keeps a row without doc_id, which readers skip.
    """
    table = spark.read.schema(schemas.CHUNK).parquet(path)
    unknown = doomed.join(table.select("tenant", "doc_id").distinct(), ["tenant", "doc_id"], "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown documents: {[tuple(r) for r in unknown]}")
    touched = table.join(doomed.select("tenant").distinct(), "tenant", "left_semi")
    left = touched.join(doomed.select("tenant", "doc_id"), ["tenant", "doc_id"], "left_anti")
    stage = scratch_path(spark, "delete")
    left.write.parquet(stage)
    back = spark.read.schema(left.schema).parquet(stage)
    # Every touched tenant has a row to overwrite its folder with, also one that lost all its documents.
    rows = _chunk_columns(back).unionByName(_chunk_columns(doomed.select("tenant").distinct()))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(stage)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def compact_turns(log: DataFrame) -> DataFrame:
    """Turn log (tenant, session_id, turn, version, ...) -> the latest version of each turn."""
    return last_wins(log, ["tenant", "session_id", "turn"], ["version"])


def session_heads(log: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """One row per session: turns, title of the first turn as first written, last update.

    The title is set while the session has exactly one turn, so a replaced first turn renames it only
    if no second turn existed by then.
    """
    from lexweave.operators.sessions import title_of
    second = log.filter("turn > 0").groupBy("tenant", "session_id").agg(F.min("ts").alias("_second"))
    first = (log.filter("turn = 0").join(second, ["tenant", "session_id"], "left")
             .filter(F.col("_second").isNull() | (F.col("ts") <= F.col("_second")))
             .groupBy("tenant", "session_id").agg(F.max_by("user_content", "version").alias("_msg")))
    heads = log.groupBy("tenant", "session_id").agg(
        F.count_distinct("turn").alias("turns"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    if deleted is not None:
        heads = heads.join(deleted, ["tenant", "session_id"], "left_anti")
    return heads.join(first, ["tenant", "session_id"], "left").select(
        "tenant", "session_id", title_of(F.col("_msg")).alias("title"), "turns", "created_at", "updated_at")


def write_sessions(log: DataFrame, path: str, deleted: DataFrame | None = None) -> None:
    """Append a turn log to <path>/log and compact what is stored of its tenants into <path>/turns and <path>/sessions.

    Deletions are appended to <path>/deleted and hold for later calls too. A repeated call stores its rows twice in
    the log, which compaction does not show.
    """
    spark = log.sparkSession
    log.write.mode("append").partitionBy("tenant").parquet(f"{path}/log")
    touched = log.select("tenant").distinct()
    if deleted is not None:
        deleted.select("tenant", "session_id").write.mode("append").parquet(f"{path}/deleted")
        touched = touched.unionByName(deleted.select("tenant")).distinct()
    stored = spark.read.schema(log.schema).parquet(f"{path}/log").join(touched, "tenant", "left_semi")
    gone = spark.createDataFrame([], log.select("tenant", "session_id").schema)
    if _exists(spark, f"{path}/deleted"):
        gone = spark.read.schema(gone.schema).parquet(f"{path}/deleted").distinct()
    turns = compact_turns(stored).join(gone, ["tenant", "session_id"], "left_anti")
    for name, df in [("turns", turns), ("sessions", session_heads(stored, gone))]:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant").parquet(f"{path}/{name}"))


def write_profiles(nodes: DataFrame, edges: DataFrame, preferences: DataFrame, statistics: DataFrame, path: str) -> None:
    """Profile JSON lines, gzipped, below tenant=<tenant>/, one line per graph element and one per tenant for the rest.

    A graph of any size is written row by row; only the top preferences of a tenant are nested.
    """
    part = lambda df, kind: df.select("tenant", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c != "tenant"])).alias("body"))
    top = preferences.groupBy("tenant").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in preferences.columns if c not in ("tenant", "rank")]))).alias("preferences"))
    rows = part(nodes, "node").unionByName(part(edges, "edge")).unionByName(part(top, "preferences")).unionByName(part(statistics, "statistics"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant").json(path, compression="gzip")


def benchmark_markdown(summary: DataFrame, delta: DataFrame, skill: str, model: str, date: str, evals: list[int], runs_per_config: int = 3) -> DataFrame:
    """Lines (line_no, value) of the summary table; summary has one row per configuration, delta one row."""
    two = summary.orderBy("configuration").limit(2).withColumn("_k", F.lit(0)).groupBy("_k").agg(
        F.array_sort(F.collect_list(F.struct("configuration", *[c for c in summary.columns if c != "configuration"]))).alias("c"))
    one = two.join(delta.withColumn("_k", F.lit(0)), "_k")
    def cell(i: int, metric: str, fmt: str, factor: float = 1.0) -> Column:
        c = F.try_element_at("c", F.lit(i + 1))
        return F.format_string(fmt, F.coalesce(c[f"{metric}_mean"], F.lit(0.0)) * factor, F.coalesce(c[f"{metric}_stddev"], F.lit(0.0)) * factor)
    def label(i: int) -> Column:
        return F.initcap(F.replace(F.coalesce(F.try_element_at("c", F.lit(i + 1))["configuration"], F.lit(f"config_{'ab'[i]}")), F.lit("_"), F.lit(" ")))
    def row(title: str, metric: str, fmt: str, unit: str, factor: float = 1.0) -> Column:
        return F.concat(F.lit(f"| {title} | "), cell(0, metric, fmt, factor), F.lit(" | "), cell(1, metric, fmt, factor), F.lit(" | "), F.col(f"delta_{metric}"), F.lit(f"{unit} |"))
    lines = F.array(
        F.lit(f"# Skill Benchmark: {skill}"), F.lit(""), F.lit(f"**Model**: {model}"), F.lit(f"**Date**: {date}"),
        F.lit(f"**Evals**: {', '.join(map(str, evals))} ({runs_per_config} runs each per configuration)"), F.lit(""), F.lit("## Summary"), F.lit(""),
        F.concat(F.lit("| Metric | "), label(0), F.lit(" | "), label(1), F.lit(" | Delta |")),
        F.lit("|--------|------------|---------------|-------|"),
        row("Pass Rate", "pass_rate", "%.0f%% ± %.0f%%", "", 100.0), row("Time", "time_seconds", "%.1fs ± %.1fs", "s"),
        row("Tokens", "tokens", "%.0f ± %.0f", ""))
    return one.select(F.posexplode(lines).alias("line_no", "value"))


def benchmark_json(runs: DataFrame) -> DataFrame:
    """One JSON line per run in the benchmark layout."""
    result = F.struct("pass_rate", "passed", "failed", "total", "time_seconds", "tokens", "tool_calls", "errors")
    return runs.select(F.to_json(F.struct("eval_id", "configuration", "run_number", result.alias("result"), "expectations", "notes")).alias("value"))


def base_name(c: Column) -> Column:
    """File name without any folder, so a writer cannot leave its own folder."""
    return F.regexp_extract(F.regexp_replace(c, r"[/\\]+$", ""), r"([^/\\]*)$", 1)


def save_texts(files: DataFrame, path: str) -> None:
    """files(name, text): each text goes below file=<base name>/; other files stay."""
    files.select(base_name(F.col("name")).alias("file"), F.col("text").alias("value")).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("file").text(path)


def append_memories(entries: DataFrame, path: str) -> None:
    """entries(tenant, content, tags, created_at) get an 8-character id and are appended."""
    (entries.select(F.coalesce("tenant", F.lit("default")).alias("tenant"), F.substring(F.uuid(), 1, 8).alias("id"), "content",
                    F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "created_at")
     .write.mode("append").partitionBy("tenant").parquet(path))
