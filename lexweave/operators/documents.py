"""Document intake, listing and index status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.numbers import format_bytes
from lexweave.functions.text import chunk_uid, strip_blank, token_windows
from lexweave.scale import exploded

# Extensions that may be uploaded.
ALLOWED_EXTENSIONS = [".pdf", ".docx", ".doc", ".txt", ".md", ".markdown", ".csv"]


def extension(filename: Column) -> Column:
    """Lower-case suffix with its dot, '' when there is none (a leading dot is not a suffix)."""
    base = F.substring_index(filename, "/", -1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^.]+)$", 1))


def admit(files: DataFrame) -> DataFrame:
    """Adds file_extension, success and message; nothing is dropped and nothing fails."""
    ext = extension(F.col("filename"))
    ok = ext.isin(*ALLOWED_EXTENSIONS)
    return (files.withColumn("file_extension", ext).withColumn("success", ok)
            .withColumn("message", F.when(ok, F.lit("")).otherwise(F.concat(F.lit("不支持的文件类型: "), ext))))


def upload_outcome(admitted: DataFrame) -> DataFrame:
    """total / success / failure and the batch message."""
    c = admitted.agg(F.count("*").alias("total_files"), F.count_if("success").alias("success_count"),
                     F.count_if(~F.col("success")).alias("failure_count"))
    return c.withColumn("success", F.col("failure_count") == 0).withColumn(
        "message", F.when(F.col("failure_count") == 0, F.lit("批量上传完成")).otherwise(F.lit("部分文件上传失败")))


def document_filter(keyword: str = "", kind: str = "all") -> Column:
    """Keyword in name or title, and an extension filter where `word` means doc or docx."""
    key = keyword.strip().lower()
    ext = F.regexp_replace(F.col("file_extension"), r"^\.", "")
    ok = F.lit(True)
    if key:
        ok = F.lower(F.coalesce("name", F.lit(""))).contains(key) | F.lower(F.coalesce("title", F.lit(""))).contains(key)
    if kind == "word":
        return ok & ext.isin("doc", "docx")
    return ok if kind == "all" else ok & (ext == kind)


def chunk(docs: DataFrame, size: int = 600, overlap: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> overlapping token windows. Works inside each row; nothing is shuffled."""
    w = exploded(docs, ["doc_id", *keep], token_windows(F.col("text"), size, overlap), "w")
    return w.select("doc_id", *keep, "w.chunk_index", chunk_uid(F.col("doc_id"), F.col("w.chunk_index")).alias("chunk_uid"),
                    "w.n_tokens", "w.text")


def index_status(meta: DataFrame) -> DataFrame:
    """One row: documents, chunks, bytes, formatted size, last upload, state."""
    a = meta.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("chunks_count"), F.lit(0)).cast("bigint").alias("chunks_count"),
                 F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("total_size_bytes"), F.max("added_at").alias("last_updated"))
    return (a.withColumn("total_size", format_bytes(F.col("total_size_bytes")))
            .withColumn("state", F.when(F.col("chunks_count") > 0, F.lit("Indexed")).otherwise(F.lit("Empty"))))


def type_counts(meta: DataFrame) -> DataFrame:
    ext = F.coalesce(F.nullif(F.col("file_extension"), F.lit("")), F.lit("unknown"))
    return meta.groupBy(F.upper(F.regexp_replace(ext, r"^\.+", "")).alias("file_type")).agg(F.count("*").alias("files"))


def recent(meta: DataFrame, n: int = 5) -> DataFrame:
    return meta.orderBy(F.col("added_at").desc_nulls_last(), F.col("doc_id")).limit(n)


def not_blank(c: Column) -> Column:
    return F.length(strip_blank(F.coalesce(c, F.lit("")))) > 0


def tenant_of(own: Column) -> Column:
    """A row's tenant; a row without one belongs to `default`."""
    return F.coalesce(own, F.lit("default"))


def in_tenant(own: Column, asked: Column) -> Column:
    """Whether a row of tenant `own` may be seen by tenant `asked`; either may be missing. On a partition column it prunes."""
    return tenant_of(own) == tenant_of(asked)
