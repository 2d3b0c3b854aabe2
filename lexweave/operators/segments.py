"""A maintained index: segments of postings with deletion marks, tiered compaction and a manifest of the live segments.

A segment holds what one batch of documents brought, or several such segments merged: `postings` and `docs` of the live
documents, `marks` of all documents it speaks about (changed or deleted ones too), all in `BUCKETS` folders by document,
and `terms`, how the batch changed the document counts of terms. A row is live if no later segment marks its document.
A batch reads older segments only in the buckets of its own documents. `TIER` segments of a level are merged into one of
the next level, so a reader meets a number of segments that grows with the logarithm of the batches.

The manifest is written after a segment is complete. Batch n commits as version 2n, its compaction as 2n + 1; a batch that
runs again starts from the last version before its own and overwrites what it left, so a run may stop at any point.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import rag_tokens
from lexweave.operators import index as ix
from lexweave.scale import bounded_broadcast, release, staged

BUCKETS, TIER = 64, 4
# Documents that are sent to every task.
BROADCAST_DOCUMENTS = 500_000
KEYS = ["tenant", "doc_id"]
COLUMNS = {"postings": "dl long, term string, tf long, ", "docs": "dl long, ", "marks": ""}


_MANIFEST = "high long, low long, level int, name string, kind string"


@dataclass(frozen=True, order=True)
class Segment:
    """Batches low to high; kind is the type of the document ids."""

    high: int
    low: int
    level: int
    name: str
    kind: str


def folder_of(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = folder_of(spark, path)
    return fs.exists(place)


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, place = folder_of(spark, f"{path}/manifest")
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and exists(spark, f"{path}/manifest/{n}/_SUCCESS"))


def _manifest(spark: SparkSession, path: str, version: int) -> list[Segment]:
    return sorted(Segment(*r) for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={version}").collect())


def live_segments(spark: SparkSession, path: str, before: int | None = None) -> list[Segment]:
    """The segments of the latest version, optionally of the latest one below `before`; from the oldest on."""
    known = [v for v in _versions(spark, path) if before is None or v < before]
    return _manifest(spark, path, known[-1]) if known else []


def _commit(spark: SparkSession, path: str, version: int, segments: list[Segment]) -> None:
    (spark.createDataFrame([astuple(s) for s in segments], _MANIFEST).coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/manifest/version={version}"))


def bucket() -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int").alias("bucket")


def _stored(spark: SparkSession, path: str, segments: list[Segment], table: str, buckets: list[int] | None) -> DataFrame:
    def one(s: Segment) -> DataFrame:
        rows = spark.read.schema(f"tenant string, doc_id {s.kind}, {COLUMNS[table]}bucket int").parquet(f"{path}/segments/{s.name}/{table}")
        rows = rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))
        rows = rows.filter(F.col("term") != ix.DOCUMENT_ROW) if table == "postings" else rows
        return rows.withColumn("seq", F.lit(s.high))
    return reduce(DataFrame.unionByName, [one(s) for s in segments])


def rows_of(spark: SparkSession, path: str, segments: list[Segment], table: str, buckets: list[int] | None = None) -> DataFrame:
    """The live rows of `postings` or `docs` (with bucket), optionally of some buckets only; other buckets are not read."""
    held = _stored(spark, path, segments, table, buckets)
    if len(segments) == 1:
        return held.drop("seq")
    # What later segments replaced is less than what they left, so rows stay where they lie while it is little.
    seen = _stored(spark, path, segments, "marks", buckets).groupBy(*KEYS).agg(F.sort_array(F.collect_list("seq")).alias("_seen")).filter(F.size("_seen") > 1)
    dead = seen.select(*KEYS, F.explode(F.slice("_seen", F.lit(1), F.size("_seen") - 1)).alias("seq"))
    named = F.col("tenant").isNotNull() & F.col("doc_id").isNotNull()
    return held.filter(named).join(bounded_broadcast(dead, BROADCAST_DOCUMENTS), [*KEYS, "seq"], "left_anti").drop("seq")


def _gone(spark: SparkSession, path: str, segments: list[Segment], now: DataFrame, buckets: list[int]) -> DataFrame:
    """The live postings of the documents in `now`; which of their versions are live is settled before postings are read."""
    last = _stored(spark, path, segments, "marks", buckets).groupBy(*KEYS).agg(F.max("seq").alias("seq")).join(now.select(*KEYS), KEYS, "left_semi")
    return _stored(spark, path, segments, "postings", buckets).join(bounded_broadcast(last, BROADCAST_DOCUMENTS), [*KEYS, "seq"], "left_semi")


def _write(df: DataFrame, folder: str, order: list[str]) -> None:
    (df.repartition("bucket").sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(folder))


def add_batch(batch: DataFrame, path: str, n: int, tokenizer=rag_tokens) -> None:
    """Put batch n of documents (tenant, doc_id, text) into the index below `path`, then merge full tiers.

    A document that comes again replaces its earlier version; one with null text is deleted. Of equal ids inside a batch the
    greatest text counts.
    """
    spark = batch.sparkSession
    base = live_segments(spark, path, 2 * n)
    folder = f"{path}/segments/b{n}"
    now = staged(batch.groupBy(*KEYS).agg(F.max("text").alias("text")).withColumn("bucket", bucket()), "batch")
    if now.isEmpty():
        release(now)
        return
    live = now.filter(F.col("text").isNotNull())
    _write(now.select(*KEYS, "bucket"), f"{folder}/marks", KEYS)
    # Texts move to the task of their bucket and are counted there; the marker rows among the postings are the documents.
    kind = now.schema["doc_id"].dataType.simpleString()
    tokens = live.repartition("bucket").select(*KEYS, F.array_join(F.concat(tokenizer(F.col("text")), F.array(F.lit(ix.DOCUMENT_ROW))), ix.SEPARATOR).alias("tokens"))
    counted = tokens.mapInArrow(ix._count, f"tenant {now.schema['tenant'].dataType.simpleString()}, doc_id {kind}, term string, dl bigint, tf bigint")
    (counted.withColumn("bucket", bucket()).sortWithinPartitions("bucket", "tenant", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings"))
    stored = spark.read.schema(f"tenant string, doc_id {kind}, {COLUMNS['postings']}bucket int").parquet(f"{folder}/postings")
    _write(stored.filter(F.col("term") == ix.DOCUMENT_ROW).select(*KEYS, "dl", "bucket"), f"{folder}/docs", KEYS)
    own = Segment(n, n, 0, f"b{n}", kind)
    delta = ix.term_stats(_stored(spark, path, [own], "postings", None))
    if base:
        touched = sorted(r["bucket"] for r in now.select("bucket").distinct().collect())
        delta = delta.unionByName(ix.term_stats(_gone(spark, path, base, now, touched)).withColumn("df", -F.col("df")))
    delta.groupBy("tenant", "term").agg(F.sum("df").alias("df")).filter("df <> 0").write.mode("overwrite").parquet(f"{folder}/terms")
    _commit(spark, path, 2 * n, [*base, own])
    release(now)
    compact(spark, path, n)


def compact(spark: SparkSession, path: str, n: int) -> None:
    """Merge full tiers of the version of batch n; does nothing where no level holds TIER segments."""
    segments = live_segments(spark, path, 2 * n + 1)
    changed = False
    while True:
        level = next((s.level for s in reversed(segments) if sum(t.level == s.level for t in segments) >= TIER), None)
        if level is None:
            break
        group = [s for s in segments if s.level == level]
        merged = Segment(group[-1].high, group[0].low, level + 1, f"c{group[0].low}-{group[-1].high}", group[-1].kind)
        _merge(spark, path, group, merged, oldest=group[0] == segments[0])
        segments = sorted([s for s in segments if s.level != level] + [merged])
        changed = True
    if changed:
        _commit(spark, path, 2 * n + 1, segments)
        _vacuum(spark, path, 2 * n)


def _merge(spark: SparkSession, path: str, group: list[Segment], merged: Segment, oldest: bool) -> None:
    folder = f"{path}/segments/{merged.name}"
    docs = rows_of(spark, path, group, "docs")
    _write(docs, f"{folder}/docs", KEYS)
    _write(rows_of(spark, path, group, "postings"), f"{folder}/postings", ["tenant", "term"])
    # Below the oldest segment there is nothing that a deleted document's mark could hide.
    marks = docs.select(*KEYS, "bucket") if oldest else _stored(spark, path, group, "marks", None).select(*KEYS, "bucket").distinct()
    _write(marks, f"{folder}/marks", KEYS)
    terms_of(spark, path, group).write.mode("overwrite").parquet(f"{folder}/terms")


def _vacuum(spark: SparkSession, path: str, batch_version: int) -> None:
    """Remove segments and versions that neither the newest versions nor a repeated run of the newest batch can read."""
    versions = _versions(spark, path)
    base = max((v for v in versions if v < batch_version), default=batch_version)
    kept = [v for v in versions if v >= base]
    names = {s.name for v in kept for s in _manifest(spark, path, v)}
    fs, place = folder_of(spark, f"{path}/segments")
    for status in fs.listStatus(place):
        if status.getPath().getName() not in names:
            fs.delete(status.getPath(), True)
    for v in versions:
        if v < base:
            old = folder_of(spark, f"{path}/manifest/version={v}")[1]
            fs.delete(old, True)


def terms_of(spark: SparkSession, path: str, segments: list[Segment]) -> DataFrame:
    """(tenant, term, df): the sum of the segments' changes."""
    parts = [spark.read.schema("tenant string, term string, df long").parquet(f"{path}/segments/{s.name}/terms") for s in segments]
    return reduce(DataFrame.unionByName, parts).groupBy("tenant", "term").agg(F.sum("df").alias("df")).filter("df <> 0")


def open_segments(spark: SparkSession, path: str) -> ix.Index:
    """The latest version as an index to search; ids have the type they were written with."""
    segments = live_segments(spark, path)
    if not segments:
        raise ValueError(f"no index below {path}")
    docs = rows_of(spark, path, segments, "docs").select(*KEYS, "dl")
    return ix.Index(rows_of(spark, path, segments, "postings").select(*KEYS, "term", "tf", "dl"), docs, terms_of(spark, path, segments), ix.corpus_stats(docs))
