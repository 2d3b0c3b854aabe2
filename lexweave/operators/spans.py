"""Segments, corrections and conflict-free spans over documents.

Offsets count code points; spans are half open. Per-document steps never look beyond one document,
and the order-dependent ones are first split into independent islands or batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import text as tx
from lexweave.functions.pytext import align_udf, diff_udf, match_udf, opcodes_udf, sub_segments_udf
from lexweave.scale import cut, exploded, running, spread

CONTEXT = 8
NO_ERROR = "无误"
SEGMENT_LIMIT = 1000


def running_offset(segments: DataFrame, key: str, order: str, length: Column, out: str = "offset") -> DataFrame:
    """Sum of the lengths of the segments before each one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn(out, F.coalesce(F.sum(length).over(w), F.lit(0)).cast("bigint"))


def text_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, line (1-based), line_text, line_start)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("_i", "line_text"))
    lines = running_offset(lines, "doc_id", "_i", F.length("line_text") + 1, "line_start")
    return lines.select("doc_id", (F.col("_i") + 1).cast("bigint").alias("line"), "line_text", "line_start")


def paragraphs(docs: DataFrame) -> DataFrame:
    """Split at newlines and bars, carriage returns dropped, blank normalised.

    (doc_id, par_no, text, offset_compact, offset_source): the first offset ignores the removed
    separators, the second is the true position in the cleaned text.
    """
    clean = F.replace(tx.normalize_blanks(F.col("text")), F.lit("\r"), F.lit(""))
    parts = docs.select("doc_id", F.posexplode(F.split(clean, "[\n|]")).alias("par_no", "text"))
    parts = running_offset(parts, "doc_id", "par_no", F.length("text"), "offset_compact")
    return (parts.withColumn("offset_source", F.col("offset_compact") + F.col("par_no"))
            .filter(F.length(tx.strip_blank(F.col("text"))) > 0))


def segments(docs: DataFrame) -> DataFrame:
    """Paragraphs, the long ones cut by the sentence and clause rules: (doc_id, seg_no, offset_*, text)."""
    par = paragraphs(docs)
    whole = F.array(F.struct(F.lit(0).alias("offset"), F.col("text").alias("text")))
    # Python only sees the long paragraphs.
    short = par.filter(F.length("text") <= SEGMENT_LIMIT).withColumn("s", F.explode(whole))
    long = exploded(par.filter(F.length("text") > SEGMENT_LIMIT), par.columns, sub_segments_udf("text"), "s")
    both = short.unionByName(long).filter(F.length(tx.strip_blank(F.col("s.text"))) > 0)
    out = both.select("doc_id", (F.col("offset_compact") + F.col("s.offset")).alias("offset_compact"),
                      (F.col("offset_source") + F.col("s.offset")).alias("offset_source"), F.col("s.text").alias("text"))
    w = Window.partitionBy("doc_id").orderBy("offset_source")
    return out.withColumn("seg_no", F.row_number().over(w) - 1)


def passes_gate(original: Column, corrected: Column, error_type: Column) -> Column:
    """False for 'no error', for corrections over twice as long or under half as long as a long original."""
    return (F.coalesce(error_type != NO_ERROR, F.lit(True))
            & (F.length(corrected) <= F.length(original) * 2)
            & ~((F.length(corrected) < F.length(original) * 0.5) & (F.length(original) > 10)))


def valid_span(start: Column, end: Column, original: Column, length: Column) -> Column:
    return (start >= 0) & (end >= start) & ((original == "") | (end <= length))


def diff_spans(pairs: DataFrame) -> DataFrame:
    """pairs(..., original, corrected) -> one row per span: start, end, span_original, span_corrected."""
    keep = pairs.columns
    changed = spread(pairs.filter(F.col("original") != F.col("corrected")))
    return (exploded(changed, keep, diff_udf("original", "corrected"), "_s")
            .select(*keep, "_s.start", "_s.end", "_s.span_original", "_s.span_corrected"))


def diff_steps(pairs: DataFrame) -> DataFrame:
    """pairs(..., original, corrected) -> one row per step (tag, i1, i2, j1, j2), equal stretches included."""
    keep = pairs.columns
    return exploded(spread(pairs), keep, opcodes_udf("original", "corrected"), "_s").select(*keep, "_s.*")


def add_context(df: DataFrame, text: str, start: str, end: str, width: int = CONTEXT) -> DataFrame:
    """Up to `width` characters on either side of the span."""
    lo = F.greatest(F.lit(0), F.col(start) - width)
    return (df.withColumn("context_before", F.substring(F.col(text), (lo + 1).cast("int"), (F.col(start) - lo).cast("int")))
            .withColumn("context_after", F.substring(F.col(text), (F.col(end) + 1).cast("int"), F.lit(width))))


def locate(corrections: DataFrame, segs: DataFrame) -> DataFrame:
    """Place corrections(doc_id, batch, corr_id, original) in segments(doc_id, batch, seg_no, text, offset).

    Exact text first, where the last of equal segments wins; the rest by containment either way inside the same
    (small) batch, where the first wins. A `start` of the correction (a place inside its text) adds to the offset.
    """
    s = segs.select("doc_id", "batch", "seg_no", F.col("text").alias("_t"), "offset")
    place = F.struct("seg_no", "offset")
    exact = (corrections.join(s, (corrections.doc_id == s.doc_id) & (corrections.batch == s.batch) & (corrections.original == s._t))
             .groupBy(corrections.doc_id, corrections.batch, "corr_id").agg(F.max(place).alias("p")))
    rest = corrections.join(exact.select("doc_id", "batch", "corr_id"), ["doc_id", "batch", "corr_id"], "left_anti")
    loose = (rest.join(s, ["doc_id", "batch"])
             .filter(F.contains("_t", F.col("original")) | F.contains("original", F.col("_t"))
                     | (tx.strip_blank(F.col("_t")) == tx.strip_blank(F.col("original"))))
             .groupBy("doc_id", "batch", "corr_id").agg(F.min(place).alias("p")))
    found = exact.unionByName(loose).select("doc_id", "batch", "corr_id", "p.seg_no", "p.offset")
    if "start" not in corrections.columns:
        return found
    begun = corrections.select("doc_id", "batch", "corr_id", F.coalesce("start", F.lit(0)).alias("_start"))
    return found.join(begun, ["doc_id", "batch", "corr_id"]).withColumn("offset", F.col("offset") + F.col("_start")).drop("_start")


def _batched(df: DataFrame, number: str, columns: list[str], prefix: str) -> DataFrame:
    """One row per (doc_id, batch) with its few rows as parallel arrays in `number` order."""
    rows = F.array_sort(F.collect_list(F.struct(number, *columns)))
    packed = df.groupBy("doc_id", "batch").agg(rows.alias("_r"))
    def pull(c: str) -> Column:
        return F.transform("_r", lambda r: r[c]).alias(f"{prefix}_{c}")
    return packed.select("doc_id", "batch", *[pull(c) for c in [number, *columns]])


def align(lines: DataFrame, originals: DataFrame) -> DataFrame:
    """Assign correction lines to originals, one to one: (doc_id, batch, orig_no, original, corrected, matched).

    Inputs are (doc_id, batch, line_no, text) and (doc_id, batch, orig_no, text); a batch holds a few
    segments. Exact or contained text first, then the best similarity above 0.3; unmatched originals
    keep their text.
    """
    j = _batched(originals, "orig_no", ["text"], "o").join(_batched(lines, "line_no", ["text"], "l"), ["doc_id", "batch"], "left")
    none = F.array().cast("array<string>")
    picked = spread(j).withColumn("_p", align_udf(F.coalesce("l_text", none), "o_text"))
    out = exploded(picked, ["doc_id", "batch"], F.arrays_zip("o_orig_no", "o_text", "_p"), "z")
    return out.select("doc_id", "batch", F.col("z.o_orig_no").alias("orig_no"), F.col("z.o_text").alias("original"),
                      F.coalesce("z._p", "z.o_text").alias("corrected"), F.col("z._p").isNotNull().alias("matched"))


def match_results(results: DataFrame, originals: DataFrame) -> DataFrame:
    """Give each result(doc_id, batch, res_no, original, corrected) a known original.

    A known original stays; an unknown one takes the most similar (> 0.5) or is dropped; an empty one
    takes the first contained or the most similar (> 0.3) unused original. Originals without a result
    get a no-error row (res_no null).
    """
    r = _batched(results, "res_no", ["original", "corrected"], "r")
    j = _batched(originals, "orig_no", ["text"], "o").join(r, ["doc_id", "batch"], "full")
    none = F.array().cast("array<string>")
    texts = F.coalesce("o_text", none)
    picked = spread(j).select("doc_id", "batch", "r_res_no", "r_corrected", texts.alias("o_text"),
                      match_udf(F.coalesce("r_original", none), F.coalesce("r_corrected", none), texts).alias("_p"))
    found = (exploded(picked, ["doc_id", "batch"], F.arrays_zip("r_res_no", "r_corrected", "_p"), "z")
             .select("doc_id", "batch", F.col("z.r_res_no").alias("res_no"), F.col("z._p").alias("original"), F.col("z.r_corrected").alias("corrected"))
             .filter(F.col("original").isNotNull()))
    unused = F.array_except("o_text", F.coalesce("_p", none))
    fill = exploded(picked, ["doc_id", "batch"], unused, "original")
    return found.unionByName(fill.select("doc_id", "batch", F.lit(None).cast("bigint").alias("res_no"), "original", F.col("original").alias("corrected")))


def issue_islands(issues: DataFrame, width: int = 100_000) -> DataFrame:
    """Number the groups of touching or overlapping issues of a document.

    No rule of `resolve_overlaps` relates issues of different islands.
    """
    order = ["start", "neg_end", "issue_id"]
    # Each step reads its input twice (rows and piece totals), so the input is written once.
    src = cut(issues.withColumn("neg_end", -F.col("end")))
    seen = running(src, ["doc_id"], order, F.floor(F.col("start") / width), {"reach": ("max", F.col("end"))})
    opens = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)
    marked = cut(seen.withColumn("_open", opens))
    before = running(marked, ["doc_id"], order, F.floor(F.col("start") / width), {"_n": ("sum", F.col("_open"))})
    return before.withColumn("island", F.col("_n") + F.col("_open")).drop("neg_end", "reach", "_open", "_n")


def resolve_overlaps(issues: DataFrame) -> DataFrame:
    """Drop contained issues, keep the wider of equal starts and the shorter of overlapping equal texts.

    issues(doc_id, issue_id, start, end, original, ...) in the order start ascending, end descending.
    Issues that touch no other one never reach Python; the other islands are streamed in order.
    """
    cols = issues.columns
    isl = issue_islands(issues)
    isl = cut(isl.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "island"))))
    crowded = (isl.filter("_n > 1").withColumn("_neg", -F.col("end")).repartition("doc_id", "island")
               .sortWithinPartitions("doc_id", "island", "start", "_neg", "issue_id").select(*cols, "island"))
    at = {c: cols.index(c) for c in ("doc_id", "start", "end", "original")}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, kept = None, []
        for pdf in batches:
            done = []
            for row in pdf.itertuples(index=False, name=None):
                key = (row[at["doc_id"]], row[-1])
                if key != here:
                    done += kept
                    here, kept = key, []
                # What ended before this start can meet nothing any more.
                done += [k for k in kept if k[at["end"]] < row[at["start"]]]
                kept = [k for k in kept if k[at["end"]] >= row[at["start"]]]
                _settle(kept, row, at["start"], at["end"], at["original"])
            yield pd.DataFrame([r[:-1] for r in done], columns=cols)
        yield pd.DataFrame([r[:-1] for r in kept], columns=cols)
    return isl.filter("_n = 1").select(*cols).unionByName(crowded.mapInPandas(scan, issues.schema))


def _settle(kept: list[tuple], row: tuple, s: int, e: int, o: int) -> None:
    """Add one issue to the kept ones of its island; the first kept issue a rule applies to decides."""
    for i, k in enumerate(kept):
        if k[s] <= row[s] and row[e] <= k[e]:
            return
        wider = k[s] == row[s] and row[e] > k[e]
        clash = k[o] == row[o] and k[s] != row[s] and max(k[s], row[s]) < min(k[e], row[e])
        if clash and not wider and row[e] - row[s] >= k[e] - k[s]:
            return
        if wider or clash:
            del kept[i]
            break
    kept.append(row)


def issue_summary(issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per kind and one overall line."""
    c = issues.groupBy(key).agg(
        F.count("*").alias("total_issues"), F.count_if(F.col("type") == "error").alias("errors"),
        F.count_if(F.col("type") == "warning").alias("warnings"),
        F.count_if(F.col("type") == "suggestion").alias("suggestions"))
    overall = (F.when(F.col("errors") > 0, F.concat(F.lit("检测到 "), "errors", F.lit(" 个错误需要修正，建议优先处理。")))
               .when(F.col("warnings") > 0, F.concat(F.lit("检测到 "), "warnings", F.lit(" 个警告，建议检查。")))
               .when(F.col("suggestions") > 0, F.concat(F.lit("检测到 "), "suggestions", F.lit(" 个改进建议。")))
               .otherwise(F.lit("文本质量良好，未检测到问题。")))
    return c.withColumn("overall", overall)


def apply_issues(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """Rewrite docs(doc_id, text) by their issues from right to left: (doc_id, text).

    If the text at a span is not the issue's original, its first occurrence is replaced; if there is
    none the issue is skipped. The edits of one document are bounded by the document itself.
    """
    edits = (issues.filter(F.col("start").isNotNull() & F.col("end").isNotNull())
             .groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct(
                 F.col("end").cast("int").alias("e"), F.col("start").cast("int").alias("s"),
                 F.coalesce("original", F.lit("")).alias("o"), F.coalesce("suggestion", F.lit("")).alias("r"))))).alias("edits")))
    def step(acc: Column, x: Column) -> Column:
        n = F.length(acc)
        s = F.greatest(F.lit(0), F.least(n, x["s"]))
        e = F.greatest(s, F.least(n, x["e"]))
        here = F.substring(acc, s + 1, e - s)
        first = F.position(x["o"], acc)
        moved = (x["o"] != "") & (here != x["o"])
        s2 = F.when(moved, first - 1).otherwise(s)
        e2 = F.when(moved, first - 1 + F.length(x["o"])).otherwise(e)
        new = F.concat(F.substring(acc, F.lit(1), s2), x["r"], F.substring(acc, e2 + 1, n))
        return F.when(moved & (first == 0), acc).otherwise(new)
    return (docs.join(edits, "doc_id", "left")
            .select("doc_id", F.when(F.col("edits").isNull(), F.col("text"))
                    .otherwise(F.aggregate("edits", F.col("text"), step)).alias("text")))


# The layout of correction records and the values that mean no suggestion.
_LABELLED = {
    "record": r"\[纠错结果\]",
    "original": r"原句[:：]\s*(.+)",
    "detail": r"(?s)错情[:：]\s*(.+)",
    "kind": r"错误类型[:：]\s*([^，,。.\n]+)",
    "place": r"起始位置\s*[=：:]\s*(\d+)[，,]\s*终止位置\s*[=：:]\s*(\d+)",
    "suggestion": r"(?s)正确建议[:：]\s*(.+)",
}
_NO_SUGGESTION = ("无", "NULL", "null", "None", "")
_NOT_LABELLED = ("词语搭配",)


def parse_labelled(raw: DataFrame) -> DataFrame:
    """raw(doc_id, content) of labelled correction records -> one row per record that is not 'no error'.

    (doc_id, rec_no, original, category, explanation, start, end, suggestion)
    """
    sec = raw.select("doc_id", F.posexplode(F.split("content", _LABELLED["record"])).alias("rec_no", "s"))
    s = F.col("s")
    sec = sec.filter((tx.strip_blank(s) != "") & s.rlike(_LABELLED["original"]) & ~s.contains(NO_ERROR))
    detail = F.regexp_replace(tx.strip_blank(F.regexp_extract(s, _LABELLED["detail"], 1)), r"\\[nN]", "\n")
    kind = tx.strip_blank(F.regexp_extract(detail, _LABELLED["kind"], 1))
    sug = tx.strip_blank(F.regexp_extract(s, _LABELLED["suggestion"], 1))
    num = lambda g: F.expr(f"try_cast(regexp_extract(s, r'{_LABELLED['place']}', {g}) as int)")
    out = sec.select(
        "doc_id", "rec_no", tx.strip_blank(F.regexp_extract(s, _LABELLED["original"], 1)).alias("original"),
        tx.map_category(kind, _NOT_LABELLED).alias("category"), detail.alias("explanation"),
        num(1).alias("_s"), num(2).alias("_e"),
        F.when(~sug.isin(*_NO_SUGGESTION), sug).alias("suggestion"))
    # Without positions: the stretch between the common prefix and the last differing place.
    shorter = F.least(F.length("original"), F.length("suggestion"))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))),
                       lambda i: F.substring("original", i, F.lit(1)) != F.substring("suggestion", i, F.lit(1)))
    guessed = F.col("_s").isNull() & F.col("suggestion").isNotNull() & (F.size(differs) > 0)
    return out.select(
        "doc_id", "rec_no", "original", "category", "explanation",
        F.coalesce("_s", F.when(guessed, F.array_min(differs) - 1), F.lit(0)).alias("start"),
        F.coalesce("_e", F.when(guessed, F.array_max(differs)), F.length("original")).alias("end"), "suggestion")


def parse_corrected_body(raw: DataFrame) -> DataFrame:
    """raw(doc_id, content) -> (doc_id, think, body, error_type, explanation).

    The body is what follows `</think>`; type and reason come from the part before the first empty
    line, or from the thinking part if the body has none.
    """
    c = F.coalesce("content", F.lit(""))
    think = tx.strip_blank(F.regexp_extract(c, r"(?s)<think>\s*(.*?)\s*</think>", 1))
    after = F.when(c.contains("</think>"), F.substring(c, F.position(F.lit("</think>"), c) + 8, F.length(c))).otherwise(c)
    whole = tx.strip_blank(after)
    blank = F.position(F.lit("\n\n"), whole)
    df = raw.select("doc_id", think.alias("think"), whole.alias("whole"), blank.alias("gap"))
    reason = F.when(F.col("gap") > 0, tx.strip_blank(F.substring("whole", F.lit(1), F.col("gap") - 1))).otherwise(F.col("think"))
    body = F.when(F.col("gap") > 0, F.substring("whole", F.col("gap") + 2, F.length("whole"))).otherwise(F.col("whole"))
    lines = F.filter(F.split(body, "\n"), lambda r: tx.strip_blank(r) != "")
    df = df.select("doc_id", "think", reason.alias("reason"),
                   F.array_join(F.transform(lines, lambda r: F.regexp_replace(r, f"{tx.BLANK}+$", "")), "\n").alias("body"))
    r = F.col("reason")
    kind = tx.strip_blank(F.regexp_extract(r, r"错误类型[:：]?\s*([^，,\n]+)", 1))
    why = r"(?s)修改(?:说明|原因|解释)[:：]\s*(.+?)(?=错误类型[:：]|$)"
    text = F.when(r.rlike(why), tx.strip_blank(F.regexp_extract(r, why, 1))).otherwise(
        tx.strip_blank(F.regexp_replace(r, r"错误类型[:：]?\s*[^，,\n]+\n?", "")))
    return df.select("doc_id", "think", "body", tx.map_error_type(kind).alias("error_type"),
                     F.replace(text, F.lit("\\n"), F.lit("\n")).alias("explanation"))


def merge_runs(runs: DataFrame, keys: list[str], pos: str, same: list[str], width: int = 10_000) -> DataFrame:
    """Join neighbours that agree on the `same` columns: texts in order, one row per island.

    runs(keys..., pos, same..., text). A large container is scanned in pieces of `width` positions and
    only the island's own texts meet in one place.
    """
    mark = F.struct(*[F.col(c) for c in same])
    bucket = F.floor(F.col(pos) / width)
    prev = running(runs, keys, [pos], bucket, {"_prev": ("last", mark)})
    flagged = prev.withColumn("_new", F.when(F.col("_prev").eqNullSafe(mark), 0).otherwise(1))
    # Written once: the second pass would else compute the first again for each of its branches.
    counted = running(cut(flagged), keys, [pos], bucket, {"_n": ("sum", F.col("_new"))})
    island = counted.withColumn("island", (F.col("_n") + F.col("_new")).cast("bigint"))
    return island.groupBy(*keys, "island").agg(
        *[F.min_by(c, pos).alias(c) for c in same], F.min(pos).alias(pos), F.count("*").alias("merged"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "text"))), lambda x: x["text"]), "").alias("text"))
