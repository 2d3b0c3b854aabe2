"""Mixing sources to target weights under a time-varying curriculum.

A schedule gives each source's weight at knots of a clock from 0 to 1, linear in between. Its integral is the source's
share of the mix; `targets` turns shares into words, each source stopping at `max_repeats` times its own size. Documents
of a source stand in a fixed random order and repeat in that order until the target is met; a document whose words lie at
offset c of that stream is trained on when the source's cumulative demand reaches c, so its position is the inverse of
the integrated schedule at c. Documents are then range-sorted by position.

Only DataFrame functions are used. Per source one row with its totals and one per knot exist; rows of one source are
spread over pieces of about `PIECE_ROWS` rows, so that a hot source is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.scale import bounded_broadcast

PIECE_ROWS = 16384
SOURCES_BROADCAST = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, total: Column, max_repeats: float) -> DataFrame:
    """Adds `target` to (source, weight, source_size): min(level * weight, max_repeats * source_size), summing to `total`.

    The level is found in one ordered pass: sources in order of their cap per weight fill up first, and the level is what
    is left over for the others. A source without weight gets 0; if all caps together are below `total`, all are met.
    """
    cap = F.lit(max_repeats) * F.col("source_size")
    fill = Window.orderBy("_ratio", "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    ranked = (sources.withColumn("_cap", cap).withColumn("_total", total.cast("double"))
              .withColumn("_ratio", F.when(F.col("weight") > 0, F.col("_cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
              .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.nullif(F.sum("weight").over(after), F.lit(0.0))))
    # The first source whose cap is above its level sets the level for all that follow.
    level = F.min(F.when((F.col("weight") > 0) & (F.col("_ratio") >= F.col("_level")), F.struct("_ratio", "source", "_level"))).over(Window.partitionBy())
    met = F.least(F.col("_cap"), F.coalesce(level["_level"], F.lit(float("inf"))) * F.col("weight"))
    return (ranked.withColumn("target", F.when(F.col("weight") > 0, met).otherwise(F.lit(0.0)))
            .drop("_cap", "_total", "_ratio", "_level"))


def integrated(schedule: DataFrame) -> DataFrame:
    """(source, area, segments) of a schedule (source, at, weight): the integral of the weights and its pieces.

    A segment holds its start, length, weight at the start, slope, and the area before and at its end.
    """
    order = Window.partitionBy("source").orderBy("at")
    steps = (schedule.withColumn("_to", F.lead("at").over(order)).withColumn("_next", F.lead("weight").over(order))
             .filter(F.col("_to") > F.col("at"))
             .withColumn("_area", (F.col("_to") - F.col("at")) * (F.col("weight") + F.col("_next")) / 2)
             .withColumn("_done", F.sum("_area").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    segment = F.struct(F.col("at").alias("start"), (F.col("_to") - F.col("at")).alias("length"), F.col("weight").alias("first"),
                       ((F.col("_next") - F.col("weight")) / (F.col("_to") - F.col("at"))).alias("slope"),
                       (F.col("_done") - F.col("_area")).alias("before"), F.col("_done").alias("upto"))
    return steps.groupBy("source").agg(F.max("_done").alias("area"), F.array_sort(F.collect_list(segment)).alias("segments"))


def clock_at(segments: Column, area: Column) -> Column:
    """When the integrated schedule reaches `area`: the quadratic solved in the segment that holds it."""
    s = F.element_at(F.filter(segments, lambda x: (x["upto"] >= area) & (x["upto"] > x["before"])), 1)
    rest = area - s["before"]
    # 2r / (b + sqrt(b^2 + 2sr)) is the root of s t^2 / 2 + b t = r that stays exact for small slopes.
    root = F.sqrt(F.greatest(s["first"] * s["first"] + 2 * s["slope"] * rest, F.lit(0.0)))
    step = F.when(rest > 0, 2 * rest / F.nullif(s["first"] + root, F.lit(0.0))).otherwise(F.lit(0.0))
    return s["start"] + F.least(F.coalesce(step, s["length"]), s["length"])


def placed(docs: DataFrame, schedule: DataFrame, share: float, max_repeats: float, size: str = "size", source: str = "source",
           order: Column | None = None) -> DataFrame:
    """Every row of docs as `row`, with source_size, target, start (its offset in the source's order) and segments.

    `schedule` has (source, at, weight) for every source of docs; sources compare null-safely. `order` is a hex string
    that fixes the order inside a source; its first digits cut the source into pieces. Rows of equal order follow size.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) if order is None else order
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"),
                       F.col(size).cast("long").alias("size"), order.alias("order"))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    curves = integrated(schedule)
    weighted = (sums.alias("t").join(curves.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")))
                .select("t.source", "t.source_size", "t.rows", "segments", "area", F.col("area").alias("weight")))
    total = F.lit(share) * F.sum("source_size").over(Window.partitionBy())
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("rows") / PIECE_ROWS))).cast("int")
    plan = targets(weighted.withColumn("_all", total), F.col("_all"), max_repeats).select(
        F.col("source").alias("plan_source"), "source_size", "target", "segments", "area", digits.alias("digits"))
    joined = rows.join(bounded_broadcast(plan, SOURCES_BROADCAST), F.col("source").eqNullSafe(F.col("plan_source")))
    pieced = joined.withColumn("piece", F.expr("substring(order, 1, digits)"))
    inside = Window.partitionBy("source", "piece").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = (pieced.groupBy("source", "piece").agg(F.sum("size").alias("held"))
               .select(F.col("source").alias("c_source"), F.col("piece").alias("c_piece"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("carry")))
    local = pieced.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (local.join(carried, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("piece") == F.col("c_piece")))
            .select("row", "size", "source_size", "target", "segments", "area", (F.col("carry") + F.col("inner")).alias("start")))


def copies(rows: DataFrame) -> DataFrame:
    """Adds `copies`: an array of (epoch, taken, position), one for every time the mix takes words of the document.

    `taken` counts words; the last document of a source may be cut so that the source meets its target to the word.
    `position` is the clock at the middle of the taken words.
    """
    demand = F.round("target").cast("long")
    begin = lambda e: F.col("start") + e * F.col("source_size")
    taken = lambda e: F.greatest(F.lit(0), F.least(F.col("size"), F.col("demand") - begin(e)))
    epochs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("demand") / F.nullif(F.col("source_size"), F.lit(0))).cast("int")))
    at = lambda e: clock_at(F.col("segments"), F.col("area") * F.least(F.lit(1.0), (begin(e) + taken(e) / 2) / F.nullif(F.col("demand"), F.lit(0))))
    made = F.transform(epochs, lambda e: F.struct(e.alias("epoch"), taken(e).cast("long").alias("taken"), at(e).alias("position")))
    return (rows.withColumn("demand", demand)
            .withColumn("copies", F.coalesce(F.filter(made, lambda c: c["taken"] > 0), F.array().cast("array<struct<epoch:int,taken:bigint,position:double>>"))))


def by_rank(docs: DataFrame, weights: list[float], tilts: list[float], source: str = "source") -> DataFrame:
    """A schedule for the sources of docs: by code point, null last, they take `weights` in turn.

    Over the clock a source's weight moves linearly from weight * (1 + tilt) to weight * (1 - tilt); the integral stays weight.
    """
    ranked = docs.select(F.col(source).alias("source")).distinct().withColumn(
        "_n", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("_n") + 1).cast("int"))
    knots = F.array(F.struct(F.lit(0.0).alias("at"), (pick(weights) * (1 + pick(tilts))).alias("weight")),
                    F.struct(F.lit(1.0).alias("at"), (pick(weights) * (1 - pick(tilts))).alias("weight")))
    return ranked.select("source", F.explode(knots).alias("k")).select("source", "k.at", "k.weight")


def mixture(docs: DataFrame, schedule: DataFrame, share: float = 1.5, max_repeats: float = 2.0, size: str = "size",
            whole: bool = False) -> DataFrame:
    """The training order: every copy of a document as a row of docs with epoch, taken and position, range-sorted.

    A document's words are taken at most max_repeats times. With `whole`, a copy that is cut by its source's target stays
    if half of its words or more are taken, and goes otherwise. Rows of size 0 take no words and are left out. Null
    sources are a source of their own; repeated rows are documents of their own; an empty table gives an empty one.
    """
    made = copies(placed(docs, schedule, share, max_repeats, size)).select("row", "size", F.explode("copies").alias("copy"))
    if whole:
        made = made.filter(2 * F.col("copy.taken") >= F.col("size"))
    return made.orderBy("copy.position", "copy.epoch").select("row.*", "copy.*")
