"""Evaluation runs: summaries, deltas, trigger rates, confusion counts, patterns.

eval_runs(eval_id, configuration, run_number, pass_rate, time_seconds, tokens, ...)
trigger_runs(iteration, query, should_trigger, run, triggered)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.scale import running

METRICS = ("pass_rate", "time_seconds", "tokens")
THRESHOLD = 0.5


def spread(c: str, digits: int = 4) -> list[Column]:
    """mean, sample stddev (0 for one value), min and max of a column.

    The mean is taken in decimals, so that rounding does not hang on the order of the sum.
    """
    r = lambda x: F.round(x.cast("double"), digits)
    mean = F.round(F.avg(F.col(c).cast("decimal(28,9)")), digits).cast("double")
    return [mean.alias(f"{c}_mean"), r(F.coalesce(F.nanvl(F.stddev_samp(c), F.lit(0.0)), F.lit(0.0))).alias(f"{c}_stddev"),
            r(F.min(c)).alias(f"{c}_min"), r(F.max(c)).alias(f"{c}_max")]


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("configuration").agg(F.count("*").alias("runs"), *[x for m in METRICS for x in spread(m)])


def run_delta(summary: DataFrame) -> DataFrame:
    """First configuration minus second, by name, as signed texts; a missing side counts as 0."""
    two = summary.orderBy("configuration").limit(2).withColumn("_k", F.lit(0))
    both = two.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("configuration", *[f"{m}_mean" for m in METRICS]))).alias("c"))
    side = lambda i, m: F.coalesce(F.try_element_at("c", F.lit(i))[f"{m}_mean"], F.lit(0.0))
    fmt = {"pass_rate": "%+.2f", "time_seconds": "%+.1f", "tokens": "%+.0f"}
    return both.select(*[F.format_string(fmt[m], side(1, m) - side(2, m)).alias(f"delta_{m}") for m in METRICS])


def with_timing(gradings: DataFrame, timings: DataFrame, keys: list[str]) -> DataFrame:
    """Grading time unless it is 0, then the timing row; tokens fall back to the output characters."""
    own = F.coalesce("time_seconds", F.lit(0.0))
    j = gradings.join(timings.select(*keys, F.col("total_duration_seconds").alias("_d"), F.col("total_tokens").alias("_t")), keys, "left")
    tokens = F.when(own == 0.0, F.coalesce("_t", F.lit(0))).otherwise(F.lit(0))
    return (j.withColumn("tokens", F.when(tokens == 0, F.coalesce("output_chars", F.lit(0))).otherwise(tokens).cast("bigint"))
            .withColumn("time_seconds", F.when(own == 0.0, F.coalesce("_d", F.lit(0.0))).otherwise(own)).drop("_d", "_t"))


def with_feedback(runs: DataFrame, feedback: DataFrame) -> DataFrame:
    """runs(run_id, outputs) and feedback(run_id, feedback), both sides kept; blank feedback is ignored."""
    said = feedback.filter(F.trim(F.coalesce("feedback", F.lit(""))) != "")
    return runs.join(said, "run_id", "full").select("run_id", F.coalesce("feedback", F.lit("")).alias("feedback"), F.coalesce("outputs", F.lit(0)).alias("outputs"))


def trigger_rates(runs: DataFrame, keys: tuple[str, ...] = ("query",), threshold: float = THRESHOLD) -> DataFrame:
    g = runs.groupBy(*keys).agg(F.max("should_trigger").alias("should_trigger"), F.count_if("triggered").alias("triggers"), F.count("*").alias("runs"))
    rate = F.col("triggers") / F.col("runs")
    return g.withColumn("trigger_rate", rate).withColumn(
        "pass", F.when(F.col("should_trigger"), rate >= threshold).otherwise(rate < threshold))


def pass_summary(rates: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return rates.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("pass").alias("passed"), F.count_if(~F.col("pass")).alias("failed"))


def confusion(rates: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """tp, fn, fp, tn over runs; precision and recall are 1 when undefined, accuracy 0 when empty."""
    s, t, n = F.col("should_trigger"), F.col("triggers"), F.col("runs")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    c = rates.groupBy(*keys).agg(total(F.when(s, t)).alias("tp"), total(F.when(s, n - t)).alias("fn"),
                                 total(F.when(~s, t)).alias("fp"), total(F.when(~s, n - t)).alias("tn"))
    ratio = lambda a, b, empty: F.when(b > 0, a / b).otherwise(F.lit(empty))
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return (c.withColumn("precision", ratio(tp, tp + fp, 1.0)).withColumn("recall", ratio(tp, tp + fn, 1.0))
            .withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn, 0.0)))


def score_bands(rates: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Correct runs, all runs and the band good / ok / bad."""
    right = F.when(F.col("should_trigger"), F.col("triggers")).otherwise(F.col("runs") - F.col("triggers"))
    g = rates.groupBy(*keys).agg(F.sum(right).cast("bigint").alias("correct"), F.sum("runs").cast("bigint").alias("total"))
    r = F.when(F.col("total") > 0, F.col("correct") / F.col("total"))
    return g.withColumn("band", F.when(r >= 0.8, F.lit("score-good")).when(r >= 0.5, F.lit("score-ok")).otherwise(F.lit("score-bad")))


def failures(rates: DataFrame) -> DataFrame:
    """Wrong predictions only: `missed` should have fired, `false` should not."""
    return rates.filter(~F.col("pass")).withColumn("kind", F.when(F.col("should_trigger"), F.lit("missed")).otherwise(F.lit("false")))


def expectation_patterns(exps: DataFrame, with_config: str, without_config: str) -> DataFrame:
    """exps(text, configuration, passed) -> how each expectation behaves over the two configurations."""
    on, off = F.col("configuration") == with_config, F.col("configuration") == without_config
    p = F.col("passed")
    g = exps.groupBy("text").agg(F.min(F.when(on, p)).alias("wmin"), F.max(F.when(on, p)).alias("wmax"),
                                 F.min(F.when(off, p)).alias("omin"), F.max(F.when(off, p)).alias("omax"), F.count("*").alias("n"))
    w_all, w_none, o_all, o_none = F.col("wmin"), ~F.col("wmax"), F.col("omin"), ~F.col("omax")
    label = (F.when(w_all & o_all, "always_pass").when(w_none & o_none, "always_fail")
             .when(w_all & o_none, "only_with").when(w_none & o_all, "only_without").otherwise("variable"))
    return g.select("text", "n", label.alias("pattern"))


def eval_spread(runs: DataFrame) -> DataFrame:
    return runs.groupBy("eval_id", "configuration").agg(F.count("*").alias("runs"), *spread("pass_rate"), *spread("time_seconds"))


def outlier_runs(runs: DataFrame, z: float = 2.0) -> DataFrame:
    """Runs whose time is more than z sample deviations from the mean of their eval and configuration."""
    stats = runs.groupBy("eval_id", "configuration").agg(F.avg("time_seconds").alias("_m"), F.stddev_samp("time_seconds").alias("_s"))
    score = (F.col("time_seconds") - F.col("_m")) / F.col("_s")
    return (runs.join(stats, ["eval_id", "configuration"]).filter(F.col("_s") > 0)
            .withColumn("z", score).filter(F.abs("z") > z).drop("_m", "_s"))


def answer_report(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """results(expected, actual, duration, n_tool_calls): exact-match accuracy and means."""
    hit = F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)) & (F.coalesce("actual", F.lit("")) != "")
    return results.groupBy(*keys).agg(
        F.count_if(hit).alias("correct"), F.count("*").alias("total"), (F.avg(hit.cast("int")) * 100).alias("accuracy"),
        F.avg("duration").alias("average_duration"), F.avg("n_tool_calls").alias("average_tool_calls"),
        F.sum("n_tool_calls").cast("bigint").alias("total_tool_calls"))


def tool_usage(calls: DataFrame, keys: tuple[str, ...] = ("tool",)) -> DataFrame:
    """calls(tool, duration): count and duration figures; the single durations stay in the call table."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("duration").alias("total_duration"), F.avg("duration").alias("mean_duration"),
                                    F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"))


def best_iteration(history: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Most test passes (train where there is no test), the earliest of equals."""
    score = F.coalesce("test_passed", "train_passed", F.lit(0))
    order = F.struct(score, -F.col("iteration"))
    return history.groupBy(*keys).agg(F.max_by("iteration", order).alias("iteration"), F.max_by(score, order).alias("passed"))


def holdout(items: DataFrame, label: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """Stratified split: adds `is_test`, max(1, floor(n * share)) items per label in hashed order.

    The hash (MD5 of key:seed) spreads each label over 4096 pieces that are numbered on their own and then offset.
    """
    h = items.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed).cast("string"))))
    n = h.groupBy(label).agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("_take"))
    pos = running(h, [label], ["_h", key], F.substring("_h", 1, 3), {"_before": ("sum", F.lit(1))})
    return pos.join(n, label).withColumn("is_test", F.col("_before") < F.col("_take")).drop("_h", "_before", "_take")


def split_by_query(results: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train results, test results) by membership of the query."""
    q = train.select("query").distinct()
    return results.join(q, "query", "left_semi"), results.join(q, "query", "left_anti")


def eval_ids(runs: DataFrame) -> DataFrame:
    return runs.select("eval_id").distinct().orderBy("eval_id")
