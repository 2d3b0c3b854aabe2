"""Evaluation queries. Labelled documents are runs: source = eval and query, length class = configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import evals as ev
from lexweave.plans.registry import query, table

RUNS_SQL = """ru as (select source eval_id, case when n_chars > 900 then 'with_skill' else 'without_skill' end configuration, doc_id run_number, quality::double pass_rate,
 quality = 1 passed, toxic = 1 toxic, case when toxic = 1 then 0.0 else n_chars/100.0 end::double time_seconds, n_chars tokens, lang, doc_id from labels join documents using(doc_id))"""


def runs(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    return j.select(F.col("source").alias("eval_id"), F.when(F.col("n_chars") > 900, "with_skill").otherwise("without_skill").alias("configuration"),
                    F.col("doc_id").alias("run_number"), F.col("quality").cast("double").alias("pass_rate"), (F.col("quality") == 1).alias("passed"),
                    (F.col("toxic") == 1).alias("toxic"), F.when(F.col("toxic") == 1, F.lit(0.0)).otherwise(F.col("n_chars") / 100.0).alias("time_seconds"),
                    F.col("n_chars").alias("tokens"), "lang", "doc_id")


def spread_sql(c):
    # The mean in whole numbers: billionths summed exactly, then rounded half up to four places.
    total = f"sum(({c}::decimal(28,9)*1000000000)::hugeint)"
    mean = f"(sign({total}) * ((2*abs({total})*10000 + count({c})*1000000000::hugeint) // (2*count({c})*1000000000::hugeint)))::double / 10000 {c}_mean"
    return mean + ", " + ", ".join(f"round({e}::double,4) {c}_{n}" for n, e in [("stddev", f"coalesce(stddev_samp({c}),0)"), ("min", f"min({c})"), ("max", f"max({c})")])


SUMMARY_SQL = f"{RUNS_SQL}, su as (select configuration, count(*) runs, {', '.join(spread_sql(m) for m in ev.METRICS)} from ru group by 1)"


@query("agg8_run_summary", f"with {SUMMARY_SQL} select * from su")
def agg8(spark, d):
    return ev.run_summary(runs(spark, d))


@query("agg8_event_summary", f"with ru as (select event_type configuration, value pass_rate, value*2 time_seconds, user_id tokens from events) select configuration, count(*) runs, {', '.join(spread_sql(m) for m in ev.METRICS)} from ru group by 1")
def agg8_events(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("configuration"), F.col("value").alias("pass_rate"), (F.col("value") * 2).alias("time_seconds"), F.col("user_id").alias("tokens"))
    return ev.run_summary(e)


@query("agg9_run_delta", f"""with {SUMMARY_SQL}, a as (select * from su where configuration = 'with_skill'), b as (select * from su where configuration = 'without_skill')
select printf('%+.2f', a.pass_rate_mean - b.pass_rate_mean) delta_pass_rate, printf('%+.1f', a.time_seconds_mean - b.time_seconds_mean) delta_time_seconds, printf('%+.0f', a.tokens_mean - b.tokens_mean) delta_tokens from a, b""")
def agg9(spark, d):
    return ev.run_delta(ev.run_summary(runs(spark, d)))


@query("join8_timing_fallback", """with g as (select l.doc_id, case when toxic = 1 then 0.0 else quality * 1.5 end::double ts, quality * 100 oc from labels l),
t as (select doc_id, n_chars/10.0 d, case when lang = 'en' then n_chars else 0 end k from documents where lang <> 'fr')
select doc_id, case when ts = 0 then coalesce(d,0.0) else ts end::double time_seconds, case when ts = 0 and coalesce(k,0) <> 0 then k else oc end::bigint tokens from g left join t using(doc_id)""")
def join8(spark, d):
    g = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, F.lit(0.0)).otherwise(F.col("quality") * 1.5).alias("time_seconds"), (F.col("quality") * 100).alias("output_chars"))
    t = table(spark, d, "documents").filter("lang <> 'fr'").select("doc_id", (F.col("n_chars") / 10.0).alias("total_duration_seconds"), F.when(F.col("lang") == "en", F.col("n_chars")).otherwise(F.lit(0)).alias("total_tokens"))
    return ev.with_timing(g, t, ["doc_id"]).select("doc_id", "time_seconds", "tokens")


@query("join10_feedback", """select coalesce(l.doc_id, f.doc_id) run_id, coalesce(feedback,'') feedback, coalesce(quality,0)::int outputs from labels l full join
 (select doc_id, case lang when 'en' then '  ' when 'es' then null else source end feedback from documents where trim(case lang when 'en' then '  ' when 'es' then '' else source end) <> '') f on l.doc_id = f.doc_id""")
def join10(spark, d):
    r = table(spark, d, "labels").select(F.col("doc_id").alias("run_id"), F.col("quality").alias("outputs"))
    f = table(spark, d, "documents").select(F.col("doc_id").alias("run_id"), F.expr("case lang when 'en' then '  ' when 'es' then null else source end").alias("feedback"))
    return ev.with_feedback(r, f)


TRIG_SQL = RUNS_SQL + """, tr as (select lang iteration, eval_id query, eval_id < 'src3' should_trigger, passed triggered from ru),
ra as (select query, bool_or(should_trigger) should_trigger, count(*) filter (triggered) triggers, count(*) runs, count(*) filter (triggered)/count(*)::double trigger_rate from tr group by 1),
rp as (select *, case when should_trigger then trigger_rate >= 0.8 else trigger_rate < 0.8 end pass from ra),
ia as (select iteration, query, bool_or(should_trigger) should_trigger, count(*) filter (triggered) triggers, count(*) runs, count(*) filter (triggered)/count(*)::double trigger_rate from tr group by 1, 2),
ip as (select *, case when should_trigger then trigger_rate >= 0.8 else trigger_rate < 0.8 end pass from ia)"""


def triggers(spark, d):
    r = runs(spark, d)
    return r.select(F.col("lang").alias("iteration"), F.col("eval_id").alias("query"), (F.col("eval_id") < "src3").alias("should_trigger"), F.col("passed").alias("triggered"))


def rates(spark, d, keys=("query",)):
    return ev.trigger_rates(triggers(spark, d), keys, threshold=0.8)


@query("agg10_trigger_rates", f"with {TRIG_SQL} select query, should_trigger, triggers, runs, round(trigger_rate,6) trigger_rate, pass from rp")
def agg10(spark, d):
    return rates(spark, d).withColumn("trigger_rate", F.round("trigger_rate", 6))


@query("agg10_pass_summary", f"with {TRIG_SQL} select count(*) total, count(*) filter (pass) passed, count(*) filter (not pass) failed from rp")
def agg10_summary(spark, d):
    return ev.pass_summary(rates(spark, d))


@query("agg11_confusion", f"""with {TRIG_SQL}, c as (select coalesce(sum(triggers) filter (should_trigger),0)::bigint tp, coalesce(sum(runs-triggers) filter (should_trigger),0)::bigint fn, coalesce(sum(triggers) filter (not should_trigger),0)::bigint fp, coalesce(sum(runs-triggers) filter (not should_trigger),0)::bigint tn from rp)
select *, case when tp+fp>0 then tp/(tp+fp) else 1.0 end::double "precision", case when tp+fn>0 then tp/(tp+fn) else 1.0 end::double recall, case when tp+tn+fp+fn>0 then (tp+tn)/(tp+tn+fp+fn) else 0.0 end::double accuracy from c""")
def agg11(spark, d):
    return ev.confusion(rates(spark, d))


@query("agg12_score_bands", f"""with {TRIG_SQL}, c as (select iteration, sum(case when should_trigger then triggers else runs-triggers end)::bigint correct, sum(runs)::bigint total from ip group by 1)
select *, case when correct/total >= 0.8 then 'score-good' when correct/total >= 0.5 then 'score-ok' else 'score-bad' end band from c""")
def agg12(spark, d):
    return ev.score_bands(rates(spark, d, ("iteration", "query")), ("iteration",))


@query("flt9_failures", f"with {TRIG_SQL} select query, case when should_trigger then 'missed' else 'false' end kind from rp where not pass")
def flt9(spark, d):
    return ev.failures(rates(spark, d)).select("query", "kind")


@query("agg13_expectation_patterns", f"""with {RUNS_SQL}, e as (select eval_id || lang as "text", configuration, passed from ru),
g as (select "text", count(*) n, bool_and(passed) filter (configuration='with_skill') wa, bool_or(passed) filter (configuration='with_skill') wo, bool_and(passed) filter (configuration='without_skill') oa, bool_or(passed) filter (configuration='without_skill') oo from e group by 1)
select "text", n, case when wa and oa then 'always_pass' when not wo and not oo then 'always_fail' when wa and not oo then 'only_with' when not wo and oa then 'only_without' else 'variable' end pattern from g""")
def agg13(spark, d):
    e = runs(spark, d).select(F.concat("eval_id", "lang").alias("text"), "configuration", "passed")
    return ev.expectation_patterns(e, "with_skill", "without_skill")


@query("agg14_eval_spread", f"with {RUNS_SQL} select eval_id, configuration, count(*) runs, {spread_sql('pass_rate')}, {spread_sql('time_seconds')} from ru group by 1, 2")
def agg14(spark, d):
    return ev.eval_spread(runs(spark, d))


@query("agg14_outlier_runs", """with g as (select event_type, user_id, avg(value) m, stddev_samp(value) s from events group by 1, 2) select event_id, round((value-m)/s,4) z from events join g using(event_type, user_id) where s > 0 and abs((value-m)/s) > 2""")
def agg14_outliers(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("eval_id"), F.col("user_id").alias("configuration"), F.col("value").alias("time_seconds"))
    return ev.outlier_runs(e).select("event_id", F.round("z", 4).alias("z"))


@query("agg15_answer_report", """select user_id, count(*) filter (event_type = 'click') correct, count(*) total, round(avg((event_type='click')::int)*100,6) accuracy, round(avg(value),6) average_duration, round(avg(length(props)),6) average_tool_calls, sum(length(props))::bigint total_tool_calls from events group by 1""")
def agg15(spark, d):
    e = table(spark, d, "events").select("user_id", F.lit("click").alias("expected"), F.col("event_type").alias("actual"), F.col("value").alias("duration"), F.length("props").alias("n_tool_calls"))
    r = ev.answer_report(e, ("user_id",))
    return r.select("user_id", "correct", "total", *[F.round(c, 6).alias(c) for c in ("accuracy", "average_duration", "average_tool_calls")], "total_tool_calls")


@query("agg16_tool_usage", "select event_type tool, count(*) calls, round(sum(value),3) total_duration, round(avg(value),6) mean_duration, min(value) min_duration, max(value) max_duration from events group by 1")
def agg16(spark, d):
    u = ev.tool_usage(table(spark, d, "events").select(F.col("event_type").alias("tool"), F.col("value").alias("duration")))
    return u.withColumn("total_duration", F.round("total_duration", 3)).withColumn("mean_duration", F.round("mean_duration", 6))


@query("set4_eval_ids", f"with {RUNS_SQL} select distinct eval_id from ru")
def set4(spark, d):
    return ev.eval_ids(runs(spark, d))


@query("join11_split_back", f"with {TRIG_SQL} select query, pass, case when query in (select 'src' || r_regionkey from region) then 'train' else 'test' end side from rp")
def join11(spark, d):
    train = table(spark, d, "region").select(F.concat(F.lit("src"), "r_regionkey").alias("query"))
    a, b = ev.split_by_query(rates(spark, d), train)
    return a.select("query", "pass", F.lit("train").alias("side")).unionByName(b.select("query", "pass", F.lit("test").alias("side")))


@query("set6_train_test_batch", f"with {TRIG_SQL} select case when query in (select 'src' || r_regionkey from region) then 'train' else 'test' end side, count(*) total, count(*) filter (pass) passed, count(*) filter (not pass) failed from rp group by 1")
def set6(spark, d):
    train_q = table(spark, d, "region").select(F.concat(F.lit("src"), "r_regionkey").alias("query"))
    runs_ = triggers(spark, d)
    both = runs_.join(train_q, "query", "left_semi").unionByName(runs_.join(train_q, "query", "left_anti"))
    a, b = ev.split_by_query(ev.trigger_rates(both, threshold=0.8), train_q)
    return ev.pass_summary(a.withColumn("side", F.lit("train")).unionByName(b.withColumn("side", F.lit("test"))), ("side",))


@query("win7_best_iteration", """with h as (select c_mktsegment seg, c_nationkey iteration, count(*) filter (c_acctbal > 0) train_passed, case when c_mktsegment = 'BUILDING' then null else count(*) filter (c_acctbal > 4000) end test_passed from customer group by 1, 2)
select seg, iteration, passed from (select *, coalesce(test_passed, train_passed, 0) passed, row_number() over (partition by seg order by coalesce(test_passed, train_passed, 0) desc, iteration) rn from h) where rn = 1""")
def win7(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("iteration")).agg(
        F.count_if(F.col("c_acctbal") > 0).alias("train_passed"), F.count_if(F.col("c_acctbal") > 4000).alias("_t"))
    h = c.withColumn("test_passed", F.when(F.col("seg") != "BUILDING", F.col("_t")))
    return ev.best_iteration(h, ("seg",))


@query("win8_holdout", """with h as (select *, count(*) over (partition by quality) n, row_number() over (partition by quality order by md5(doc_id || ':42'), doc_id) r from labels)
select doc_id, quality, toxic, r <= greatest(1, floor(n * 0.4)) is_test from h""")
def win8(spark, d):
    return ev.holdout(table(spark, d, "labels"), "quality", "doc_id", 0.4)


@query("src7_eval_tree", """select doc_id run_number, substr(source, 4)::int eval_id, lang configuration, quality::double pass_rate, case when toxic = 1 or quality = 0 then n_chars/10.0 else quality*2.0 end::double time_seconds,
 case when (toxic = 1 or quality = 0) then n_chars else 7 end::bigint tokens, 1::int n_expectations from labels join documents using(doc_id) where lang <> 'es'""")
def src7(spark, d):
    """Grading and timing JSON with their paths, derived per labelled document; 'es' gradings are broken."""
    from lexweave.sources.readers import parse_eval_runs
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    path = F.concat(F.lit("x/eval-"), F.substring("source", 4, 9), F.lit("/"), "lang", F.lit("/run-"), "doc_id")
    body = F.to_json(F.struct(
        F.struct(F.col("quality").cast("double").alias("pass_rate")).alias("summary"),
        F.struct(F.when(F.col("toxic") == 1, F.lit(0.0)).otherwise(F.col("quality") * 2.0).alias("total_duration_seconds")).alias("timing"),
        F.struct(F.lit(7).alias("output_chars")).alias("execution_metrics"),
        F.array(F.struct(F.col("source").alias("text"), (F.col("quality") == 1).alias("passed"), F.lit("e").alias("evidence"))).alias("expectations")))
    grading = j.select(F.concat(path, F.lit("/grading.json")).alias("path"), F.when(F.col("lang") == "es", F.lit("{no")).otherwise(body).alias("value"))
    timing = j.select(F.concat(path, F.lit("/timing.json")).alias("path"),
                      F.to_json(F.struct((F.col("n_chars") / 10.0).alias("total_duration_seconds"), F.col("n_chars").alias("total_tokens"))).alias("value"))
    r = parse_eval_runs(grading, timing)
    return r.select(F.col("run_number").cast("bigint").alias("run_number"), "eval_id", "configuration", "pass_rate", "time_seconds", "tokens", F.size("expectations").alias("n_expectations"))
