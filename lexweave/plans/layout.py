"""Layout queries: orders are boxes and cells on their customer's page, parts are files, line items references."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import layout as ly
from lexweave.operators import spans as sp
from lexweave.plans.registry import query, table

BOX_SQL = """bx as (select o_custkey page, o_orderkey box_id, case when o_orderstatus = 'F' then 'label' else 'entry' end kind, floor(o_totalprice/1000)::double x0, extract(year from o_orderdate)*10.0 y0,
 floor(o_totalprice/1000)::double + 60 x1, extract(year from o_orderdate)*10.0 + extract(month from o_orderdate) + 5 y1, case when o_orderpriority = '5-LOW' then 12.0 end font_size from orders)"""


def boxes(spark, d):
    return table(spark, d, "orders").select(
        F.lit("d").alias("doc_id"), F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("box_id"),
        F.when(F.col("o_orderstatus") == "F", "label").otherwise("entry").alias("kind"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("x0"), (F.year("o_orderdate") * 10.0).alias("y0"),
        (F.floor(F.col("o_totalprice") / 1000).cast("double") + 60).alias("x1"), (F.year("o_orderdate") * 10.0 + F.month("o_orderdate") + 5).alias("y1"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(12.0)).alias("font_size"))


@query("join12_box_overlaps", f"with {BOX_SQL} select a.page, a.box_id a_box_id, a.kind a_kind, b.box_id b_box_id, b.kind b_kind from bx a join bx b on a.page = b.page and a.box_id < b.box_id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1")
def join12(spark, d):
    return ly.box_overlaps(boxes(spark, d)).drop("doc_id")


@query("join12_short_entries", f"with {BOX_SQL} select box_id, (y1-y0)::double height, coalesce(font_size,14)::double font_size from bx where kind = 'entry' and y1-y0 < coalesce(font_size,14)")
def join12_short(spark, d):
    return ly.short_entries(boxes(spark, d)).select("box_id", "height", "font_size")


@query("win4_row_boundaries", """with l as (select distinct l_orderkey page, round(l_extendedprice/1000,1) y from lineitem where l_quantity*20 > 600*0.5),
b as (select page, y row_top, lead(y) over (partition by page order by y) row_bottom from l) select page, row_top, row_bottom, round(row_bottom-row_top,1) row_height from b where row_bottom is not null""")
def win4(spark, d):
    l = table(spark, d, "lineitem").select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page"), F.lit(600.0).alias("page_width"), (F.col("l_extendedprice") / 1000).alias("y"),
                                           F.lit(0.0).alias("x0"), (F.col("l_quantity") * 20).alias("x1"))
    return ly.row_boundaries(l).drop("doc_id")


@query("win4_checkboxes", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_quantity between 5 and 15 and l_linenumber*3 between 5 and 15 and abs(l_quantity - l_linenumber*3) < 2")
def win4_boxes(spark, d):
    z = F.lit(0.0)
    return table(spark, d, "lineitem").filter(ly.is_checkbox(z, z, F.col("l_quantity"), F.col("l_linenumber") * 3.0)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("win12_reading_order", "select o_orderkey item_id, row_number() over (partition by o_orderstatus order by extract(year from o_orderdate), -floor(o_totalprice/1000), o_custkey, o_orderkey) pos from orders")
def win12(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("doc_id"), F.year("o_orderdate").alias("page"), F.floor(F.col("o_totalprice") / 1000).alias("y"), F.col("o_custkey").alias("x"), F.col("o_orderkey").alias("item_id"))
    return ly.reading_order(o).select("item_id", "pos")


CELL = "case o_orderpriority when '1-URGENT' then 'x #REF! #VALUE!' when '2-HIGH' then '=SUM(A1)' when '3-MEDIUM' then '#N/A' when '4-NOT SPECIFIED' then 'ok' else case when o_orderstatus = 'F' then '=#DIV/0!' end end"
CELL_SQL = f"ce as (select o_orderstatus workbook, 'S' || extract(year from o_orderdate) sheet, 'A' || o_orderkey coord, o_orderkey ord, {CELL} v from orders), er as (select *, case when contains(v,'#VALUE!') then '#VALUE!' when contains(v,'#DIV/0!') then '#DIV/0!' when contains(v,'#REF!') then '#REF!' when contains(v,'#N/A') then '#N/A' end error from ce)"


def cells(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("workbook"), F.concat(F.lit("S"), F.year("o_orderdate")).alias("sheet"), F.concat(F.lit("A"), "o_orderkey").alias("coord"),
                                            F.col("o_orderkey").alias("ord"), F.expr(CELL).alias("value"))


@query("agg20_error_counts", f"with {CELL_SQL} select workbook, error, count(*) \"count\" from er where error is not null group by 1, 2")
def agg20_counts(spark, d):
    return ly.cell_report(cells(spark, d))[0]


@query("agg20_error_locations", f"with {CELL_SQL} select workbook, error, n, sheet || '!' || coord as \"location\" from (select *, row_number() over (partition by workbook, error order by ord)::int n from er where error is not null) where n <= 20")
def agg20_locations(spark, d):
    return ly.cell_report(cells(spark, d))[1]


@query("agg20_workbooks", f"with {CELL_SQL} select workbook, count(*) filter (v like '=%') total_formulas, count(error) total_errors, case when count(error) = 0 then 'success' else 'errors_found' end status from er group by 1")
def agg20_books(spark, d):
    return ly.cell_report(cells(spark, d))[2]


@query("agg21_duplicate_ids", """with i as (select o_orderstatus file, o_orderpriority tag, o_custkey::varchar id_value, o_orderkey line, case when o_orderpriority < '3' then 'global' else 'file' end as scope from orders),
f as (select *, first_value({'file': file, 'line': line}) over w fst, row_number() over w rn from i window w as (partition by scope, case when scope = 'global' then '' else file end, case when scope = 'global' then '' else tag end, id_value order by file, line))
select scope, file, tag, id_value, line, fst.file first_file, fst.line first_line from f where rn > 1""")
def agg21(spark, d):
    i = table(spark, d, "orders").select(F.lit("p").alias("package"), F.col("o_orderstatus").alias("file"), F.col("o_orderpriority").alias("tag"), F.lit("id").alias("attr"), F.col("o_custkey").cast("string").alias("id_value"),
                                         F.col("o_orderkey").alias("line"), F.when(F.col("o_orderpriority") < "3", "global").otherwise("file").alias("scope"))
    return ly.duplicate_ids(i).drop("package", "attr")


@query("agg22_new_author", """with m as (select c_nationkey package, c_mktsegment author, count(*) n from customer group by 1, 2), o as (select s_nationkey package, 'BUILDING' author, count(*) n from supplier group by 1),
g as (select m.package, m.author, m.n - coalesce(o.n,0) added from m left join o using(package, author)), h as (select package, count(*) filter (added > 0) candidates, min(author) filter (added > 0) a from g group by 1)
select package, candidates, case candidates when 0 then 'nobody' when 1 then a end author, case when candidates > 1 then 'ambiguous' else 'ok' end status from h""")
def agg22(spark, d):
    m = table(spark, d, "customer").select(F.col("c_nationkey").alias("package"), F.col("c_mktsegment").alias("author"))
    o = table(spark, d, "supplier").select(F.col("s_nationkey").alias("package"), F.lit("BUILDING").alias("author"))
    return ly.inferred_author(m, o, "nobody")


def files_refs(spark, d):
    f = table(spark, d, "part").select(F.lit("p").alias("package"), F.concat(F.lit("f/"), "p_partkey").alias("path"))
    target = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("http://x/"), "l_partkey")).otherwise(F.concat(F.lit("f/"), F.col("l_partkey") * F.col("l_linenumber")))
    r = table(spark, d, "lineitem").select(F.lit("p").alias("package"), F.concat(F.lit("o/"), "l_orderkey").alias("source_path"), target.alias("target_path"))
    return f, r


REF_SQL = "re as (select 'o/' || l_orderkey source_path, 'f/' || l_partkey*l_linenumber target_path from lineitem where l_returnflag <> 'A'), fi as (select 'f/' || p_partkey path from part)"


@query("join16_dangling_refs", f"with {REF_SQL} select source_path, target_path, count(*) refs from re where target_path not in (select path from fi) group by 1, 2")
def join16(spark, d):
    return ly.reference_audit(*files_refs(spark, d))[0].groupBy("source_path", "target_path").agg(F.count("*").alias("refs"))


@query("set5_unreferenced_files", f"with {REF_SQL} select path from fi where path not in (select target_path from re)")
def set5(spark, d):
    return ly.reference_audit(*files_refs(spark, d))[1].select("path")


@query("join17_cleanup", """with recursive used as (select distinct l_partkey - l_partkey % 4 p from lineitem),
f as (select p_partkey p from part where p_size < 45 and p_partkey not in (select p from used)),
gone as (select p, 1 as "round" from f where p % 2 = 0 or (p - 1) // 2 not in (select p_partkey from part)
 union all select f.p, gone."round" + 1 from gone join f on f.p = 2 * gone.p + 1)
select 'p' package, p::varchar path, "round"::int as "round" from gone""")
def join17(spark, d):
    """Parts refer to the part twice their number plus one, line items to the fourth below theirs; unreferenced parts go, round by round."""
    p = table(spark, d, "part")
    f = p.select(F.lit("p").alias("package"), F.col("p_partkey").cast("string").alias("path"), (F.col("p_size") < 45).alias("removable"))
    r = p.select(F.lit("p").alias("package"), F.col("p_partkey").cast("string").alias("source_path"), (F.col("p_partkey") * 2 + 1).cast("string").alias("target_path"))
    used = table(spark, d, "lineitem").select(F.lit("p").alias("package"), F.concat(F.lit("o"), "l_orderkey").alias("source_path"), (F.col("l_partkey") - F.col("l_partkey") % 4).cast("string").alias("target_path"))
    return ly.remove_unreferenced(f, r.unionByName(used))


@query("join18_field_values", """select l_orderkey, l_linenumber, l_suppkey, l_partkey, case when p_partkey is null then 'unknown_field' when l_linenumber < 3 and l_linenumber <> p_partkey % 3 then 'wrong_page' when l_linenumber >= 3 and p_type = 'PROMO' then ''
 when l_linenumber >= 3 and p_size > 40 then '' when l_returnflag <> case when p_size > 20 then 'A' else 'N' end and l_returnflag <> 'R' and not (p_type = 'PROMO' or p_size > 40) then 'bad_value' else '' end problem
 from lineitem left join (select *, p_partkey + 5 fk from part) on fk = l_partkey""")
def join18(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_partkey").alias("field_id"), F.when(F.col("l_linenumber") < 3, F.col("l_linenumber")).alias("_pg"), F.col("l_returnflag").alias("value"))
    k = table(spark, d, "part").select((F.col("p_partkey") + 5).alias("field_id"), (F.col("p_partkey") % 3).alias("page"),
                                       F.when(~((F.col("p_type") == "PROMO") | (F.col("p_size") > 40)), F.array(F.when(F.col("p_size") > 20, "A").otherwise("N"), F.lit("R"))).alias("allowed"))
    s = s.withColumn("page", F.col("_pg"))
    # A line without a page of its own is on the field's page.
    s = s.join(k.select("field_id", F.col("page").alias("_kp")), "field_id", "left").withColumn("page", F.coalesce("page", "_kp")).drop("_kp", "_pg")
    return ly.check_values(s, k).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "problem")


@query("win9_near_duplicates", """with recursive o as (select label, vec_id, embedding::float[] v, row_number() over (partition by label order by vec_id) rn from embeddings),
r as (select label, rn, vec_id, v lastv, true kept from o where rn = 1 union all
 select o.label, o.rn, o.vec_id, case when 1 - list_avg(list_transform(list_zip(r.lastv, o.v), lambda z: abs(z[1]-z[2])::double))/1.0 < 0.88 then o.v else r.lastv end, 1 - list_avg(list_transform(list_zip(r.lastv, o.v), lambda z: abs(z[1]-z[2])::double))/1.0 < 0.88
 from r join o on o.label = r.label and o.rn = r.rn + 1) select label, vec_id from r where kept""")
def win9(spark, d):
    v = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("vector"))
    return ly.drop_near_duplicates(v, "label", "vec_id", threshold=0.88, value_range=1.0, bucket=F.floor(F.col("vec_id") / 50)).select("label", "vec_id")


RUN_SQL = "rn as (select conv_id container, turn pos, case when length(text) > 300 then 'b' end fmt, case when role = 'system' then 'user' else role end author, text from conversations)"


@query("win11_merge_runs", f"""with {RUN_SQL}, f as (select *, case when fmt is not distinct from lag(fmt) over w and lag(pos) over w is not null then 0 else 1 end nw from rn window w as (partition by container order by pos)),
i as (select *, sum(nw) over (partition by container order by pos)::bigint island from f) select container, island, min(pos) pos, count(*) merged, coalesce(any_value(fmt),'-') fmt, md5(string_agg(text, '' order by pos)) text_md5 from i group by 1, 2""")
def win11(spark, d):
    r = table(spark, d, "conversations").select(F.col("conv_id").alias("container"), F.col("turn").alias("pos"), F.when(F.length("text") > 300, "b").alias("fmt"), "text")
    m = sp.merge_runs(r, ["container"], "pos", ["fmt"])
    return m.select("container", "island", "pos", "merged", F.coalesce("fmt", F.lit("-")).alias("fmt"), F.md5("text").alias("text_md5"))


@query("win11_merge_changes", f"""with {RUN_SQL}, f as (select *, case when author is not distinct from lag(author) over w and lag(pos) over w is not null then 0 else 1 end nw from rn window w as (partition by container order by pos)),
i as (select *, sum(nw) over (partition by container order by pos)::bigint island from f) select container, island, any_value(author) author, count(*) merged, md5(string_agg(text, '' order by pos)) text_md5 from i group by 1, 2""")
def win11_changes(spark, d):
    r = table(spark, d, "conversations").select(F.col("conv_id").alias("container"), F.col("turn").alias("pos"), F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("author"), "text")
    m = sp.merge_runs(r, ["container"], "pos", ["author"], width=3)
    return m.select("container", "island", "author", "merged", F.md5("text").alias("text_md5"))
