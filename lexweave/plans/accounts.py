"""Account queries: nations are tenants, customers users, orders and suppliers what refers to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import accounts as ac
from lexweave.plans.registry import query, table


def users(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.concat(F.lower("c_mktsegment"), F.lit("@"), "c_custkey").alias("email"),
        F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).alias("tenant_id"))


USERS_SQL = "us as (select c_custkey id, c_name username, lower(c_mktsegment) || '@' || c_custkey email, case when c_nationkey < 20 then c_nationkey end tenant_id from customer)"


@query("join3_user_tenant", f"with {USERS_SQL} select id, username, coalesce(n_name, '-') tenant_name from us left join nation on n_nationkey = tenant_id")
def join3(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return ac.with_tenant(users(spark, d), t).select("id", "username", F.coalesce("tenant_name", F.lit("-")).alias("tenant_name"))


LOGIN = "case when o_orderstatus = 'F' then 'building@' || o_custkey else 'Customer#' || lpad(o_custkey::varchar, 9, '0') end"


@query("join4_login_match", f"with {USERS_SQL}, lo as (select distinct {LOGIN} login from orders) select login, coalesce(min(id), -1) id from lo left join us on login = username or login = email group by 1")
def join4(spark, d):
    logins = table(spark, d, "orders").select(F.expr("case when o_orderstatus = 'F' then concat('building@', o_custkey) else concat('Customer#', lpad(cast(o_custkey as string), 9, '0')) end").alias("login")).distinct()
    return ac.login_match(logins, users(spark, d)).select("login", F.coalesce("id", F.lit(-1)).alias("id"))


@query("join5_admit_registrations", """with recursive n as (
  select o_orderkey seq, case when o_orderstatus = 'F' then 'Customer#' || lpad(o_custkey::varchar, 9, '0') else 'u' || o_custkey end username, 'm' || floor(o_totalprice / 100)::bigint || '@x' email from orders),
s as (
  select *, false won from n where username not in (select c_name from customer) and email not in (select lower(c_mktsegment) || '@' || c_custkey from customer)
  union all
  select seq, username, email, w from (
    select *, bool_or(w) over (partition by username) or bool_or(w) over (partition by email) taken from (
      select seq, username, email, seq = min(seq) over (partition by username) and seq = min(seq) over (partition by email) w from s where not won))
  where w or not taken)
select seq, username, email from s where won""")
def join5(spark, d):
    """Orders as registrations: status F takes a known customer name, the rest repeat names and emails."""
    new = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).otherwise(F.concat(F.lit("u"), "o_custkey")).alias("username"),
        F.concat(F.lit("m"), F.floor(F.col("o_totalprice") / 100), F.lit("@x")).alias("email"))
    return ac.admit_registrations(new, users(spark, d))


@query("join5_known_accounts", """select o_orderkey seq from orders where 'Customer#' || lpad((o_custkey*2)::varchar, 9, '0') not in (select c_name from customer) and 'building@' || o_custkey not in (select lower(c_mktsegment) || '@' || c_custkey from customer)""")
def join5_known(spark, d):
    """The two anti joins alone; every name and email of the batch is new to the batch."""
    new = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("username"),
                                           F.concat(F.lit("building@"), "o_custkey").alias("email"))
    u = users(spark, d)
    return new.join(u.select("username"), "username", "left_anti").join(u.select("email"), "email", "left_anti").select("seq")


@query("join6_backfill", "select s_suppkey id, s_nationkey tenant_id, coalesce(case when s_acctbal > 5000 then 'own-' || s_suppkey end, md5(n_name)) tenant_uuid from supplier left join nation on n_nationkey = s_nationkey")
def join6(spark, d):
    keys = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("tenant_id"), F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("own-"), "s_suppkey")).alias("tenant_uuid"))
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.md5("n_name").alias("uuid"))
    return ac.backfill_tenant(keys, t).select("id", "tenant_id", "tenant_uuid")


NAME = "case c_mktsegment when 'BUILDING' then ' ab ' when 'MACHINERY' then replace(c_name,'#','_') when 'HOUSEHOLD' then '____' when 'AUTOMOBILE' then c_name else 'Zoë_' || c_custkey end"


@query("flt11_registration_checks", f"""with r as (select c_custkey, trim({NAME}) u, ' Mail' || c_custkey || '@X.Org ' e, case when c_acctbal < 1000 then '12345' else c_acctbal::varchar || 'xxxxx' end p from customer)
select c_custkey, lower(trim(e)) email, case when length(u) < 3 then '用户名至少需要3个字符' when not regexp_full_match(u, '[\\p{{L}}\\p{{N}}_]+') or regexp_full_match(u, '_+') then '用户名只能包含字母、数字和下划线' when length(p) < 6 then '密码至少需要6个字符' else '' end problem from r""")
def flt11(spark, d):
    c = table(spark, d, "customer")
    email = F.concat(F.lit(" Mail"), "c_custkey", F.lit("@X.Org "))
    pw = F.when(F.col("c_acctbal") < 1000, F.lit("12345")).otherwise(F.concat(F.col("c_acctbal").cast("string"), F.lit("xxxxx")))
    return c.select("c_custkey", ac.normalize_email(email).alias("email"), ac.registration_problem(F.expr(NAME), email, pw).alias("problem"))


@query("src10_account_tables", "select n_nationkey id, 'uuid-' || n_nationkey uuid, n_name as \"name\", count(c_custkey) users from nation left join customer on c_nationkey = n_nationkey group by 1, 2, 3")
def src10(spark, d):
    """Tenants and users written and read back with their fixed schemas."""
    from lexweave import schemas
    from lexweave.scale import scratch_path
    from lexweave.sources.readers import read_table
    root = scratch_path(spark, "accounts")
    def put(df, name):
        fields = schemas.struct(schemas.ACCOUNT_TABLES[name]).fields
        df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).write.parquet(f"{root}/{name}")
    put(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("uuid-"), "n_nationkey").alias("uuid"), F.col("n_name").alias("name")), "tenants")
    put(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_nationkey").alias("tenant_id")), "users")
    n = read_table(spark, root, "users").groupBy(F.col("tenant_id").alias("id")).agg(F.count("*").alias("users"))
    return read_table(spark, root, "tenants").select("id", "uuid", "name").join(n, "id", "left").withColumn("users", F.coalesce("users", F.lit(0)))
