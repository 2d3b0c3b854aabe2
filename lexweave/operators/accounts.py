"""Accounts: login matching, registration checks, tenant back-fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import strip_blank
from lexweave.scale import first_wins


def login_match(logins: DataFrame, users: DataFrame) -> DataFrame:
    """logins(login) -> the user whose username or email it is; the least id of several.

    Two equi joins and a minimum: an OR condition would be a nested loop.
    """
    u = F.struct(*users.columns)
    by = lambda c: logins.join(users.select(F.col(c).alias("login"), u.alias("u")), "login")
    hit = by("username").unionByName(by("email")).groupBy("login").agg(F.min_by("u", "u.id").alias("u"))
    return logins.join(hit, "login", "left").select("login", "u.*")


def with_tenant(users: DataFrame, tenants: DataFrame) -> DataFrame:
    """Left lookup: users without a tenant keep a null name."""
    t = tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant_name"))
    return users.join(t, "tenant_id", "left")


def registration_problem(username: Column, email: Column, password: Column) -> Column:
    """First reason against a registration, '' if there is none. Checked on the trimmed name."""
    name = strip_blank(username)
    return (F.when(F.length(name) < 3, F.lit("用户名至少需要3个字符"))
            .when(~name.rlike(r"^[\p{L}\p{N}_]+$") | ~name.rlike(r"[^_]"), F.lit("用户名只能包含字母、数字和下划线"))
            .when(F.length(password) < 6, F.lit("密码至少需要6个字符")).otherwise(F.lit("")))


def normalize_email(email: Column) -> Column:
    return F.lower(strip_blank(email))


def admit_registrations(new: DataFrame, users: DataFrame) -> DataFrame:
    """new(seq, username, email) without names or emails that exist already or come earlier in the batch.

    A row that loses its name or its email does not reserve the other one, so the batch is settled in
    rounds: per round every row that is first for both is admitted and blocks its rivals.
    """
    rest = (new.join(users.select("username").distinct(), "username", "left_anti")
            .join(users.select("email").distinct(), "email", "left_anti").select(*new.columns))
    from lexweave.scale import cut
    admitted = None
    rest = cut(rest)
    while True:
        names = first_wins(rest.select("username", "seq"), ["username"], ["seq"])
        mails = first_wins(rest.select("email", "seq"), ["email"], ["seq"])
        won = cut(rest.join(names, ["username", "seq"], "left_semi").join(mails, ["email", "seq"], "left_semi").select(*new.columns))
        admitted = won if admitted is None else admitted.unionByName(won)
        rest = cut(rest.join(won.select("username"), "username", "left_anti").join(won.select("email"), "email", "left_anti").select(*new.columns))
        if rest.isEmpty():
            return admitted


def backfill_tenant(keys: DataFrame, tenants: DataFrame) -> DataFrame:
    """Fill tenant_uuid from the tenant, only where it is missing."""
    t = tenants.select(F.col("id").alias("tenant_id"), F.col("uuid").alias("_u"))
    return keys.join(t, "tenant_id", "left").withColumn("tenant_uuid", F.coalesce("tenant_uuid", "_u")).drop("_u")
