"""Audit ledger, retention, tenant deletion and key status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_RETENTION = 365
MAX_RETENTION = 2555
COLUMNS = ["tenant_id", "actor", "action", "resource", "request_id", "ts", "detail"]


def validate_audit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to append and rows to reject: a request id has 16 to 64 characters."""
    good = F.coalesce(F.length("request_id").between(16, 64), F.lit(False))
    return rows.where(good), rows.where(~good)


def retention_split(rows: DataFrame, now: Column, days: int = MIN_RETENTION) -> tuple[DataFrame, DataFrame]:
    """Rows to keep and rows past retention."""
    if isinstance(days, bool) or not isinstance(days, int) or not MIN_RETENTION <= days <= MAX_RETENTION:
        raise ValueError(f"retention must be {MIN_RETENTION} to {MAX_RETENTION} days")
    old = F.col("ts") < now - F.make_dt_interval(days=F.lit(days))
    return rows.where(~old), rows.where(old)


def on_hold(tenants: DataFrame, now: Column) -> DataFrame:
    return tenants.where(F.col("legal_hold_until") > now).select("tenant_id")


def delete_tenants(
    tables: dict[str, DataFrame], audit: DataFrame, tenants: DataFrame, leaving: DataFrame, now: Column
) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Remove tenants from every table. Audit rows of a tenant on legal hold stay.

    Returns the remaining tables (with ``audit``), the preserved audit rows with their reason, and a
    summary of deleted and preserved counts per tenant and table.
    """
    going = leaving.select("tenant_id").distinct()
    held = on_hold(tenants, now).join(going, "tenant_id", "left_semi")
    free = going.join(held, "tenant_id", "left_anti")
    remaining = {name: t.join(going, "tenant_id", "left_anti") for name, t in tables.items()}
    remaining["audit"] = audit.join(free, "tenant_id", "left_anti")
    preserved = audit.join(held, "tenant_id", "left_semi").withColumn("reason", F.lit("retention_required"))

    def counted(rows: DataFrame, name: str, deleted: bool) -> DataFrame:
        n = rows.groupBy("tenant_id").agg(F.count("*").alias("_n"))
        none = F.lit(0).cast("long")
        return n.select(
            "tenant_id", F.lit(name).alias("table_name"),
            (F.col("_n") if deleted else none).alias("deleted"), (none if deleted else F.col("_n")).alias("preserved"),
        )

    parts = [counted(t.join(going, "tenant_id", "left_semi"), name, True) for name, t in tables.items()]
    parts.append(counted(audit.join(free, "tenant_id", "left_semi"), "audit", True))
    parts.append(counted(preserved, "audit", False))
    summary = parts[0]
    for part in parts[1:]:
        summary = summary.unionByName(part)
    return remaining, preserved, summary


def key_prefix(token: Column) -> Column:
    """Part before the first underscore if it has 8 to 12 characters."""
    before = F.substring_index(token, "_", 1)
    return F.when(token.contains("_") & F.length(before).between(8, 12), before)


def key_status(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Status of the key each request ``(request_id, authorization, key_id, ts)`` came with.

    ``key_id`` is the key whose stored hash the token matched, found where hashes are verified; a key
    only counts under its own prefix. The tenant is known as soon as the key is.
    """
    header = F.coalesce(F.col("authorization"), F.lit(""))
    bearer = F.lower(F.substring_index(header, " ", 1)) == "bearer"
    rest = F.when(header.contains(" "), F.regexp_replace(header, "(?s)^[^ ]* ", ""))
    token = F.when(bearer, F.regexp_replace(rest, r"(?U)^\s+|\s+$", ""))
    rows = requests.withColumn("_token", F.when(token != "", token)).withColumn("_prefix", key_prefix(F.col("_token")))
    stored = keys.select(
        F.col("key_id").alias("_id"), F.col("key_prefix").alias("_p"), "tenant_id", "expires_at", "revoked_at",
        F.coalesce("rotation_grace_seconds", F.lit(3600)).alias("_grace"),
    )
    joined = rows.join(stored, (F.col("key_id") == F.col("_id")) & (F.col("_prefix") == F.col("_p")), "left")
    grace_end = F.col("revoked_at") + F.make_dt_interval(secs=F.col("_grace"))
    status = (
        F.when(F.col("_token").isNull(), "missing_token")
        .when(F.col("_id").isNull(), "invalid_token")
        .when(F.col("ts") > F.col("expires_at"), "expired_token")
        .when(F.col("ts") > grace_end, "revoked_token")
        .otherwise("ok")
    )
    return joined.select("request_id", "ts", status.alias("status"), "tenant_id")


def audit_actions(
    auth: DataFrame | None = None, index_failures: DataFrame | None = None,
    sessions: DataFrame | None = None, crawl: DataFrame | None = None,
) -> DataFrame:
    """One audit table from the classes of events that are audited."""
    none = F.lit(None).cast("string")
    parts = []
    if auth is not None:
        parts.append(auth.where(F.col("status") != "ok").select(
            F.lit("auth_failure").alias("action"), F.lit("anonymous").alias("actor"), "tenant_id",
            F.col("resource"), F.to_json(F.struct(F.col("status").alias("error_code"))).alias("detail")))
    if index_failures is not None:
        parts.append(index_failures.select(
            F.lit("index_failure").alias("action"), F.lit("indexer").alias("actor"), none.alias("tenant_id"),
            F.col("source_url").alias("resource"),
            F.to_json(F.struct("source_url", "failure_reason", "attempts")).alias("detail")))
    if sessions is not None:
        parts.append(sessions.select(
            "action", F.lit("session_sweep").alias("actor"), "tenant_id", "resource", "detail"))
    if crawl is not None:
        parts.append(crawl.select("action", "actor", none.alias("tenant_id"), "resource", "detail"))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def lost_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of an append-only table that a later snapshot lacks or has changed; empty when it only grew."""
    return before.exceptAll(after)
