"""Research sessions: expiry and bounded memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.operators.ordered import top_n

MAX_CITATIONS = 50
MAX_DOCUMENTS = 20
DEFAULT_RETENTION = 14


def with_expiry(sessions: DataFrame) -> DataFrame:
    """Add ``expires_at``: creation plus 1 to 90 days of retention, 14 unless given."""
    days = F.coalesce(F.col("retention_days"), F.lit(DEFAULT_RETENTION)).cast("int")
    return sessions.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(days=days))


def invalid_retention(sessions: DataFrame) -> DataFrame:
    return sessions.where(~F.col("retention_days").between(1, 90))


def is_expired(now: Column) -> Column:
    return F.col("state").isin("expired", "deleted") | (now >= F.col("expires_at"))


def active_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Usable sessions; one past its time is not, swept or not."""
    return with_expiry(sessions).where(~is_expired(now))


def expire_sessions(
    sessions: DataFrame, memory: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sweep: sessions with new states, memory rows that stay, and one audit row per expired session."""
    dated = with_expiry(sessions)
    due = (F.col("state") == "active") & (now >= F.col("expires_at"))
    swept = dated.where(due)
    after = dated.withColumn("state", F.when(due, "expired").otherwise(F.col("state")))
    kept = memory.join(swept.select("session_id"), "session_id", "left_anti")
    audit = swept.select(
        F.lit("session_expired").alias("action"),
        F.col("session_id").alias("resource"),
        "tenant_id",
        now.alias("timestamp_utc"),
        F.to_json(F.struct("session_id", "tenant_id", now.alias("deletion_timestamp"))).alias("detail"),
    )
    return after, kept, audit


def recent_citations(citations: DataFrame, n: int = MAX_CITATIONS) -> DataFrame:
    """Latest n citations of each session by ``pos``."""
    return top_n(citations, ["session_id"], [F.desc("pos")], n, "recency")


def recent_documents(additions: DataFrame, n: int = MAX_DOCUMENTS) -> DataFrame:
    """Latest n distinct documents of each session; adding one again makes it the latest."""
    last = additions.groupBy("session_id", "document_id").agg(F.max("pos").alias("pos"))
    return top_n(last, ["session_id"], [F.desc("pos")], n, "recency")


def session_context(citations: DataFrame, additions: DataFrame) -> DataFrame:
    """Memory of each session as two arrays, oldest first. Both are cut before they are collected."""
    fields = ["document_id", "version", "answer_start", "answer_end", "source_start", "source_end"]
    cited = recent_citations(citations).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("_c")
    )
    used = recent_documents(additions).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "document_id"))).alias("_d")
    )
    both = cited.join(used, "session_id", "full_outer")
    empty_c = F.array().cast(cited.schema["_c"].dataType)
    return both.select(
        "session_id",
        F.transform(F.coalesce("_c", empty_c), lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias("citations"),
        F.transform(F.coalesce("_d", F.array().cast(used.schema["_d"].dataType)), lambda d: d["document_id"]).alias("doc_ids"),
    )
