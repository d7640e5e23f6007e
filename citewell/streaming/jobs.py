"""Streaming jobs: ingest with dead letters, metering, rate limits, retries, sessions, audit, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from citewell.functions import text
from citewell.operators import audit as ledger
from citewell.operators import usage
from citewell.operators.ingest import merge_versions
from citewell.schemas import STORED_VERSIONS
from citewell.sources import messages, stores, tables
from citewell.streaming import state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on disk with changelog checkpoints; arbitrary state needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def versions_table(spark: SparkSession, root: str, parts: int = 64) -> stores.KeyedTable:
    """Where ``ingest`` keeps document versions, by the hash of their URL."""
    return stores.KeyedTable(spark, f"{root}/versions", "source_url", STORED_VERSIONS, parts)


def ingest(stream: DataFrame, root: str, checkpoint: str, parts: int = 64, **trigger) -> StreamingQuery:
    """Parse, clean and version messages; unusable ones go to dead letters.

    Each micro-batch merges into the parts of the versions table that hold its URLs and leaves all others alone.
    Running a batch again after a failure starts from the table below its number and gives the same tables.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        good = batch.where(F.col("parse_error").isNull())
        observed = good.select(
            "source_url", F.coalesce("published_at", F.current_timestamp()).alias("fetched_at"), text.clean_html(F.col("raw_content")).alias("cleaned_text")
        ).withColumn("content_hash", text.content_hash(F.col("cleaned_text")))
        versions_table(spark, root, parts).update(number, tables.cut(observed, "observed"), lambda stored, new: merge_versions(stored, new)[0])
        bad = messages.dead_letters(batch.where(F.col("parse_error").isNotNull()), F.current_timestamp())
        tables.write_snapshot(bad, f"{root}/dead_letters", number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _keyed(rows: DataFrame, keys: list[str], processor, mode: str) -> DataFrame:
    return rows.groupBy(*keys).transformWithState(processor, processor.output, "Append", mode)


def versions(observations: DataFrame) -> DataFrame:
    """Version flags per observation ``(source_url, fetched_at, content_hash)`` from per-URL state."""
    rows = observations.select("source_url", "content_hash", F.unix_micros("fetched_at").alias("micros"))
    flags = _keyed(rows, ["source_url"], state.Versions(), "None")
    return flags.withColumn("fetched_at", F.timestamp_micros("micros")).drop("micros")


def metering_keys(spark: SparkSession, root: str) -> stores.KeySet:
    """The keys of what ``metering`` has stored."""
    return stores.KeySet(spark, f"{root}-keys")


def metering(stream: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store billable requests once per key for ever, however late a copy comes.

    Each micro-batch appends the keys that no earlier batch has. Its keys ask the filters of a key set beside the stored
    rows, and only the parts of it that may hold one are read. A batch that runs again after a failure replaces its own
    folder and its own keys.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = usage.append_metering(metering_keys(spark, root), number, batch)
        fresh.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()


LEVELS = T.StructType([
    T.StructField("bucket", T.StringType()), T.StructField("tenant_id", T.StringType()), T.StructField("endpoint", T.StringType()),
    T.StructField("level", T.DoubleType()), T.StructField("at", T.DoubleType()),
])


def rate_limits(stream: DataFrame, root: str, checkpoint: str, parts: int = 16, segment_seconds: int | None = None, **trigger) -> StreamingQuery:
    """Token buckets over a stream of requests; answers go to ``root/answers``, one folder per micro-batch.

    A micro-batch is limited like a table: a busy key is cut where its bucket is full, and no task holds a key's
    requests. Only each bucket's level at its last request is kept between batches, in parts of which a batch
    rewrites those of its own keys. A batch that runs again replaces its answers and levels.
    """

    def limit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        levels = stores.KeyedTable(spark, f"{root}/levels", "bucket", LEVELS, parts)
        asked = tables.cut(batch.withColumn("bucket", F.to_json(F.struct(*usage.BUCKET_KEY))), "asked")
        before = levels.read(number, levels.touched(asked))
        granted = tables.cut(usage.continued_bucket(asked, before, segment_seconds), "granted")
        granted.drop("level", "at").write.mode("overwrite").parquet(f"{root}/answers/batch={number}")

        def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
            now = usage.bucket_levels(granted).withColumn("bucket", F.to_json(F.struct(*usage.BUCKET_KEY)))
            return stored.join(now.select("bucket"), "bucket", "left_anti").unionByName(now)

        levels.update(number, asked, merge)

    return stream.writeStream.foreachBatch(limit).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def retries(attempts: DataFrame, delay: str = "1 hour") -> DataFrame:
    rows = attempts.withColumn("micros", F.unix_micros("attempt_at")).withWatermark("attempt_at", delay)
    routed = _keyed(rows, ["key"], state.RetryCounter(), "EventTime")
    return routed.withColumn("routed_at", F.timestamp_micros("micros")).drop("micros")


def session_memory(additions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Memory after each batch of ``(session_id, ts, pos, document_id, created_at, retention_days)``."""
    rows = additions.withColumn("micros", F.unix_micros("ts")).withColumn("created_micros", F.unix_micros("created_at"))
    return _keyed(rows.withWatermark("ts", delay), ["session_id"], state.SessionMemory(), "EventTime")


def order_guard(events: DataFrame) -> DataFrame:
    """Flags per event ``(job_id, event_id, arrival)``."""
    return _keyed(events, ["job_id"], state.OrderGuard(), "None")


def audit(stream: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append valid audit rows and put the others aside, one folder per batch."""

    def write(batch: DataFrame, number: int) -> None:
        good, bad = ledger.validate_audit(batch)
        tables.write_snapshot(good, f"{root}/ledger", number)
        tables.write_snapshot(bad, f"{root}/rejected", number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def sliding_ratio(
    requests: DataFrame, by: list[str], part: Column, width: str, slide: str = "30 seconds", delay: str = "1 minute"
) -> DataFrame:
    """Share of requests meeting ``part`` over sliding windows.

    Requests are first counted per slide-wide pane, and windows are added up from panes, so a six-hour
    window every 30 seconds multiplies panes and not requests.
    """
    counted = (
        requests.withWatermark("ts", delay)
        .groupBy(*by, F.window("ts", slide).alias("pane"))
        .agg(F.count("*").alias("requests"), F.count_if(part).alias("part"))
    )
    windows = counted.groupBy(*by, F.window(F.window_time("pane"), width, slide).alias("w")).agg(
        F.sum("requests").alias("requests"), F.sum("part").alias("part")
    )
    return windows.select(
        *by, F.col("w.end").alias("evaluated_at"), "requests", "part", (F.col("part") / F.col("requests")).alias("ratio")
    )


# Windows, thresholds and holding times of the alert rules, evaluated every 30 seconds.
BURN_RULES = (
    state.AlertRule("availability_low", 3600, 0.001, 300),
    state.AlertRule("error_budget_fast", 3600, 0.0144, 300),
    state.AlertRule("error_budget_slow", 21600, 0.006, 1800),
)
REJECTION_RULES = (state.AlertRule("rate_limit_saturation", 300, 0.1, 300),)
DEAD_LETTER_RULES = (state.AlertRule("dead_letter_growth", 900, 1.0, 900, per_second=True),)


def alerts(
    log: DataFrame, key: Column, part: Column, rules: tuple[state.AlertRule, ...], step_seconds: int = 30, delay: str = "1 minute"
) -> DataFrame:
    """Every rule at every step, for each key that has rows in the rule's window.

    Rows are counted per key and pane of one step, partly in every task, so that a busy key travels as panes. The panes
    of a key feed all rules at once. ``total`` and ``part`` are the sums of the window that ends at ``evaluated_at``;
    ``over`` tells whether the rule holds, ``firing`` whether it has held long enough.
    """
    counted = (
        log.withWatermark("ts", delay)
        .groupBy(key.alias("key"), F.window("ts", f"{step_seconds} seconds").alias("pane"))
        .agg(F.count("*").alias("total"), F.count_if(part).alias("part"))
    )
    panes = counted.select("key", F.window_time("pane").alias("at"), F.unix_micros("pane.end").alias("tick"), "total", "part")
    found = _keyed(panes, ["key"], state.Alerts(rules, step_seconds), "EventTime")
    return found.withColumn("evaluated_at", F.timestamp_micros("micros")).drop("micros")
