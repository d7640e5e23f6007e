"""Ingest messages as JSON, from and to Kafka or files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.schemas import INGEST_MESSAGE

INGEST_TOPIC = "document-ingest"
DEAD_LETTER_TOPIC = "document-ingest-dlq"
REQUIRED = ["raw_content", "source_url", "request_id"]


def ingest_messages(pages: DataFrame, published_at: Column) -> DataFrame:
    """Message rows of pages. The message id is a hash of its content, so a retry repeats it."""
    tenant = F.col("tenant_id") if "tenant_id" in pages.columns else F.lit("")
    request = F.col("request_id") if "request_id" in pages.columns else F.concat(
        F.lit("ingest-"), F.substring(F.sha2("url", 256), 1, 24)
    )
    return pages.select(
        F.substring(F.sha2(F.concat_ws("|", F.col("url"), request, F.sha2("html", 256)), 256), 1, 32).alias("message_id"),
        F.col("url").alias("source_url"),
        F.col("html").alias("raw_content"),
        F.coalesce(tenant, F.lit("")).alias("tenant_id"),
        request.alias("request_id"),
        published_at.alias("published_at"),
    )


def to_json_value(messages: DataFrame) -> DataFrame:
    """Key and JSON value columns, as a topic takes them."""
    return messages.select(F.col("source_url").alias("key"), F.to_json(F.struct(*messages.columns)).alias("value"))


def from_json_value(values: DataFrame, column: str = "value") -> DataFrame:
    """Parsed messages next to their raw text, with ``parse_error`` set where a required field is missing."""
    raw = F.col(column).cast("string")
    parsed = values.select(raw.alias("raw"), F.from_json(raw, INGEST_MESSAGE).alias("_m"))
    missing = F.array_compact(F.array(*[F.when(F.col(f"_m.{f}").isNull(), F.lit(f)) for f in REQUIRED]))
    error = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    return parsed.select("raw", "_m.*", error.alias("parse_error"))


def read_topic(spark: SparkSession, servers: str, topic: str = INGEST_TOPIC, per_trigger: int = 100_000) -> DataFrame:
    """Ingest stream from the earliest offset; needs the Kafka connector on the class path."""
    stream = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", per_trigger)
    )
    return from_json_value(stream.load())


def read_files(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """Ingest stream of files with one JSON message per line."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return from_json_value(lines)


def publish(messages: DataFrame, servers: str, topic: str = INGEST_TOPIC) -> None:
    to_json_value(messages).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def publish_files(messages: DataFrame, path: str) -> None:
    to_json_value(messages).select("value").write.mode("append").text(path)


def dead_letters(bad: DataFrame, failed_at: Column) -> DataFrame:
    """The original message with error and time of failure."""
    return bad.select("raw", F.col("parse_error").alias("error"), failed_at.alias("failed_at"))
