"""Schemas of the tables, for readers and streams that must not infer."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _schema(fields: str, **nested: T.DataType) -> T.StructType:
    """Schema of "name type, name type"; needs no running session, unlike a DDL string."""
    pairs = [field.split() for field in fields.split(", ")]
    return T.StructType([T.StructField(name, nested.get(kind) or _TYPES[kind]) for name, kind in pairs])


INGEST_MESSAGE = _schema(
    "message_id string, source_url string, raw_content string, tenant_id string, request_id string, published_at timestamp"
)
PROVENANCE = _schema("credibility_score double, ai_generated_likelihood double, scored_at timestamp")
DOCUMENT_VERSIONS = _schema(
    "document_id string, source_url string, version bigint, content_hash string, cleaned_text string, "
    "created_at timestamp, last_seen_at timestamp, provenance scores, visible boolean",
    scores=PROVENANCE,
)
STORED_VERSIONS = T.StructType([f for f in DOCUMENT_VERSIONS if f.name not in ("provenance", "visible")])
