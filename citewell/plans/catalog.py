"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# Columns that the SQL engine types as INTEGER; like Spark's they are widened.
NARROW = {
    "S8_object_keys": ["version"], "S13_metering_sink": ["stored"], "flagship_page_search": ["version"],
    "R4_hybrid_by_version": ["version"], "R9_candidate_lookup": ["version"], "join_left_outer": ["quality"],
    "P8_first_highlight": ["matched"], "A1_contents": ["position", "version"], "A2_highlights": ["place"],
    "A10_detect_citations": ["version"], "C5_robots_as_of": ["pass"], "C7_effective_delay": ["in_flight"], "join_interval": ["pass"],
    "M1_billable": ["response_status"], "M2_dedup_metering": ["tokens"], "G4_request_counts": ["response_status"],
    "G6_latency_histogram": ["bucket"], "G12_distinct": ["k"], "ST1_ingest_stream": ["version"], "fn_math": ["l_linenumber"],
    "fn_map_json": ["k"], "J5_read_citations": ["answer_start", "answer_end", "source_start", "source_end"],
}


def _wide_integers(df: DataFrame) -> DataFrame:
    """Whole numbers leave the queries as bigint, whatever width an expression gave them."""
    narrow = {f.name for f in df.schema if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType))}
    if not narrow:
        return df
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in narrow else F.col(c) for c in df.columns])


def query(name: str, sql: str | None = None):
    """Register a ``(spark, folder) -> DataFrame`` function, with equivalent SQL where there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _wide_integers(fn(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in NARROW.get(name, []))
            SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return fn

    return register
