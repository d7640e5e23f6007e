"""The registered queries, each next to the SQL that checks it."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from citewell.plans.catalog import QUERIES, SQL

SECTIONS = [
    "ingest_queries", "source_queries", "filter_queries", "text_queries", "search_queries", "step_queries",
    "answer_queries", "crawl_queries", "usage_queries", "research_queries", "audit_queries", "stream_queries",
    "function_queries",
]


def _load() -> None:
    for section in SECTIONS:
        importlib.import_module(f"citewell.plans.{section}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    from citewell.plans.search_queries import page_search

    return page_search(spark, folder)
