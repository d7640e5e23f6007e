"""Error code of each logged request, NULL when it is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.functions import urls
from citewell.functions.text import strip

MODES = ["neural", "keyword", "hybrid"]
QUERY_MAX = 2048
URL_MAX = 2048
GOAL_MAX = 4096


def _blank(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)), F.lit(0)) == 0


def search_error() -> Column:
    """Columns: query_text, mode, num_results, min_credibility, max_ai_generated_likelihood."""
    outside = lambda name: F.col(name).isNotNull() & ~F.col(name).between(0.0, 1.0)
    return (
        F.when(_blank(F.col("query_text")) | (F.length("query_text") > QUERY_MAX), "invalid_query")
        .when(~F.coalesce(F.col("mode").isin(MODES), F.lit(False)), "invalid_mode")
        .when(~F.coalesce("num_results", F.lit(10)).between(0, 100), "invalid_num_results")
        .when(outside("min_credibility") | outside("max_ai_generated_likelihood"), "invalid_threshold")
    )


def find_similar_error() -> Column:
    """Columns: url, num_results."""
    url = F.col("url")
    incomplete = (urls.scheme(url) == "") | (urls.authority(url) == "")
    return (
        F.when(_blank(url) | (F.length(url) > URL_MAX) | incomplete, "invalid_url")
        .when(~F.coalesce("num_results", F.lit(10)).between(0, 100), "invalid_num_results")
    )


def contents_error() -> Column:
    """Columns: document_ids, highlights, query_text."""
    count = F.coalesce(F.size("document_ids"), F.lit(0))
    return F.when(~count.between(1, 100), "invalid_document_id_count").when(
        F.coalesce(F.col("highlights"), F.lit(False)) & _blank(F.col("query_text")), "missing_highlight_query"
    )


def research_error() -> Column:
    """Columns: research_goal, output_schema (JSON text or NULL)."""
    goal = F.col("research_goal")
    schema = F.col("output_schema")
    not_object = schema.isNotNull() & F.json_object_keys(schema).isNull()
    return F.when(_blank(goal) | (F.length(goal) > GOAL_MAX) | not_object, "invalid_research_request")


def with_error(requests: DataFrame, error: Column) -> DataFrame:
    return requests.withColumn("error_code", error)
