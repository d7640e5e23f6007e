"""Filters: predicates, thresholds, visibility, tenants, validation, projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from citewell.functions.predicates import all_of, any_of, eq, ge, gt, is_in, le, lt, ne, not_
from citewell.operators import search, validation
from citewell.plans import inputs as i
from citewell.plans.catalog import query


def _filtered(name: str, make, where: str):
    @query(name, i.cte(i.DOCS, select=f"SELECT document_id, language, category FROM docs WHERE {where}"))
    def run(spark, sf):
        return i.docs(spark, sf).where(make().column).select("document_id", "language", "category")


_filtered("F1_eq", lambda: eq("language", "en"), "language = 'en'")
_filtered("F2_ne", lambda: ne("published_at", "2024-01-15"), "published_at <> TIMESTAMP '2024-01-15'")
_filtered("F3_in", lambda: is_in("category", ["src1", "src2", "src3"]), "category IN ('src1', 'src2', 'src3')")
_filtered(
    "F4_range",
    lambda: all_of(ge("published_at", dt.date(2024, 3, 1)), lt("published_at", "2024-09-01T12:00:00Z"),
                   gt("metadata.chars", 300), le("metadata.chars", 9000)),
    "published_at >= TIMESTAMP '2024-03-01' AND published_at < TIMESTAMP '2024-09-01 12:00:00' AND n_chars > 300 AND n_chars <= 9000",
)
_filtered("F5_not", lambda: not_(eq("language", "en")), "NOT language = 'en'")
_filtered(
    "F6_and", lambda: all_of(eq("language", "fr"), ne("category", "src3"), gt("metadata.chars", 500)),
    "language = 'fr' AND category <> 'src3' AND n_chars > 500",
)
_filtered(
    "F7_or", lambda: any_of(eq("language", "de"), eq("domain", "src5.example.org"), lt("metadata.chars", 200)),
    "language = 'de' OR domain = 'src5.example.org' OR n_chars < 200",
)
_filtered(
    "F8_fields",
    lambda: any_of(eq("metadata.lang.group", "f"), eq("url", "https://src1.example.org/1"), eq("domain", "src2.example.org"),
                   eq("category", "src4"), lt("published_at", "2024-01-20")),
    """lang_group = 'f' OR url = 'https://src1.example.org/1' OR domain = 'src2.example.org' OR category = 'src4'
       OR published_at < TIMESTAMP '2024-01-20'""",
)
_filtered(
    "F9_literals",
    lambda: any_of(eq("metadata.chars", 380), is_in("metadata.chars", [155, 260.0, "380"]), eq("published_at", "2024-02-03T00:00:00+00:00"),
                   gt("language", "fr")),
    "n_chars IN (380, 155, 260) OR published_at = TIMESTAMP '2024-02-03' OR language > 'fr'",
)


def _deep():
    """A tree at the allowed depth: alternating negations around a set of comparisons."""
    tree = any_of(*[eq("category", f"src{n}") for n in range(10)])
    for _ in range(30):
        tree = not_(tree)
    return tree


_filtered("F10_bounds", _deep, "category IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9')")


def _threshold(name: str, apply, where: str):
    @query(name, i.cte(i.DOC_VERSIONS, select=f"SELECT document_id, version FROM doc_versions WHERE n_chars % 5 <> 0 AND {where}"))
    def run(spark, sf):
        return apply(i.doc_versions(spark, sf)).select("document_id", "version")


_threshold("F11_min_credibility", lambda d: search.min_credibility(d, 0.6), "credibility >= 0.6::DOUBLE")
_threshold("F12_max_ai_generated", lambda d: search.max_ai_generated(d, 0.5), "ai <= 0.5")
_threshold("F13_thresholds", lambda d: search.apply_thresholds(d, 0.3, 0.625), "credibility >= 0.3::DOUBLE AND ai <= 0.625")


@query("F14_visibility", i.cte(i.DOC_VERSIONS, select="SELECT document_id, version FROM doc_versions WHERE visible"))
def visibility(spark, sf):
    return search.visible_only(i.doc_versions(spark, sf)).select("document_id", "version")


@query(
    "F15_tenant_isolation",
    i.cte(
        i.DOC_VERSIONS,
        select="""SELECT v.document_id, v.version FROM doc_versions v
        WHERE EXISTS (SELECT 1 FROM docs d WHERE d.document_id = v.document_id AND (d.tenant_id IS NULL OR d.tenant_id = 'src3'))""",
    ),
)
def tenant_isolation(spark, sf):
    children = search.tenant_children(i.doc_versions(spark, sf), i.docs(spark, sf), "src3")
    return children.select("document_id", "version")


@query(
    "F16_result_projection",
    i.cte(
        i.DOC_VERSIONS,
        select="""SELECT document_id, version, source_url AS url, substr(trim(split_part(cleaned_text, chr(10), 1)), 1, 100) AS title,
        round(greatest(0, least(1, n_chars / 5000.0 - 0.1)), 6) AS score, round(credibility, 6) AS credibility, round(ai, 6) AS ai
        FROM doc_versions WHERE visible""",
    ),
)
def result_projection(spark, sf):
    d = i.doc_versions(spark, sf)
    candidates = d.select("document_id", "version", (F.col("n_chars") / 5000.0 - 0.1).alias("score"))
    found = search.to_results(candidates, d, i.start())
    return found.select(
        "document_id", "version", "url", "title", F.round("score", 6).alias("score"),
        F.round("provenance.credibility_score", 6).alias("credibility"), F.round("provenance.ai_generated_likelihood", 6).alias("ai"),
    )


@query(
    "F17_validate_search",
    """SELECT doc_id, coalesce(CASE WHEN length(trim(text)) = 0 OR length(text) > 2048 THEN 'invalid_query'
        WHEN lang NOT IN ('en', 'fr') THEN 'invalid_mode' WHEN n_chars % 130 NOT BETWEEN 0 AND 100 THEN 'invalid_num_results'
        WHEN n_chars / 1500.0 > 1 THEN 'invalid_threshold' END, 'ok') AS error_code FROM documents""",
)
def validate_search(spark, sf):
    """Document texts as queries; language, length and size become mode, count and threshold."""
    d = i.table(spark, sf, "documents")
    asked = d.select(
        "doc_id", F.col("text").alias("query_text"),
        F.when(F.col("lang") == "en", "hybrid").when(F.col("lang") == "fr", "keyword").otherwise(F.col("lang")).alias("mode"),
        (F.col("n_chars") % 130).cast("int").alias("num_results"), (F.col("n_chars") / 1500.0).alias("min_credibility"),
        F.lit(None).cast("double").alias("max_ai_generated_likelihood"),
    )
    checked = validation.with_error(asked, validation.search_error())
    return checked.select("doc_id", F.coalesce("error_code", F.lit("ok")).alias("error_code"))


@query(
    "F17_validate_find_similar",
    """SELECT page_id, CASE WHEN length(url) % 4 = 0 THEN 'invalid_url' WHEN length(html) % 150 > 100 THEN 'invalid_num_results'
       ELSE 'ok' END AS error_code FROM pages""",
)
def validate_find_similar(spark, sf):
    """Some URLs lose their scheme."""
    p = i.table(spark, sf, "pages")
    asked = p.select(
        "page_id", F.when(F.length("url") % 4 == 0, F.regexp_replace("url", "^https?:", "")).otherwise(F.col("url")).alias("url"),
        (F.length("html") % 150).cast("int").alias("num_results"),
    )
    checked = validation.with_error(asked, validation.find_similar_error())
    return checked.select("page_id", F.coalesce("error_code", F.lit("ok")).alias("error_code"))


@query(
    "F17_validate_contents",
    """SELECT conv_id, CASE WHEN sum(length(text)) % 120 NOT BETWEEN 1 AND 100 THEN 'invalid_document_id_count'
        WHEN count(*) % 2 = 0 AND min(length(text)) % 2 = 0 THEN 'missing_highlight_query' ELSE 'ok' END AS error_code
       FROM conversations GROUP BY conv_id""",
)
def validate_contents(spark, sf):
    """Conversations as requests for as many ids as their length says."""
    c = i.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.sum(F.length("text")).alias("chars"), F.count("*").alias("turns"), F.min(F.length("text")).alias("least")
    )
    asked = c.select(
        "conv_id",
        F.array_repeat(F.lit("d"), (F.col("chars") % 120).cast("int")).alias("document_ids"),
        (F.col("turns") % 2 == 0).alias("highlights"),
        F.when(F.col("least") % 2 == 1, "words").otherwise("  ").alias("query_text"),
    )
    checked = validation.with_error(asked, validation.contents_error())
    return checked.select("conv_id", F.coalesce("error_code", F.lit("ok")).alias("error_code"))


@query(
    "F17_validate_research",
    """SELECT doc_id, CASE WHEN length(trim(text)) = 0 OR length(text) > 4096 OR lang = 'de' THEN 'invalid_research_request' ELSE 'ok' END
       AS error_code FROM documents""",
)
def validate_research(spark, sf):
    """German documents bring an output schema that is an array."""
    d = i.table(spark, sf, "documents")
    asked = d.select(
        "doc_id", F.col("text").alias("research_goal"),
        F.when(F.col("lang") == "de", "[1]").when(F.col("lang") == "fr", '{"type": "object"}').alias("output_schema"),
    )
    checked = validation.with_error(asked, validation.research_error())
    return checked.select("doc_id", F.coalesce("error_code", F.lit("ok")).alias("error_code"))
