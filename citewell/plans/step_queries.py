"""Result steps, alone and chained."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citewell.functions import text
from citewell.functions.highlights import highlights
from citewell.operators import steps
from citewell.plans import inputs as i
from citewell.plans.catalog import query


LIST_IDS = 500


def results(spark, sf):
    """All documents, dealt into ranked lists of bounded length by source and number, scored by size."""
    d = i.docs(spark, sf).withColumn("list", F.concat_ws("/", "category", F.floor(F.col("doc_id") / LIST_IDS).cast("string")))
    listed = d.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy("doc_id")))
    return listed.select(
        F.col("list").alias("query_id"), (F.col("rank") - 1).alias("position"), "document_id", "url",
        text.title(F.col("cleaned_text")).alias("title"), (F.col("n_chars") % 1000 / 1000.0).alias("score"), "published_at",
        F.nullif("language", F.lit("es")).alias("language"),
        F.when(F.col("n_chars") % 5 != 0, F.struct((F.col("n_chars") % 11 / 10.0).alias("credibility_score"))).alias("provenance"),
    )


RESULTS = i.DOCS + """,
results AS (
  SELECT * FROM (
    SELECT category || '/' || CAST(doc_id // 500 AS VARCHAR) AS query_id, row_number() OVER (PARTITION BY category, doc_id // 500 ORDER BY doc_id) - 1 AS position, document_id, url,
           substr(trim(split_part(cleaned_text, chr(10), 1)), 1, 100) AS title, (n_chars % 1000) / 1000.0::DOUBLE AS score, published_at,
           nullif(language, 'es') AS language, CASE WHEN n_chars % 5 <> 0 THEN (n_chars % 11) / 10.0::DOUBLE ELSE 0.5 END AS trust
    FROM docs))"""
KEPT = "query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY position) - 1 AS position"
RESORTED = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) - 1 AS position, round(score, 6) AS score"
def now():
    return F.lit("2024-12-31 00:00:00").cast("timestamp")



def _ran(spark, sf, *chain):
    done = steps.run_steps(results(spark, sf), list(chain))
    return done.select("query_id", "document_id", F.col("position").cast("bigint").alias("position"), F.round("score", 6).alias("score"), "title")


@query("P1_domain_filter", i.cte(RESULTS, select=f"SELECT {KEPT} FROM results WHERE url LIKE '%/1%' OR url LIKE '%src5%'"))
def domain_filter(spark, sf):
    return _ran(spark, sf, ("domain_filter", {"domains": ["/1", "src5"]})).drop("score", "title")


@query("P1_domain_exclusion", i.cte(RESULTS, select=f"SELECT {KEPT} FROM results WHERE NOT (url LIKE '%/1%' OR url LIKE '%src5%')"))
def domain_exclusion(spark, sf):
    return _ran(spark, sf, ("domain_filter", {"domains": ["/1", "src5"], "exclude": True})).drop("score", "title")


@query(
    "P2_freshness_filter",
    i.cte(RESULTS, select=f"SELECT {KEPT} FROM results WHERE published_at IS NULL OR published_at >= TIMESTAMP '2024-12-31' - INTERVAL 200 DAY"),
)
def freshness_filter(spark, sf):
    return _ran(spark, sf, ("freshness_filter", {"max_age_days": 200, "now": now()})).drop("score", "title")


@query("P3_language_filter", i.cte(RESULTS, select=f"SELECT {KEPT} FROM results WHERE language IS NULL OR language IN ('en', 'fr')"))
def language_filter(spark, sf):
    return _ran(spark, sf, ("language_filter", {"languages": ["en", "fr"]})).drop("score", "title")


BOOSTED = "SELECT * REPLACE (CASE WHEN url LIKE '%/2%' OR url LIKE '%src3%' THEN least(1.0, score * 1.5) ELSE score END AS score) FROM results"


@query("P4_score_reranker", i.cte(RESULTS, select=f"SELECT query_id, document_id, {RESORTED} FROM ({BOOSTED})"))
def score_reranker(spark, sf):
    return _ran(spark, sf, ("score_reranker", {"boost_factor": 1.5, "boost_domains": ["/2", "src3"]})).drop("title")


@query(
    "P5_credibility_reranker",
    i.cte(RESULTS, select=f"""SELECT query_id, document_id, {RESORTED} FROM (
    SELECT * REPLACE (least(1.0, (1 - 0.3::DOUBLE) * score + 0.3::DOUBLE * trust) AS score) FROM results)"""),
)
def credibility_reranker(spark, sf):
    return _ran(spark, sf, "credibility_reranker").drop("title")


@query(
    "P6_reciprocal_rank_reranker",
    i.cte(RESULTS, select=f"SELECT query_id, document_id, {RESORTED} FROM (SELECT * REPLACE (1.0::DOUBLE / (60 + position + 1) AS score) FROM results)"),
)
def reciprocal_rank_reranker(spark, sf):
    return _ran(spark, sf, "reciprocal_rank_reranker").drop("title")


@query("P7_title_transform", i.cte(RESULTS, select="SELECT query_id, document_id, position, substr('>> ' || title || ' <<', 1, 60) AS title FROM results"))
def title_transform(spark, sf):
    return _ran(spark, sf, ("title_transform", {"max_length": 60, "prefix": ">> ", "suffix": " <<"})).drop("score")


@query("P8_snippet_transform", i.cte(RESULTS, select="SELECT query_id, document_id, position, round(score, 6) AS score, title FROM results"))
def snippet_transform(spark, sf):
    return _ran(spark, sf, "snippet_transform")


@query(
    "P9_dedup_transform",
    i.cte(RESULTS, select=f"""SELECT {KEPT} FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, language ORDER BY position) AS n FROM results) WHERE n = 1"""),
)
def dedup_transform(spark, sf):
    return _ran(spark, sf, ("dedup_transform", {"field": "language"})).drop("score", "title")


@query(
    "P10_implicit_order",
    i.cte(RESULTS, select=f"""SELECT query_id, document_id, {RESORTED}, substr('* ' || title, 1, 100) AS title
    FROM ({BOOSTED}) WHERE language IS NULL OR language IN ('en')"""),
)
def implicit_order(spark, sf):
    """Declared backwards; filters run first and transforms last."""
    return _ran(
        spark, sf, ("title_transform", {"prefix": "* "}), ("score_reranker", {"boost_factor": 1.5, "boost_domains": ["/2", "src3"]}),
        ("language_filter", {"languages": ["en"]}),
    )


@query(
    "P11_chained_steps",
    i.cte(
        RESULTS,
        f"boosted AS ({BOOSTED} WHERE NOT url LIKE '%/7%')",
        """resorted AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) - 1 AS position) FROM boosted)""",
        """blended AS (SELECT * REPLACE (least(1.0, (1 - 0.5::DOUBLE) * score + 0.5::DOUBLE * trust) AS score) FROM resorted)""",
        """placed AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) - 1 AS position) FROM blended)""",
        select="""SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY position) - 1 AS position, round(score, 6) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(title, '') ORDER BY position) AS n FROM placed) WHERE n = 1""",
    ),
)
def chained(spark, sf):
    return _ran(
        spark, sf, ("domain_filter", {"domains": ["/7"], "exclude": True}),
        ("score_reranker", {"boost_factor": 1.5, "boost_domains": ["/2", "src3"]}), ("credibility_reranker", {"credibility_weight": 0.5}),
        "snippet_transform", ("dedup_transform", {"field": "title"}),
    ).drop("title")


@query("P12_defined_steps", i.cte(RESULTS, select=f"SELECT {KEPT} FROM results WHERE url LIKE '%1%'"))
def defined_steps(spark, sf):
    """The longest list allowed: twenty steps, with and without config."""
    long = [("domain_filter", {"domains": ["1"]})] + ["snippet_transform"] * 19
    return _ran(spark, sf, *long).drop("score", "title")


def _at_least(rows, config):
    return rows.where(F.col("score") >= config["least"]).transform(steps.language_filter, config)


@query(
    "P13_registered_step",
    i.cte(RESULTS, select=f"SELECT {KEPT} FROM results WHERE score >= 0.4 AND (language IS NULL OR language = 'en')"),
)
def registered_step(spark, sf):
    """A step of the user's own, made from a DataFrame function and another step."""
    steps.register_step("at_least", "filter", _at_least)
    return _ran(spark, sf, ("at_least", {"least": 0.4, "languages": ["en"]})).drop("score", "title")


@query(
    "L2_stable_sort",
    i.cte(RESULTS, select="""SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 1) DESC, position) - 1 AS position FROM results"""),
)
def stable_sort(spark, sf):
    """Scores rounded so that many tie; ties keep their order."""
    coarse = results(spark, sf).withColumn("score", F.round("score", 1))
    sorted_rows = steps.run_steps(coarse, [("score_reranker", {"boost_factor": 1.0})])
    return sorted_rows.select("query_id", "document_id", F.col("position").cast("bigint").alias("position"))


@query(
    "P8_first_highlight",
    i.cte(
        RESULTS,
        select="""SELECT r.query_id, r.document_id, CASE WHEN instr(lower(d.cleaned_text), 'the') > 0 THEN 1 ELSE 0 END AS matched
        FROM results r JOIN docs d USING (document_id)""",
    ),
)
def first_highlight(spark, sf):
    """Snippets by way of highlights: which results mention the word at all."""
    listed = results(spark, sf).select("query_id", "document_id")
    joined = listed.join(i.docs(spark, sf).select("document_id", "cleaned_text"), "document_id")
    first = F.get(highlights(F.col("cleaned_text"), F.lit("the")), 0)  # an empty text has none
    inside = F.substring(F.lower("cleaned_text"), first["start"] + 1, first["end"] - first["start"])
    return joined.select("query_id", "document_id", F.coalesce(inside.contains("the").cast("int"), F.lit(0)).alias("matched"))
