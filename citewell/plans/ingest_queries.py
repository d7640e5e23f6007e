"""Cleaning, identity, versions, merging, scoring, retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell.functions import text, urls, vectors
from citewell.operators import ingest
from citewell.plans import inputs as i
from citewell.plans.catalog import query
from citewell.sources.tables import cut

def now():
    return i.later(i.start(), days=F.lit(2), secs=F.lit(100))



@query(
    "I1_clean_html",
    f"SELECT page_id, {i.CLEAN('html')} AS cleaned_text FROM pages",
)
def clean_html(spark, sf):
    return i.table(spark, sf, "pages").select("page_id", text.clean_html(F.col("html")).alias("cleaned_text"))


@query(
    "I2_content_hash",
    f"SELECT page_id, sha256({i.CLEAN('html')}) AS content_hash FROM pages UNION ALL "
    "SELECT doc_id, sha256(text) FROM documents",
)
def content_hash(spark, sf):
    pages = ingest.clean_pages(i.table(spark, sf, "pages")).select("page_id", "content_hash")
    documents = i.table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")))
    return pages.union(documents)


@query(
    "I3_document_identity",
    i.cte(
        i.PAGES,
        select=f"""SELECT url AS canonical_url, substr(sha256(url), 1, 32) AS document_id,
        {i.TS_TEXT('min(fetched_at)')} AS first_seen_at FROM pg GROUP BY url""",
    ),
)
def document_identity(spark, sf):
    found = ingest.document_identity(i.pages(spark, sf))
    return found.withColumn("first_seen_at", i.ts_text(F.col("first_seen_at")))


@query(
    "I4_assign_versions",
    i.cte(
        i.NUMBERED,
        select=f"""SELECT document_id, source_url, version, content_hash, {i.TS_TEXT('created_at')} AS created_at,
        {i.TS_TEXT('last_seen_at')} AS last_seen_at, length(cleaned_text) AS chars FROM page_versions""",
    ),
)
def assign_versions(spark, sf):
    versions = ingest.assign_versions(cut(i.observations(spark, sf)))
    return versions.select(
        "document_id", "source_url", "version", "content_hash", i.ts_text(F.col("created_at")).alias("created_at"),
        i.ts_text(F.col("last_seen_at")).alias("last_seen_at"), F.length("cleaned_text").alias("chars"),
    )


def merged(spark, sf):
    """Crawls one and two are stored, the third arrives as a batch."""
    seen = cut(i.observations(spark, sf))
    stored = cut(ingest.assign_versions(seen.where("pass < 2")))
    return ingest.merge_versions(stored, seen.where("pass = 2"))


# Stored first: what the SQL numbers are the observations left in, the third crawl always among them.
MERGE = i.OBSERVATIONS + """,
left_in AS (SELECT * FROM observations ),
numbered AS (
  SELECT *, substr(sha256(source_url), 1, 32) AS document_id,
         sum(changed) OVER (PARTITION BY source_url ORDER BY fetched_at) AS version
  FROM (SELECT *, lag(content_hash) OVER w AS before, CASE WHEN lag(content_hash) OVER w = content_hash THEN 0 ELSE 1 END AS changed
        FROM left_in WINDOW w AS (PARTITION BY source_url ORDER BY fetched_at)))"""


@query(
    "I5_merge_flags",
    i.cte(
        MERGE,
        select=f"""SELECT document_id, source_url, {i.TS_TEXT('fetched_at')} AS fetched_at, CAST(version AS BIGINT) AS version,
        before IS NULL AS is_new, before IS NOT NULL AND changed = 1 AS version_incremented, changed = 0 AS last_seen_only
        FROM numbered WHERE pass = 2""",
    ),
)
def merge_flags(spark, sf):
    _, results = merged(spark, sf)
    return results.withColumn("fetched_at", i.ts_text(F.col("fetched_at")))


@query(
    "I5_merged_versions",
    i.cte(
        MERGE,
        select=f"""SELECT document_id, CAST(version AS BIGINT) AS version, content_hash, any_value(length(cleaned_text)) AS chars,
        {i.TS_TEXT('min(fetched_at)')} AS created_at, {i.TS_TEXT('max(fetched_at)')} AS last_seen_at
        FROM numbered GROUP BY document_id, version, content_hash""",
    ),
)
def merged_versions(spark, sf):
    table, _ = merged(spark, sf)
    return table.select(
        "document_id", "version", "content_hash", F.length("cleaned_text").cast("bigint").alias("chars"), i.ts_text(F.col("created_at")).alias("created_at"),
        i.ts_text(F.col("last_seen_at")).alias("last_seen_at"),
    )


def _line_versions(spark, sf):
    """Order lines as versions of their order: line numbers may have gaps."""
    return i.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_linenumber").cast("bigint").alias("version")
    )


@query(
    "I6_version_gaps",
    """WITH v AS (SELECT CAST(l_orderkey AS VARCHAR) AS document_id, CAST(l_linenumber AS BIGINT) AS version,
                         lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS previous_version
                  FROM lineitem)
    SELECT document_id, version, CAST(coalesce(previous_version, 0) AS BIGINT) AS previous_version,
           CAST(coalesce(previous_version, 0) + 1 AS BIGINT) AS expected_version
    FROM v WHERE version <> coalesce(previous_version, 0) + 1""",
)
def version_gaps(spark, sf):
    gaps = ingest.version_gaps(_line_versions(spark, sf))
    return gaps.withColumn("previous_version", F.coalesce("previous_version", F.lit(0)))


@query(
    "I7_latest_versions",
    i.cte(
        i.NUMBERED,
        select="""SELECT document_id, source_url, version, content_hash FROM page_versions
        QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY version DESC) = 1""",
    ),
)
def latest_versions(spark, sf):
    versions = ingest.assign_versions(cut(i.observations(spark, sf)))
    return ingest.latest_versions(versions).select("document_id", "source_url", "version", "content_hash")


@query(
    "I8_analyze",
    f"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'),
        lambda t: t NOT IN ({i.STOP_LIST})), ' ') AS tokens FROM documents""",
)
def analyze(spark, sf):
    return i.table(spark, sf, "documents").select(
        "doc_id", F.array_join(text.analyze(F.col("text")), " ").alias("tokens")
    )


@query(
    "I9_hash_embedding",
    f"""WITH raw AS (SELECT item_id, {i.embedding_sql('text')} AS r FROM benchmark)
    SELECT item_id, u.i - 1 AS component, round(u.x, 9) AS value
    FROM raw, unnest({i.unit_sql('r')}) WITH ORDINALITY AS u(x, i)""",
)
def hash_embedding(spark, sf):
    vec = vectors.hash_embedding(F.col("text"))
    exploded = i.table(spark, sf, "benchmark").select("item_id", F.posexplode(vec).alias("component", "value"))
    return exploded.withColumn("value", F.round("value", 9))


@query(
    "I10_canonical_url",
    r"""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) || '://' || lower(regexp_extract(url, '//([^/?#]+)', 1)) ||
      CASE WHEN regexp_extract(url, '//[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/'
           ELSE rtrim(regexp_extract(url, '//[^/?#]*([^?#]*)', 1), '/') END ||
      CASE WHEN url LIKE '%?%' THEN '?' || regexp_extract(url, '\?([^#]*)', 1) ELSE '' END AS canonical
    FROM pages""",
)
def canonical_url(spark, sf):
    return i.table(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(
    "I11_domain",
    r"""SELECT page_id, regexp_extract(url, '//([^/?#]+)', 1) AS host,
      regexp_extract(regexp_extract(url, '//([^/?#]+)', 1), '([^.]+\.[^.]+)$', 1) AS domain,
      regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path FROM pages""",
)
def domain(spark, sf):
    host = urls.host(F.col("url"))
    return i.table(spark, sf, "pages").select(
        "page_id", host.alias("host"), urls.registrable_domain(host).alias("domain"), urls.path(F.col("url")).alias("path")
    )


@query(
    "I12_retry_decisions",
    "WITH RECURSIVE " + i.ATTEMPTS + """,
    ordered AS (SELECT *, row_number() OVER w AS rn, us - lag(us) OVER w AS gap FROM attempts
                WINDOW w AS (PARTITION BY key ORDER BY us, attempt_id)),
    spaced AS (SELECT *, coalesce(gap >= 60000000 AND lag(gap) OVER (PARTITION BY key ORDER BY rn) >= 60000000, FALSE) AS spaced
               FROM ordered),
    walk AS (
      SELECT key, rn, us, error, CASE WHEN ok THEN 0 ELSE 1 END AS n, FALSE AS routed, 0 AS made FROM spaced WHERE rn = 1
      UNION ALL
      SELECT s.key, s.rn, s.us, s.error,
             CASE WHEN s.ok OR (w.n + 1 >= 3 AND s.spaced) THEN 0 ELSE w.n + 1 END,
             NOT s.ok AND w.n + 1 >= 3 AND s.spaced, w.n + 1
      FROM walk w JOIN spaced s ON s.key = w.key AND s.rn = w.rn + 1)
    SELECT key AS source_url, error AS failure_reason, CAST(made AS BIGINT) AS attempts, us AS routed_us FROM walk WHERE routed""",
)
def retry_decisions(spark, sf):
    routed = ingest.retry_decisions(i.attempts(spark, sf))
    return routed.select("source_url", "failure_reason", "attempts", F.unix_micros("routed_at").alias("routed_us"))


@query(
    "I13_due_sources",
    i.cte(
        i.RECRAWLS,
        select="""SELECT p.url FROM (SELECT DISTINCT url FROM pages) p
        LEFT JOIN (SELECT regexp_extract(source_url, '^(.*)#[0-9]+$', 1) AS url, max(fetched_at) AS last FROM raw_crawls
                   WHERE pass < length(html) % 3 GROUP BY 1) c USING (url)
        WHERE last IS NULL OR last <= TIMESTAMP '2024-01-02 00:01:40'""",
    ),
)
def due_sources(spark, sf):
    sources = i.table(spark, sf, "pages").select("url").distinct()
    crawls = i.recrawls(spark, sf).where(F.col("pass") < F.length("html") % 3).select(
        F.regexp_replace("source_url", "#[0-9]+$", "").alias("url"), F.col("fetched_at").alias("crawled_at")
    )
    return ingest.due_sources(sources, crawls, now()).select("url")


@query(
    "I14_index_version",
    i.cte(
        i.NUMBERED,
        select=f"""SELECT tenant_id, {i.TS_TEXT('created_at')} AS created_at,
          CAST(1 + sum(n) OVER (PARTITION BY tenant_id ORDER BY created_at) AS BIGINT) AS index_version
        FROM (SELECT regexp_extract(source_url, '//([^/]+)', 1) AS tenant_id, created_at, count(*) AS n
              FROM page_versions GROUP BY ALL)""",
    ),
)
def index_version(spark, sf):
    versions = ingest.assign_versions(cut(i.observations(spark, sf)))
    owned = versions.withColumn("tenant_id", urls.host(F.col("source_url")))
    counted = ingest.index_versions(owned)
    return counted.withColumn("created_at", i.ts_text(F.col("created_at")))


def VARIANCE(lengths: str) -> str:
    """Population variance of an integer list."""
    return f"""((len({lengths}) * list_sum(list_transform({lengths}, lambda n: n * n)) - list_sum({lengths}) * list_sum({lengths}))
      / CAST(len({lengths}) * len({lengths}) AS DOUBLE))"""


SCORES = f"""parts AS (
  SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s, chr(10) || ' ' || chr(9))), lambda s: s <> '') AS s,
         list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS words,
         list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p, chr(10) || ' ' || chr(9))), lambda p: p <> '') AS paras
  FROM documents),
sizes AS (
  SELECT *, list_transform(s, lambda x: CAST(length(x) AS BIGINT)) AS chars,
         list_transform(s, lambda x: CAST(len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) AS BIGINT)) AS counts,
         list_transform(paras, lambda p: CAST(length(p) AS BIGINT)) AS plen,
         (lower(text) LIKE '%furthermore%')::INT + (lower(text) LIKE '%moreover%')::INT + (lower(text) LIKE '%additionally%')::INT
         + (lower(text) LIKE '%in conclusion%')::INT + (lower(text) LIKE '%it is important to note%')::INT
         + (lower(text) LIKE '%it is worth noting%')::INT AS phrases
  FROM parts),
scored AS (
  SELECT doc_id, round(least(1.0, 0.5::DOUBLE + CASE WHEN length(text) > 500 THEN 0.1 ELSE 0 END
      + CASE WHEN length(text) > 2000 THEN 0.1 ELSE 0 END
      + CASE WHEN len(regexp_extract_all(text, '[0-9]+\\.?[0-9]*')) > 3 THEN 0.1 ELSE 0 END
      + CASE WHEN len(s) > 3 AND {VARIANCE('chars')} > 100 THEN 0.05 ELSE 0 END
      + CASE WHEN len(words) > 0 AND len(list_distinct(words)) / CAST(len(words) AS DOUBLE) > 0.6 THEN 0.05 ELSE 0 END), 6) AS credibility,
    round(CASE WHEN len(s) < 3 THEN 0.3::DOUBLE ELSE 0.3::DOUBLE
      + CASE WHEN {VARIANCE('counts')} < 20 THEN 0.2 WHEN {VARIANCE('counts')} < 50 THEN 0.1 ELSE 0 END
      + CASE WHEN phrases >= 3 THEN 0.15 WHEN phrases >= 2 THEN 0.1 ELSE 0 END
      + CASE WHEN len(paras) > 2 AND {VARIANCE('plen')} < 500 THEN 0.1 ELSE 0 END END, 6) AS ai
  FROM sizes)"""


def _scored(spark, sf):
    return ingest.score_documents(i.docs(spark, sf).drop("provenance"), i.start())


@query("V1_credibility", i.cte(SCORES, select="SELECT doc_id, credibility FROM scored"))
def credibility(spark, sf):
    from citewell.functions.provenance import credibility as score

    return i.table(spark, sf, "documents").select("doc_id", F.round(score(F.col("text")), 6).alias("credibility"))


@query("V2_ai_likelihood", i.cte(SCORES, select="SELECT doc_id, ai FROM scored"))
def ai_likelihood(spark, sf):
    from citewell.functions.provenance import ai_likelihood as score

    return i.table(spark, sf, "documents").select("doc_id", F.round(score(F.col("text")), 6).alias("ai"))


@query(
    "V3_score_and_gate",
    i.cte(SCORES, select="SELECT 'd' || doc_id AS document_id, credibility, ai, TRUE AS visible FROM scored"),
)
def score_and_gate(spark, sf):
    return _scored(spark, sf).select(
        "document_id", F.round("provenance.credibility_score", 6).alias("credibility"),
        F.round("provenance.ai_generated_likelihood", 6).alias("ai"), "visible",
    )


def _rescored(spark, sf):
    """Labelled documents are rescored with some already scored and some not."""
    d = i.docs(spark, sf)
    before = d.withColumn(
        "provenance",
        F.when(
            F.col("language") == "en",
            F.struct(F.lit(0.0).alias("credibility_score"), F.lit(1.0).alias("ai_generated_likelihood"), i.start().alias("scored_at")),
        ),
    )
    labelled = i.table(spark, sf, "labels").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.lit(1).alias("version"))
    return ingest.rescore(before, labelled, now())


@query(
    "V4_rescore",
    i.cte(
        SCORES,
        select="""SELECT 'd' || d.doc_id AS document_id,
          CASE WHEN d.lang <> 'en' THEN -1.0 WHEN l.doc_id IS NULL THEN 0.0 ELSE s.credibility END AS credibility,
          CASE WHEN d.lang <> 'en' THEN -1.0 WHEN l.doc_id IS NULL THEN 1.0 ELSE s.ai END AS ai
        FROM documents d JOIN scored s ON s.doc_id = d.doc_id
        LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""",
    ),
)
def rescore(spark, sf):
    after, _ = _rescored(spark, sf)
    unscored = F.lit(-1.0)
    return after.select(
        "document_id", F.coalesce(F.round("provenance.credibility_score", 6), unscored).alias("credibility"),
        F.coalesce(F.round("provenance.ai_generated_likelihood", 6), unscored).alias("ai"),
    )


@query(
    "V4_never_scored",
    "SELECT DISTINCT 'd' || doc_id AS document_id FROM labels JOIN documents USING (doc_id) WHERE lang <> 'en'",
)
def never_scored(spark, sf):
    _, unknown = _rescored(spark, sf)
    return unknown.select("document_id")
