"""Tables the registered queries run on: the given tables under the names and shapes the operators use.

Every function has a SQL twin of the same name in upper case, a common table expression over the given
tables. Both derive everything from the data: no clock, no random numbers, no literal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.functions.text import STOPWORDS
from citewell.operators.ingest import clean_pages
from citewell.sources.tables import table

STOP_LIST = ", ".join(f"'{w}'" for w in STOPWORDS)


def start() -> Column:
    """When the logs begin."""
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def later(base: Column, **parts: Column) -> Column:
    return base + F.make_dt_interval(**parts)


def sped(column: str, factor: int) -> Column:
    """A time on a log replayed so many times as fast; times before its beginning are rounded towards it, as ``//`` does in SQL."""
    base = F.unix_micros(start())
    return F.timestamp_micros(base + F.call_function("div", F.unix_micros(column) - base, F.lit(factor)))


def ts_text(c: Column) -> Column:
    """Timestamps leave the queries as text, which both engines print alike."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def TS_TEXT(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def cte(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


# --- pages -------------------------------------------------------------------------------------------


def CLEAN(html: str) -> str:
    """Cleaned text of a page. The pages use four entities, some cut off before the semicolon; the
    ampersand is decoded last."""
    bare = f"regexp_replace({html}, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'gis')"
    bare = f"regexp_replace({bare}, '<[^>]+>', ' ', 'g')"
    for entity, char in [("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")]:
        bare = f"regexp_replace({bare}, '{entity}', '{char}', 'g')"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").withColumn("fetched_at", later(start(), secs=F.col("page_id")))


PAGES = """pg AS (
  SELECT page_id, url, html, TIMESTAMP '2024-01-01' + to_seconds(page_id) AS fetched_at FROM pages)"""


def recrawls(spark: SparkSession, sf: str) -> DataFrame:
    """Three daily crawls of every page. Some pages change on day two, some on day two and back on day three."""
    crawled = pages(spark, sf).withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    host_length = F.length(F.regexp_extract("url", "//([^/]+)", 1)) % 3
    edited = (F.col("pass") == 1) & (host_length > 0) | (F.col("pass") == 2) & (host_length == 2)
    html = F.when(edited, F.concat("html", F.lit("<p>edited</p>"))).otherwise(F.col("html"))
    return crawled.select(
        "page_id",
        F.concat("url", F.lit("#"), "page_id").alias("source_url"),
        html.alias("html"),
        later(F.col("fetched_at"), days=F.col("pass")).alias("fetched_at"),
        "pass",
    )


RECRAWLS = """raw_crawls AS (
  SELECT page_id, url || '#' || page_id AS source_url, pass,
         CASE WHEN (pass = 1 AND length(regexp_extract(url, '//([^/]+)', 1)) % 3 > 0)
                OR (pass = 2 AND length(regexp_extract(url, '//([^/]+)', 1)) % 3 = 2)
              THEN html || '<p>edited</p>' ELSE html END AS html,
         TIMESTAMP '2024-01-01' + to_seconds(page_id) + to_days(CAST(pass AS INT)) AS fetched_at
  FROM pages, (SELECT unnest([0, 1, 2]) AS pass))"""

OBSERVATIONS = RECRAWLS + f""",
observations AS (
  SELECT page_id, source_url, fetched_at, pass, cleaned_text, sha256(cleaned_text) AS content_hash
  FROM (SELECT *, {CLEAN('html')} AS cleaned_text FROM raw_crawls))"""

NUMBERED = OBSERVATIONS + """,
numbered AS (
  SELECT *, substr(sha256(source_url), 1, 32) AS document_id,
         sum(changed) OVER (PARTITION BY source_url ORDER BY fetched_at) AS version
  FROM (SELECT *, CASE WHEN lag(content_hash) OVER (PARTITION BY source_url ORDER BY fetched_at) = content_hash
                       THEN 0 ELSE 1 END AS changed FROM observations)),
page_versions AS (
  SELECT document_id, source_url, CAST(version AS BIGINT) AS version, content_hash,
         min(fetched_at) AS created_at, max(fetched_at) AS last_seen_at, any_value(cleaned_text) AS cleaned_text
  FROM numbered GROUP BY ALL)"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return clean_pages(recrawls(spark, sf)).drop("html")


# --- documents ---------------------------------------------------------------------------------------


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as first versions, with the fields filters may name."""
    d = table(spark, sf, "documents")
    return d.select(
        F.concat(F.lit("d"), "doc_id").alias("document_id"),
        F.lit(1).alias("version"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id").alias("source_url"),
        F.col("text").alias("cleaned_text"),
        F.nullif(F.col("source"), F.lit("src0")).alias("tenant_id"),
        F.concat("source", F.lit(".example.org")).alias("domain"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id").alias("url"),
        F.when(F.col("n_chars") % 7 != 0, later(start(), days=(F.col("n_chars") % 400).cast("int"))).alias("published_at"),
        F.col("lang").alias("language"),
        F.col("source").alias("category"),
        F.create_map(
            F.lit("chars"), F.col("n_chars").cast("string"), F.lit("lang.group"), F.substring("lang", 1, 1)
        ).alias("metadata"),
        "doc_id",
        "n_chars",
    )


DOCS = """docs AS (
  SELECT 'd' || doc_id AS document_id, CAST(1 AS BIGINT) AS version, 'https://' || source || '.example.org/' || doc_id AS source_url,
         text AS cleaned_text, nullif(source, 'src0') AS tenant_id, source || '.example.org' AS domain,
         'https://' || source || '.example.org/' || doc_id AS url,
         CASE WHEN n_chars % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(n_chars % 400 AS INT)) END AS published_at,
         lang AS language, source AS category, n_chars, substr(lang, 1, 1) AS lang_group, doc_id
  FROM documents)"""


def doc_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a second version for those not in English, and the scores of both."""
    first = docs(spark, sf).select("document_id", "version", "source_url", "cleaned_text", "language", "n_chars")
    second = first.where("language <> 'en'").withColumn("version", F.lit(2)).withColumn(
        "cleaned_text", F.concat("cleaned_text", F.lit("\n"), "source_url")
    )
    return first.unionByName(second).withColumn(
        "provenance",
        F.when(
            F.col("n_chars") % 5 != 0,
            F.struct(
                (F.col("n_chars") % 11 / 10.0).alias("credibility_score"),
                (F.col("n_chars") % 9 / 8.0).alias("ai_generated_likelihood"),
                start().alias("scored_at"),
            ),
        ),
    ).withColumn("visible", F.col("n_chars") % 10 != 3)


DOC_VERSIONS = DOCS + """,
doc_versions AS (
  SELECT *, CASE WHEN n_chars % 5 <> 0 THEN (n_chars % 11) / 10.0::DOUBLE ELSE 0.5 END AS credibility,
         CASE WHEN n_chars % 5 <> 0 THEN (n_chars % 9) / 8.0::DOUBLE ELSE 0.5 END AS ai,
         n_chars % 10 <> 3 AS visible
  FROM (SELECT document_id, version, source_url, cleaned_text, language, n_chars FROM docs
        UNION ALL
        SELECT document_id, CAST(2 AS BIGINT), source_url, cleaned_text || chr(10) || source_url, language, n_chars
        FROM docs WHERE language <> 'en')),
latest AS (
  SELECT * FROM doc_versions QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY version DESC) = 1)"""


def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark texts as search requests of all modes, sizes and thresholds."""
    q = table(spark, sf, "benchmark")
    n = F.length("text")
    return q.select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query_text"),
        F.element_at(F.array(F.lit("neural"), F.lit("keyword"), F.lit("hybrid")), (n % 3 + 1).cast("int")).alias("mode"),
        (n % 6 + 5).cast("int").alias("num_results"),
        F.when(n % 4 == 0, F.lit(0.4)).alias("min_credibility"),
        F.when(n % 5 == 0, F.lit(0.75)).alias("max_ai_generated_likelihood"),
    )


QUERIES = """queries AS (
  SELECT item_id AS query_id, text AS query_text,
         CASE length(text) % 3 WHEN 0 THEN 'neural' WHEN 1 THEN 'keyword' ELSE 'hybrid' END AS mode,
         length(text) % 6 + 5 AS num_results,
         CASE WHEN length(text) % 4 = 0 THEN 0.4::DOUBLE END AS min_credibility,
         CASE WHEN length(text) % 5 = 0 THEN 0.75::DOUBLE END AS max_ai
  FROM benchmark)"""


def bm25_sql(corpus: str = "latest", column: str = "cleaned_text", prefix: str = "") -> str:
    """Tables ``{prefix}raw``: BM25 of every query and document with a term in common."""
    p = prefix
    return f"""{p}tokens AS (
  SELECT document_id, version, t.term FROM {corpus}, unnest(regexp_extract_all(lower({column}), '[a-z0-9]+')) AS t(term)
  WHERE t.term NOT IN ({STOP_LIST})),
{p}lengths AS (
  SELECT c.document_id, c.version, count(t.term) AS dl FROM {corpus} c
  LEFT JOIN {p}tokens t ON t.document_id = c.document_id AND t.version = c.version GROUP BY ALL),
{p}stats AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM {p}lengths),
{p}tf AS (SELECT document_id, version, term, count(*) AS tf FROM {p}tokens GROUP BY ALL),
{p}df AS (SELECT term, count(DISTINCT document_id) AS df FROM {p}tf GROUP BY term),
{p}qt AS (
  SELECT query_id, t.term, count(*) AS qtf FROM queries, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS t(term)
  WHERE t.term NOT IN ({STOP_LIST}) GROUP BY ALL),
{p}raw AS (
  SELECT query_id, document_id, version, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0)
         * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))), 9) AS raw_score
  FROM {p}qt JOIN {p}tf USING (term) JOIN {p}df USING (term) JOIN {p}lengths USING (document_id, version), {p}stats
  GROUP BY ALL)"""


def embedding_sql(text: str, dim: int = 256) -> str:
    raw = f"list_transform(range({dim}), lambda i: CAST('0x' || substr(md5({text} || ':' || i), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE * 2 - 1)"
    return raw


def unit_sql(raw: str) -> str:
    """Unit vector of an unnormalised one, given as a column name."""
    return f"list_transform({raw}, lambda x: x / sqrt(list_inner_product({raw}, {raw})))"


def near_sql(queries: str, corpus: str, skip: str = "FALSE") -> str:
    """``near``: score of every query and document; ``queries`` and ``corpus`` name tables with ``vec``."""
    return f"""near AS (
  SELECT q.query_id, d.document_id, d.version,
         round(greatest(0, least(1, (list_inner_product(q.vec, d.vec) + 1) / 2)), 9) AS score
  FROM {queries} q, {corpus} d WHERE NOT ({skip}))"""


# --- logs --------------------------------------------------------------------------------------------


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the number in their properties as ``k``."""
    e = table(spark, sf, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


EVENTS = "ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Request log: users are tenants, event types endpoints, errors server errors."""
    e = events(spark, sf)
    return e.select(
        F.concat(F.lit("req-"), F.lpad(F.col("event_id").cast("string"), 14, "0")).alias("request_id"),
        F.concat(F.lit("t"), "user_id").alias("tenant_id"),
        F.concat(F.lit("/v1/"), "event_type").alias("endpoint"),
        "ts",
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("response_status"),
        F.when(F.col("k") % 3 != 0, F.col("k")).alias("tokens_consumed"),
        (F.col("value") / 100.0).alias("duration_s"),
        "k",
        "event_id",
    )


REQUESTS = EVENTS + """,
requests AS (
  SELECT 'req-' || lpad(CAST(event_id AS VARCHAR), 14, '0') AS request_id, 't' || user_id AS tenant_id,
         '/v1/' || event_type AS endpoint, ts, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS response_status,
         CASE WHEN k % 3 <> 0 THEN k END AS tokens_consumed, value / 100.0::DOUBLE AS duration_s, k, event_id
  FROM ev)"""


def retried_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The request log with some requests delivered again a minute later."""
    r = requests(spark, sf)
    again = r.where("k < 20").withColumn("ts", later(F.col("ts"), mins=F.lit(1)))
    return r.unionByName(again)


RETRIED = REQUESTS + """,
retried AS (
  SELECT * FROM requests UNION ALL
  SELECT * REPLACE (ts + INTERVAL 1 MINUTE AS ts) FROM requests WHERE k < 20)"""


def busy_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The log replayed 2000 times as fast, against two requests a minute."""
    r = requests(spark, sf)
    return r.select("tenant_id", "endpoint", sped("ts", 2000).alias("ts"), "request_id", F.lit(2).alias("limit_per_minute"))


BUSY = REQUESTS + """,
busy AS (
  SELECT tenant_id, endpoint, request_id, 2 AS lim,
         1704067200000000 + (epoch_us(ts) - 1704067200000000) // 2000 AS us FROM requests)"""


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Indexing attempts: users are documents, views succeed, times run 1000 times as fast."""
    e = events(spark, sf)
    return e.select(
        F.concat(F.lit("https://example.org/u/"), "user_id").alias("key"),
        sped("ts", 500).alias("attempt_at"),
        F.col("event_id").alias("attempt_id"),
        ((F.col("event_type") == "view") & (F.col("k") < 40)).alias("ok"),
        F.concat(F.lit("failed: "), "event_type").alias("error"),
    )


ATTEMPTS = EVENTS + """,
attempts AS (
  SELECT 'https://example.org/u/' || user_id AS key, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 500 AS us,
         event_id AS attempt_id, event_type = 'view' AND k < 40 AS ok, 'failed: ' || event_type AS error FROM ev)"""


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    """Research job log: users are jobs; the event type decides the kind of event."""
    e = events(spark, sf)
    kind = (
        F.when(F.col("event_type") == "view", "step_started")
        .when(F.col("event_type") == "click", "step_completed")
        .when(F.col("event_type") == "signup", "citation")
        .when(F.col("event_type") == "purchase", "report_chunk")
        .when(F.col("k") < 3, "error")
        .when(F.col("k") < 8, "done")
        .otherwise("step_completed")
    )
    return e.select(
        F.col("user_id").alias("job_id"),
        F.col("event_id"),
        kind.alias("type"),
        F.concat(F.lit("finding "), F.col("k").cast("string")).alias("text"),
        F.when(kind == "error", F.when(F.col("k") == 1, "budget_exceeded").otherwise("internal_error")).alias("error_code"),
        F.col("ts").alias("emitted_at"),
        "k",
    )


JOB_EVENTS = EVENTS + """,
job_events AS (
  SELECT *, CASE WHEN type = 'error' THEN CASE WHEN k = 1 THEN 'budget_exceeded' ELSE 'internal_error' END END AS error_code
  FROM (SELECT user_id AS job_id, event_id, 'finding ' || k AS text, ts AS emitted_at, k,
               CASE event_type WHEN 'view' THEN 'step_started' WHEN 'click' THEN 'step_completed'
                    WHEN 'signup' THEN 'citation' WHEN 'purchase' THEN 'report_chunk'
                    ELSE CASE WHEN k < 3 THEN 'error' WHEN k < 8 THEN 'done' ELSE 'step_completed' END END AS type
        FROM ev))"""


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """One session per conversation; the number and length of turns decide tenant, age and retention."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars")
    )
    return c.select(
        F.col("conv_id").alias("session_id"),
        F.concat(F.lit("t"), (F.col("chars") % 7).cast("string")).alias("tenant_id"),
        later(start(), hours=(F.col("chars") % 1000).cast("int")).alias("created_at"),
        (F.col("chars") % 90 + 1).cast("int").alias("retention_days"),
        F.when(F.col("chars") % 13 == 0, "deleted").otherwise("active").alias("state"),
    )


SESSIONS = """sessions AS (
  SELECT conv_id AS session_id, 't' || chars % 7 AS tenant_id,
         TIMESTAMP '2024-01-01' + to_hours(CAST(chars % 1000 AS INT)) AS created_at,
         CAST(chars % 90 + 1 AS INT) AS retention_days, CASE WHEN chars % 13 = 0 THEN 'deleted' ELSE 'active' END AS state
  FROM (SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id))"""


def memory_additions(spark: SparkSession, sf: str) -> DataFrame:
    """What users' sessions cite, in order."""
    e = events(spark, sf)
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("pos"),
        F.concat(F.lit("d"), "k").alias("document_id"), F.lit(1).alias("version"),
        F.lit(0).alias("answer_start"), F.col("k").alias("answer_end"), F.lit(0).alias("source_start"),
        (F.col("k") + 1).alias("source_end"),
    )


ADDITIONS = EVENTS + """,
additions AS (
  SELECT user_id AS session_id, event_id AS pos, 'd' || k AS document_id, 1 AS version, 0 AS answer_start,
         k AS answer_end, 0 AS source_start, k + 1 AS source_end FROM ev)"""


# --- answers -----------------------------------------------------------------------------------------


def retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of a conversation, as the documents its answers may cite."""
    c = table(spark, sf, "conversations")
    return c.select(
        F.col("conv_id").alias("answer_id"), F.concat(F.lit("turn-"), "turn").alias("document_id"), F.lit(1).alias("version"),
        F.concat(F.lit("https://example.org/c/"), "conv_id", F.lit("/"), "turn").alias("url"),
        F.substring("text", 1, 40).alias("title"), F.col("text").alias("cleaned_text"), (F.col("turn") + 1).alias("rank"),
        F.col("conv_id").alias("query_id"),
    )


RETRIEVAL = """retrieval AS (
  SELECT conv_id AS answer_id, 'turn-' || turn AS document_id, 1 AS version,
         'https://example.org/c/' || conv_id || '/' || turn AS url, substr(text, 1, 40) AS title,
         text AS cleaned_text, turn + 1 AS rank, conv_id AS query_id FROM conversations)"""


def answer_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as token streams: the words of a conversation's last turn, each with the blank before it."""
    c = table(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    tokens = F.regexp_extract_all("text", F.lit(r"( ?[^ ]+)"), 1)
    return last.select(F.col("conv_id").alias("answer_id"), F.posexplode(tokens).alias("idx", "token"))


TOKENS = """last_turn AS (
  SELECT conv_id AS answer_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id),
tokens AS (
  SELECT answer_id, generate_subscripts(t, 1) - 1 AS idx, unnest(t) AS token
  FROM (SELECT answer_id, regexp_extract_all(text, ' ?[^ ]+') AS t FROM last_turn))"""
