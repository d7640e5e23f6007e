"""Metering, rate limits, counters, histograms, percentiles, alerts and session memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell.operators import sessions, usage
from citewell.plans import inputs as i
from citewell.plans.catalog import query
from citewell.sources.tables import cut

def now():
    return i.later(i.start(), days=F.lit(45))



@query("M1_billable", i.cte(i.REQUESTS, select="SELECT request_id, response_status FROM requests WHERE response_status BETWEEN 200 AND 299"))
def billable(spark, sf):
    return usage.billable(i.requests(spark, sf)).select("request_id", "response_status")


@query(
    "M2_dedup_metering",
    i.cte(
        i.RETRIED,
        select="""SELECT 'meter:' || request_id AS dedup_key, tenant_id, endpoint, epoch_us(min(ts)) AS us, coalesce(any_value(tokens_consumed), 0) AS tokens
        FROM retried WHERE response_status BETWEEN 200 AND 299 GROUP BY ALL""",
    ),
)
def dedup_metering(spark, sf):
    kept = usage.dedup_metering(i.retried_requests(spark, sf))
    return kept.select("dedup_key", "tenant_id", "endpoint", F.unix_micros("ts").alias("us"), F.coalesce("tokens_consumed", F.lit(0)).alias("tokens"))


# A request at a time: refill, then take a token if there is one.
BUCKETS = "WITH RECURSIVE " + i.BUSY + """,
ordered AS (SELECT *, us / 1e6 AS now, row_number() OVER (PARTITION BY tenant_id, endpoint ORDER BY us, request_id) AS rn FROM busy),
walk AS (
  SELECT tenant_id, endpoint, request_id, rn, lim, now, CAST(lim AS DOUBLE) - 1 AS tokens, TRUE AS allowed FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.tenant_id, o.endpoint, o.request_id, o.rn, o.lim, o.now,
         least(o.lim, w.tokens + (o.now - w.now) * (o.lim / 60.0::DOUBLE)) - CASE WHEN least(o.lim, w.tokens + (o.now - w.now) * (o.lim / 60.0::DOUBLE)) >= 1 THEN 1 ELSE 0 END,
         least(o.lim, w.tokens + (o.now - w.now) * (o.lim / 60.0::DOUBLE)) >= 1
  FROM walk w JOIN ordered o ON o.tenant_id = w.tenant_id AND o.endpoint = w.endpoint AND o.rn = w.rn + 1)"""


def limited(spark, sf):
    return usage.token_bucket(cut(i.busy_requests(spark, sf)), 60)


@query(
    "M3_token_bucket",
    BUCKETS + """SELECT request_id, allowed, CAST(CASE WHEN allowed THEN floor(tokens) ELSE 0 END AS BIGINT) AS remaining,
      CAST(CASE WHEN lim - tokens > 0 THEN ceil(now + (lim - tokens) / (lim / 60.0::DOUBLE)) ELSE ceil(now) END AS BIGINT) AS reset_at,
      CAST(CASE WHEN allowed THEN -1 ELSE ceil((1 - tokens) / (lim / 60.0::DOUBLE)) END AS BIGINT) AS retry_after FROM walk""",
)
def token_bucket(spark, sf):
    return limited(spark, sf).select("request_id", "allowed", "remaining", "reset_at", "retry_after")


@query("G4_request_counts", i.cte(i.REQUESTS, select="SELECT endpoint, response_status, count(*) AS requests FROM requests GROUP BY ALL"))
def request_counts(spark, sf):
    return usage.request_counts(i.requests(spark, sf), ["endpoint", "response_status"])


@query("G5_rejections", BUCKETS + "SELECT tenant_id, count(*) AS requests FROM walk WHERE NOT allowed GROUP BY tenant_id")
def rejections(spark, sf):
    return usage.request_counts(limited(spark, sf).where(~F.col("allowed")), ["tenant_id"])


def BUCKET_SQL(by: str, bounds, source: str = "requests") -> str:
    rows = "\nUNION ALL ".join(
        f"SELECT {by}, {n} AS bucket, {b}::DOUBLE AS le, count(*) FILTER (duration_s <= {b}) AS cumulative FROM {source} GROUP BY ALL"
        for n, b in enumerate(bounds)
    )
    return rows + f"\nUNION ALL SELECT {by}, {len(bounds)}, 'infinity'::DOUBLE, count(*) FROM {source} GROUP BY ALL"


HTTP = usage.BUCKETS["http"]


@query("G6_latency_histogram", i.cte(i.REQUESTS, f"h AS ({BUCKET_SQL('endpoint', HTTP)})", select="SELECT endpoint, bucket, cumulative FROM h"))
def latency_histogram(spark, sf):
    return usage.histogram(i.requests(spark, sf), ["endpoint"], "duration_s", HTTP).select("endpoint", "bucket", "cumulative")


@query(
    "G7_latency_percentiles",
    i.cte(
        i.REQUESTS,
        """packed AS (SELECT tenant_id, list(duration_s ORDER BY duration_s) AS l, count(*) AS n, avg(duration_s) AS mean,
          count(*) FILTER (response_status >= 500) AS errors FROM requests GROUP BY tenant_id)""",
        select="""SELECT tenant_id, round(l[CAST(least(floor(n * 0.5::DOUBLE), n - 1) AS BIGINT) + 1], 6) AS p50,
          round(l[CAST(least(floor(n * 0.95::DOUBLE), n - 1) AS BIGINT) + 1], 6) AS p95,
          round(l[CAST(least(floor(n * 0.99::DOUBLE), n - 1) AS BIGINT) + 1], 6) AS p99,
          n AS requests, round(mean, 6) AS mean, errors, round((n - errors) / CAST(n AS DOUBLE), 6) AS success_rate FROM packed""",
    ),
)
def latency_percentiles(spark, sf):
    r = i.requests(spark, sf)
    found = usage.latency_percentiles(r, ["tenant_id"], "duration_s", F.floor(F.col("duration_s") * 10))
    return found.select(
        "tenant_id", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")], "requests", F.round("mean", 6).alias("mean"), "errors",
        F.round("success_rate", 6).alias("success_rate"),
    )


@query(
    "G8_histogram_quantile",
    i.cte(
        i.REQUESTS, f"h AS ({BUCKET_SQL('endpoint, date_trunc($$day$$, ts) AS day', HTTP)})",
        """steps AS (SELECT *, lag(le, 1, 0) OVER w AS low, lag(cumulative, 1, 0) OVER w AS passed, max(cumulative) OVER (PARTITION BY endpoint, day) AS total
          FROM h WINDOW w AS (PARTITION BY endpoint, day ORDER BY le)),
        hit AS (SELECT * FROM steps WHERE cumulative >= 0.95 * total QUALIFY row_number() OVER (PARTITION BY endpoint, day ORDER BY le) = 1)""",
        select="""SELECT endpoint, strftime(day, '%Y-%m-%d') AS day, round(CASE WHEN isinf(le) THEN low
          ELSE low + (le - low) * (0.95::DOUBLE * total - passed) / (cumulative - passed) END, 6) AS quantile FROM hit""",
    ),
)
def histogram_quantile(spark, sf):
    """95th percentile per endpoint and day, estimated from buckets."""
    r = i.requests(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    buckets = usage.histogram(r, ["endpoint", "day"], "duration_s", HTTP)
    found = usage.histogram_quantile(buckets, ["endpoint", "day"], 0.95)
    return found.withColumn("quantile", F.round("quantile", 6))


@query(
    "G9_gauges",
    i.cte(
        i.EVENTS,
        select="""SELECT round(avg(CAST(k < 30 AS INT)), 6) AS cache_hit_ratio, count(*) FILTER (event_type IN ('view', 'click')) AS active_jobs,
        count(DISTINCT user_id) AS documents FROM ev""",
    ),
)
def gauges(spark, sf):
    e = i.events(spark, sf)
    state = F.when(F.col("event_type") == "view", "planning").when(F.col("event_type") == "click", "running").otherwise("succeeded")
    measured = e.select((F.col("k") < 30).alias("cache_hit"), state.alias("job_state"), F.col("user_id").alias("document_id"))
    return usage.gauges(measured).withColumn("cache_hit_ratio", F.round("cache_hit_ratio", 6))


@query(
    "G11_usage_by_window",
    i.cte(
        i.REQUESTS,
        select=f"""SELECT tenant_id, endpoint, {i.TS_TEXT("date_trunc('day', ts)")} AS window_start, count(*) AS events,
        CAST(sum(coalesce(tokens_consumed, 0)) AS BIGINT) AS tokens FROM requests WHERE response_status < 300 GROUP BY tenant_id, endpoint, date_trunc('day', ts)""",
    ),
)
def usage_by_window(spark, sf):
    metered = usage.billable(i.requests(spark, sf))
    return usage.usage_by_window(metered, "1 day").withColumn("window_start", i.ts_text(F.col("window_start")))


@query("G12_distinct", i.cte(i.EVENTS, select="SELECT DISTINCT user_id, k FROM ev"))
def distinct(spark, sf):
    return i.events(spark, sf).select("user_id", "k").distinct()


# One pane per two hours here; windows of a day every two hours.
ALERTS = i.REQUESTS + """,
panes AS (
  SELECT endpoint, time_bucket(INTERVAL 2 HOUR, ts) AS pane, count(*) AS n, count(*) FILTER (k < 30) AS bad FROM requests GROUP BY ALL),
ends AS (SELECT DISTINCT endpoint, pane + (j + 1) * INTERVAL 2 HOUR AS moment FROM panes, (SELECT unnest(range(12)) AS j)),
windows AS (
  SELECT e.endpoint, e.moment, sum(n) AS n, sum(bad) AS bad FROM ends e JOIN panes p
    ON p.endpoint = e.endpoint AND p.pane >= e.moment - INTERVAL 24 HOUR AND p.pane < e.moment GROUP BY ALL)"""


def day_windows(spark, sf):
    r = i.requests(spark, sf).withColumn("bad_one", F.col("k") < 30)
    panes = usage.panes(r, ["endpoint"], "2 hours", n=F.lit(True), bad=F.col("bad_one"))
    return usage.sliding_sums(panes, ["endpoint"], ["n", "bad"], "24 hours", "2 hours")


@query(
    "W8_sustained_condition",
    i.cte(
        ALERTS,
        """flagged AS (SELECT *, bad / CAST(n AS DOUBLE) > 0.3 AS breached FROM windows),
        islands AS (SELECT *, sum(starts) OVER (PARTITION BY endpoint ORDER BY moment) AS island FROM (
          SELECT *, CASE WHEN breached AND coalesce(lag(breached) OVER w, FALSE) AND lag(moment) OVER w >= moment - INTERVAL 2 HOUR THEN 0 ELSE 1 END AS starts
          FROM flagged WINDOW w AS (PARTITION BY endpoint ORDER BY moment)))""",
        select=f"""SELECT endpoint, {i.TS_TEXT('moment')} AS evaluated_at, breached,
          breached AND moment - min(moment) OVER (PARTITION BY endpoint, island) >= INTERVAL 6 HOUR AS firing FROM islands""",
    ),
)
def sustained(spark, sf):
    flagged = day_windows(spark, sf).withColumn("breached", F.col("bad") / F.col("n") > 0.3)
    found = usage.sustained(flagged, ["endpoint"], 6 * 3600, every=2 * 3600, segment_seconds=86_400)
    return found.select("endpoint", i.ts_text(F.col("evaluated_at")).alias("evaluated_at"), "breached", "firing")


@query(
    "W8_sliding_windows",
    i.cte(ALERTS, select=f"SELECT endpoint, {i.TS_TEXT('moment')} AS evaluated_at, CAST(n AS BIGINT) AS n, CAST(bad AS BIGINT) AS bad FROM windows"),
)
def sliding(spark, sf):
    return day_windows(spark, sf).withColumn("evaluated_at", i.ts_text(F.col("evaluated_at")))


# --- sessions ----------------------------------------------------------------------------------------


@query(
    "N1_active_sessions",
    i.cte(
        i.SESSIONS,
        select=f"""SELECT session_id, {i.TS_TEXT('created_at + to_days(retention_days)')} AS expires_at FROM sessions
        WHERE state = 'active' AND TIMESTAMP '2024-02-15' < created_at + to_days(retention_days)""",
    ),
)
def active_sessions(spark, sf):
    found = sessions.active_sessions(i.sessions(spark, sf), now())
    return found.select("session_id", i.ts_text(F.col("expires_at")).alias("expires_at"))


def swept(spark, sf):
    memory = i.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    return sessions.expire_sessions(i.sessions(spark, sf), memory, now())


DUE = "state = 'active' AND TIMESTAMP '2024-02-15' >= created_at + to_days(retention_days)"


@query("N2_swept_states", i.cte(i.SESSIONS, select=f"SELECT session_id, CASE WHEN {DUE} THEN 'expired' ELSE state END AS state FROM sessions"))
def swept_states(spark, sf):
    return swept(spark, sf)[0].select("session_id", "state")


@query("N2_kept_memory", i.cte(i.SESSIONS, select=f"SELECT conv_id AS session_id, turn FROM conversations JOIN sessions ON session_id = conv_id WHERE NOT ({DUE})"))
def kept_memory(spark, sf):
    return swept(spark, sf)[1]


@query("N2_sweep_audit", i.cte(i.SESSIONS, select=f"SELECT 'session_expired' AS action, session_id AS resource, tenant_id FROM sessions WHERE {DUE}"))
def sweep_audit(spark, sf):
    return swept(spark, sf)[2].select("action", "resource", "tenant_id")


@query(
    "N3_recent_citations",
    i.cte(i.ADDITIONS, select="""SELECT session_id, pos, document_id, recency FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS recency FROM additions) WHERE recency <= 50"""),
)
def recent_citations(spark, sf):
    return sessions.recent_citations(i.memory_additions(spark, sf)).select("session_id", "pos", "document_id", "recency")


LAST_DOCS = """last_docs AS (SELECT * FROM (
  SELECT session_id, document_id, max(pos) AS pos, row_number() OVER (PARTITION BY session_id ORDER BY max(pos) DESC) AS recency
  FROM additions GROUP BY session_id, document_id) WHERE recency <= 20)"""


@query("N4_recent_documents", i.cte(i.ADDITIONS, LAST_DOCS, select="SELECT session_id, document_id, pos, recency FROM last_docs"))
def recent_documents(spark, sf):
    return sessions.recent_documents(i.memory_additions(spark, sf))


@query(
    "N5_session_context",
    i.cte(
        i.ADDITIONS, LAST_DOCS,
        """cited AS (SELECT session_id, string_agg(document_id || ':' || answer_end, ' ' ORDER BY pos) AS citations FROM (
          SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS recency FROM additions) WHERE recency <= 50 GROUP BY session_id)""",
        select="""SELECT session_id, citations, string_agg(document_id, ' ' ORDER BY pos) AS doc_ids FROM last_docs JOIN cited USING (session_id) GROUP BY ALL""",
    ),
)
def session_context(spark, sf):
    additions = i.memory_additions(spark, sf)
    packed = sessions.session_context(additions, additions)
    shown = F.transform("citations", lambda c: F.concat(c["document_id"], F.lit(":"), c["answer_end"].cast("string")))
    return packed.select("session_id", F.array_join(shown, " ").alias("citations"), F.array_join("doc_ids", " ").alias("doc_ids"))
