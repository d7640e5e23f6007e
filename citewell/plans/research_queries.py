"""Research job logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell.operators import research
from citewell.operators.ordered import id_segment
from citewell.plans import inputs as i
from citewell.plans.catalog import query

def now():
    return i.later(i.start(), days=F.lit(25))



@query(
    "W6_number_events",
    i.cte(i.JOB_EVENTS, select="SELECT job_id, text, row_number() OVER (PARTITION BY job_id ORDER BY emitted_at, e.event_id) AS event_id, e.event_id AS source FROM job_events e"),
)
def number_events(spark, sf):
    e = i.job_events(spark, sf).withColumnRenamed("event_id", "source")
    numbered = research.number_events(e, ["emitted_at", "source"])
    return numbered.select("job_id", "text", "event_id", "source")


# Ids that fall back now and then.
SHUFFLED = """shuffled AS (SELECT job_id, event_id - (k % 4) * 100 AS event_id, event_id AS arrival FROM job_events)"""


def shuffled(spark, sf):
    return i.job_events(spark, sf).select(
        "job_id", (F.col("event_id") - F.col("k") % 4 * 100).alias("event_id"), F.col("event_id").alias("arrival")
    )


@query(
    "W6_order_violations",
    i.cte(
        i.JOB_EVENTS, SHUFFLED,
        select="""SELECT job_id, event_id, arrival, highest AS highest_before FROM (
        SELECT *, max(event_id) OVER (PARTITION BY job_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM shuffled)
        WHERE event_id <= highest""",
    ),
)
def order_violations(spark, sf):
    return research.order_violations(shuffled(spark, sf), ["arrival"], id_segment(F.col("arrival"), 1000))


@query(
    "J1_replay",
    i.cte(
        i.JOB_EVENTS,
        """resumes AS (SELECT job_id, CASE WHEN job_id % 5 = 0 THEN NULL ELSE max(event_id) - count(*) * 20 END AS last_event_id FROM job_events GROUP BY job_id)""",
        select="SELECT job_id, event_id, type FROM job_events JOIN resumes USING (job_id) WHERE last_event_id IS NULL OR event_id > last_event_id",
    ),
)
def replay(spark, sf):
    """Clients of some jobs start over, the others resume."""
    e = i.job_events(spark, sf)
    resumes = e.groupBy("job_id").agg(F.max("event_id").alias("top"), F.count("*").alias("n")).select(
        "job_id", F.when(F.col("job_id") % 5 != 0, F.col("top") - F.col("n") * 20).alias("last_event_id")
    )
    return research.replay(e, resumes).select("job_id", "event_id", "type")


@query(
    "J2_retention",
    i.cte(
        i.JOB_EVENTS,
        select="""SELECT job_id, event_id FROM job_events WHERE job_id NOT IN (
        SELECT job_id FROM job_events WHERE type IN ('done', 'error') GROUP BY job_id HAVING max(emitted_at) < TIMESTAMP '2024-01-26' - INTERVAL 24 HOUR)""",
    ),
)
def retention(spark, sf):
    return research.retained_events(i.job_events(spark, sf), now()).select("job_id", "event_id")


@query(
    "J3_budget_stops",
    i.cte(
        i.EVENTS,
        """steps AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_no, ts AS checked_at, k % 3 AS tool_calls FROM ev),
        budgets AS (SELECT user_id AS job_id, min(ts) AS started_at, 10 + user_id % 40 AS max_steps, (user_id % 20 + 1) * 86400000 AS max_duration_ms,
                    5 + user_id % 25 AS max_tool_calls FROM ev GROUP BY user_id),
        used AS (SELECT *, step_no - 1 AS n, coalesce(sum(tool_calls) OVER (PARTITION BY job_id ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS calls,
                 (epoch_us(checked_at) - epoch_us(started_at)) // 1000 AS ms FROM steps JOIN budgets USING (job_id))""",
        select="""SELECT job_id, step_no, CASE WHEN n >= max_steps THEN 'max_steps' WHEN ms >= max_duration_ms THEN 'max_duration_ms' ELSE 'max_tool_calls' END AS reason,
          CAST(CASE WHEN n >= max_steps THEN n WHEN ms >= max_duration_ms THEN ms ELSE calls END AS BIGINT) AS current_value,
          CAST(CASE WHEN n >= max_steps THEN max_steps WHEN ms >= max_duration_ms THEN max_duration_ms ELSE max_tool_calls END AS BIGINT) AS limit_value
        FROM used WHERE n >= max_steps OR ms >= max_duration_ms OR calls >= max_tool_calls
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY step_no) = 1""",
    ),
)
def budget_stops(spark, sf):
    e = i.events(spark, sf)
    steps = research.number_events(
        e.select(F.col("user_id").alias("job_id"), F.col("ts").alias("checked_at"), "event_id", (F.col("k") % 3).alias("tool_calls")).withColumnRenamed("event_id", "source"),
        ["checked_at", "source"],
    ).withColumnRenamed("event_id", "step_no")
    user = F.col("user_id")
    budgets = e.groupBy("user_id").agg(F.min("ts").alias("started_at")).select(
        user.alias("job_id"), "started_at", (10 + user % 40).alias("max_steps"), ((user % 20 + 1) * 86_400_000).alias("max_duration_ms"),
        (5 + user % 25).alias("max_tool_calls"),
    )
    return research.budget_stops(steps, budgets)


REPORTS = """rolled AS (
  SELECT job_id, string_agg(text, chr(10) || chr(10) ORDER BY event_id) FILTER (type = 'report_chunk') AS body,
         count(*) FILTER (type = 'citation') AS citations, bool_or(coalesce(error_code = 'budget_exceeded', FALSE)) AS budget,
         bool_or(coalesce(error_code = 'internal_error', FALSE)) AS failed FROM job_events GROUP BY job_id)"""


@query(
    "J4_job_reports",
    i.cte(
        i.JOB_EVENTS, REPORTS,
        select="""SELECT job_id, CASE WHEN failed THEN '' WHEN body IS NULL AND NOT budget THEN 'Research complete.' ELSE coalesce(body, '') END AS text,
        CASE WHEN failed THEN 0 ELSE citations END AS citation_count, failed OR budget AS is_partial FROM rolled""",
    ),
)
def job_reports(spark, sf):
    return research.job_reports(i.job_events(spark, sf))


def retrieved(spark, sf):
    """The turns of a conversation as what its job retrieved; some have no text."""
    c = i.table(spark, sf, "conversations")
    return c.select(
        F.col("conv_id").alias("job_id"), F.col("turn").alias("pos"), F.concat(F.lit("turn-"), "turn").alias("document_id"), F.lit(1).alias("version"),
        F.when(F.col("role") != "system", F.substring("text", 1, 20)).alias("title"), F.when(F.length("text") % 5 != 0, F.col("text")).alias("cleaned_text"),
    )


LAST_READ = """last_read AS (
  SELECT conv_id AS job_id, turn AS pos, 'turn-' || turn AS document_id, CASE WHEN role <> 'system' THEN substr(text, 1, 20) END AS title,
         CASE WHEN length(text) % 5 <> 0 THEN text ELSE '' END AS body FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5)"""


@query(
    "J5_read_citations",
    i.cte(LAST_READ, select="SELECT job_id, pos, document_id, 0 AS answer_start, 50 AS answer_end, 0 AS source_start, CAST(least(50, length(body)) AS INT) AS source_end FROM last_read"),
)
def read_citations(spark, sf):
    return research.read_step(retrieved(spark, sf))[0].drop("version")


@query(
    "J5_read_text",
    i.cte(LAST_READ, select="SELECT job_id, string_agg('From ' || coalesce(title, 'unknown') || ': ' || substr(body, 1, 100), chr(10) ORDER BY pos) AS text FROM last_read GROUP BY job_id"),
)
def read_text(spark, sf):
    return research.read_step(retrieved(spark, sf))[1]


@query(
    "J6_synthesis",
    """SELECT doc_id AS job_id, 'Based on the research conducted, ' || CASE WHEN n > 0 THEN 'analysis of ' || n || ' documents reveals the following findings.'
      ELSE 'no relevant documents were found.' END AS text
    FROM documents LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) ON conv_id = doc_id""",
)
def synthesis(spark, sf):
    """Jobs are documents; those with a conversation of the same number retrieved something."""
    jobs = i.table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"))
    return research.synthesis(jobs, retrieved(spark, sf))


@query(
    "J7_job_states",
    i.cte(
        i.JOB_EVENTS,
        select="""SELECT job_id, CASE WHEN type = 'done' THEN 'succeeded' WHEN type = 'error' AND error_code = 'budget_exceeded' THEN 'budget_exceeded'
        WHEN type = 'error' THEN 'failed' ELSE 'running' END AS state FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY event_id DESC) = 1""",
    ),
)
def job_states(spark, sf):
    return research.job_states(i.job_events(spark, sf))


@query(
    "J8_missing_fields",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'text' ELSE 'text,total' END AS missing FROM events""",
)
def missing_fields(spark, sf):
    """The properties of an event as a report's payload, some with a total added."""
    e = i.table(spark, sf, "events")
    payload = F.when(F.col("event_type").isin("view", "click"), F.regexp_replace("props", r"\}$", ', "total": 1}')).otherwise(F.col("props"))
    checked = research.missing_fields(e.withColumn("payload", payload), ["k", "text", "total"])
    return checked.select("event_id", F.array_join("missing", ",").alias("missing"))


@query(
    "L4_first_in_first_out",
    i.cte(i.JOB_EVENTS, select="SELECT job_id, sha256(string_agg(type || ':' || text, ',' ORDER BY event_id)) AS log FROM job_events GROUP BY job_id"),
)
def first_in_first_out(spark, sf):
    packed = i.job_events(spark, sf).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "type", "text"))).alias("e"))
    lines = F.transform("e", lambda e: F.concat(e["type"], F.lit(":"), e["text"]))
    return packed.select("job_id", F.sha2(F.array_join(lines, ","), 256).alias("log"))
