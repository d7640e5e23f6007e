"""Research job logs: event order, replay, retention, budgets and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.operators.ordered import id_segment, position, running, segment_of, top_n

TERMINAL = ["done", "error"]
WIDTH = 100_000


def number_events(events: DataFrame, order: list[str], segment: Column | None = None) -> DataFrame:
    """Assign strictly increasing event ids per job in the given order."""
    if segment is None:
        segment = segment_of(events, order[0])
    return position(events, ["job_id"], order, segment, "event_id")


def order_violations(events: DataFrame, arrival: list[str], segment: Column) -> DataFrame:
    """Events whose id is not above every earlier arrival's id of their job."""
    checked = running(events, ["job_id"], arrival, segment, peak_before={"highest_before": "event_id"})
    return checked.where(F.col("event_id") <= F.col("highest_before"))


def replay(events: DataFrame, resumes: DataFrame) -> DataFrame:
    """Events after each job's ``last_event_id``; all of them where it is NULL."""
    joined = events.join(resumes.select("job_id", "last_event_id"), "job_id")
    after = F.col("last_event_id").isNull() | (F.col("event_id") > F.col("last_event_id"))
    return joined.where(after).drop("last_event_id")


def retained_events(events: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Events of jobs that have not ended, or ended at most a day ago."""
    ended = events.where(F.col("type").isin(TERMINAL)).groupBy("job_id").agg(F.max("emitted_at").alias("_end"))
    gone = ended.where(F.col("_end") < now - F.make_dt_interval(hours=F.lit(hours)))
    return events.join(gone.select("job_id"), "job_id", "left_anti")


def budget_stops(steps: DataFrame, budgets: DataFrame, width: int = WIDTH) -> DataFrame:
    """First step of each job that its budget does not allow, with the reason.

    steps: (job_id, step_no, checked_at, tool_calls); budgets: (job_id, started_at, max_steps,
    max_duration_ms, max_tool_calls). A limit stops the step once the steps before have reached it.
    """
    counted = running(
        steps.withColumn("_one", F.lit(1)), ["job_id"], ["step_no"], id_segment(F.col("step_no"), width),
        total={"_steps": "_one", "_calls": "tool_calls"},
    )
    used = counted.withColumn("_steps", F.col("_steps") - 1).withColumn("_calls", F.col("_calls") - F.col("tool_calls"))
    joined = used.join(budgets, "job_id")
    elapsed = F.floor((F.unix_micros("checked_at") - F.unix_micros("started_at")) / 1000)
    checks = [
        ("max_steps", F.col("_steps"), F.col("max_steps")),
        ("max_duration_ms", elapsed, F.col("max_duration_ms")),
        ("max_tool_calls", F.col("_calls"), F.col("max_tool_calls")),
    ]
    reason, current, limit = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for name, value, most in reversed(checks):
        hit = value >= most
        reason = F.when(hit, name).otherwise(reason)
        current = F.when(hit, value.cast("long")).otherwise(current)
        limit = F.when(hit, most.cast("long")).otherwise(limit)
    stopped = joined.select("job_id", "step_no", reason.alias("reason"), current.alias("current_value"), limit.alias("limit_value"))
    return top_n(stopped.where(F.col("reason").isNotNull()), ["job_id"], [F.col("step_no")], 1, "_r").drop("_r")


def job_reports(events: DataFrame) -> DataFrame:
    """Report of each job from its chunk and citation events, in event order.

    A job that ran into its budget or failed has a partial report; one without chunks that ended well
    says so. A report is one document, as long as a job's own plan of at most 32 steps makes it.
    """
    budget = F.col("error_code") == "budget_exceeded"
    chunk = F.when(F.col("type") == "report_chunk", F.struct("event_id", "text"))
    rolled = events.groupBy("job_id").agg(
        F.array_sort(F.collect_list(chunk)).alias("_chunks"),
        F.count_if(F.col("type") == "citation").alias("citation_count"),
        F.bool_or((F.col("type") == "error") & budget).alias("_budget"),
        F.bool_or((F.col("type") == "error") & ~F.coalesce(budget, F.lit(False))).alias("_failed"),
    )
    body = F.array_join(F.transform("_chunks", lambda c: c["text"]), "\n\n")
    failed, partial = F.coalesce("_failed", F.lit(False)), F.coalesce("_budget", F.lit(False))
    text = (
        F.when(failed, F.lit("")).when((F.size("_chunks") == 0) & ~partial, F.lit("Research complete.")).otherwise(body)
    )
    return rolled.select(
        "job_id", text.alias("text"),
        F.when(failed, F.lit(0)).otherwise(F.col("citation_count")).cast("long").alias("citation_count"),
        (failed | partial).alias("is_partial"),
    )


def read_step(retrieved: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Citations and text of reading each job's last n retrieved documents ``(job_id, pos, ...)``."""
    last = top_n(retrieved, ["job_id"], [F.desc("pos")], n, "_r").drop("_r")
    body = F.coalesce("cleaned_text", F.lit(""))
    citations = last.select(
        "job_id", "pos", "document_id", "version", F.lit(0).alias("answer_start"), F.lit(50).alias("answer_end"),
        F.lit(0).alias("source_start"), F.least(F.lit(50), F.length(body)).alias("source_end"),
    )
    line = F.concat(F.lit("From "), F.coalesce("title", F.lit("unknown")), F.lit(": "), F.substring(body, 1, 100))
    lines = last.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("_l"))
    return citations, lines.select("job_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))


def synthesis(jobs: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Closing line of each job from the number of documents it retrieved."""
    counts = retrieved.groupBy("job_id").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    ending = F.when(
        n > 0, F.concat(F.lit("analysis of "), n.cast("string"), F.lit(" documents reveals the following findings."))
    ).otherwise("no relevant documents were found.")
    joined = jobs.select("job_id").join(counts, "job_id", "left")
    return joined.select("job_id", F.concat(F.lit("Based on the research conducted, "), ending).alias("text"))


def job_states(events: DataFrame) -> DataFrame:
    """State of each job from its last event."""
    last = events.groupBy("job_id").agg(F.max_by(F.struct("type", "error_code"), "event_id").alias("_last"))
    kind, code = F.col("_last.type"), F.col("_last.error_code")
    state = (
        F.when(kind == "done", "succeeded")
        .when((kind == "error") & (code == "budget_exceeded"), "budget_exceeded")
        .when(kind == "error", "failed")
        .otherwise("running")
    )
    return last.select("job_id", state.alias("state"))


def missing_fields(reports: DataFrame, required: list[str], payload: str = "payload") -> DataFrame:
    """Add the required top-level fields a report's JSON payload lacks."""
    fields = F.map_keys(F.from_json(payload, "map<string,string>"))
    wanted = F.array(*[F.lit(f) for f in required])
    return reports.withColumn("missing", F.array_except(wanted, F.coalesce(fields, F.array().cast("array<string>"))))
