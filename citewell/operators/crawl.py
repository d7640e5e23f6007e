"""Crawl rules: opt-outs, robots.txt, the fetch gate and politeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.functions import urls
from citewell.functions.text import strip
from citewell.operators.ordered import running, segment_of, top_n
from citewell.sources.tables import cut

MIN_DELAY = 1.0

_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_RULES = "array<struct<agent:string,pattern:string,ordinal:int>>"


def opt_out_active(url_rows: DataFrame, opt_outs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Add ``opted_out``: the first registration of the URL's domain is at least a day old."""
    first = (
        opt_outs.groupBy(F.lower(F.trim("domain")).alias("_domain")).agg(F.min("registered_at").alias("_since"))
    )
    rows = url_rows.withColumn("domain", urls.registrable_domain(urls.host(F.col("url"))))
    joined = rows.join(first, F.col("domain") == F.col("_domain"), "left")
    active = now >= F.col("_since") + F.make_dt_interval(hours=F.lit(hours))
    return joined.withColumn("opted_out", F.coalesce(active, F.lit(False))).drop("_domain", "_since")


def robots_rules(body: Column) -> Column:
    """Disallow rules and crawl delay of one robots.txt as a struct.

    A group ends at the next user-agent line after any rule with a value or any allow line; a group with
    only an empty disallow stays open, so its agents share the next group's rules. The body is one value
    of one row, so it is folded where it lies.
    """
    lines = F.transform(F.split(body, _LINE_END), lambda raw: strip(F.substring_index(raw, "#", 1)))
    directives = F.transform(
        F.filter(lines, lambda line: line.contains(":")),
        lambda line: F.struct(
            F.lower(strip(F.substring_index(line, ":", 1))).alias("name"),
            strip(F.regexp_replace(line, "(?s)^[^:]*:", "")).alias("value"),
        ),
    )
    none = F.array().cast("array<string>")
    start = F.struct(
        none.alias("agents"), none.alias("paths"), F.lit(False).alias("allows"),
        F.array().cast(_RULES).alias("rules"), F.lit(None).cast("double").alias("delay"),
    )

    def closed(acc):
        pairs = F.flatten(
            F.transform(
                acc["agents"],
                lambda agent: F.transform(
                    acc["paths"],
                    lambda path, i: F.struct(F.lower(agent).alias("agent"), path.alias("pattern"),
                                             (F.size(acc["rules"]) + i).cast("int").alias("ordinal")),
                ),
            )
        )
        return F.concat(acc["rules"], pairs).cast(_RULES)

    def step(acc, d):
        agent_line = d["name"] == "user-agent"
        rule_line = d["name"].isin("disallow", "allow")
        ends_group = agent_line & (F.size(acc["agents"]) > 0) & ((F.size(acc["paths"]) > 0) | acc["allows"])
        agents = F.when(ends_group, none).otherwise(acc["agents"])
        agents = (
            F.when(agent_line, F.array_append(agents, d["value"]))
            .when(rule_line & (F.size(agents) == 0), F.array(F.lit("*")))
            .otherwise(agents)
        )
        paths = F.when(ends_group, none).otherwise(acc["paths"])
        paths = F.when((d["name"] == "disallow") & (d["value"] != ""), F.array_append(paths, d["value"])).otherwise(paths)
        number = F.when(d["value"].rlike(_NUMBER), d["value"]).try_cast("double")
        return F.struct(
            agents.alias("agents"),
            paths.alias("paths"),
            F.when(ends_group, F.lit(False)).otherwise(acc["allows"] | (d["name"] == "allow")).alias("allows"),
            F.when(ends_group, closed(acc)).otherwise(acc["rules"]).alias("rules"),
            F.when(d["name"] == "crawl-delay", F.coalesce(number, acc["delay"])).otherwise(acc["delay"]).alias("delay"),
        )

    return F.aggregate(
        directives, start, step,
        lambda acc: F.struct(closed(acc).alias("rules"), acc["delay"].alias("crawl_delay")),
    )


def parse_robots(fetches: DataFrame) -> DataFrame:
    """One row per rule of each fetched robots.txt ``(host, fetched_at, status, body)``."""
    parsed = fetches.withColumn("_p", robots_rules(F.col("body")))
    return parsed.select("host", "fetched_at", F.col("_p.crawl_delay").alias("crawl_delay"), F.inline("_p.rules"))


def robots_availability(fetches: DataFrame) -> DataFrame:
    """Server errors and missing answers make robots.txt unavailable; client errors mean no rules."""
    available = F.col("status").isNotNull() & (F.col("status") < 500)
    body = F.when(available & (F.col("status") < 400), F.coalesce("body", F.lit(""))).otherwise("")
    return fetches.withColumn("available", available).withColumn("body", body)


def path_matches(path: Column, pattern: Column) -> Column:
    """Disallow pattern match: prefix, ``*`` and a final ``$``.

    Pieces between stars are found leftmost-first without backtracking, and ``$`` then asks whether the
    last piece found ends the path.
    """
    anchored = pattern.endswith("$")
    base = F.when(anchored, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    pieces = F.split(base, r"\*")
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"), F.lit(0).alias("i"))

    def step(acc, piece):
        # locate() finds nothing from past the end, like the empty rest of the path.
        hit = F.call_function("locate", piece, path, acc["at"] + 1)
        at_start = (acc["i"] > 0) | (hit == 1)
        ok = acc["ok"] & ((piece == "") | ((hit > 0) & at_start))
        at = F.when((piece == "") | (hit == 0), acc["at"]).otherwise(hit - 1 + F.length(piece))
        return F.struct(at.cast("int").alias("at"), ok.alias("ok"), (acc["i"] + 1).alias("i"))

    wild = F.aggregate(pieces, start, step, lambda acc: acc["ok"] & (~anchored | (acc["at"] == F.length(path))))
    return (
        F.when(pattern == "", F.lit(False))
        .when(base.contains("*"), wild)
        .when(anchored, path == base)
        .otherwise(path.startswith(pattern))
    )


def match_robots(url_rows: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Add ``allowed``. An agent with rules of its own follows those only, others follow ``*``.

    URLs meet rules by host. A host with many URLs and many rules is handled by its URLs: rule lists are
    packed per host, so a URL row is joined once and never multiplied.
    """
    mine = rules.where(F.col("agent").isin(agent.lower(), "*"))
    packed = mine.groupBy("host").agg(
        F.collect_set(F.when(F.col("agent") == agent.lower(), F.col("pattern"))).alias("_own"),
        F.collect_set(F.when(F.col("agent") == "*", F.col("pattern"))).alias("_any"),
    )
    rows = url_rows.withColumn("host", urls.host(F.col("url"))).withColumn("path", urls.path(F.col("url")))
    joined = rows.join(packed, "host", "left")
    applicable = F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("_any"))
    blocked = F.exists(applicable, lambda p: path_matches(F.col("path"), p))
    return joined.withColumn("allowed", ~F.coalesce(blocked, F.lit(False))).drop("_own", "_any")


def robots_as_of(url_rows: DataFrame, fetches: DataFrame, hours: int = 24, at: str = "requested_at") -> DataFrame:
    """Attach to each request the newest robots fetch of its host made before it and under a day old.

    As-of join without pairs: requests and fetches are laid in one time line per host and the last fetch
    is carried forward, segment by segment, so a busy host is spread over many tasks.
    """
    rows = url_rows.withColumn("host", urls.host(F.col("url")))
    usable = robots_availability(fetches).select(
        "host", F.col("fetched_at").alias("_at"), F.struct("available", "body", "fetched_at").alias("_fetch")
    )
    line = rows.withColumn("_at", F.col(at)).withColumn("_kind", F.lit(1)).unionByName(
        usable.withColumn("_kind", F.lit(0)), allowMissingColumns=True
    )
    # Later fetches are larger in time, so the last fetch so far is a running maximum.
    known = cut(line.withColumn("_f", F.when(F.col("_kind") == 0, F.col("_fetch.fetched_at"))).drop("_fetch"), "timeline")
    # Ties: a fetch at the request's own time counts as made before it, so fetches sort first.
    carried = running(
        known, ["host"], ["_at", "_kind"], segment_of(known, "_at"),
        peak_before={"_last": "_f"}, stored=True,
    ).where(F.col("_kind") == 1)
    fresh = F.col("_last") > F.col(at) - F.make_dt_interval(hours=F.lit(hours))
    keyed = carried.drop("_f", "_kind", "_at").withColumn("_last", F.when(fresh, F.col("_last")))
    # A host fetched twice at one instant has one answer, so a request stays one row.
    versions = usable.groupBy(F.col("host").alias("_h"), F.col("_fetch.fetched_at").alias("_l")).agg(
        F.max(F.struct("_fetch.available", "_fetch.body")).alias("_v")
    ).select("_h", "_l", "_v.available", "_v.body")
    joined = keyed.join(versions, (F.col("host") == F.col("_h")) & (F.col("_last") == F.col("_l")), "left")
    return joined.withColumnRenamed("_last", "robots_fetched_at").drop("_h", "_l")


def fetch_gate(
    url_rows: DataFrame, opt_outs: DataFrame, fetches: DataFrame, agent: str, now: Column
) -> DataFrame:
    """Decide each URL: opted out, robots unavailable, disallowed or allowed, with the delay to keep."""
    latest = top_n(robots_availability(fetches), ["host"], [F.desc("fetched_at")], 1, "_r").drop("_r")
    rows = opt_out_active(url_rows, opt_outs, now)
    known = latest.select("host", "available", robots_rules(F.col("body")).alias("_p"))
    rules = known.select("host", F.inline("_p.rules"))
    checked = match_robots(rows, rules, agent).join(
        known.select("host", "available", F.col("_p.crawl_delay").alias("crawl_delay")), "host", "left"
    )
    reason = (
        F.when(F.col("opted_out"), "domain_opted_out")
        .when(~F.coalesce("available", F.lit(False)), "robots_unavailable")
        .when(~F.col("allowed"), "disallowed_by_robots")
        .otherwise("allowed")
    )
    return checked.withColumn("decision", reason).withColumn("effective_delay", effective_delay(F.col("crawl_delay")))


def gate_audit(decisions: DataFrame, agent: str) -> DataFrame:
    """Audit rows of the skipped URLs."""
    detail = (
        F.when(F.col("decision") == "domain_opted_out", F.to_json(F.struct("domain", "url")))
        .when(F.col("decision") == "robots_unavailable", F.to_json(F.struct("host")))
        .otherwise(F.to_json(F.struct("host", "path", F.lit(agent).alias("user_agent"))))
    )
    return decisions.where(F.col("decision") != "allowed").select(
        F.col("decision").alias("action"), F.lit("crawler").alias("actor"), F.col("url").alias("resource"),
        detail.alias("detail"),
    )


def effective_delay(delay: Column) -> Column:
    """Seconds between requests to a host: at least one."""
    return F.greatest(F.coalesce(delay.cast("double"), F.lit(MIN_DELAY)), F.lit(MIN_DELAY))


def effective_concurrency(requested: Column) -> Column:
    """Requests in flight per host: one to eight, two unless asked."""
    return F.greatest(F.lit(1), F.least(F.lit(8), F.coalesce(requested.cast("int"), F.lit(2))))


def politeness(fetch_log: DataFrame, segment_seconds: int | None = None) -> DataFrame:
    """Per fetch ``(host, fetch_id, started_at, ended_at)``: seconds since the last completion before it
    was started and fetches in flight at its start, itself included.

    Starts and ends are edges on one time line; counts and the last end are running values over it.
    """
    edge = lambda at, step: fetch_log.select(
        "host", "fetch_id", F.col(at).alias("at"), F.lit(step).alias("step")
    )
    # At one instant ends (-1) come before starts (+1).
    edges = edge("started_at", 1).unionByName(edge("ended_at", -1))
    edges = edges.withColumn("_end", F.when(F.col("step") == -1, F.col("at")))
    segment = segment_of(fetch_log, "started_at", segment_seconds, of="at")
    line = running(
        edges, ["host"], ["at", "step", "fetch_id"], segment,
        total={"in_flight": "step"}, peak_before={"_last_end": "_end"},
    )
    starts = line.where(F.col("step") == 1)
    gap = (F.unix_micros("at") - F.unix_micros("_last_end")) / 1e6
    return starts.select("host", "fetch_id", F.col("at").alias("started_at"), gap.alias("gap_seconds"), "in_flight")
