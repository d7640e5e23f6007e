"""Steps, answers, crawl rules, usage, sessions, research, audit."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from citewell.functions import predicates as p
from citewell.operators import answers, audit, crawl, research, sessions, steps, usage

T0 = dt.datetime(2024, 1, 1)


def sec(n):
    return T0 + dt.timedelta(seconds=n)


# --- predicates and steps ----------------------------------------------------------------------------


def test_predicate_bounds(spark):
    with pytest.raises(p.FilterError):
        p.eq("author", "x")
    with pytest.raises(p.FilterError):
        p.eq("metadata", "x")
    with pytest.raises(p.FilterError):
        p.is_in("category", [])
    with pytest.raises(p.FilterError):
        p.is_in("category", ["x"] * 257)
    with pytest.raises(p.FilterError):
        p.eq("category", "x" * 1025)
    with pytest.raises(p.FilterError):
        p.eq("published_at", "yesterday")
    with pytest.raises(p.FilterError):
        p.any_of(*[p.eq("category", "x")] * 1025)
    tree = p.eq("category", "x")
    for _ in range(31):
        tree = p.not_(tree)
    with pytest.raises(p.FilterError):
        p.not_(tree)


def test_missing_values_are_not_selected_by_ne(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "category string")
    assert [r.category for r in rows.where(p.ne("category", "a").column).collect()] == ["b"]


def results(spark):
    sites = [("oak", "reeds.test/a", "Reed beds", 0.91), ("elm", "moor.test/b", "Moor walks", 0.84), ("fir", "reeds.test/c", "Heron rookeries", 0.52), ("ash", "dunes.test/d", "Dune grass", 0.5)]
    rows = [("q", k, name, f"https://{url}", title, score) for k, (name, url, title, score) in enumerate(sites)]
    return spark.createDataFrame(rows, "query_id string, position int, document_id string, url string, title string, score double")


def order(df):
    return [r.document_id for r in df.orderBy("position").collect()]


def test_steps(spark):
    r = results(spark).withColumn("provenance", F.struct(F.when(F.col("position") == 3, 1.0).alias("credibility_score")))
    assert order(steps.run_steps(r, [("domain_filter", {"domains": ["reeds"]})])) == ["oak", "fir"]
    assert order(steps.run_steps(r, ["domain_filter"])) == order(r)
    boosted = steps.run_steps(r, [("score_reranker", {"boost_factor": 1.75, "boost_domains": ["dunes"]})])
    assert order(boosted) == ["oak", "ash", "elm", "fir"] and boosted.where("score > 1").count() == 0
    assert order(steps.run_steps(r, [("credibility_reranker", {"credibility_weight": 0.9})]))[0] == "ash"
    assert [round(x.score, 6) for x in steps.run_steps(r, ["reciprocal_rank_reranker"]).orderBy("position").collect()][:2] == [round(1 / 61, 6), round(1 / 62, 6)]
    assert order(steps.run_steps(r, [("dedup_transform", {"field": "nothing"})])) == ["oak"]
    titled = steps.run_steps(r, [("title_transform", {"max_length": 4, "prefix": "a"})])
    assert {x.title for x in titled.collect()} == {"aRee", "aMoo", "aHer", "aDun"}


def test_step_lists_are_checked(spark):
    for bad in ([], ["snippet_transform"] * 21, ["no_such_step"]):
        with pytest.raises(steps.StepError):
            steps.define_steps(bad)
    named = steps.ordered_steps(steps.define_steps(["title_transform", "score_reranker", "domain_filter", "snippet_transform"]))
    assert [s.name for s, _ in named] == ["domain_filter", "score_reranker", "title_transform", "snippet_transform"]


# --- answers -----------------------------------------------------------------------------------------


def test_citations_while_streaming(spark):
    source = "The quick brown fox jumps over the lazy dog near the river bank today."
    words = ["The ", "quick ", "brown ", "fox ", "", "jumps ", "elsewhere"]
    tokens = spark.createDataFrame([(1, k, w) for k, w in enumerate(words)], "answer_id int, idx int, token string")
    retrieved = spark.createDataFrame([(1, "d", 1, source), (1, "d", 2, source), (1, "e", 1, "other")], "answer_id int, document_id string, version int, cleaned_text string")
    found = answers.detect_citations(tokens, retrieved, width=2)
    text, expected = "", set()
    for k, w in enumerate(words):
        text += w
        size = min(30, len(text))
        at = source.find(text[-size:]) if len(text) >= 10 else -1
        if at >= 0 and w:
            expected.add((k, "d", 1, len(text) - size, len(text), at, at + size))
    assert {tuple(r[c] for c in ("idx", "document_id", "version", "answer_start", "answer_end", "source_start", "source_end")) for r in found.collect()} == expected
    endings = spark.createDataFrame([(1, None), (2, None)], "answer_id int, failure string")
    done = {r.answer_id: r for r in answers.assemble_answers(tokens, found, retrieved, endings).collect()}
    assert done[1].answer == "".join(words) and done[1].citation_count == len(expected) and done[1].error_code is None
    assert done[2].error_code == "no_sources_available" and done[2].answer is None


# --- crawl -------------------------------------------------------------------------------------------

ROBOTS = {
    "User-agent: *\nDisallow: /drafts/\nDisallow: /basket": ([("*", "/drafts/"), ("*", "/basket")], None),
    "User-agent: A\nUser-agent: B\nDisallow: /x # note\nCrawl-delay: 5\nCrawl-delay: soon": ([("a", "/x"), ("b", "/x")], 5.0),
    "User-agent: a\nDisallow:\nUser-agent: b\nDisallow: /y": ([("a", "/y"), ("b", "/y")], None),
    "User-agent: a\nAllow: /\nUser-agent: b\nDisallow: /y": ([("b", "/y")], None),
    "Disallow: /z\r\nuser-agent: q": ([("*", "/z")], None),
    "garbage\n\n#only": ([], None),
}


def test_robots_parsing(spark):
    df = spark.createDataFrame([(b,) for b in ROBOTS], "b string").select("b", crawl.robots_rules(F.col("b")).alias("r"))
    for row in df.collect():
        assert ([(x.agent, x.pattern) for x in row.r.rules], row.r.crawl_delay) == ROBOTS[row.b]


@pytest.mark.parametrize(
    "path, pattern, hit",
    [
        ("/private/x", "/private", True), ("/x", "", False), ("/a/b.html", "/*.html$", True), ("/a.html?x", "/*.html$", False),
        ("aba", "*a$", False), ("ba", "*a$", True), ("/fr/", "/fr/$", True), ("/fr/x", "/fr/$", False), ("/x/y/z", "/x*z", True), ("/y/x", "x*", False),
        ("/ab", "*", True), ("/abc", "/a**c", True),
    ],
)
def test_path_patterns(spark, path, pattern, hit):
    df = spark.createDataFrame([(path, pattern)], "p string, q string")
    assert df.select(crawl.path_matches(F.col("p"), F.col("q"))).first()[0] is hit


def test_gate_order_and_own_rules(spark):
    urls = spark.createDataFrame([("https://a.gone.org/x",), ("https://b.ok.org/p",), ("https://c.ok.org/p",), ("https://d.ok.org/p",), ("https://e.ok.org/p",)], "url string")
    body = "User-agent: bot\nDisallow: /q\nUser-agent: *\nDisallow: /p\nCrawl-delay: 0.2"
    fetches = spark.createDataFrame(
        [("b.ok.org", T0, 503, ""), ("c.ok.org", T0, 200, body), ("d.ok.org", T0, 404, body), ("e.ok.org", T0, 200, "User-agent: *\nDisallow: /p")],
        "host string, fetched_at timestamp, status int, body string",
    )
    outs = spark.createDataFrame([(" GONE.org ", sec(0)), ("gone.org", sec(90_000))], "domain string, registered_at timestamp")
    got = crawl.fetch_gate(urls, outs, fetches, "Bot", F.lit(sec(86_400)))
    assert {r.host: (r.decision, r.effective_delay) for r in got.collect()} == {
        "a.gone.org": ("domain_opted_out", 1.0), "b.ok.org": ("robots_unavailable", 1.0), "c.ok.org": ("allowed", 1.0),
        "d.ok.org": ("allowed", 1.0), "e.ok.org": ("disallowed_by_robots", 1.0),
    }
    assert crawl.gate_audit(got, "Bot").count() == 3


# --- usage -------------------------------------------------------------------------------------------


def test_token_bucket_equals_a_walk_on_a_hot_key(spark):
    """One busy tenant, bursts and pauses; tiny segments so that runs cross them."""
    rng = random.Random(7)
    rows, now = [], 0.0
    for n in range(900):
        now += rng.choice([0.1, 0.5, 1.0, 3.0, 40.0, 70.0])
        tenant = "hot" if rng.random() < 0.8 else f"t{n % 5}"
        rows.append((tenant, "/s", T0 + dt.timedelta(milliseconds=int(now * 1000)), f"r{n:04d}", 5))
    df = spark.createDataFrame(rows, "tenant_id string, endpoint string, ts timestamp, request_id string, limit_per_minute int")
    expected, buckets = {}, {}
    for tenant, _, ts, rid, limit in rows:
        at = ts.replace(tzinfo=dt.timezone.utc).timestamp()
        tokens, last = buckets.get(tenant, (float(limit), at))
        tokens = min(limit, tokens + (at - last) * limit / 60)
        ok = tokens >= 1
        buckets[tenant] = (tokens - ok, at)
        expected[rid] = (ok, int(tokens - 1) if ok else 0)
    got = usage.token_bucket(df, segment_seconds=30)
    assert {r.request_id: (r.allowed, r.remaining) for r in got.collect()} == expected
    runs = usage._independent_runs(df, usage.time_segment(F.col("ts"), 30)).where("tenant_id = 'hot'").select("_run").distinct().count()
    assert runs > 50


def test_percentiles_histogram_and_quantile(spark):
    values = [float(v) for v in range(1, 101)] + [50.0] * 300
    df = spark.createDataFrame([("a", v, 200 if v < 90 else 500) for v in values], "g string, v double, response_status int")
    row = usage.latency_percentiles(df, ["g"], "v", F.floor("v")).first()
    ordered = sorted(values)
    assert (row.p50, row.p95, row.p99) == tuple(ordered[int(len(values) * q)] for q in (0.5, 0.95, 0.99))
    assert row.errors == 11 and row.success_rate == pytest.approx(389 / 400)
    buckets = usage.histogram(df, ["g"], "v", [10, 50, 80])
    assert [r.cumulative for r in buckets.orderBy("bucket").collect()] == [10, 350, 380, 400]
    assert usage.histogram_quantile(buckets, ["g"], 0.5).first()["quantile"] == pytest.approx(10 + 40 * (200 - 10) / 340)
    assert usage.histogram_quantile(buckets, ["g"], 0.99).first()["quantile"] == 80


def test_sustained_condition(spark):
    rows = [("g", sec(30 * n), n not in (3, 9)) for n in range(14) if n != 6]
    df = spark.createDataFrame(rows, "g string, evaluated_at timestamp, breached boolean")
    got = usage.sustained(df, ["g"], 60, every=30, segment_seconds=45)
    assert [int((r.evaluated_at - T0).total_seconds() / 30) for r in got.where("firing").orderBy("evaluated_at").collect()] == [2, 12, 13]


# --- sessions, research, audit -----------------------------------------------------------------------


def test_session_memory_and_expiry(spark):
    adds = spark.createDataFrame([(1, n, f"d{n % 25}" if n < 60 else "d0", 1, 0, 1, 0, 1) for n in range(61)],
                                 "session_id int, pos int, document_id string, version int, answer_start int, answer_end int, source_start int, source_end int")
    row = sessions.session_context(adds, adds).first()
    assert len(row.citations) == 50 and len(row.doc_ids) == 20 and row.doc_ids[-1] == "d0" and row.doc_ids.count("d0") == 1
    table = spark.createDataFrame([(1, "t", T0, 1, "active"), (2, "t", T0, 2, "active"), (3, "t", T0, 1, "deleted")],
                                  "session_id int, tenant_id string, created_at timestamp, retention_days int, state string")
    memory = spark.createDataFrame([(1, "m"), (2, "m")], "session_id int, v string")
    after, kept, trail = sessions.expire_sessions(table, memory, F.lit(sec(86_400)))
    assert {r.session_id: r.state for r in after.collect()} == {1: "expired", 2: "active", 3: "deleted"}
    assert [r.session_id for r in kept.collect()] == [2] and [r.resource for r in trail.collect()] == [1]
    assert [r.session_id for r in sessions.active_sessions(table, F.lit(sec(86_400))).collect()] == [2]


def test_job_logs(spark):
    log = [
        (1, 1, "step_started", None, None), (1, 2, "report_chunk", "b", None), (1, 10, "report_chunk", "a", None), (1, 11, "citation", None, None), (1, 12, "done", None, None),
        (2, 1, "report_chunk", "x", None), (2, 2, "error", None, "budget_exceeded"), (3, 1, "error", None, "internal_error"), (4, 1, "done", None, None), (5, 1, "step_started", None, None),
    ]
    df = spark.createDataFrame([(*r, T0) for r in log], "job_id int, event_id int, type string, text string, error_code string, emitted_at timestamp")
    reports = {r.job_id: (r.text, r.citation_count, r.is_partial) for r in research.job_reports(df).collect()}
    assert reports == {1: ("b\n\na", 1, False), 2: ("x", 0, True), 3: ("", 0, True), 4: ("Research complete.", 0, False), 5: ("Research complete.", 0, False)}
    states = {r.job_id: r.state for r in research.job_states(df).collect()}
    assert states == {1: "succeeded", 2: "budget_exceeded", 3: "failed", 4: "succeeded", 5: "running"}
    kept = research.retained_events(df, F.lit(sec(86_401)))
    assert {r.job_id for r in kept.collect()} == {5}


def test_budget_reasons_in_order(spark):
    steps_df = spark.createDataFrame([(j, n, sec(n), 1) for j in (1, 2, 3) for n in range(1, 6)], "job_id int, step_no int, checked_at timestamp, tool_calls int")
    budgets = spark.createDataFrame([(1, T0, 2, 10**9, 2), (2, T0, 99, 4000, 99), (3, T0, 99, 10**9, 3)], "job_id int, started_at timestamp, max_steps int, max_duration_ms bigint, max_tool_calls int")
    got = {r.job_id: (r.step_no, r.reason, r.current_value) for r in research.budget_stops(steps_df, budgets, width=2).collect()}
    assert got == {1: (3, "max_steps", 2), 2: (4, "max_duration_ms", 4000), 3: (4, "max_tool_calls", 3)}


def test_audit_rules(spark):
    rows = spark.createDataFrame([("t1", "x" * 15), ("t1", "x" * 16), ("t2", "x" * 64), ("t2", "x" * 65), ("t2", None)], "tenant_id string, request_id string")
    good, bad = audit.validate_audit(rows)
    assert good.count() == 2 and bad.count() == 3
    for days in (364, 2556, True):
        with pytest.raises(ValueError):
            audit.retention_split(rows, F.lit(T0), days)
    tenants = spark.createDataFrame([("t1", sec(10)), ("t2", None)], "tenant_id string, legal_hold_until timestamp")
    left, preserved, summary = audit.delete_tenants({"sessions": rows}, rows, tenants, tenants.select("tenant_id"), F.lit(T0))
    assert left["sessions"].count() == 0 and left["audit"].count() == 2 and preserved.count() == 2
    assert {(r.tenant_id, r.table_name, r.deleted, r.preserved) for r in summary.collect()} == {
        ("t1", "sessions", 2, 0), ("t2", "sessions", 3, 0), ("t2", "audit", 3, 0), ("t1", "audit", 0, 2),
    }
    assert audit.lost_rows(rows, rows.unionByName(rows)).count() == 0 and audit.lost_rows(rows, rows.where("tenant_id = 't1'")).count() == 3


def test_key_status(spark):
    keys = spark.createDataFrame(
        [("k1", "prefix01", "t1", sec(100), None, 60), ("k2", "prefix02", "t2", None, sec(0), 60)],
        "key_id string, key_prefix string, tenant_id string, expires_at timestamp, revoked_at timestamp, rotation_grace_seconds int",
    )
    asks = [
        ("a", None, None, 0, "missing_token"), ("b", "Bearer  ", None, 0, "missing_token"), ("c", "Basic prefix01_x", "k1", 0, "missing_token"),
        ("d", "Bearer short_x", "k1", 0, "invalid_token"), ("e", "Bearer prefix02_x", "k1", 0, "invalid_token"), ("f", "bearer prefix01_x", "k1", 100, "ok"),
        ("g", "Bearer prefix01_x", "k1", 101, "expired_token"), ("h", "Bearer prefix02_x", "k2", 60, "ok"), ("i", "Bearer prefix02_x", "k2", 61, "revoked_token"),
    ]
    df = spark.createDataFrame([(r, h, k, sec(s)) for r, h, k, s, _ in asks], "request_id string, authorization string, key_id string, ts timestamp")
    got = {r.request_id: (r.status, r.tenant_id) for r in audit.key_status(df, keys).collect()}
    assert {r: s for r, (s, _) in got.items()} == {r: s for r, *_, s in asks}
    assert got["g"][1] == "t1" and got["i"][1] == "t2" and got["e"][1] is None


# --- rows that must not get lost ----------------------------------------------------------------------


def test_a_host_fetched_twice_at_one_instant_answers_a_request_once(spark):
    fetches = spark.createDataFrame([("h.test", 200, "a", sec(0)), ("h.test", 200, "b", sec(0))], "host string, status int, body string, fetched_at timestamp")
    asked = spark.createDataFrame([("https://h.test/x", sec(60))], "url string, requested_at timestamp")
    assert [r.body for r in crawl.robots_as_of(asked, fetches).collect()] == ["b"]


def test_bucket_refills_and_waits():
    bucket = usage.Bucket(2, 100.0)
    assert bucket.request(100.0) == (True, 1, 130, -1)
    assert bucket.request(100.0) == (True, 0, 160, -1)
    assert bucket.request(115.0) == (False, 0, 160, 15)
    assert bucket.request(131.0)[0] and not bucket.request(90.0)[0]


def test_queries_over_the_limit_are_refused(spark):
    from citewell.operators import search

    asked = spark.createDataFrame([(1, 10), (2, 101), (3, 0), (4, None), (5, 100)], "query_id int, num_results int")
    assert sorted(r.query_id for r in search.refused(asked).collect()) == [2, 3, 4]
