import datetime as dt

from pyspark.sql import functions as F

from citewell.operators.usage import token_bucket
from citewell.plans import inputs
from citewell.plans.stream_queries import as_stream, drained, fed, timed
from citewell.sources import messages, tables
from citewell.streaming import jobs, state

T0 = dt.datetime(2024, 1, 1)


def test_session_memory_expires_by_event_time(spark):
    rows = [(1, n, f"d{n}", T0 + dt.timedelta(hours=h), T0, 1) for n, h in enumerate([0, 1, 2])]
    rows += [(2, n, f"d{n}", T0 + dt.timedelta(hours=h), T0 + dt.timedelta(hours=20), 30) for n, h in enumerate([20, 60, 61])]
    df = spark.createDataFrame(rows, "session_id bigint, pos bigint, document_id string, ts timestamp, created_at timestamp, retention_days int")
    stream, feed = as_stream(spark, timed(df, "ts"), "memory-test", 3)
    got = drained(spark, jobs.session_memory(stream.drop("_at")), "memory-out", feed)
    assert {r.session_id for r in got.where("kind = 'expired'").collect()} == {1}
    last = got.where("session_id = 2").orderBy(F.desc("pos")).first()
    assert last.doc_ids == ["d0", "d1", "d2"]


def test_bad_messages_go_to_dead_letters_and_a_repeated_batch_changes_nothing(spark):
    root = tables.shared_dir(spark, "ingest-test")
    pages = spark.createDataFrame([("https://a.org/", "<p>one</p>"), ("https://b.org/", "<p>two</p>")], "url string, html string")
    messages.publish_files(messages.ingest_messages(pages, F.lit(T0)), f"{root}/topic")
    spark.createDataFrame([("{no json",)], "value string").write.mode("append").text(f"{root}/topic")
    run = lambda: jobs.ingest(
        messages.read_files(spark, f"{root}/topic", 1), root, f"{root}/checkpoint", availableNow=True
    ).awaitTermination()
    run()
    newest = lambda: jobs.versions_table(spark, root).read()
    assert {(r.source_url, r.version, r.cleaned_text) for r in newest().collect()} == {("https://a.org/", 1, "one"), ("https://b.org/", 1, "two")}
    dead = spark.read.parquet(f"{root}/dead_letters/*")
    assert [(r.raw, r.error) for r in dead.collect()] == [("{no json", "missing raw_content, source_url, request_id")]
    messages.publish_files(messages.ingest_messages(pages.withColumn("html", F.lit("<p>new</p>")), F.lit(T0 + dt.timedelta(days=1))), f"{root}/topic")
    run()
    assert newest().groupBy("version").count().where("version = 2").first()["count"] == 2


def test_kafka_source_and_sink_take_the_same_columns(spark):
    pages = spark.createDataFrame([("https://a.org/", "x")], "url string, html string")
    value = messages.to_json_value(messages.ingest_messages(pages, F.lit(T0)))
    assert value.columns == ["key", "value"]
    parsed = messages.from_json_value(value).first()
    assert parsed.raw_content == "x" and parsed.parse_error is None and len(parsed.message_id) == 32


def alert_rows(spark, seconds, part, rules, parts=3):
    df = spark.createDataFrame([(n, T0 + dt.timedelta(seconds=s), p) for n, (s, p) in enumerate(zip(seconds, part))], "n int, ts timestamp, bad boolean")
    stream, feed = as_stream(spark, timed(df, "ts"), "alerts-test", parts)
    found = drained(spark, jobs.alerts(stream, F.lit("all"), F.col("bad"), rules, delay="0 seconds"), "alerts-out", feed)
    return {(r.rule, int((r.evaluated_at - T0).total_seconds())): (r.total, r.part, r.over, r.firing) for r in found.collect()}


def test_alerts_are_evaluated_at_every_step_and_fire_after_holding(spark):
    """One bad minute in an hour of quiet: two widths from one state, ticks without rows included."""
    rules = (state.AlertRule("short", 60, 0.5, 30), state.AlertRule("long", 300, 0.2, 120), state.AlertRule("rate", 60, 0.04, 0, per_second=True))
    seconds = [*range(0, 600, 20), 3000]
    bad = [200 <= s < 260 for s in seconds]
    got = alert_rows(spark, seconds, bad, rules)
    for rule in rules:
        since = None
        for tick in range(30, 3001, 30):
            inside = [b for s, b in zip(seconds, bad) if tick - rule.width_seconds <= s < tick]
            over = bool(inside) and sum(inside) / (rule.width_seconds if rule.per_second else len(inside)) > rule.threshold
            since = (tick if since is None else since) if over else None
            expected = (len(inside), sum(inside), over, over and tick - since >= rule.hold_seconds) if inside else None
            assert got.get((rule.name, tick)) == expected, (rule.name, tick)
    assert any(v[3] for v in got.values()) and any(v[2] and not v[3] for v in got.values())


def test_a_rule_goes_on_holding_where_the_last_pane_leaves_as_the_next_comes(spark):
    """Between two runs all panes of the key are too old for the next tick, and at that tick a new one comes."""
    rules = (state.AlertRule("rule", 300, 0.1, 300),)
    df = spark.createDataFrame([("a", 10, True), ("b", 310, False), ("a", 310, True), ("b", 1200, False)], "key string, s int, bad boolean")
    df = df.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.lit(T0)) + F.col("s"))).withColumn("_at", F.col("s").cast("double"))
    early, late = df.where("key = 'a' AND s = 10 OR key = 'b' AND s = 310"), df.where("key = 'a' AND s = 310 OR s = 1200")
    path = tables.shared_dir(spark, "leaving")
    early.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    found = drained(spark, jobs.alerts(stream, F.col("key"), F.col("bad"), rules, delay="0 seconds"), "leaving-out", [lambda: late.write.mode("append").parquet(path)])
    firing = {int((r.evaluated_at - T0).total_seconds()): r.firing for r in found.where("key = 'a'").collect()}
    assert firing == {tick: tick >= 330 for tick in range(30, 601, 30)}


def test_times_before_the_log_begins_are_sped_up_as_in_sql(spark):
    micros = [1704067200000000 + n for n in (-250, -100, -1, 0, 99, 100, 250)]
    df = spark.createDataFrame([(n,) for n in micros], "n bigint").select("n", F.timestamp_micros("n").alias("ts"))
    got = [r.us - 1704067200000000 for r in df.select("n", F.unix_micros(inputs.sped("ts", 100)).alias("us")).orderBy("n").collect()]
    assert got == [-2, -1, 0, 0, 0, 1, 2]


def test_rate_limits_go_on_from_batch_to_batch(spark):
    """A bucket that is empty at the end of a micro-batch is so at the beginning of the next; a replay changes nothing."""
    rows = [("t", "e", T0 + dt.timedelta(seconds=2 * n), f"r{n:03d}", 3) for n in range(60)] + [("u", "e", T0 + dt.timedelta(seconds=40 * n), f"u{n}", 3) for n in range(4)]
    df = spark.createDataFrame(rows, "tenant_id string, endpoint string, ts timestamp, request_id string, limit_per_minute int")
    stream, feed = as_stream(spark, timed(df, "ts"), "limits-test", 4)
    root = tables.shared_dir(spark, "limits-out")
    fed(lambda: jobs.rate_limits(stream.drop("_at"), root, f"{root}/checkpoint", availableNow=True), feed)
    columns = ["request_id", "allowed", "remaining", "reset_at", "retry_after"]
    got = sorted(map(tuple, spark.read.parquet(f"{root}/answers").select(*columns).collect()))
    assert got == sorted(map(tuple, token_bucket(tables.cut(df)).select(*columns).collect())) and 0 < sum(r[1] for r in got) < 60


def test_metering_reads_few_keys_and_finds_late_copies(spark):
    rows = [(f"r{n}", "t", "e", 200, T0 + dt.timedelta(days=n)) for n in range(30)] + [("r0", "t", "e", 200, T0 + dt.timedelta(days=300)), ("r1", "t", "e", 500, T0)]
    df = spark.createDataFrame(rows, "request_id string, tenant_id string, endpoint string, response_status int, ts timestamp")
    stream, feed = as_stream(spark, timed(df, "ts"), "meter-test", 3)
    root = tables.shared_dir(spark, "meter-out")
    fed(lambda: jobs.metering(stream.drop("_at"), f"{root}/stored", f"{root}/checkpoint", availableNow=True), feed)
    stored = [r.dedup_key for r in spark.read.parquet(f"{root}/stored").collect()]
    assert sorted(stored) == sorted(f"meter:r{n}" for n in range(30))


def test_rows_without_a_time_are_fed_first(spark):
    df = spark.createDataFrame([(None, 1), (5.0, 2), (9.0, 3)], "_at double, n int")
    stream, feed = as_stream(spark, df, "null-times", 2)
    got = drained(spark, stream, "null-times-out", feed)
    assert sorted(r.n for r in got.collect()) == [1, 2, 3]
