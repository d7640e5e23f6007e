import datetime as dt
import random

from pyspark.sql import functions as F

from citewell.operators import ingest
from citewell.schemas import DOCUMENT_VERSIONS

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def seen(spark, rows):
    df = spark.createDataFrame([(u, at(h), t) for u, h, t in rows], "source_url string, fetched_at timestamp, cleaned_text string")
    return df.withColumn("content_hash", F.sha2("cleaned_text", 256))


def test_coming_back_to_old_content_is_a_new_version(spark):
    got = ingest.assign_versions(seen(spark, [("u", 0, "A"), ("u", 30, "B"), ("u", 60, "A"), ("u", 90, "A"), ("w", 1, "A")]), segment_seconds=3600)
    rows = {(r.source_url, r.version): (r.cleaned_text, r.created_at, r.last_seen_at) for r in got.collect()}
    assert rows == {
        ("u", 1): ("A", at(0), at(0)), ("u", 2): ("B", at(30), at(30)), ("u", 3): ("A", at(60), at(90)), ("w", 1): ("A", at(1), at(1)),
    }
    assert ingest.version_gaps(got).count() == 0
    assert {r.version for r in ingest.latest_versions(got).where("source_url = 'u'").collect()} == {3}


def test_merge_flags_and_idempotence(spark):
    stored = ingest.assign_versions(seen(spark, [("u", 0, "A"), ("w", 0, "X")]))
    merged, results = ingest.merge_versions(stored, seen(spark, [("u", 5, "A"), ("u", 6, "B"), ("new", 5, "N")]))
    flags = {(r.source_url, r.fetched_at): (r.version, r.is_new, r.version_incremented, r.last_seen_only) for r in results.collect()}
    assert flags == {
        ("u", at(5)): (1, False, False, True), ("u", at(6)): (2, False, True, False), ("new", at(5)): (1, True, False, False),
    }
    assert {(r.source_url, r.version, r.last_seen_at) for r in merged.collect()} == {
        ("u", 1, at(5)), ("u", 2, at(6)), ("w", 1, at(0)), ("new", 1, at(5)),
    }
    again, _ = ingest.merge_versions(merged, seen(spark, [("u", 9, "B")]))
    assert again.where("source_url = 'u'").count() == 2


def test_merge_into_nothing(spark):
    empty = spark.createDataFrame([], DOCUMENT_VERSIONS)
    merged, results = ingest.merge_versions(empty, seen(spark, [("u", 0, "A"), ("u", 1, "A")]))
    assert merged.count() == 1 and {r.is_new for r in results.collect()} == {True, False}


def walk(attempts):
    """One attempt after the other."""
    out, times, count = [], [], 0
    for when, ok in attempts:
        if ok:
            times, count = [], 0
            continue
        count, times = count + 1, (times + [when])[-3:]
        if count >= 3 and times[1] - times[0] >= 60 and times[2] - times[1] >= 60:
            out.append((when, count))
            times, count = [], 0
    return out


def test_retry_decisions_equal_a_walk(spark):
    rng = random.Random(5)
    rows, expected = [], set()
    for key in range(6):
        now, attempts = 0, []
        for _ in range(150):
            now += rng.choice([10, 59, 60, 61, 200, 4000])
            attempts.append((now, rng.random() < 0.1))
        rows += [(f"k{key}", T0 + dt.timedelta(seconds=s), n, ok, f"e{n}") for n, (s, ok) in enumerate(attempts)]
        expected |= {(f"k{key}", T0 + dt.timedelta(seconds=s), n) for s, n in walk(attempts)}
    df = spark.createDataFrame(rows, "key string, attempt_at timestamp, attempt_id bigint, ok boolean, error string")
    for width in (600, 10**9):
        got = ingest.retry_decisions(df, segment_seconds=width).collect()
        assert {(r.source_url, r.routed_at, r.attempts) for r in got} == expected


def test_due_sources(spark):
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    crawls = spark.createDataFrame([("a", at(0)), ("b", at(0)), ("b", at(1))], "url string, crawled_at timestamp")
    due = ingest.due_sources(sources, crawls, F.lit(at(24)))
    assert {r.url for r in due.collect()} == {"a", "c"}


def test_rescoring_touches_only_scores(spark):
    versions = ingest.assign_versions(seen(spark, [("u", 0, "A text."), ("w", 0, "B text.")]))
    scored = ingest.score_documents(versions, F.lit(at(1)))
    after, unknown = ingest.rescore(scored, scored.where("source_url = 'u'").select("document_id", "version"), F.lit(at(2)))
    assert unknown.count() == 0
    assert {(r.source_url, r.provenance.scored_at) for r in after.collect()} == {("u", at(2)), ("w", at(1))}
    rest = [c for c in scored.columns if c != "provenance"]
    assert sorted(after.select(rest).collect()) == sorted(scored.select(rest).collect())
    missing = spark.createDataFrame([("nope", 1)], "document_id string, version bigint")
    assert ingest.rescore(scored, missing, F.lit(at(2)))[1].count() == 1


def test_versions_keep_rows_without_a_time(spark):
    rows = [("u", None, "A", "a"), ("u", dt.datetime(2024, 1, 1), "B", "b"), ("v", None, "C", "c")]
    seen = spark.createDataFrame(rows, "source_url string, fetched_at timestamp, cleaned_text string, content_hash string")
    found = ingest.assign_versions(seen)
    assert sorted((r.source_url, r.version, r.cleaned_text) for r in found.collect()) == [("u", 1, "A"), ("u", 2, "B"), ("v", 1, "C")]
    merged, results = ingest.merge_versions(found.limit(0), seen)
    assert merged.count() == results.count() == 3
