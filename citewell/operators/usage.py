"""Metering, rate limits and latency statistics over request logs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.operators.ordered import running, segment_of, time_segment
from citewell.sources.stores import KeySet
from citewell.sources.tables import cut

# Latency bucket bounds in seconds per kind of request.
BUCKETS = {
    "http": [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0],
}


def billable(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("response_status").between(200, 299))


def dedup_key(request_id: Column) -> Column:
    return F.concat(F.lit("meter:"), request_id)


def dedup_metering(requests: DataFrame) -> DataFrame:
    """Billable requests once per dedup key; the first by time wins. Copies of a key are reduced map-side."""
    keyed = billable(requests).withColumn("dedup_key", dedup_key(F.col("request_id")))
    rest = [c for c in keyed.columns if c not in ("dedup_key", "ts")]
    firsts = keyed.groupBy("dedup_key").agg(F.min(F.struct("ts", *rest)).alias("_first"))
    return firsts.select("dedup_key", "_first.*")


def append_metering(keys: KeySet, number: int, requests: DataFrame) -> DataFrame:
    """The rows that batch ``number`` adds: billable requests whose key no earlier batch has. Their keys are added to the set."""
    asked = cut(dedup_metering(requests), "metered")
    known, _ = keys.known(number, asked.select(F.col("dedup_key").alias("key")))
    fresh = cut(asked.join(known.select(F.col("key").alias("dedup_key")), "dedup_key", "left_anti"), "fresh")
    keys.add(number, fresh.select(F.col("dedup_key").alias("key")))
    return fresh


def usage_by_window(metered: DataFrame, width: str = "1 hour") -> DataFrame:
    grouped = metered.groupBy("tenant_id", "endpoint", F.window("ts", width).start.alias("window_start"))
    return grouped.agg(F.count("*").alias("events"), F.sum(F.coalesce("tokens_consumed", F.lit(0))).alias("tokens"))


# A bucket that would be full even if every request so far had been charged is full whatever was really
# granted, so requests from there on do not depend on those before. The charge-everything level before a
# request is limit + S - max(S up to it) with S = refill so far - requests so far: a record of S means
# full. S is counted in exact integers (micro-tokens), and a record must win by a margin far above the
# rounding of the double arithmetic that follows.
_MICROS_PER_TOKEN_MINUTE = 60_000_000
_MARGIN = 60_000
_EPOCH_2020 = 1_577_836_800_000_000


def _independent_runs(requests: DataFrame, segment: Column) -> DataFrame:
    key, order = ["tenant_id", "endpoint"], ["ts", "request_id"]
    counted = running(requests.withColumn("_one", F.lit(1)), key, order, segment, total={"_count": "_one"}, stored=True)
    limit = F.col("limit_per_minute").cast("long")
    balance = (F.unix_micros("ts") - _EPOCH_2020) * limit - (F.col("_count") - 1) * _MICROS_PER_TOKEN_MINUTE
    level = running(counted.withColumn("_s", balance), key, order, segment, peak_before={"_peak": "_s"})
    # What a bucket lacks at the start counts as if it had been full that much earlier.
    lacking = F.ceil((limit - F.col("_level")) * _MICROS_PER_TOKEN_MINUTE).cast("long")
    start = (F.floor(F.col("_at") * 1_000_000).cast("long") - _EPOCH_2020) * limit + lacking
    peak = F.greatest("_peak", start)
    full = peak.isNull() | (F.col("_s") >= peak + _MARGIN)
    flagged = level.withColumn("_full", F.when(full, 1).otherwise(0))
    return running(flagged, key, order, segment, total={"_run": "_full"}).drop("_one", "_count", "_s", "_peak", "_full")


class Bucket:
    """A level that rises steadily by ``limit`` a minute and never above it; a granted request takes one from it."""

    __slots__ = ("at", "level", "limit")

    def __init__(self, limit: int, at: float, level: float | None = None):
        self.limit, self.at, self.level = limit, at, float(limit) if level is None else level

    def _until(self, level: float) -> float:
        """Seconds from now until the bucket stands at a level."""
        return max(0.0, level - self.level) * 60.0 / self.limit if self.limit > 0 else 0.0

    def request(self, now: float) -> tuple[bool, int, int, int]:
        """allowed, whole tokens left (0 if refused), when the bucket is full again, and seconds to wait (-1 if allowed)."""
        elapsed = max(0.0, now - self.at)
        self.level = min(float(self.limit), self.level + elapsed * (self.limit / 60.0))
        self.at += elapsed
        allowed = self.level >= 1
        if allowed:
            self.level -= 1
        full_at = math.ceil(now + self._until(self.limit))
        return (True, math.floor(self.level), full_at, -1) if allowed else (False, 0, full_at, math.ceil(self._until(1)))


BUCKET_KEY = ["tenant_id", "endpoint"]


def token_bucket(requests: DataFrame, segment_seconds: int | None = None) -> DataFrame:
    """Token bucket per (tenant, endpoint): each request ``(tenant_id, endpoint, ts, request_id,
    limit_per_minute)`` gets allowed, remaining, reset_at and retry_after.

    Keys are cut where the bucket is certainly full, so a busy key is many independent runs. Rows stream
    through each task in order with one bucket in memory; a run is never collected. The requests are a
    stored table.
    """
    return continued_bucket(requests, None, segment_seconds).drop("level", "at")


def continued_bucket(requests: DataFrame, buckets: DataFrame | None, segment_seconds: int | None = None) -> DataFrame:
    """``token_bucket`` of requests that follow earlier ones: ``buckets`` has the level of each key's bucket and the time
    (seconds) at which it was that; keys without one are full. The result has both after every request."""
    slim = requests.select(*BUCKET_KEY, "ts", "request_id", "limit_per_minute")
    if buckets is None:
        slim = slim.withColumns({"_level": F.lit(None).cast("double"), "_at": F.lit(None).cast("double")})
    else:
        levels = buckets.select(*BUCKET_KEY, F.col("level").alias("_level"), F.col("at").alias("_at"))
        slim = cut(slim.join(levels, BUCKET_KEY, "left"), "requests")
    runs = _independent_runs(slim, segment_of(slim, "ts", segment_seconds))
    timed = runs.withColumn("_now", F.unix_micros("ts"))
    key = [*BUCKET_KEY, "_run"]
    placed = timed.repartition(*key).sortWithinPartitions(*key, "ts", "request_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bucket = None, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*key, "limit_per_minute", "_now", "_level", "_at")]
            out = []
            for tenant, endpoint, run, limit, micros, level, at in zip(*columns):
                now = micros / 1e6
                if (tenant, endpoint, run) != current:
                    current = (tenant, endpoint, run)
                    # Only the first run goes on from an earlier level; each later one begins full.
                    bucket = Bucket(limit, at, level) if run == 0 and level is not None else Bucket(limit, now)
                bucket.limit = limit
                out.append((*bucket.request(now), bucket.level, bucket.at))
            names = [*BUCKET_KEY, "ts", "request_id", "limit_per_minute"]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            added = [pa.array([row[i] for row in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(kept + added, names=[*names, "allowed", "remaining", "reset_at", "retry_after", "level", "at"])

    base = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema if not f.name.startswith("_"))
    return placed.mapInArrow(fold, f"{base}, allowed boolean, remaining bigint, reset_at bigint, retry_after bigint, level double, at double")


def bucket_levels(granted: DataFrame) -> DataFrame:
    """The last level of each key of ``continued_bucket``, for the requests to come."""
    last = granted.groupBy(*BUCKET_KEY).agg(F.max(F.struct("ts", "request_id", "level", "at")).alias("last"))
    return last.select(*BUCKET_KEY, "last.level", "last.at")



def request_counts(requests: DataFrame, by: list[str]) -> DataFrame:
    return requests.groupBy(*by).agg(F.count("*").alias("requests"))


def histogram(requests: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative bucket counts: one conditional count per bound in a single pass, then one row per bound.
    The last bucket, without a bound, holds everything."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    wide = requests.groupBy(*by).agg(*counts, F.count(value).alias(f"_{len(bounds)}"))
    cells = [
        F.struct(F.lit(i).alias("bucket"), F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("cumulative"))
        for i, b in enumerate([*bounds, math.inf])
    ]
    return wide.select(*by, F.inline(F.array(*cells)))


def histogram_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds the rank.

    The lowest bucket starts at zero; a rank in the open last bucket gives the highest bound. A histogram
    has as many rows as bounds, so a group is small by construction.
    """
    ordered = F.array_sort(F.collect_list(F.struct("le", "cumulative")))
    packed = buckets.groupBy(*by).agg(ordered.alias("_b"))
    total = F.element_at("_b", -1)["cumulative"]
    rank = total * F.lit(q)
    at = F.size(F.filter("_b", lambda b: b["cumulative"] < rank)) + 1
    here, below = F.try_element_at("_b", at), F.try_element_at("_b", F.when(at > 1, at - 1))
    low, passed = F.coalesce(below["le"], F.lit(0.0)), F.coalesce(below["cumulative"], F.lit(0))
    inside = low + (here["le"] - low) * (rank - passed) / F.nullif(here["cumulative"] - passed, F.lit(0))
    value = F.when(total == 0, F.lit(None)).when(at >= F.size("_b"), low).otherwise(inside)
    return packed.select(*by, value.alias("quantile"))


def latency_percentiles(
    requests: DataFrame, by: list[str], value: str, segment: Column, shares=(0.5, 0.95, 0.99)
) -> DataFrame:
    """Nearest-rank percentiles: the value at position floor(n * p) of the sorted list, exactly.

    Equal values are counted first, and positions are running counts over (group, value), so no group is
    collected. ``segment`` cuts the value range into pieces, in order.
    """
    counted = requests.groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = running(counted, by, [value], segment, total={"_upto": "_n"})
    totals = requests.groupBy(*by).agg(
        F.count("*").alias("requests"), F.avg(value).alias("mean"),
        F.count_if(F.col("response_status") >= 500).alias("errors"),
    )
    joined = placed.join(totals.select(*by, F.col("requests").alias("_all")), by)
    picks = []
    for p in shares:
        wanted = F.least(F.floor(F.col("_all") * F.lit(float(p))), F.col("_all") - 1)
        holds = (F.col("_upto") > wanted) & (F.col("_upto") - F.col("_n") <= wanted)
        picks.append(F.max(F.when(holds, F.col(value))).alias(f"p{round(p * 100)}"))
    found = joined.groupBy(*by).agg(*picks).join(totals, by)
    return found.withColumn("success_rate", (F.col("requests") - F.col("errors")) / F.col("requests"))


def gauges(requests: DataFrame) -> DataFrame:
    """Cache hit ratio, jobs running and distinct documents, in one row."""
    return requests.agg(
        F.avg(F.col("cache_hit").cast("double")).alias("cache_hit_ratio"),
        F.count_if(F.col("job_state").isin("planning", "running")).alias("active_jobs"),
        F.countDistinct("document_id").alias("documents"),
    )


def panes(requests: DataFrame, by: list[str], width: str = "30 seconds", **measures: Column) -> DataFrame:
    """Counts per group and pane: what sliding windows are added up from, instead of from raw rows."""
    counts = [F.count_if(c).alias(name) for name, c in measures.items()]
    grouped = requests.groupBy(*by, F.window("ts", width).alias("_w")).agg(*counts)
    return grouped.select(*by, F.col("_w.start").alias("pane"), *measures)


def sliding_sums(pane_rows: DataFrame, by: list[str], measures: list[str], width: str, slide: str) -> DataFrame:
    """Sums over sliding windows ending at each slide; only panes are multiplied, not requests."""
    grouped = pane_rows.groupBy(*by, F.window("pane", width, slide).alias("_w"))
    summed = grouped.agg(*[F.sum(m).alias(m) for m in measures])
    return summed.select(*by, F.col("_w.end").alias("evaluated_at"), *measures)


def sustained(evaluations: DataFrame, by: list[str], seconds: int, every: int = 30, segment_seconds: int = 86_400) -> DataFrame:
    """Add ``firing``: breached at every evaluation for the given time. A missing evaluation ends a streak."""
    order, segment = ["evaluated_at"], time_segment(F.col("evaluated_at"), segment_seconds)
    seen = running(
        evaluations, by, order, segment,
        previous={"_was": ("breached", 1), "_at": ("evaluated_at", 1)},
    )
    adjoining = F.unix_micros("evaluated_at") - F.unix_micros("_at") <= every * 1_000_000
    goes_on = F.coalesce(F.col("_was") & adjoining, F.lit(False))
    begun = seen.withColumn("_begin", F.when(F.col("breached") & ~goes_on, F.col("evaluated_at")))
    carried = running(begun, by, order, segment, peak_before={"_since": "_begin"})
    since = F.when(F.col("breached"), F.greatest("_since", "_begin"))
    held = (F.unix_micros("evaluated_at") - F.unix_micros(since)) >= seconds * 1_000_000
    return carried.withColumn("since", since).withColumn("firing", F.coalesce(held, F.lit(False))).drop(
        "_was", "_at", "_begin", "_since"
    )
