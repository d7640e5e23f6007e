"""From raw pages to versioned, scored documents, and what hangs on indexing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.functions import provenance, text, vectors
from citewell.operators.ordered import position, running, segment_of, top_n
from citewell.sources.tables import cut


def clean_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add cleaned text and content hash."""
    return pages.withColumn("cleaned_text", text.clean_html(F.col(html))).withColumn(
        "content_hash", text.content_hash(F.col("cleaned_text"))
    )


def document_id(url: Column) -> Column:
    """Stable id of a URL: the same page gets the same id in every run and on every cluster."""
    return F.substring(F.sha2(url, 256), 1, 32)


def document_identity(pages: DataFrame, url: str = "url", ts: str = "fetched_at") -> DataFrame:
    """One row per URL: id and first time seen."""
    firsts = pages.groupBy(F.col(url).alias("canonical_url")).agg(F.min(ts).alias("first_seen_at"))
    return firsts.withColumn("document_id", document_id(F.col("canonical_url")))


def number_versions(
    observations: DataFrame, url: str = "source_url", ts: str = "fetched_at", segment_seconds: int | None = None
) -> DataFrame:
    """Version of every stored observation: a change against the latest content adds one, so A, B, A is
    three. Texts stay out of it; only URL, time and hash are shuffled."""
    order = [ts, "content_hash"]
    slim = observations.select(url, *order)
    segment = segment_of(slim, ts, segment_seconds)
    seen = running(slim, [url], order, segment, previous={"_before": ("content_hash", 1)}, stored=True)
    seen = seen.withColumn("changed", F.when(F.col("_before").eqNullSafe(F.col("content_hash")), 0).otherwise(1))
    numbered = running(seen.drop("_before"), [url], order, segment, total={"version": "changed"})
    return numbered.withColumn("document_id", document_id(F.col(url)))


def assign_versions(
    observations: DataFrame, url: str = "source_url", ts: str = "fetched_at", segment_seconds: int | None = None
) -> DataFrame:
    """One row per (document, version) of stored observations, with when it was created and last seen."""
    numbered = number_versions(observations, url, ts, segment_seconds)
    versions = numbered.groupBy("document_id", url, "version", "content_hash").agg(
        F.min(ts).alias("created_at"), F.max(ts).alias("last_seen_at")
    )
    # The text is that of the observation that created the version; twins of it are equal.
    texts = observations.select(url, F.col(ts).alias("created_at"), "content_hash", "cleaned_text").dropDuplicates(
        [url, "created_at", "content_hash"]
    )
    return _with_texts(versions, texts, [url, "created_at", "content_hash"]).withColumnRenamed(url, "source_url").select(
        "document_id", "source_url", "version", "content_hash", "created_at", "last_seen_at", "cleaned_text"
    )


def _with_texts(rows: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be NULL, so that rows without a time keep their text and stay."""
    renamed = texts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "cleaned_text")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(renamed, same).drop(*[f"_of_{k}" for k in keys])


def contents_by_instant(versions: DataFrame) -> DataFrame:
    """(document_id, source_url, version, content_hash) of each content once, numbered by the instants a document brought new ones.

    Contents of one instant share a number: no clock tells which came first, and it must not hang on the batch they arrived in.
    """
    key = ["document_id", "created_at"]
    firsts = cut(versions.groupBy("document_id", "source_url", "content_hash").agg(F.min("created_at").alias("created_at")), "contents")
    instants = cut(firsts.select(*key).distinct(), "instants")
    numbered = position(instants, ["document_id"], ["created_at"], segment_of(instants, "created_at"), "version", stored=False)
    return firsts.join(numbered, key).select("document_id", "source_url", "version", "content_hash")


def latest_versions(versions: DataFrame) -> DataFrame:
    """The highest version of each document."""
    return top_n(versions, ["document_id"], [F.desc("version")], 1, "_rank").drop("_rank")


def latest_of_stored(versions: DataFrame) -> DataFrame:
    """The same where versions are cheap to read twice: settled on keys, so that a task neither sorts nor holds texts. Only
    those of a number that a document has twice are sorted, to keep one."""
    counted = versions.groupBy("document_id", "version").agg(F.count("*").alias("_n"))
    newest = counted.groupBy(F.col("document_id").alias("_document")).agg(F.max("version").alias("_version"), F.max_by("_n", "version").alias("_n"))

    def of(keys: DataFrame) -> DataFrame:
        same = F.col("document_id").eqNullSafe(F.col("_document")) & F.col("version").eqNullSafe(F.col("_version"))
        return versions.join(keys.hint("shuffle_hash"), same).select(*versions.columns)

    return of(newest.where("_n = 1")).unionByName(latest_versions(of(newest.where("_n IS NULL OR _n > 1"))))


def merge_versions(existing: DataFrame, batch: DataFrame, segment_seconds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fold a batch of cleaned observations into stored versions.

    Returns the new version table and one result row per batch observation with the flags ``is_new``,
    ``version_incremented`` and ``last_seen_only``. Both inputs are stored tables. Stored rows whose URL
    is not in the batch are passed on without being numbered again.
    """
    touched = batch.select("source_url").distinct()
    base = latest_versions(existing.join(touched, "source_url", "left_semi")).select(
        "source_url",
        F.col("last_seen_at").alias("fetched_at"),
        "content_hash",
        "cleaned_text",
        F.col("version").alias("_base"),
    )
    arriving = batch.select(
        "source_url", "fetched_at", "content_hash", "cleaned_text", F.lit(None).cast("long").alias("_base")
    )
    # The stored row opens each URL's history, whatever the clock says about the batch.
    both = base.withColumn("_stored", F.lit(0)).unionByName(arriving.withColumn("_stored", F.lit(1)))
    order = ["_stored", "fetched_at", "content_hash"]
    arrived = F.coalesce(segment_of(batch, "fetched_at", segment_seconds), F.lit(1 - 2**40))
    segment = F.when(F.col("_stored") == 0, F.lit(-(2**40))).otherwise(arrived)
    slim = cut(both.drop("cleaned_text"), "merge")
    seen = running(slim, ["source_url"], order, segment, previous={"_before": ("content_hash", 1)}, stored=True)
    seen = seen.withColumn(
        "_step",
        F.when(F.col("_stored") == 0, F.col("_base"))
        .when(F.col("_before").eqNullSafe(F.col("content_hash")), 0)
        .otherwise(1),
    )
    numbered = running(seen, ["source_url"], order, segment, total={"version": "_step"})
    numbered = cut(numbered.withColumn("document_id", document_id(F.col("source_url"))), "numbered")

    results = numbered.where(F.col("_stored") == 1).select(
        "document_id",
        "source_url",
        "fetched_at",
        "version",
        F.col("_before").isNull().alias("is_new"),
        (F.col("_before").isNotNull() & (F.col("_step") == 1)).alias("version_incremented"),
        (F.col("_step") == 0).alias("last_seen_only"),
    )
    texts = batch.select("source_url", "fetched_at", "content_hash", "cleaned_text").dropDuplicates(
        ["source_url", "fetched_at", "content_hash"]
    )
    changes = numbered.where(F.col("_stored") == 1).groupBy("document_id", "source_url", "version", "content_hash").agg(
        F.min("fetched_at").alias("created_at"), F.max("fetched_at").alias("last_seen_at"),
        F.max("_step").alias("_new"),
    )
    # Only new versions need their text; the others just move last_seen_at of a stored row.
    fresh = _with_texts(
        changes.where(F.col("_new") == 1), texts.withColumnRenamed("fetched_at", "created_at"), ["source_url", "created_at", "content_hash"]
    )
    seen_again = changes.where(F.col("_new") == 0).select(
        "document_id", "version", F.col("last_seen_at").alias("_seen")
    )
    columns = ["document_id", "source_url", "version", "content_hash", "cleaned_text", "created_at", "last_seen_at"]
    kept = existing.select(*columns).join(seen_again, ["document_id", "version"], "left")
    kept = kept.withColumn("last_seen_at", F.greatest("last_seen_at", "_seen"))
    return kept.select(*columns).unionByName(fresh.select(*columns)), results


def version_gaps(versions: DataFrame, width: int = 100_000) -> DataFrame:
    """Versions that do not follow their document's previous version by exactly one (first: 1)."""
    segment = F.floor(F.col("version") / width)
    chained = running(
        versions, ["document_id"], ["version"], segment, previous={"previous_version": ("version", 1)}, stored=True
    )
    expected = F.coalesce(F.col("previous_version"), F.lit(0)) + 1
    return chained.withColumn("expected_version", expected).where(F.col("version") != F.col("expected_version"))


def score_documents(versions: DataFrame, scored_at: Column, credibility=None, ai_likelihood=None) -> DataFrame:
    """Add the provenance struct; a version is visible once it is scored. Scorers are Column -> Column."""
    credibility = credibility or provenance.credibility
    ai_likelihood = ai_likelihood or provenance.ai_likelihood
    body = F.col("cleaned_text")
    scored = versions.withColumn(
        "provenance",
        F.when(
            body.isNotNull(),
            F.struct(
                credibility(body).alias("credibility_score"),
                ai_likelihood(body).alias("ai_generated_likelihood"),
                scored_at.alias("scored_at"),
            ),
        ),
    )
    return scored.withColumn("visible", F.col("provenance.scored_at").isNotNull())


def rescore(scored: DataFrame, subset: DataFrame, scored_at: Column) -> tuple[DataFrame, DataFrame]:
    """Replace the scores of the (document_id, version) rows in ``subset``; also the keys never scored."""
    key = ["document_id", "version"]
    wanted = subset.select(*key).distinct().withColumn("_wanted", F.lit(True))
    marked = scored.join(wanted, key, "left")
    body = F.col("cleaned_text")
    fresh = F.struct(
        provenance.credibility(body).alias("credibility_score"),
        provenance.ai_likelihood(body).alias("ai_generated_likelihood"),
        scored_at.alias("scored_at"),
    )
    due = F.col("_wanted") & F.col("provenance").isNotNull()
    updated = marked.withColumn("provenance", F.when(due, fresh).otherwise(F.col("provenance"))).drop("_wanted")
    known = scored.where(F.col("provenance").isNotNull())
    return updated, wanted.drop("_wanted").join(known, key, "left_anti")


def search_documents(scored: DataFrame, tenant: Column | None = None) -> DataFrame:
    """Denormalised rows for searching: title, scores (0.5 where unscored) and visibility."""
    half = F.lit(0.5)
    return scored.select(
        "document_id",
        "version",
        (tenant if tenant is not None else F.lit(None).cast("string")).alias("tenant_id"),
        F.col("source_url").alias("url"),
        text.title(F.col("cleaned_text")).alias("title"),
        "cleaned_text",
        F.coalesce("provenance.credibility_score", half).alias("credibility_score"),
        F.coalesce("provenance.ai_generated_likelihood", half).alias("ai_generated_likelihood"),
        "visible",
    )


def vector_entries(versions: DataFrame, dim: int = vectors.DEFAULT_DIM) -> DataFrame:
    return versions.select(
        "document_id", "version", vectors.hash_embedding(F.col("cleaned_text"), dim).alias("embedding")
    )


def remove_entries(entries: DataFrame, removed: DataFrame) -> DataFrame:
    """Index entries without the given (document_id, version) keys."""
    return entries.join(removed.select("document_id", "version"), ["document_id", "version"], "left_anti")


# A key's retry state is how many failures it has seen since the last success or routing, with three
# meaning three or more. Each attempt maps the four possible states to the next ones, maps compose, and
# so long histories are folded segment by segment.
_STATES = 4


def _next_state(state: Column, attempt: Column, limit: int) -> Column:
    counted = F.least(state + 1, F.lit(limit))
    routed = (counted == limit) & attempt["spaced"]
    return F.when(attempt["ok"] | routed, F.lit(0)).otherwise(counted)


def retry_decisions(
    attempts: DataFrame, max_attempts: int = 3, min_gap_seconds: int = 60, segment_seconds: int | None = None
) -> DataFrame:
    """Dead-letter routing of indexing attempts ``(key, attempt_at, attempt_id, ok, error)``.

    A failure is routed when it is at least the third since the key's last success or routing and the
    last three attempts are each at least a minute apart. Returns the routed rows with the number of
    attempts made and the last error. The attempts are a stored table.
    """
    order = ["attempt_at", "attempt_id"]
    segment = segment_of(attempts, "attempt_at", segment_seconds)
    lags = {f"_t{k}": ("attempt_at", k) for k in range(1, max_attempts)}
    lagged = running(attempts, ["key"], order, segment, previous=lags, stored=True)
    times = [F.col("attempt_at"), *[F.col(f"_t{k}") for k in range(1, max_attempts)]]
    gaps = [F.unix_micros(a) - F.unix_micros(b) >= min_gap_seconds * 1_000_000 for a, b in zip(times, times[1:])]
    spaced = F.lit(True)
    for gap in gaps:
        spaced = spaced & F.coalesce(gap, F.lit(False))
    flagged = lagged.select("key", *order, "ok", "error", spaced.alias("spaced"), segment.alias("_seg"))

    # Fold each segment once for every state it could start in.
    per_segment = cut(
        flagged.groupBy("key", "_seg").agg(
            F.array_sort(F.collect_list(F.struct(*order, "ok", "spaced", "error"))).alias("_attempts")
        ),
        "retries",
    )
    ends = F.transform(
        F.sequence(F.lit(0), F.lit(max_attempts)),
        lambda s: F.aggregate("_attempts", s, lambda state, a: _next_state(state, a, max_attempts)),
    )
    history = per_segment.select("key", F.struct("_seg", ends.alias("ends")).alias("_m"))
    starts = history.groupBy("key").agg(F.array_sort(F.collect_list("_m")).alias("_maps")).select(
        "key",
        F.explode(
            F.aggregate(
                "_maps",
                F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<_seg:bigint,state:int>>").alias("starts")),
                lambda acc, m: F.struct(
                    F.element_at(m["ends"], acc["state"] + 1).alias("state"),
                    F.array_append(acc["starts"], F.struct(m["_seg"].alias("_seg"), acc["state"].alias("state")))
                    .cast("array<struct<_seg:bigint,state:int>>").alias("starts"),
                ),
                lambda acc: acc["starts"],
            )
        ).alias("_start"),
    ).select("key", F.col("_start._seg").alias("_seg"), F.col("_start.state").alias("_state"))

    # Replay every segment from the state it really starts in, then count since the last clearing.
    def replay(acc, a):
        after = _next_state(acc["state"], a, max_attempts)
        row = F.struct(a["attempt_at"].alias("attempt_at"), a["attempt_id"].alias("attempt_id"), a["ok"].alias("ok"),
                       a["error"].alias("error"), (~a["ok"] & (after == 0)).alias("routed"))
        return F.struct(after.alias("state"), F.array_append(acc["rows"], row).alias("rows"))

    row_type = "array<struct<attempt_at:timestamp,attempt_id:bigint,ok:boolean,error:string,routed:boolean>>"
    replayed = per_segment.join(starts, ["key", "_seg"]).select(
        "key",
        F.inline(
            F.aggregate(
                "_attempts",
                F.struct(F.col("_state").alias("state"), F.array().cast(row_type).alias("rows")),
                lambda acc, a: F.struct(replay(acc, a)["state"].alias("state"), replay(acc, a)["rows"].cast(row_type).alias("rows")),
                lambda acc: acc["rows"],
            )
        ),
    )
    counted = running(replayed.withColumn("_one", F.lit(1)), ["key"], order, segment, total={"_n": "_one"})
    cleared = counted.withColumn("_cleared", F.when(F.col("ok") | F.col("routed"), F.col("_n")))
    ranked = running(cleared, ["key"], order, segment, peak_before={"_last": "_cleared"})
    return ranked.where("routed").select(
        F.col("key").alias("source_url"),
        F.col("error").alias("failure_reason"),
        (F.col("_n") - F.coalesce("_last", F.lit(0))).alias("attempts"),
        F.col("attempt_at").alias("routed_at"),
    )


def due_sources(sources: DataFrame, crawls: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Priority sources never crawled, or last crawled at least a day ago."""
    last = crawls.groupBy("url").agg(F.max("crawled_at").alias("last_crawled_at"))
    joined = sources.join(last, "url", "left")
    return joined.where(
        F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") <= now - F.make_dt_interval(hours=F.lit(hours)))
    )


def index_versions(versions: DataFrame, segment_seconds: int | None = None) -> DataFrame:
    """Index version of each tenant after each new document version: 1 + changes so far."""
    changes = cut(versions.groupBy("tenant_id", "created_at").agg(F.count("*").alias("_changes")), "changes")
    counted = running(
        changes, ["tenant_id"], ["created_at"], segment_of(changes, "created_at", segment_seconds),
        total={"_so_far": "_changes"}, stored=True,
    )
    return counted.select("tenant_id", "created_at", (F.col("_so_far") + 1).alias("index_version"))
