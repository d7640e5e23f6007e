"""Contents look-ups, citations and answer assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.functions.highlights import highlights
from citewell.functions.text import summary as first_sentences
from citewell.operators.ingest import latest_versions
from citewell.operators.ordered import id_segment, running, top_n

WINDOW = 30
MIN_ANSWER = 10


def contents(
    requests: DataFrame, versions: DataFrame, query: Column | None = None,
    summarise: Callable[[Column], Column] | None = first_sentences,
) -> DataFrame:
    """Latest text of each requested id, in request order, with highlights and a summary.

    requests: (request_id, document_ids array). An unknown id gets ``document_not_found``.
    """
    asked = requests.select("*", F.posexplode("document_ids").alias("position", "document_id"))
    # Only requested documents reach the version pick and the text expressions.
    known = versions.join(asked.select("document_id").distinct(), "document_id", "left_semi")
    newest = latest_versions(known).select("document_id", "version", F.col("source_url").alias("url"), "cleaned_text", "provenance")
    found = asked.join(newest, "document_id", "left")
    found = found.withColumn("error_code", F.when(F.col("version").isNull(), F.lit("document_not_found")))
    if query is not None:
        found = found.withColumn("highlights", highlights(F.col("cleaned_text"), query))
    if summarise is not None:
        found = found.withColumn("summary", summarise(F.col("cleaned_text")))
    return found.drop("document_ids")


def validate_citations(citations: DataFrame, retrieval: DataFrame, answers: DataFrame) -> DataFrame:
    """Add ``error_code``: the cited pair must be retrieved and both spans must lie inside their texts.

    retrieval: (answer_id, document_id, version, cleaned_text); answers: (answer_id, answer_length).
    """
    sources = retrieval.select(
        "answer_id", "document_id", "version", F.length("cleaned_text").alias("_source_length")
    ).dropDuplicates(["answer_id", "document_id", "version"])
    joined = citations.join(sources, ["answer_id", "document_id", "version"], "left").join(
        answers.select("answer_id", "answer_length"), "answer_id", "left"
    )
    inside = lambda start, end, length: (start >= 0) & (end > start) & (end <= length)
    code = (
        F.when(F.col("_source_length").isNull(), "not_in_retrieval_set")
        .when(~inside(F.col("answer_start"), F.col("answer_end"), F.coalesce("answer_length", F.lit(0))), "answer_offsets")
        .when(~inside(F.col("source_start"), F.col("source_end"), F.col("_source_length")), "source_offsets")
    )
    return joined.withColumn("error_code", code).drop("_source_length", "answer_length")


def answer_texts(tokens: DataFrame) -> DataFrame:
    """(answer_id, answer, answer_length, tokens): an answer is one value, at most as long as a model writes."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "token")))
    joined = tokens.groupBy("answer_id").agg(ordered.alias("_t"))
    answer = F.array_join(F.transform("_t", lambda t: t["token"]), "")
    return joined.select("answer_id", answer.alias("answer"), F.length(answer).alias("answer_length"),
                         F.size("_t").alias("tokens"))


def detect_citations(tokens: DataFrame, retrieval: DataFrame, width: int = 10_000) -> DataFrame:
    """Citations found while an answer streams: after each token its last 30 characters are looked up in
    every retrieved document (once the answer has ten).

    Only the tail of the answer is needed, so rows carry a running length and cut the tail out of the
    assembled answer, instead of collecting every prefix.
    """
    sized = tokens.withColumn("_chars", F.length("token"))
    placed = running(sized, ["answer_id"], ["idx"], id_segment(F.col("idx"), width), total={"_end": "_chars"})
    tails = placed.join(answer_texts(tokens).select("answer_id", "answer"), "answer_id").where(F.col("_end") >= MIN_ANSWER)
    size = F.least(F.col("_end"), F.lit(WINDOW))
    tails = tails.select(
        "answer_id",
        (F.col("_end") - size).cast("int").alias("answer_start"),
        F.col("_end").cast("int").alias("answer_end"),
        F.substring("answer", F.col("_end") - size + 1, size).alias("_tail"),
        "idx",
    )
    # Tokens without characters repeat a tail; the first one emits the citation.
    tails = tails.groupBy("answer_id", "answer_start", "answer_end", "_tail").agg(F.min("idx").alias("idx"))
    sources = retrieval.select("answer_id", "document_id", "version", "cleaned_text")
    found = tails.join(sources, "answer_id").withColumn("_at", F.call_function("locate", F.col("_tail"), F.col("cleaned_text")))
    hits = found.where(F.col("_at") > 0).select(
        "answer_id", "idx", "document_id", "version", "answer_start", "answer_end",
        (F.col("_at") - 1).alias("source_start"),
        (F.col("_at") - 1 + F.col("answer_end") - F.col("answer_start")).alias("source_end"),
    )
    # A document cited in two versions for one span keeps the first.
    return top_n(hits, ["answer_id", "document_id", "answer_start", "answer_end"], [F.col("idx"), F.col("version")], 1, "_r").drop("_r")


def assemble_answers(tokens: DataFrame, citations: DataFrame, retrieval: DataFrame, endings: DataFrame) -> DataFrame:
    """One row per asked answer: full text, number of citations and the error code, if any.

    endings: (answer_id, failure) with failure NULL, ``stream_timeout``, ``model_error`` or other text.
    """
    sources = retrieval.select("answer_id").distinct().withColumn("_sources", F.lit(True))
    cited = citations.groupBy("answer_id").agg(
        F.count("*").alias("citation_count"),
        F.array_sort(F.collect_list(F.struct("idx", "document_id", "version", "answer_start", "answer_end",
                                             "source_start", "source_end"))).alias("citations"),
    )
    base = endings.join(sources, "answer_id", "left").join(answer_texts(tokens), "answer_id", "left").join(
        cited, "answer_id", "left"
    )
    code = (
        F.when(F.col("_sources").isNull(), "no_sources_available")
        .when(F.col("failure").isin("stream_timeout", "model_error"), F.col("failure"))
        .when(F.col("failure").isNotNull(), "internal_error")
    )
    done = F.col("error_code").isNull()
    return base.withColumn("error_code", code).select(
        "answer_id",
        F.when(done, F.coalesce("answer", F.lit(""))).alias("answer"),
        F.when(done, F.coalesce("citation_count", F.lit(0))).alias("citation_count"),
        F.when(done, F.coalesce("citations", F.array().cast(cited.schema["citations"].dataType))).alias("citations"),
        "error_code",
    )


def build_context(results: DataFrame) -> DataFrame:
    """Numbered sources of each query: title, URL and the first 200 characters."""
    entry = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit(" ("), F.col("url"), F.lit(")\n    "),
        F.substring("cleaned_text", 1, 200), F.lit("..."),
    )
    packed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("_e"))
    return packed.select("query_id", F.array_join(F.transform("_e", lambda e: e["entry"]), "\n").alias("context"))
