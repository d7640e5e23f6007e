"""The queries of the operators, under the names of the entry point, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.llm import byte_bpe, collision_search, collocations, exact_topk, max_sketches, mixture, near_duplicates, quality, repeats, reputation, secrets, token_files, wrappers
from citewell.llm.common import read

RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Host, start of the path, and verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality; labels that are held out are never learned from."""
    docs = read(spark, folder, "documents")
    scored = quality.scored(docs, quality.learn(docs, read(spark, folder, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_wrapper_induction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return wrappers.main_texts(read(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op3_collision_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every twentieth vector's 20 nearest."""
    return collision_search.search(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and back."""
    import public_tokenizers

    return byte_bpe.digests(read(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Every fiftieth vector's five highest scores."""
    return exact_topk.search(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, probability and draw of every document."""
    return mixture.mixture(read(spark, folder, "documents"))


def op7_suffix_merge_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What repeated byte strings take from every document."""
    return repeats.digests(read(spark, folder, "documents"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, read back."""
    import public_tokenizers

    files = token_files.write_token_files(read(spark, folder, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID)
    return token_files.read_documents(files)


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The group of near copies of every document."""
    return near_duplicates.near_duplicates(read(spark, folder, "documents"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.secret_spans(read(spark, folder, "documents"))


def op11_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """A page is bad if the label of its id says low quality or toxic."""
    labels = read(spark, folder, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return reputation.judged(read(spark, folder, "pages"), outcomes, rules).drop("bad_bound")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations.collocations(read(spark, folder, "documents"))


def op13_lexical_max_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """The best documents for every benchmark text."""
    return max_sketches.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


QUERIES = {
    "op1_quality_crf": op1_quality_crf,
    "op2_wrapper_induction": op2_wrapper_induction,
    "op3_collision_search": op3_collision_search,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_exact_topk": op5_exact_topk,
    "op6_source_mixture": op6_source_mixture,
    "op7_suffix_merge_dedup": op7_suffix_merge_dedup,
    "op8_token_files": op8_token_files,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_secret_scan": op10_secret_scan,
    "op11_host_reputation": op11_host_reputation,
    "op12_collocations": op12_collocations,
    "op13_lexical_max_sketches": op13_lexical_max_sketches,
}

SQL = {
    "op11_host_reputation": reputation.sql(URL_RULES),
    "op12_collocations": collocations.SQL,
    "op13_lexical_max_sketches": max_sketches.SQL,
    "op6_source_mixture": mixture.sql(),
    "op5_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
            FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
}
