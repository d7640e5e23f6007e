"""From raw documents to token ids: quality, near-duplicates, secrets, mixture, encoding.

All stages but the last return the columns that they are given. NULL and empty texts, NULL doc_ids, repeated rows, very long
texts, further columns and empty tables are allowed in each; what a stage does with them stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citewell.llm import byte_bpe, mixture, near_duplicates, quality, secrets
from citewell.llm.common import cut, read
from citewell.llm.queries import RANKS

#: Share of the tokens that the mixture keeps on average.
BUDGET = 0.8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of documents that are still there.

    NULL and empty texts are scored as one empty line. Repeated rows are judged each; without labels nothing is rejected."""
    return quality.accepted(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays.

    NULL and empty texts and rows without an id are no copies and stay; rows of one id stay or go together."""
    return near_duplicates.distinct_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every row stays, NULL and empty texts as they are."""
    return secrets.redact(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the targets of source, language and topic.

    NULLs of these are a value of their own; texts without tokens stay with their combination's probability, or all if it has
    no tokens; rows of one id share their draw."""
    return mixture.sampled(docs, BUDGET)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every row; a NULL text has no ids, a NULL doc_id stays."""
    import public_tokenizers

    return byte_bpe.encode_texts(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixture", source_mixture),
    ("encode", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written, and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
