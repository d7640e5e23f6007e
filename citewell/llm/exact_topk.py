"""Exact top-k by integer inner product: histograms of all scores, refined until they show the k-th value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewell.llm.blocks import QUERY_ROWS, VECTOR_ROWS, grid_for, matrix_of, met, pack, queries_of, ranked, usable
from citewell.llm.common import cut

BINS = 2048
EXACT_DOUBLE = 2.0**53


def scores(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, vectors by queries; in floating point only where every partial sum is exact."""
    if vectors.size and queries.size and np.abs(vectors).max() * np.abs(queries).max() * vectors.shape[1] >= EXACT_DOUBLE:
        return vectors.astype(np.int64) @ queries.astype(np.int64).T
    return (vectors @ queries.T).astype(np.int64)


def search(vectors: DataFrame, query_condition, k: int, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(scale * x), exactly.

    Every pair of a query and another row is scored, block by block, in every round. A round adds up histograms of the
    scores of all blocks; the bin that holds a query's k-th score is the range of the next round, until it is one number
    wide. Then the scores from that number on are kept; of equal ones at the number itself, a block keeps the k smallest
    ids, so copies of one vector do not pile up. Ties go to the smaller vec_id.

    Vectors that are NULL, empty or hold NULL or non-finite components, and rows without an id, take no part. Rows with
    the query's own id are not its candidates; repeated rows are candidates each, and ask once. Vectors meet only those of
    equal length. A query with fewer than k candidates gets all. No vectors or no queries: no rows. Products must fit 64
    bits. Other columns are left aside.
    """
    whole = usable(vectors).withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")))
    blocks = cut(pack(whole, VECTOR_ROWS, stride=vectors.rdd.getNumPartitions()), "vector-blocks")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    reach = whole.agg(F.max(norm)).first()[0] or 0.0  # no score is beyond the product of two lengths
    bound = (norm * F.lit(reach) + 1).cast("bigint") + 1
    asked = cut(
        queries_of(whole, query_condition).select("vec_id", "embedding", (-bound).alias("low"), F.ceil((2 * bound + 1) / BINS).alias("width"), (bound + 1).alias("high"), F.lit(0).cast("bigint").alias("above")),
        "queries",
    )
    grid = grid_for(vectors, query_condition, VECTOR_ROWS)

    def pairs(asked: list[dict], stored: Iterator[dict], *columns: str) -> Iterator[tuple]:
        """Ids and scores of each two blocks, and the columns of the query block."""
        queries = [(row["dim"], *matrix_of(row), [np.frombuffer(row[c], np.int64) for c in columns]) for row in asked]
        for row in stored:
            ids, matrix = matrix_of(row)
            for dim, q_ids, q_matrix, values in queries:
                if dim == row["dim"]:
                    yield ids, q_ids, scores(matrix, q_matrix), *values

    def histograms(asked: list[dict], stored: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for ids, q_ids, found, low, width, high in pairs(asked, stored, "low", "width", "high"):
            bins = np.where(width > 0, (found - low) // np.maximum(width, 1), -1)
            bins[(ids[:, None] == q_ids) | (found >= high)] = -1  # higher ones are counted already
            # No bin below the block's own k-th score can hold the k-th of all.
            floor = np.partition(bins, len(ids) - k, axis=0)[len(ids) - k] if len(ids) > k else np.zeros(len(q_ids), np.int64)
            r, c = np.nonzero((bins >= floor) & (bins >= 0))
            code, count = np.unique(c * BINS + bins[r, c], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[code // BINS]), pa.array(code % BINS), pa.array(count.astype(np.int64))], names=["query_id", "bin", "n"])

    while asked.where("width > 0").limit(1).count():
        counted = met(blocks, pack(asked, QUERY_ROWS, ["low", "width", "high"]), grid, histograms, "query_id bigint, bin bigint, n bigint")
        summed = counted.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))  # at most BINS rows for each query
        running = summed.join(asked.select(F.col("vec_id").alias("query_id"), "above"), "query_id").withColumn("upto", F.col("above") + F.sum("n").over(down))
        reached = running.where(f"upto >= {k}").groupBy("query_id").agg(F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("over"))).alias("at"))
        # A width of 0 says that ``low`` is the k-th score itself, or that there are fewer than k.
        asked = cut(
            asked.join(reached.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select(
                "vec_id", "embedding",
                F.when(F.col("at").isNull() | (F.col("width") == 0), F.col("low")).otherwise(F.col("low") + F.col("at.bin") * F.col("width")).alias("low"),
                F.when(F.col("at").isNull() | (F.col("width") <= 1), F.lit(0)).otherwise(F.ceil(F.col("width") / BINS)).cast("bigint").alias("width"),
                F.when(F.col("at").isNull() | (F.col("width") == 0), F.col("high")).otherwise(F.least(F.col("high"), F.col("low") + (F.col("at.bin") + 1) * F.col("width"))).alias("high"),
                F.when(F.col("at").isNull() | (F.col("width") == 0), F.col("above")).otherwise(F.col("at.over")).alias("above"),
            ),
            "queries",
        )

    def selected(asked: list[dict], stored: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for ids, q_ids, found, low in pairs(asked, stored, "low"):
            kept = (found >= low) & (ids[:, None] != q_ids)
            c, r = np.nonzero(kept.T)
            order = np.lexsort((ids[r], -found[r, c], c))
            c, r = c[order], r[order]
            place = np.arange(len(c)) - np.searchsorted(c, c)
            c, r = c[place < k], r[place < k]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[c]), pa.array(ids[r]), pa.array(found[r, c])], names=["query_id", "vec_id", "score"])

    return ranked(met(blocks, pack(asked, QUERY_ROWS, ["low"]), grid, selected, "query_id bigint, vec_id bigint, score bigint"), k)
