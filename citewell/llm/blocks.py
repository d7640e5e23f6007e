"""Vectors packed into rows of many, so that a query set meets all vectors block by block."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR_ROWS = 4096
QUERY_ROWS = 512
CELLS_PER_CORE = 4
PART_QUERIES = 65_536
#: A prime, so that blocks of one partition lie in different parts as well.
STRIDE = 1_048_583


def usable(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """vec_id and embedding as doubles, or floats where the table has these, of the rows with an id and finite components (and,
    if asked, one that is not 0)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0)
    if nonzero:
        kept &= F.exists("embedding", lambda x: x != 0)
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    return vectors.where(kept).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))


def pack(vectors: DataFrame, rows: int, more: list[str] | None = None, stride: int = STRIDE) -> DataFrame:
    """One row for up to ``rows`` vectors of equal length: block, dim, n, ids and matrix (both as bytes); columns named in
    ``more`` (all bigint) are packed alike. ``stride`` is no less than the number of partitions; blocks count on from one to the
    next if it is that number."""
    more = more or []
    names = ["block", "dim", "n", "ids", "matrix", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = TaskContext.get().partitionId()

        def row(dim: int, parts: list) -> pa.RecordBatch:
            nonlocal made
            ids, matrix, *others = (np.concatenate(x) for x in zip(*parts, strict=True))
            values = [made, dim, len(ids), ids.tobytes(), matrix.tobytes(), *(x.tobytes() for x in others)]
            made += stride
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)

        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten())
            at = np.concatenate([[0], np.cumsum(sizes)])
            scalars = [np.asarray(batch.column(c)) for c in (0, *range(2, 2 + len(more)))]
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                matrix = flat[(at[mine][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
                for start in range(0, len(mine), rows):
                    some = slice(start, start + rows)
                    parts = held.setdefault(dim, [])
                    parts.append((scalars[0][mine[some]], matrix[some], *(s[mine[some]] for s in scalars[1:])))
                    if sum(len(p[0]) for p in parts) >= rows:
                        yield row(dim, parts)
                        held[dim] = []
        for dim, parts in held.items():
            if parts:
                yield row(dim, parts)

    schema = "block bigint, dim bigint, n bigint, ids binary, matrix binary" + "".join(f", {c} binary" for c in more)
    return vectors.select("vec_id", "embedding", *more).mapInArrow(run, schema)


def grid_for(vectors: DataFrame, condition: Column, rows: int) -> tuple[int, int]:
    """Into how many parts the vectors, in blocks of ``rows``, and their queries are dealt.

    Cells are a few for each core. A query travels, and has results, as often as the vectors have parts, and a vector as often as
    the queries have, so the smaller side has fewer. A part holds at most ``PART_QUERIES`` queries.
    """
    held, asked = (max(1, x) for x in vectors.agg(F.count("*"), F.count_if(condition)).first())
    cells = CELLS_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism
    across = min(math.ceil(held / rows), max(1, round(math.sqrt(cells * held / (2 * asked)))))
    down = max(math.ceil(asked / PART_QUERIES), min(math.ceil(asked / QUERY_ROWS), math.ceil(cells / across)))
    return across, down


def met(vector_blocks: DataFrame, query_blocks: DataFrame, grid: tuple[int, int], run: Callable[[list[dict], Iterator[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` on the query blocks and, one by one, the vector blocks of each cell of a grid; every pair of blocks meets in one.

    A cell is a partition: its query blocks come first and are held, vector blocks pass. Nothing is joined, so that no side can
    be taken for small and be collected. Blocks of different dimensions meet too; ``run`` tells them apart.
    """
    across, down = grid
    parts = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    dealt = lambda n: F.pmod("block", F.lit(n).cast("bigint"))
    stored = vector_blocks.withColumn("_kind", F.lit(1)).withColumn("_v", dealt(across)).withColumn("_q", parts(down))
    asked = query_blocks.withColumn("_kind", F.lit(0)).withColumn("_q", dealt(down)).withColumn("_v", parts(across))
    cell = (F.col("_q") * across + F.col("_v")).cast("int")
    placed = asked.unionByName(stored, allowMissingColumns=True).withColumn("_cell", cell).repartitionById(across * down, "_cell").sortWithinPartitions("_cell", "_kind")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = (column[i] for column in batch.columns)
                yield {c: v.as_buffer() if hasattr(v, "as_buffer") else v.as_py() for c, v in zip(batch.schema.names, values, strict=True)}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in groupby(rows(batches), lambda r: r["_cell"]):
            kinds = groupby(members, lambda r: r["_kind"])
            kind, first = next(kinds)
            held = list(first) if kind == 0 else []
            if held and (vectors := next(kinds, None)):
                yield from run(held, vectors[1])

    return placed.drop("_v", "_q").mapInArrow(cells, schema)


class Best:
    """The k best (score falling, id rising) of each of so many queries, over blocks of vectors."""

    def __init__(self, queries: int, k: int, kind: type):
        least = -np.inf if kind is np.float64 else np.iinfo(kind).min
        self.k, self.n = k, np.zeros(queries, np.int64)
        self.scores, self.ids = np.full((queries, k), least, kind), np.zeros((queries, k), np.int64)

    def floor(self, query: int):
        """The k-th score so far; lower ones are of no use, and none is lower before there are k."""
        return self.scores[query, -1]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        n = self.n[query]
        scores, ids = np.concatenate([self.scores[query, :n], scores]), np.concatenate([self.ids[query, :n], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        n = self.n[query] = len(order)
        self.scores[query, :n], self.ids[query, :n] = scores[order], ids[order]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        kept = np.arange(self.k) < self.n[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, self.n)), pa.array(self.ids[kept]), pa.array(self.scores[kept])], names=["query_id", "vec_id", "score"])


def queries_of(vectors: DataFrame, condition: Column) -> DataFrame:
    """The vectors that ask, one for each id (the smallest, where an id is repeated)."""
    return vectors.where(condition).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, in doubles."""
    ids = np.frombuffer(row["ids"], np.int64)
    kind = np.float32 if len(row["matrix"]) == 4 * len(ids) * row["dim"] else np.float64
    return ids, np.frombuffer(row["matrix"], kind).reshape(len(ids), row["dim"]).astype(np.float64)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query_id by (score falling, vec_id), with their rank from 1."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
