"""Approximate nearest neighbours by counting collisions of single projections in sorted arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citewell.llm.blocks import QUERY_ROWS, Best, grid_for, matrix_of, met, pack, queries_of, ranked, usable

SHARD_ROWS = 8192
#: Queries whose windows open together; what is counted for them stays in a core's cache.
TOGETHER = 32
PROJECTIONS = 48
#: Collisions that make a vector a candidate, as a share of the projections.
THRESHOLD = 0.65
#: Candidates that end the widening of windows: a share of the shard, and so many for each neighbour asked for.
SHARE = 0.27
CANDIDATES = 8
#: First half-width of a window, as a share of the distance that a projection spreads over, and its growth per rehashing.
FIRST, GROWTH = 1.0, 1.1
SEED = 20_251


@lru_cache(maxsize=8)
def directions(dim: int) -> np.ndarray:
    """The projections: standard normal, one more than the dimension for the part that makes lengths equal."""
    return np.random.default_rng(SEED + dim).standard_normal((dim + 1, PROJECTIONS))


class Shard:
    """Vectors and, for each projection, a sorted array: the values in order, and the place in it of every row. A further
    component lifts all vectors to the length of the longest, so that the nearest point has the largest inner product. The
    largest component of the shard is taken as one, so that no square is lost or infinite."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        scaled = matrix / np.abs(matrix).max()
        squares = (scaled**2).sum(axis=1)
        self.longest = float(squares.max())
        lifted = np.hstack([scaled, np.sqrt(np.maximum(0.0, self.longest - squares))[:, None]])
        values = (lifted @ directions(matrix.shape[1])).T
        order = np.argsort(values, axis=1, kind="stable")
        self.places = np.empty(values.shape, np.uint16)
        np.put_along_axis(self.places, order, np.arange(len(ids), dtype=np.uint16)[None, :], 1)
        self.values = np.take_along_axis(values, order, 1)
        self.halves, self.step = [FIRST * np.sqrt(self.longest)], 0
        self.spare = tuple(np.empty((TOGETHER, len(ids)), kind) for kind in (np.uint16, bool, np.uint8))
        self.gathered = np.empty_like(matrix)

    def hits(self, centres: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Which rows (columns) lie in enough of the windows of a query (row), and whether its windows hold the whole shard."""
        m, needed = len(centres), int(np.ceil(THRESHOLD * PROJECTIONS))
        offset, inside, count = (x[:m] for x in self.spare)
        count[:] = 0
        whole = np.ones(m, bool)
        for p, (places, values) in enumerate(zip(self.places, self.values, strict=True)):
            low, high = values.searchsorted(centres[:, p] - half), values.searchsorted(centres[:, p] + half)
            whole &= high - low == len(self.ids)
            # Unsigned, a place before the window wraps around and lies beyond its width.
            np.subtract(places, low.astype(np.uint16)[:, None], out=offset)
            np.less(offset, (high - low).astype(np.uint16)[:, None], out=inside)
            np.add(count, inside.view(np.uint8), out=count)
        return count >= needed, whole

    def candidates(self, centres: np.ndarray, wanted: int) -> np.ndarray:
        """The rows over the collision threshold for some queries, once there are enough.

        A window around the query's own projection opens in every sorted array and widens step by step (virtual rehashing); a
        row whose place lies in a window collides once. Wider windows hold what narrower ones do, so that a query's first step
        with enough rows is sought from the one where queries before it ended.
        """
        found, ended = np.empty((len(centres), len(self.ids)), bool), np.zeros(len(centres), np.int64)

        def tried(rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
            while len(self.halves) <= step:
                self.halves.append(self.halves[-1] * GROWTH)
            hits, whole = self.hits(centres[rows], self.halves[step])
            enough = whole | (np.count_nonzero(hits, axis=1) >= wanted) | (not np.isfinite(self.halves[step]))
            found[rows[enough]], ended[rows[enough]] = hits[enough], step
            return rows[enough], rows[~enough]

        step = self.step
        narrower, wider = tried(np.arange(len(centres)), step)
        while len(wider):
            wider = tried(wider, step := step + 1)[1]
        step = self.step
        while len(narrower) and step > 0:
            narrower = tried(narrower, step := step - 1)[0]
        self.step = int(np.median(ended))
        return found

    def search(self, q_ids: np.ndarray, queries: np.ndarray, projected: np.ndarray, best: Best) -> None:
        """The candidates of each query, scored exactly; ``projected`` are the queries at length one, projected."""
        n = len(self.ids)
        wanted = min(n, int(SHARE * n) + CANDIDATES * best.k + 1)
        for start in range(0, len(q_ids), TOGETHER):
            # A query may have any length; at that of the vectors its order of them is the same and the windows fit.
            found = self.candidates(projected[start : start + TOGETHER] * np.sqrt(self.longest), wanted)
            for q, hits in enumerate(found, start):
                rows = np.flatnonzero(hits)
                rows = rows[self.ids[rows] != q_ids[q]]
                scores = np.take(self.matrix, rows, axis=0, out=self.gathered[: len(rows)], mode="clip") @ queries[q]
                least = best.floor(q)
                if len(rows) > best.k:
                    least = max(least, np.partition(scores, len(rows) - best.k)[len(rows) - best.k])
                near = np.flatnonzero(scores >= least)
                if len(near):
                    best.add(q, scores[near], self.ids[rows[near]])


def _projected(queries: np.ndarray) -> np.ndarray:
    direction = queries / np.abs(queries).max(axis=1, keepdims=True)
    return (direction / np.sqrt((direction**2).sum(axis=1, keepdims=True))) @ directions(queries.shape[1])[:-1]


def search(vectors: DataFrame, query_condition, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query by inner product, in double precision.

    Every row is indexed, in shards of ``SHARD_ROWS`` that hold one sorted array per projection, made where a shard meets its
    queries; every query asks every shard and verifies the rows over the collision threshold on the original vectors. A task
    keeps k rows per query. Parameters are the same at every size; recall against brute force is measured in the tests. Ties
    go to the smaller vec_id.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows without an id, take no part. Rows
    with the query's own id are not its candidates; repeated rows are candidates each, and ask once. Vectors meet only
    those of equal length. No vectors or no queries: no rows. Other columns are left aside.
    """
    whole = usable(vectors, nonzero=True)
    asking = pack(queries_of(whole, query_condition), QUERY_ROWS)

    def run(asked: list[dict], stored: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        queries = {}
        for dim in {row["dim"] for row in asked}:
            q_ids, matrix = (np.concatenate(x) for x in zip(*(matrix_of(row) for row in asked if row["dim"] == dim), strict=True))
            queries[dim] = q_ids, matrix, _projected(matrix), Best(len(q_ids), k, np.float64)
        for row in stored:
            if row["dim"] in queries:
                Shard(*matrix_of(row)).search(*queries[row["dim"]])
        for q_ids, _, _, best in queries.values():
            yield best.batch(q_ids)

    shards = pack(whole, SHARD_ROWS, stride=vectors.rdd.getNumPartitions())
    return ranked(met(shards, asking, grid_for(vectors, query_condition, SHARD_ROWS), run, "query_id bigint, vec_id bigint, score double"), k)
