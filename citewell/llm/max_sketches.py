"""Ranked lexical search by hashed max-sketches: bounds for all documents and queries, exact scores only where they matter.

A document's impacts (how much one occurrence count adds per unit of a term's weight) are folded into a sketch: every
term has two hashed coordinates, and each keeps the largest count that falls on it. The smaller of a term's two
coordinates is never below its true count, so the sum over a query's terms bounds the score from above. Documents are
scored exactly by falling bound until the bound does not reach the ``k``-th best score so far. The result is exact.

Queries come in batches of bounded bytes; every batch is one scan of the documents, which neither writes nor shuffles
them. A task keeps k documents per query of a batch. Terms are those of ``terms_of``.

NULL and empty texts have no terms and are in no result. Documents without an id count in the statistics and are not
returned; rows that repeat an id are documents of their own. Rows of one item id are one query, NULL item ids none.
Equal scores are ordered by doc_id. Empty tables give an empty result, further columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewell.llm.common import cut, pieces, utf8

BEST = 50
PIECE_BYTES = 3_000_000
#: Bytes of terms that one batch of queries holds (or one longer query).
QUERY_BYTES = 2_000_000
#: Coordinates per different term of a document, at least.
SPREAD = 8
#: Bounds that are worked out at once.
CELLS = 1_500_000
MEMO = 500_000
SCALE, SATURATION, FLAT, SLOPE = 1_000_000_000, 1000, 50, 50

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: What a coordinate's byte stands for: counts up to 128 themselves, larger ones rounded up.
LEVELS = np.concatenate([np.arange(129), np.ceil(128 * 2.0 ** (np.arange(1, 127) * 25 / 126))]).astype(np.int64)


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, with A-Z in lower case, of UTF-8."""
    return text.translate(_TABLE).split()


class Numbers(dict):
    """Term -> 64 bits; stops learning when it grows too long."""

    def __missing__(self, term: bytes) -> int:
        number = xxhash.xxh3_64_intdigest(term)
        if len(self) < MEMO:
            self[term] = number
        return number


def term_rows(texts: DataFrame, key: str) -> DataFrame:
    """The key and each different term of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                data, ends = utf8(piece.column(1))
                terms = [sorted(set(terms_of(data[a:b].tobytes()))) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                keys = piece.column(0).take(pa.array(np.repeat(np.arange(len(terms)), [len(t) for t in terms])))
                yield pa.record_batch([keys, pa.array([t.decode() for some in terms for t in some], pa.string())], names=[key, "term"])

    return texts.select(F.col(key).cast("bigint"), "text").mapInArrow(run, f"{key} bigint, term string")


def document_counts(docs: DataFrame) -> DataFrame:
    """term, documents that hold it, and 0, in parts that need adding up. The empty term has the number of documents with
    terms, and the number of their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                data, ends = utf8(piece.column(0))
                holding, n, total = Counter(), 0, 0
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    terms = terms_of(data[a:b].tobytes())
                    holding.update(set(terms))
                    n, total = n + bool(terms), total + len(terms)
                names = pa.array(["", *(t.decode() for t in holding)], pa.string())
                yield pa.record_batch([names, pa.array([n, *holding.values()], pa.int64()), pa.array([total] + [0] * len(holding), pa.int64())], names=["term", "documents", "terms"])

    return docs.select("text").mapInArrow(run, "term string, documents bigint, terms bigint")


def weighted_queries(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, int, int]:
    """item_id and its terms with their weights, the number of documents with terms, and all their terms."""
    spark = docs.sparkSession
    asked = cut(term_rows(queries.where("item_id IS NOT NULL"), "item_id").distinct(), "query-terms")
    wanted = asked.select("term").distinct().union(spark.createDataFrame([("",)], "term string"))
    counts = cut(document_counts(docs).join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("documents").alias("df"), F.sum("terms").alias("terms")), "query-term-counts")
    totals = counts.where("term = ''").first()
    n, total = (totals.df, totals.terms) if totals else (0, 0)
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighted = asked.join(counts.where("df > 0 AND term <> ''").select("term", weight.alias("w")), "term").where("w > 0")
    return weighted.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms")), n, total


def batches_of(queries: DataFrame) -> Iterator[list[tuple[int, list[tuple[bytes, int]]]]]:
    """The queries by their ids, as many as ``QUERY_BYTES`` hold; they pass through the driver batch by batch."""
    held, size = [], 0
    for row in queries.orderBy("item_id").toLocalIterator():
        terms = [(t.term.encode(), t.w) for t in row.terms]
        length = sum(len(t) + 8 for t, _ in terms)
        if held and size + length > QUERY_BYTES:
            yield held
            held, size = [], 0
        held.append((row.item_id, terms))
        size += length
    if held:
        yield held


class Batch:
    """Queries side by side: their different terms, and for each query where its terms are and what they weigh."""

    def __init__(self, queries: list[tuple[int, list[tuple[bytes, int]]]]) -> None:
        self.queries = queries
        place: dict[bytes, int] = {}
        at = [place.setdefault(t, len(place)) for _, terms in queries for t, _ in terms]
        self.at, self.weights = np.array(at, np.int64), np.array([w for _, terms in queries for _, w in terms], np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(terms) for _, terms in queries])])[:-1]
        numbers = np.array([xxhash.xxh3_64_intdigest(t) for t in place], np.uint64)
        self.first, self.second = coordinates(numbers)

    def bounds(self, sketches: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Upper bound of every document's score for every query; one row of ``sketches`` and of ``lengths`` per document."""
        last = np.uint64(sketches.shape[1] - 1)
        codes = np.minimum(sketches[:, self.first & last], sketches[:, self.second & last])
        most = impacts(LEVELS[None, :], lengths[:, None])
        return np.add.reduceat(np.take_along_axis(most, codes, 1)[:, self.at] * self.weights, self.starts, axis=1)


def coordinates(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return numbers, (numbers >> np.uint64(32)) | (numbers << np.uint64(32))


def impacts(times: np.ndarray, length: np.ndarray) -> np.ndarray:
    return SCALE * times // (SATURATION * times + 20 * length)


def sketch(numbers: np.ndarray, times: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """One row of ``width`` (a power of two) maxima per document; ``ends`` tells where each one's terms begin and end."""
    rows = np.zeros((len(ends) - 1, width), np.uint8)
    codes = np.searchsorted(LEVELS, times).astype(np.uint8)
    first = np.repeat(np.arange(len(ends) - 1) * width, np.diff(ends))
    for some in coordinates(numbers):
        np.maximum.at(rows.reshape(-1), first + (some & np.uint64(width - 1)).astype(np.int64), codes)
    return rows


class Best:
    """The k best documents of a query so far, by score and then the smaller id."""

    def __init__(self, terms: list[tuple[bytes, int]], k: int) -> None:
        self.terms, self.k, self.kept = terms, k, []

    def least(self) -> int:
        """A score that a document must reach."""
        return self.kept[0][0] if len(self.kept) == self.k else 1

    def exact(self, counts: dict[bytes, int], length: int) -> int:
        score = 0
        for term, weight in self.terms:
            times = counts.get(term)
            if times:
                score += weight * (SCALE * times // (SATURATION * times + 20 * length))
        return score

    def rescore(self, bounds: np.ndarray, ids: np.ndarray, counts: list[dict[bytes, int]], lengths: np.ndarray) -> None:
        some = np.flatnonzero(bounds >= self.least())
        for i in some[np.lexsort((ids[some], -bounds[some]))].tolist():
            if bounds[i] < self.least():
                return
            found = (self.exact(counts[i], int(lengths[i])), -int(ids[i]))
            if found[0] > 0 and len(self.kept) < self.k:
                heapq.heappush(self.kept, found)
            elif found[0] > 0 and found > self.kept[0]:
                heapq.heapreplace(self.kept, found)


def found_in_tasks(docs: DataFrame, queries: list, n: int, total: int, k: int) -> DataFrame:
    """item_id, doc_id and score of each task's k best documents for each query of a batch."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, numbers = Batch(shared.value), Numbers()
        best = [Best(terms, k) for _, terms in batch.queries]
        for whole in batches:
            for piece in pieces(whole, "text", PIECE_BYTES):
                data, ends = utf8(piece.column(1))
                found = []
                for doc, a, b in zip(piece.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    terms = terms_of(data[a:b].tobytes())
                    if terms:
                        found.append((doc, len(terms), dict(Counter(terms))))
                look(found, batch, best, numbers)
        rows = [(item, -d, s) for (item, _), b in zip(batch.queries, best, strict=True) for s, d in b.kept]
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["item_id", "doc_id", "score"])

    def look(found: list, batch: Batch, best: list[Best], numbers: Numbers) -> None:
        by_width: dict[int, list] = {}
        for row in found:
            by_width.setdefault(1 << (SPREAD * len(row[2]) - 1).bit_length(), []).append(row)
        for width, rows in by_width.items():
            step = max(1, CELLS // max(len(batch.at), width))
            for start in range(0, len(rows), step):
                ids, sizes, counts = (list(x) for x in zip(*rows[start : start + step], strict=True))
                ids, lengths = np.array(ids, np.int64), FLAT + SLOPE * np.array(sizes, np.int64) * n // total
                bounds_at = np.concatenate([[0], np.cumsum([len(c) for c in counts])])
                codes = np.fromiter((numbers[t] for c in counts for t in c), np.uint64, bounds_at[-1])
                times = np.fromiter((v for c in counts for v in c.values()), np.int64, bounds_at[-1])
                bounds = batch.bounds(sketch(codes, times, bounds_at, width), lengths)
                least = np.array([b.least() for b in best])
                for q in np.flatnonzero((bounds >= least).any(axis=0)).tolist():
                    best[q].rescore(bounds[:, q], ids, counts, lengths)

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, queries: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k documents of highest score above 0 for each query (item_id, text).

    Statistics cover all documents: a term's weight falls with the share of documents that hold it, a document's impact
    grows with the count of the term and falls with the document's length against the mean.
    """
    weighted, n, total = weighted_queries(docs, queries)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    found = None
    for batch in batches_of(cut(weighted, "queries")):
        some = found_in_tasks(docs, batch, n, total, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        some = cut(some.select("item_id", "rank", "doc_id", "score"), "ranked")
        found = some if found is None else found.union(some)
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


SQL = r"""
    WITH terms AS (
        SELECT d, doc_id, unnest(t) AS term, len(t) AS n FROM (
            SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents)
    ), counts AS (
        SELECT d, doc_id, n, term, count(*) AS tf FROM terms GROUP BY ALL
    ), whole AS (
        SELECT count(DISTINCT d) AS n_docs, count(*) AS n_terms FROM terms
    ), asked AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM counts, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs
    ), scores AS (
        SELECT item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
        FROM asked JOIN weights USING (term) JOIN counts USING (term), whole GROUP BY ALL
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""
