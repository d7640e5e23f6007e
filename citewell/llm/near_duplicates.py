"""Near-duplicate documents: fast similarity sketches, banding, and confirmation on full shingle sets."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import cut, mapped, texts_of, utf8
from citewell.llm.components import components
from citewell.llm.shingles import mixed, shingle_sets

COORDINATES = 128
BAND_ROWS = 4
#: Two sets are linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Pairs whose sketches agree in fewer coordinates are not confirmed: at the similarity asked for, 96 agree on average, and
#: fewer than 72 about once in a million pairs.
LEAST_AGREEING = 72
#: Members of a bucket that a task holds at a time, and about the bytes of their sets.
BLOCK = 4096
BLOCK_BYTES = 32_000_000


def sketches(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``COORDINATES`` for each set, zero for an empty one.

    Round i throws every element into a bin with a value that begins with i; a bin keeps its least value, so later rounds
    fill only bins that are still empty. In the first t rounds the bin is hashed; round t + j goes to bin j alone. After
    2 t rounds every coordinate is filled, however small the set; sets whose bins are full take no part in further rounds.
    """
    t = COORDINATES
    n = len(offsets) - 1
    empty = np.iinfo(np.uint64).max
    bins = np.full(n * t, empty, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    for i in range(2 * t):
        h = mixed(elements + np.uint64((i + 1) * 0xD1342543DE82EF95 % 2**64))
        bin_of = (h >> np.uint64(57)).astype(np.int64) if i < t else i - t
        np.minimum.at(bins, owner * t + bin_of, np.uint64(i) << np.uint64(48) | h & np.uint64(2**48 - 1))
        full = (bins.reshape(n, t) != empty).all(axis=1)
        waiting = ~full[owner]
        elements, owner = elements[waiting], owner[waiting]
        if len(elements) == 0:
            break
    return np.where(bins == empty, np.uint64(0), bins).reshape(n, t)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a sketch, different from band to band."""
    banded = rows.reshape(len(rows), -1, BAND_ROWS)
    keys = np.arange(1, banded.shape[1] + 1, dtype=np.uint64)[None, :].repeat(len(rows), 0)
    for j in range(BAND_ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, j])
    return keys.astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash (of the whole set), bands and sketch (a byte of each coordinate) of every document."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        elements, offsets = shingle_sets(*utf8(piece.column("text")))
        rows = sketches(elements, offsets)
        n = np.diff(offsets)
        keys = band_keys(rows)
        hashes = [hashlib.blake2b(elements[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
        small = [x.tobytes() for x in mixed(rows).astype(np.uint8)]
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), lists, pa.array(small, pa.binary())],
            names=["doc_id", "n_shingles", "set_hash", "bands", "sketch"],
        )

    return mapped(texts_of(docs), run, "doc_id bigint, n_shingles bigint, set_hash binary, bands array<bigint>, sketch binary")


def _alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity."""
    one = signed.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    two = signed.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    # Merged by key at every size: how much is moved then grows with the input and not in steps.
    sized = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s_a, s_b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("s_a", "s_b"))
            keep = (s_a == s_b).sum(axis=1) >= LEAST_AGREEING
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return sized.select("a", "b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint").distinct()


def full_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """doc_id and shingle set (sorted 64-bit hashes) of the documents in ``needed``; the only time that texts are moved."""

    def as_set(piece: pa.RecordBatch) -> pa.RecordBatch:
        elements, offsets = shingle_sets(*utf8(piece.column("text")))
        sets = [elements[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "elements"])

    return cut(mapped(texts_of(docs).join(needed.hint("merge"), "doc_id", "left_semi"), as_set, "doc_id bigint, elements binary"), "shingle-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    one, two = (sets.select(F.col("doc_id").alias(x), F.col("elements").alias(f"e_{x}")) for x in "ab")
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("e_a"), batch.column("e_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "e_a", "e_b").mapInArrow(run, "a bigint, b bigint").distinct()


def _through_buckets(rows: DataFrame, values: list[str], compare: Callable, schema: str) -> DataFrame:
    """``compare(those that ask, a block)`` for every bucket (key, n) of ``rows``, both as arrays of ``values``.

    A bucket is cut into blocks of about ``BLOCK`` members, or fewer where the sets of that many would exceed
    ``BLOCK_BYTES``, held by a task one at a time; the members that ask (not in the
    bucket's main component) pass by every block in turn.
    """
    columns = ["key", "block", "asks", *values]
    wide = rows.withColumn("blocks", F.ceil(F.col("n") * F.greatest(F.lit(1 / BLOCK), 8 * F.col("most") / BLOCK_BYTES)).cast("int"))
    held = wide.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("asks", F.lit(0))
    asking = wide.where("component <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(1))
    dealt = held.select(*columns).unionByName(asking.select(*columns)).repartition("key", "block").sortWithinPartitions("key", "block", "asks")

    def array(batch: pa.RecordBatch, name: str) -> np.ndarray:
        column = batch.column(batch.schema.get_field_index(name))
        if name == "sketch":
            return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)
        if name == "bands":
            return np.asarray(column.flatten()).reshape(-1, COORDINATES // BAND_ROWS)
        if name == "elements":
            return np.array([*(np.frombuffer(x, np.uint64) for x in column.to_pylist()), None], object)[:-1]
        return np.asarray(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for batch in batches:
            key, number, asks, *found = (array(batch, c) for c in columns)
            edges = np.flatnonzero((key[1:] != key[:-1]) | (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            bounds = [0, *edges.tolist(), len(key)] if len(key) else [0]
            for start, end in itertools.pairwise(bounds):
                here, some = (key[start], number[start]), [x[start:end] for x in found]
                if here != at:
                    at, parts, block = here, [], None
                if not asks[start]:
                    parts.append(some)
                elif parts:
                    block = block or [np.concatenate(x) for x in zip(*parts, strict=True)]
                    for first in range(0, end - start, 128):
                        yield from compare(key[start], [x[first : first + 128] for x in some], block)

    return dealt.mapInArrow(run, schema)


def _possible(key: int, some: list[np.ndarray], block: list[np.ndarray]) -> np.ndarray:
    """Agreeing coordinates of those that ask (rows) with a block (columns); 0 where the pair need not be confirmed here:
    connected already, too different in size or sketch, or of an earlier bucket too."""
    (_, c, n, s, b), (_, component, size, sketch, bands) = some[:5], block[:5]
    agree = np.zeros((len(c), len(component)), np.uint8)
    for i in range(0, COORDINATES, 16):
        agree += (s[:, None, i : i + 16] == sketch[None, :, i : i + 16]).sum(axis=2, dtype=np.uint8)
    agree[(c[:, None] == component) | (100 * np.minimum(n[:, None], size) < PERCENT * np.maximum(n[:, None], size)) | (agree < LEAST_AGREEING)] = 0
    x, y = np.nonzero(agree)
    first = (b[x] == bands[y]).argmax(axis=1)
    other = b[x, first] != key
    agree[x[other], y[other]] = 0
    return agree


def _candidates(key: int, some: list[np.ndarray], block: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each that asks with the one of most agreement (a, b); and, with a NULL for b, all that take part in a possible pair."""
    agree = _possible(key, some, block)
    asks = np.flatnonzero(agree.any(axis=1))
    if len(asks):
        x, y = some[0][asks], block[0][agree[asks].argmax(axis=1)]
        part = np.concatenate([x, block[0][agree.any(axis=0)]])
        a, b = np.concatenate([np.minimum(x, y), part]), pa.array([*np.maximum(x, y).tolist(), *[None] * len(part)], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), key)), pa.array(a), b], names=["key", "a", "b"])


def _linked(key: int, some: list[np.ndarray], block: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Confirmed links (a, b) of those that ask: one for each component that one is linked with."""
    agree = _possible(key, some, block)
    links = []
    for x, row in enumerate(agree):
        others = np.flatnonzero(row)
        if len(others) == 0:
            continue
        mine, sets = some[5][x], block[5][others]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets)
        place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        shared = np.add.reduceat((mine[place] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
        good = others[100 * shared >= PERCENT * (len(mine) + sizes - shared)]
        _, one = np.unique(block[1][good], return_index=True)
        links += [(min(some[0][x], block[0][y]), max(some[0][x], block[0][y])) for y in good[one]]
    if links:
        yield pa.RecordBatch.from_arrays([pa.array([int(link[i]) for link in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _mixed(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (key, n, most, doc_id, component, main) of the buckets in which not all are in the smallest one's component."""
    placed = members.where("n > 2").join(components(links), "doc_id", "left").withColumn("component", F.coalesce("component_id", "doc_id"))
    main = placed.where("doc_id = pivot").select("key", F.col("component").alias("main")).distinct()
    outside = placed.join(main, "key").where("component <> main").select("key").distinct()
    return cut(placed.join(outside, "key", "left_semi").join(main, "key").select("key", "doc_id", "n", "most", "component", "main"), "mixed")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, n_shingles, component_id and kept (the document is its component's smallest).

    Documents with the same set are one class, whatever their number. Classes that agree in a band share a bucket. In a
    bucket every member is compared with the smallest one; each that is then in another component is compared with
    the one of most similar sketch, and what is still apart after that with all members whose sketches allow a link, inside
    a task that holds their sets: only links leave it. So a bucket of copies sends its size and not its square, and yet every
    two members are compared or connected. Each comparison is confirmed on full sets.

    NULL and empty texts have no set and are linked with nothing. Rows of one doc_id are one document. A NULL doc_id is
    linked with nothing, has a NULL component and is kept. Other columns are left aside; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = cut(signatures(docs), "signatures")
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    copied = cut(real.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "classes")
    # Of each class its smallest document stands for all; NULL ids and empty sets are in none.
    members_of = real.select("doc_id", "set_hash").join(copied, "set_hash").where("doc_id <> rep").select("doc_id", "rep").distinct()
    alone = cut(members_of, "copies")
    nodes = real.join(alone.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti")
    bucket = nodes.select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    keys = bucket.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("other"), F.count("*").alias("n"), F.max("n_shingles").alias("most")).where("other <> pivot")
    members = cut(bucket.drop("n_shingles").join(keys.drop("other"), "key"), "buckets")
    tested = cut(members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    alike = cut(_alike(tested, signed), "pairs")
    needed = alike.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(members.where("n > 2").select("doc_id")).distinct()
    sets = full_sets(docs, needed)
    links = cut(_confirmed(alike, sets), "confirmed")
    values = ["doc_id", "component", "n_shingles", "sketch", "bands"]
    about = signed.select("doc_id", "n_shingles", "sketch", "bands").where("doc_id IS NOT NULL").hint("merge")
    candidates = cut(_through_buckets(_mixed(members, links).join(about, "doc_id"), values, _candidates, "key bigint, a bigint, b bigint"), "candidates")
    best = candidates.where("b IS NOT NULL").select("a", "b").distinct()
    links = cut(links.unionByName(_confirmed(best, sets)), "confirmed")
    possible = candidates.where("b IS NULL").select("key", F.col("a").alias("doc_id")).distinct()
    left = _mixed(members, links).join(possible.hint("merge"), ["key", "doc_id"]).join(about, "doc_id").join(sets.hint("merge"), "doc_id")
    links = cut(links.unionByName(_through_buckets(left, [*values, "elements"], _linked, "a bigint, b bigint")), "confirmed")
    of_class = components(links)
    class_of = alone.join(of_class.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("component_id", "rep").alias("component_id")).unionByName(of_class)
    placed = signed.select("doc_id", "n_shingles").join(class_of.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left")
    return placed.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs, with all columns, without the documents that are near-copies of a smaller doc_id.

    NULL and empty texts and rows without an id are copies of nothing and stay; rows of one doc_id stay or go together."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
