"""Byte-level BPE by a queue of merge ranks over a hierarchical bitmap, and its decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from citewell.llm.common import pieces, texts_of

BATCH_BYTES = 24_000_000
CACHED_CHARS = 64
CACHED_PIECES = 200_000


class RankQueue:
    """The set of waiting merge ranks as three levels of 64-bit words: a bit of a level says that the word below it is
    not zero, so the smallest rank is found by find-first-sets. Each rank has a bucket of positions in the linked list."""

    def __init__(self, n_ranks: int):
        self.words = [[0] * (n_ranks // 64 + 1), [0] * (n_ranks // 4096 + 1), [0] * (n_ranks // 262_144 + 1)]
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.words:
            level[rank >> 6] |= 1 << (rank & 63)
            rank >>= 6

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) == 0:
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for rank, start, end in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
            self.push(rank, positions[start:end])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The smallest rank and the positions in its bucket, from left to right."""
        low, middle, high = self.words
        for top, word in enumerate(high):
            if word:
                break
        else:
            return None
        at = top << 6 | (word & -word).bit_length() - 1
        at = at << 6 | (middle[at] & -middle[at]).bit_length() - 1
        rank = at << 6 | (low[at] & -low[at]).bit_length() - 1
        bucket, place = self.buckets.pop(rank), rank
        for level in self.words:
            level[place >> 6] &= ~(1 << (place & 63))
            if level[place >> 6]:
                break
            place >>= 6
        return rank, np.unique(np.concatenate(bucket)) if len(bucket) > 1 else bucket[0]


class ByteBPE:
    """``ranks`` maps byte strings to ids, which are also their merge ranks; every single byte has one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.n = max(ranks.values()) + 1
        tokens: list[bytes] = [b""] * self.n
        for token, i in ranks.items():
            tokens[i] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pattern = regex.compile(pattern)
        # Every pair of tokens that joins to a token, as one sorted table; and the ranks after whose merge a smaller rank
        # can arise, so that one merge in a pre-token must be done before the next of the same rank.
        keys, joined, self.unsafe = [], [], np.zeros(self.n, bool)
        for token, c in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.n + b)
                    joined.append(c)
                    self.unsafe[a] |= c < a
                    self.unsafe[b] |= c < b
        order = np.argsort(keys)
        self.keys, self.joined = np.array(keys, np.int64)[order], np.array(joined, np.int64)[order]
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.at = Known(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of tokens joined pairwise, -1 where they join to none; negative ids stand for the end of a pre-token."""
        key = np.where((a >= 0) & (b >= 0), a * self.n + b, -1)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.joined[place], -1)

    def _first_smaller(self, rank: int, at: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which places may be joined at once: in each pre-token those up to the first whose join brings up a smaller rank.

        Joined from left to right, a place has a joined token before it if that ends where it begins, and what was there
        all along behind it.
        """
        gone = right[at]
        before = ids[left[at]]
        before[1:] = np.where(right[gone[:-1]] == at[1:], rank, before[1:])
        joined = np.full(len(at), rank, np.int64)
        new = np.stack([self._rank(before, joined), self._rank(joined, ids[right[gone]])])
        smaller = ((new >= 0) & (new < rank)).any(axis=0)
        # Places with such a join before them in their own pre-token wait.
        seen = np.cumsum(smaller) - smaller
        first = np.maximum.accumulate(np.where(np.diff(owner[at], prepend=-1) != 0, np.arange(len(at)), 0))
        return seen == seen[first]

    def merge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after another, and the offset of each.

        All pre-tokens stand in one linked list with gaps between them. The smallest waiting rank is popped with its
        bucket; positions whose pair has changed since are stale and skipped; the others are joined from left to right, and
        the new pairs pushed. Where a join brings up a smaller rank, the positions behind it in its pre-token wait.
        """
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + 1) - sizes - 1  # a gap after each
        total = int((sizes + 1).sum())
        ids = np.full(total + 1, -1, np.int64)  # the last place is where links end
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        inner = np.ones(total, bool)
        inner[starts + sizes] = False
        ids[:-1][inner] = self.of_byte[np.frombuffer(b"".join(texts), np.uint8)]
        whole = [self.ranks.get(t, -1) for t in texts]
        for i in np.flatnonzero(np.array(whole, np.int64) >= 0).tolist():
            ids[starts[i] : starts[i] + sizes[i]] = -1
            ids[starts[i]] = whole[i]
        right = np.arange(1, total + 2)
        right[-2:] = total
        left = np.arange(-1, total)
        left = np.where(left < 0, total, left)
        pair = np.full(total + 1, -1, np.int64)
        pair[:-1] = self._rank(ids[:-1], ids[1:])
        queue = RankQueue(self.n)
        waiting = np.flatnonzero(pair >= 0)
        queue.push_all(pair[waiting], waiting)
        while (popped := queue.pop()) is not None:
            rank, at = popped
            at = at[pair[at] == rank]
            if len(at) == 0:
                continue
            if len(at) > 1:
                waiting = at
                joins = right[at[:-1]] == at[1:]
                if joins.any():  # of places that overlap, as in aaaa, every second one
                    run = np.concatenate([[0], np.maximum.accumulate(np.where(joins, 0, np.arange(1, len(at))))])
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
                if self.unsafe[rank] and len(at) > 1:
                    upto = self._first_smaller(rank, at, ids, left, right, owner)
                    if not upto.all():
                        at = at[upto]
                        queue.push(rank, np.setdiff1d(waiting, at, assume_unique=True))
            gone = right[at]
            after = right[gone]
            ids[at], ids[gone], pair[gone] = rank, -1, -1
            right[at], left[after] = after, at
            changed = np.concatenate([at, left[at]])
            found = self._rank(ids[changed], ids[right[changed]])
            pair[changed] = found
            pair[-1] = -1
            good = found >= 0
            queue.push_all(found[good], changed[good])
        kept = ids[:-1] >= 0
        counts = np.add.reduceat(kept, starts) if len(texts) else np.zeros(0, np.int64)
        return ids[:-1][kept].astype(np.uint32), np.concatenate([[0], np.cumsum(counts)])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its ids. Pre-tokens that occurred before are looked up; long ones are not kept, and the table
        starts anew when it is full."""
        if len(self.known) > CACHED_PIECES:
            self._forget()
        before = len(self.known)
        lookup = self.known.__getitem__
        places = [np.fromiter(map(lookup, found), np.int32, len(found)) for found in map(self.pattern.findall, texts)]
        if self.known.new:
            ids, at = self.merge([p.encode("utf-8") for p in self.known.new])
            self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
            self.ids = np.concatenate([self.ids, ids])
            long = any(len(p) > CACHED_CHARS for p in self.known.new)
            self.known.new = []
        else:
            long = False
        out = [gathered(self.ids, self.at, place) for place in places]
        if long and before < len(self.known):
            self._forget()
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        return gathered(self.token_bytes, self.token_at, np.asarray(ids, np.int64)).tobytes()


class Known(dict):
    """The number of each pre-token; ``new`` holds those numbered since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


def gathered(values: np.ndarray, at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The runs ``values[at[p]:at[p + 1]]`` of all places p, one after another."""
    starts = at[places]
    sizes = at[places + 1] - starts
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line has a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(read_ranks(path), pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, and ids: those of the whole text as little-endian unsigned 32-bit integers, one after another.

    One row per row of ``docs``, in any number of copies; a NULL text is the empty text and has no ids; doc_id may be
    NULL and stays so. Other columns of ``docs`` are left aside. ``path`` is a rank file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            for piece in pieces(batch, "text", BATCH_BYTES):
                ids = [x.astype("<u4").tobytes() for x in bpe.encode_batch(piece.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return texts_of(docs).mapInArrow(run, f"doc_id {_kind(docs)}, ids binary")


def decode_texts(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that the ids stand for, from the result of ``encode_texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            decoded = [None if x is None else bpe.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_kind(encoded)}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the bytes they decode to; as ``encode_texts`` and
    ``decode_texts`` give them, reduced where they arise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            for piece in pieces(batch, "text", BATCH_BYTES):
                encoded = bpe.encode_batch(piece.column("text").to_pylist())
                counts = [len(x) for x in encoded]
                ids_sha = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in encoded]
                back_sha = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in encoded]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return texts_of(docs).mapInArrow(run, f"doc_id {_kind(docs)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()
