"""Repeated byte strings: suffixes of shards are merged through their Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewell.llm.common import cut, discard, mapped, pieces, utf8
from citewell.llm.shingles import between, prefix_hashes

LENGTH = 100
#: Hashed substrings of which the smallest in a window of ``LENGTH`` bytes is the window's key.
KEY_LENGTH = 48
#: Substrings of a window, and the most windows that hold one place's.
SPAN = LENGTH - KEY_LENGTH + 1
#: Bytes of a shard whose suffixes are sorted, and about how many are merged at a time; keys with more are taken apart.
SHARD_BYTES = 65_536
BATCH_BYTES = 1_000_000
#: Windows sent on at a time, the places over which later ones are joined to ranges, and tasks that share a window.
SOME_WINDOWS = 200_000
RANGE = 1024
SALTS = 32


STRIDE = 16
#: Symbols by which suffixes are sorted at first.
PREFIX = 7


def _periodic(data: np.ndarray) -> np.ndarray:
    """Of every ``STRIDE``-th byte whether a window around it may equal one up to ``SPAN`` bytes on: a window's worth of
    bytes then equals what follows at that distance, and so do six bytes in a row of those looked at."""
    some = data[::STRIDE]
    marks = np.zeros(len(some), bool)
    for period in range(1, SPAN + 1):
        other = data[period::STRIDE]
        same = some[: len(other)] == other
        two = same[:-1] & same[1:]
        six = two[:-4] & two[2:-2] & two[4:] if len(two) > 4 else two[:0]
        marks[: len(six)] |= six
    return marks


def keyed_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows with one key: text number, first window, number of windows, key, hash of the bytes, and
    whether a window may occur twice within.

    A window's key depends on its bytes alone, so equal windows have equal keys wherever they stand; about every
    twenty-seventh byte begins a run. Texts shorter than a window have none.
    """
    n = len(data)
    span = SPAN
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = prefix_hashes(data)
    places = np.arange(n - KEY_LENGTH + 1)
    keys = between(sums, places, places + KEY_LENGTH)
    # Least of every ``span`` neighbours: from the left in blocks, from the right in blocks, and the smaller of both.
    padded = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    least = np.minimum(right[:windows], left[span - 1 : span - 1 + windows])
    # Windows that reach into the next text do not count.
    inside = np.zeros(windows + 1, np.int8)
    starts, stops = offsets[:-1], offsets[1:] - LENGTH + 1
    long = stops > starts
    edges = np.zeros(windows + 1, bool)
    edges[starts[long]] = True
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, stops[long], -1)
    valid = np.cumsum(inside[:-1]) > 0
    new = np.ones(windows, bool)
    new[1:] = least[1:] != least[:-1]
    new |= edges[:-1]
    new[1:] |= valid[1:] & ~valid[:-1]
    first = np.flatnonzero(new & valid)
    breaks = np.flatnonzero(new | ~valid)
    after = np.append(breaks, windows)[np.searchsorted(breaks, first, side="right")]
    count = after - first
    owner = np.searchsorted(offsets, first, side="right") - 1
    marked = np.concatenate([[0], np.cumsum(_periodic(data))])
    inner = (marked[np.minimum((first + count + LENGTH - 2) // STRIDE + 1, len(marked) - 1)] > marked[-(-first // STRIDE)]) | (count > SPAN)
    return owner, first - offsets[owner], count, least[first].astype(np.int64), between(sums, first, first + count + LENGTH - 1).astype(np.int64), inner


def _turns(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key how many equal ones stand before it, and whether there is another equal one."""
    order = np.argsort(keys, kind="stable")
    begins = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])[: len(keys)])
    sizes = np.diff(np.append(begins, len(keys)))
    turn, several = np.empty(len(keys), np.int32), np.empty(len(keys), bool)
    turn[order] = np.arange(len(keys)) - np.repeat(begins, sizes)
    several[order] = np.repeat(sizes > 1, sizes)
    return turn, several


def runs_of(texts: DataFrame) -> DataFrame:
    """key, hash, doc, at, n, inner: a row for each run of every text; turn and several: how many runs of the key stand
    before it in its piece of texts, and whether the piece has others."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        owner, at, n, key, digest, inner = keyed_runs(*utf8(piece.column("text")))
        doc = piece.column("doc").take(pa.array(owner))
        columns = [pa.array(key), pa.array(digest), doc, pa.array(at), pa.array(n), pa.array(inner.astype(bool)), *map(pa.array, _turns(key))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "hash", "doc", "at", "n", "inner", "turn", "several"])

    return mapped(texts, run, "key bigint, hash bigint, doc bigint, at bigint, n bigint, inner boolean, turn int, several boolean")


def runs_to_follow(texts: DataFrame) -> DataFrame:
    """key, hash, doc, at, n, inner: the runs whose key occurs again, and those that may repeat something within.

    All runs are shuffled once, and are written nowhere else. Runs that share their key with others of their piece are known
    to be wanted; the first of them meets the firsts of other pieces, and each further one has a turn of its own. So a task
    gets no more runs of one key and turn than there are pieces, however many texts share a passage.
    """
    met = runs_of(texts).withColumn("pieces", F.count("*").over(Window.partitionBy("key", "turn")))
    return met.where("pieces > 1 OR several OR inner").select("key", "hash", "doc", "at", "n", "inner")


def shard_transforms(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of shards of strings: the rows of all shards one after another.

    ``text`` holds symbols from 1 on, and after each string a 0 that ends it and equals no other. Gives each row's place in
    the text, its symbol of the Burrows-Wheeler transform (the one before the suffix; before a string, its own end) and the
    row of the suffix that begins with that symbol. Shards are sorted by their first symbols and then by doubling prefixes,
    each in itself.
    """
    n = len(text)
    shard = np.repeat((np.cumsum(sizes + 1) - sizes - 1) // SHARD_BYTES, sizes + 1)
    ends = starts + sizes
    # The shard and the first symbols as one number; a suffix that ends within them is told from all others by its string,
    # and in the text strings stand by their numbers.
    wide = np.zeros(n + PREFIX, np.uint64)
    wide[:n] = text
    left = np.repeat(ends, sizes + 1) - np.arange(n)
    key = shard.astype(np.uint64)
    for i in range(PREFIX):
        key = key << np.uint64(8) | np.where(i <= left, wide[i : n + i], np.uint64(0))
    rows = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[rows][1:] != key[rows][:-1]
    short = left[rows] < PREFIX
    new |= short
    new[1:] |= short[:-1]
    step = PREFIX
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[rows] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        # Only suffixes that still equal a neighbour are sorted on, each group in its own places.
        waiting = np.flatnonzero(~(new & np.append(new[1:], True)))
        if len(waiting) == 0:
            break
        some = rows[waiting]
        key = rank[some] * (n + 1) + rank[np.minimum(some + step, n)] + 1
        order = np.argsort(key, kind="stable")
        rows[waiting], key = some[order], key[order]
        new[waiting] = np.append(True, key[1:] != key[:-1])
        rank[rows[waiting]] = waiting[np.maximum.accumulate(np.where(new[waiting], np.arange(len(waiting)), 0))]
        step *= 2
    rank = rank[:n]
    before = np.arange(-1, n - 1)
    before[starts] = ends
    symbols = text[before]
    return rows, symbols[rows], rank[before[rows]]


def merged_blocks(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text in the order of the merged shards, and whether each begins a new block: places in one block, two at
    least, have the same first ``LENGTH`` bytes.

    The transforms are merged by refining how their rows interleave: rows ordered by their first k symbols, dealt stably by
    the symbol before them, are the rows ordered by their first k + 1. A block is split where the dealt symbols differ, so
    the round that splits two neighbours is their common prefix. Two symbols are dealt at a time.
    """
    rows, symbols, back = shard_transforms(text, starts, sizes)
    pair = symbols[back].astype(np.uint16) << np.uint16(8) | symbols  # the two symbols before a suffix, in text order
    ended = (symbols == 0) | (symbols[back] == 0)
    back = back[back].astype(np.int32)
    at = np.arange(len(rows), dtype=np.int32)
    block = np.zeros(len(rows), np.int32)
    new = np.zeros(len(rows), bool)
    for _ in range(LENGTH // 2):
        dealt = pair[at]
        order = np.argsort(dealt, kind="stable")
        dealt, block, was = dealt[order], block[order], at[order]
        new = np.empty(len(was), bool)
        new[:1] = True
        new[1:] = (dealt[1:] != dealt[:-1]) | (block[1:] != block[:-1])
        alone = ended[was]
        new |= alone
        new[1:] |= alone[:-1]
        # What is longer on the left of a block of one is a block of one as well: such rows are done.
        open_ = ~(new & np.append(new[1:], True))
        block = np.cumsum(new, dtype=np.int32)[open_]
        at, new = back[was[open_]], new[open_]
        if len(at) == 0:
            break
    return rows[at], new


def later_windows(strings: list[bytes], docs: np.ndarray, ats: np.ndarray) -> list[tuple[int, int, int]]:
    """(doc, first window, number of windows) of all windows of the strings that also begin earlier in one of them."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.uint8)
    # UTF-8 has no byte FF, so all bytes fit above the end.
    text[np.arange(len(text)) != np.repeat(starts + sizes, sizes + 1)] = np.frombuffer(b"".join(strings), np.uint8) + 1
    places, new = merged_blocks(text, starts, sizes)
    string = np.repeat(np.arange(len(strings)), sizes + 1)[places]
    block = np.cumsum(new)
    doc, at = docs[string], ats[string] + places - starts[string]
    order = np.lexsort((at, doc, block))
    doc, at, block, string = doc[order], at[order], block[order], string[order]
    first = np.ones(len(block), bool)
    first[1:] = block[1:] != block[:-1]
    # The block's first place and others at the very same one (a run can be in several strings) are no repeats.
    head = np.maximum.accumulate(np.where(first, np.arange(len(block)), 0))
    repeat = (doc != doc[head]) | (at != at[head])
    doc, at = doc[repeat], at[repeat]
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    if len(doc) == 0:
        return []
    breaks = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)))
    lasts = np.append(breaks[1:], len(doc)) - 1
    return list(zip(doc[breaks].tolist(), at[breaks].tolist(), (at[lasts] - at[breaks] + 1).tolist(), strict=True))


def _merged(strings: DataFrame) -> DataFrame:
    """doc, at, n: the repeated windows among strings (key, doc, at, bytes). Strings of one key, of at most ``BATCH_BYTES``,
    meet in one task, in batches of whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int]] = []
        size, last = 0, None

        def found() -> pa.RecordBatch:
            texts, docs, ats = zip(*held, strict=True)
            ranges = later_windows(list(texts), np.array(docs, np.int64), np.array(ats, np.int64))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in ranges], pa.int64()) for i in range(3)], names=["doc", "at", "n"])

        for batch in batches:
            for key, doc, at, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "at", "bytes")), strict=True):
                if key != last and size >= BATCH_BYTES:
                    yield found()
                    held, size = [], 0
                held.append((text, doc, at))
                size, last = size + len(text), key
        if held:
            yield found()

    return strings.repartition("key").sortWithinPartitions("key", "doc", "at").mapInArrow(run, "doc bigint, at bigint, n bigint")


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, window (hash of its bytes), doc, at: every window of the hot runs of (doc, text, runs)."""
    held: list[tuple[int, int, int, int, bytes]] = []

    def found() -> pa.RecordBatch:
        key, doc, at, n, strings = zip(*held, strict=True)
        n = np.array(n, np.int64)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begins = np.repeat(np.cumsum(n + LENGTH - 1) - n - LENGTH + 1, n) + within
        hashes = between(prefix_hashes(np.frombuffer(b"".join(strings), np.uint8)), begins, begins + LENGTH).astype(np.int64)
        columns = [np.repeat(np.array(key, np.int64), n), hashes, np.repeat(np.array(doc, np.int64), n), np.repeat(np.array(at, np.int64), n) + within]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "window", "doc", "at"])

    waiting = 0
    for batch in batches:
        for piece in pieces(batch, "text"):
            for doc, text, runs in zip(*(piece.column(c).to_pylist() for c in ("doc", "text", "runs")), strict=True):
                data = text.encode("utf-8")
                for r in runs:
                    for at in range(r["at"], r["at"] + r["n"], SOME_WINDOWS) if r["hot"] else ():
                        n = min(SOME_WINDOWS, r["at"] + r["n"] - at)
                        held.append((r["key"], doc, at, n, data[at : at + n + LENGTH - 1]))
                        waiting += n
                        if waiting >= SOME_WINDOWS:
                            yield found()
                            waiting = 0
    if held:
        yield found()


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, at, n: the ranges of neighbours among the windows of (doc, ats)."""
    for batch in batches:
        docs, begins, sizes = [], [], []
        for doc, ats in zip(batch.column("doc").to_pylist(), batch.column("ats").to_numpy(zero_copy_only=False), strict=True):
            ats = np.unique(ats)
            breaks = np.flatnonzero(np.append(True, np.diff(ats) > 1))
            docs += [doc] * len(breaks)
            begins += ats[breaks].tolist()
            sizes += np.diff(np.append(breaks, len(ats))).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, begins, sizes)], names=["doc", "at", "n"])


def _counted(once: DataFrame) -> DataFrame:
    """doc, at, n: the repeated windows among the hot runs of (doc, text, runs), in any number of tasks.

    Every window is a row. The first place of each is found where rows lie and then among tasks; the rows of a window meet
    it in ``SALTS`` tasks.
    """
    windows = once.where(F.exists("runs", lambda r: r["hot"])).mapInArrow(_window_rows, "key bigint, window bigint, doc bigint, at bigint")
    first = windows.groupBy("key", "window").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = first.select("key", "window", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = windows.withColumn("salt", F.pmod(F.xxhash64("doc", "at"), F.lit(SALTS)).cast("int"))
    later = dealt.join(first.hint("merge"), ["key", "window", "salt"]).where("doc <> first.doc OR at <> first.at")
    near = later.groupBy("doc", F.expr(f"at div {RANGE}")).agg(F.collect_list("at").alias("ats"))  # bounded by the range
    return near.select("doc", "ats").mapInArrow(_ranged, "doc bigint, at bigint, n bigint")


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and doc, a number in the order of doc_id: doc_id itself unless it is NULL or names several texts."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tied = texts.withColumn("tie", F.xxhash64("text"))
    odd = tied.groupBy("doc_id").agg(F.min("tie").alias("low"), F.max("tie").alias("high")).where("doc_id IS NULL OR low <> high")
    if odd.limit(1).count() == 0:
        return texts.withColumn("doc", F.col("doc_id"))
    numbered = tied.select("doc_id", "tie").distinct().repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").withColumn("doc", F.monotonically_increasing_id())
    numbered = cut(numbered, "numbers").withColumnRenamed("doc_id", "id").withColumnRenamed("tie", "of")
    return tied.join(numbered, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("of"))).select("doc_id", "text", "doc")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """doc, at, n: ranges of windows that also begin earlier, from (doc, text).

    Texts are cut into runs of windows with one key; only keys that occur again, or runs
    that may repeat something within, are followed. Equal runs are summed up where
    they lie, and all but the first are repeats as a whole, so copies in any number cost one row each. The first of each of
    several different runs with one key go, as bytes, to the merge of shard transforms. Where they have more bytes than
    are merged at a time, as at the edges of a passage that many texts share, their windows are counted one by one instead.
    """
    followed = cut(runs_to_follow(texts), "followed")
    first = cut(followed.groupBy("key", "hash").agg(F.min(F.struct("doc", "at")).alias("first"), F.max("n").alias("n"), F.max("inner").alias("inner")), "first")
    later = followed.join(first.drop("n", "inner").hint("merge"), ["key", "hash"]).where("doc <> first.doc OR at <> first.at").select("doc", "at", "n")
    varied = first.groupBy("key").agg(F.count("*").alias("kinds"), F.max("inner").alias("inner"), F.sum(F.col("n") + LENGTH - 1).alias("size"))
    varied = cut(varied.where("kinds > 1 OR inner").select("key", (F.col("size") > BATCH_BYTES).alias("hot")), "varied")
    wanted = first.join(varied.hint("merge"), "key").select("key", "first.doc", "first.at", "n", "hot")
    of_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "at", "n", "hot")).alias("runs"))  # bounded by the text

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                key, doc, at, out = [], [], [], []
                for number, text, found in zip(*(piece.column(c).to_pylist() for c in ("doc", "text", "runs")), strict=True):
                    data = text.encode("utf-8")
                    for r in found:
                        if r["hot"]:
                            continue
                        key.append(r["key"])
                        doc.append(number)
                        at.append(r["at"])
                        out.append(data[r["at"] : r["at"] + r["n"] + LENGTH - 1])
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(out, pa.binary())], names=["key", "doc", "at", "bytes"])

    once = texts.join(of_doc.hint("merge"), "doc").select("doc", "text", "runs")
    strings = once.mapInArrow(sliced, "key bigint, doc bigint, at bigint, bytes binary")
    repeats = later.unionByName(_merged(strings))
    if varied.where("hot").limit(1).count():
        repeats = repeats.unionByName(_counted(once))
    repeats = cut(repeats, "repeats")
    discard(followed, first, varied)
    return repeats


def without_repeats(docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, and what is left of its UTF-8 bytes once every byte is gone that lies in a string of
    ``LENGTH`` bytes which also begins earlier (at a smaller doc_id, or earlier in the text): n_bytes, n_removed, n_spans
    (maximal removed runs), kept (binary).

    Strings are judged on the input and do not cross texts. NULL texts are empty. Rows of one doc_id and one text are one
    document, answered each; different texts of one doc_id are documents in the order of their hashes; a NULL doc_id comes
    before all others. Other columns are left aside; an empty table gives no rows.
    """
    return _cut_out(docs, "kept binary", lambda kept: pa.array(kept, pa.binary()))


def digests(docs: DataFrame) -> DataFrame:
    """``without_repeats`` with kept_sha256 instead of the bytes, reduced where they arise."""
    return _cut_out(docs, "kept_sha256 string", lambda kept: pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))


def _cut_out(docs: DataFrame, last: str, reduced) -> DataFrame:
    texts = _identified(docs)
    marks = repeated_windows(texts.select("doc", "text")).groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))  # bounded by the text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sizes, removed, spans, kept = [], [], [], []
                for text, ranges in zip(piece.column("text").to_pylist(), piece.column("ranges").to_pylist(), strict=True):
                    data, gone, parts, at, n_spans = text.encode("utf-8"), 0, [], 0, 0
                    for start, end in _union(ranges or []):
                        parts.append(data[at:start])
                        gone, at, n_spans = gone + end - start, end, n_spans + 1
                    sizes.append(len(data))
                    removed.append(gone)
                    spans.append(n_spans)
                    kept.append(b"".join(parts) + data[at:])
                columns = [piece.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), reduced(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0]])

    joined = texts.join(marks.hint("merge"), "doc", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last}")


def _union(ranges: list[dict]) -> Iterator[tuple[int, int]]:
    """Maximal byte runs under ranges of windows, in order."""
    start = end = -1
    for r in sorted(ranges, key=lambda r: r["at"]):
        upto = r["at"] + r["n"] + LENGTH - 1
        if r["at"] > end:
            if end >= 0:
                yield start, end
            start = r["at"]
        end = max(end, upto)
    if end >= 0:
        yield start, end
