"""Phrases of two to four words that occur together more often than their parts would suggest, per language.

Words, phrases and pieces are those of ``words_of``. Counting is by top-order marginalisation: every word leads one
window of four columns, padded where its piece ends, only these longest windows are counted, and a ROLLUP sums them up
to the counts of all shorter phrases. A phrase that reaches ``least`` occurrences has only words, pairs and triples that
reach it, so windows are padded as well where these do not. Which do is told by three bitmaps of fixed size, whatever the
size of the corpus; a full bitmap costs work, never a count.

Words are 64-bit numbers while they are counted; if two words of the corpus shared one, all would be counted again by
other numbers. NULL texts have no words, a NULL language is ``und``. Repeated rows count repeatedly, empty tables give an
empty result, and columns besides lang and text are not read. One word, phrase or language may hold most rows: counts
are added up in every task before they travel, and a language's best phrases are chosen in every task first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewell.llm.common import cut, discard, pieces, utf8
from citewell.sources.tables import bounded_batches

ORDER = 4
LEAST = 30
BEST = 2000
#: A candidate goes if a longer one that holds it has this share of its occurrences, in hundredths.
COVERED = 80
#: Bits of a bitmap, as a power of two (8 MB).
BITMAP = 26
BATCH_BYTES, CHUNK_BYTES, MEMO = 2_000_000, 1_000_000, 50_000
#: Words of a row of codes, about: readers and writers of files hold thousands of rows at a time.
ROW_CODES = 1024

BREAK = 0xFF  # never part of UTF-8
_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TABLE = bytes(BREAK if b in _BREAKS else 32 if b in _BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Numbers(dict):
    """Word -> its number in one language; 0 is the end of a piece. Forgets what it knows when it grows too long."""

    def __init__(self, lang: str, seed: int) -> None:
        super().__init__({bytes([BREAK]): 0})
        self.head, self.seed = lang.encode() + b"\xff", seed

    def __missing__(self, word: bytes) -> int:
        number = xxhash.xxh3_64_intdigest(self.head + word, self.seed) or 1
        if len(self) < MEMO:
            self[word] = number
        return number


def words_of(texts: bytes) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z) words of texts in UTF-8 with a ``BREAK`` after each piece, some megabytes at a time.

    Pieces end at ``. , ; : ! ?`` and line ends, words at blanks and tabs.
    """
    whole = texts.translate(_TABLE)
    at = 0
    while at < len(whole):
        upto = whole.find(b" ", at + CHUNK_BYTES) if at + CHUNK_BYTES < len(whole) else -1
        upto = len(whole) if upto < 0 else upto
        yield whole[at:upto].replace(b"\xff", b" \xff ").split()
        at = upto


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Language and its texts with ``BREAK`` between them, of batches with lang and text, in pieces of bounded size."""
    for batch in batches:
        for piece in pieces(batch, "text", BATCH_BYTES):
            data, ends = utf8(piece.column(1))
            held: dict[str, list[bytes]] = {}
            for lang, start, end in zip(piece.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                held.setdefault(lang, []).append(data[start:end].tobytes())
            for lang, texts in held.items():
                yield lang, b" \xff ".join(texts)


def pair_numbers(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(31))


def texts_by_language(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """Occurrences ``c`` of every word (lang, word, number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Numbers] = {}
        for lang, texts in by_language(batches):
            numbers = known.setdefault(lang, Numbers(lang, seed))
            for words in words_of(texts):
                of, at, times = np.unique(np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words)), return_index=True, return_counts=True)
                kept = of > 0
                names = [words[i].decode() for i in at[kept].tolist()]
                columns = [pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(of[kept].view(np.int64)), pa.array(times[kept])]
                yield pa.record_batch(columns, names=["lang", "word", "number", "c"])

    rows = texts_by_language(docs).mapInArrow(run, "lang string, word string, number bigint, c bigint")
    return rows.groupBy("lang", "word", "number").agg(F.sum("c").alias("c"))


def coded(docs: DataFrame, seed: int, words: Broadcast) -> DataFrame:
    """codes: texts as the numbers of their frequent words (unsigned, 64 bits), with 0 for others and after each piece.

    Written once, so that texts are cut into words no more than twice. A row ends with a 0, the first one after
    ``ROW_CODES`` words; no phrase goes on in another row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Numbers] = {}
        for lang, texts in by_language(batches):
            numbers = known.setdefault(lang, Numbers(lang, seed))
            some = [np.fromiter(map(numbers.__getitem__, w), np.uint64, len(w)) for w in words_of(texts)]
            codes = np.concatenate([*some, np.zeros(1, np.uint64)])
            codes[~marked(words.value, codes)] = 0
            yield pa.record_batch([rows_of(codes)], names=["codes"])

    return cut(texts_by_language(docs).mapInArrow(run, "codes binary"), "codes")


def rows_of(codes: np.ndarray) -> pa.Array:
    """Codes, the last of them 0, as binary rows that end with a 0 each."""
    ends = np.flatnonzero(codes == 0) + 1
    ends = ends[np.unique(np.searchsorted(ends, [*range(ROW_CODES, len(codes), ROW_CODES), len(codes)]))]
    offsets = pa.array(np.concatenate([[0], 8 * ends]), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets.buffers()[1], pa.py_buffer(codes)])


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The codes of each batch, one row after another, and the 0s that end the last window."""
    for batch in batches:
        if batch.num_rows:
            rows = batch.column(0)
            _, offsets, data = rows.buffers()
            ends = np.frombuffer(offsets, np.int32)[rows.offset : rows.offset + len(rows) + 1]
            yield np.concatenate([np.frombuffer(data, np.uint64, (ends[-1] - ends[0]) // 8, ends[0]), np.zeros(ORDER, np.uint64)])


def links(codes: np.ndarray, pairs: Broadcast | None, triples: Broadcast | None) -> tuple[np.ndarray, np.ndarray]:
    """For each place but the last ones whether a pair that may be frequent begins there, and whether a triple does."""
    linked = (codes[:-1] > 0) & (codes[1:] > 0)
    if pairs is not None:
        linked[linked] = marked(pairs.value, pair_numbers(codes[:-1][linked], codes[1:][linked]))
    threefold = linked[:-1] & linked[1:]
    if triples is not None:
        threefold[threefold] = marked(triples.value, triple_numbers(codes, threefold))
    return linked, threefold


def triple_numbers(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return pair_numbers(pair_numbers(codes[:-2][at], codes[1:-1][at]), codes[2:][at])


def frequent(texts: DataFrame, least: int, pairs: Broadcast | None = None) -> Broadcast:
    """The bitmap of pairs of frequent words, or, if that is given, of triples of such pairs, that may occur ``least`` times.

    They are counted by the first 32 bits of their numbers. Those that share these are counted together, which lets one
    pass that is too rare, and stops none that is not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in each(batches):
            linked, threefold = links(codes, pairs, None)
            numbers = pair_numbers(codes[:-1][linked], codes[1:][linked]) if pairs is None else triple_numbers(codes, threefold)
            of, times = np.unique((numbers >> np.uint64(32)).astype(np.uint32), return_counts=True)
            yield pa.record_batch([pa.array(of.view(np.int32)), pa.array(times.astype(np.int32))], names=["cell", "c"])

    cells = texts.mapInArrow(run, "cell int, c int").groupBy("cell").agg(F.sum("c").alias("c"))
    return bitmap(cells.where(F.col("c") >= least).select(F.shiftleft(F.col("cell").cast("bigint"), 32).alias("number")))


def bitmap(numbers: DataFrame) -> Broadcast:
    """A bit for each value of the first ``BITMAP`` bits of a number that occurs. No more than 2 ** 20 cells reach the driver."""
    bit = F.shiftrightunsigned("number", 64 - BITMAP)
    cells = numbers.groupBy(F.shiftright(bit, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(number, {64 - BITMAP}) & 63 AS int))")).alias("bits")).toArrow()
    marks = np.zeros(1 << (BITMAP - 6), np.int64)
    marks[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return numbers.sparkSession.sparkContext.broadcast(marks.view(np.uint64))


def marked(marks: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    bit = numbers >> np.uint64(64 - BITMAP)
    return (marks[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def windows(texts: DataFrame, pairs: Broadcast, triples: Broadcast) -> DataFrame:
    """w1 to w4 for every frequent word: itself and those that follow it, 0 from where its piece, or the words, pairs and
    triples that may be frequent, end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in each(batches):
            linked, threefold = links(codes, pairs, triples)
            starts = np.flatnonzero(codes)
            columns, open_ = [codes[starts]], np.ones(len(starts), bool)
            for lead in range(1, ORDER):
                open_ = open_ & linked[starts + lead - 1]
                if lead > 1:
                    open_ &= threefold[starts + lead - 2]
                columns.append(np.where(open_, codes[starts + lead], np.uint64(0)))
            whole = pa.table([pa.array(c.view(np.int64)) for c in columns], names=WINDOW)
            yield from whole.to_batches(max_chunksize=200_000)

    return texts.mapInArrow(run, ", ".join(f"{w} bigint" for w in WINDOW))


WINDOW = [f"w{i}" for i in range(1, ORDER + 1)]


def phrase_counts(longest: DataFrame, least: int) -> DataFrame:
    """words (an array of numbers) and occurrences ``f`` of every phrase of one to four words that occurs ``least`` times.

    The ROLLUP of the counted windows has each sum of a prefix; one that ends in padding repeats a shorter phrase.
    """
    sums = longest.groupBy(*WINDOW).count().rollup(*WINDOW).agg(F.sum("count").alias("f"), F.grouping_id().alias("level"))
    length = F.lit(ORDER) - F.bit_count("level")
    kept = sums.where(F.col("f") >= least).withColumn("length", length).where(length > 0)
    return kept.where(F.get(F.array(*WINDOW), F.col("length") - 1) != 0).select(F.slice(F.array(*WINDOW), 1, F.col("length")).alias("words"), "f")


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """``word_counts``, written, with the first seed by which no two words share a number."""
    for seed in range(64):
        counts = cut(word_counts(docs, seed), "word-counts")
        shared = counts.groupBy("number").count().where("count > 1")
        if shared.isEmpty():
            return counts, seed
        discard(counts)
    raise ValueError("words share numbers by every seed")


def scored(phrases: DataFrame) -> DataFrame:
    """words, a, l, r and score of every phrase of two words or more: its cut of the lowest score, the shortest first part of several."""
    size = F.size("words")
    cuts = phrases.where(size > 1).select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", 1, F.col("k")).alias("head"), F.expr("slice(words, k + 1, size(words) - k)").alias("rest"))
    heads, rests = phrases.select(F.col("words").alias("head"), F.col("f").alias("l")), phrases.select(F.col("words").alias("rest"), F.col("f").alias("r"))
    met = cuts.join(heads, "head").join(rests, "rest")
    score = F.expr("(2000000BD * cast(a AS decimal(20, 0))) div (cast(l AS decimal(20, 0)) + r)")
    lowest = met.groupBy("words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("words", "a", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """Candidates that no longer phrase holds nearly as often: 100 * f(longer) stays below ``COVERED`` * a for all of them."""
    spans = F.expr("flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))))")
    inside = phrases.where(F.size("words") > 2).select(F.explode(F.array_distinct(spans)).alias("words"), F.col("f").alias("longer"))
    most = inside.groupBy("words").agg(F.max("longer").alias("longer"))
    covered = F.expr(f"100BD * cast(longer AS decimal(20, 0)) >= {COVERED}BD * cast(a AS decimal(20, 0))")
    return candidates.join(most, "words", "left").where(F.col("longer").isNull() | ~covered).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n and score of the ``best`` phrases of each language that occur ``least`` times.

    a counts the phrase, l and r the parts of its weakest cut, n all words of the language; score is 2,000,000 a / (l + r)
    rounded down. Order: score and a falling, then phrase by its bytes. Ties beyond ``best`` are cut by that order.
    """
    counts, seed = numbered(docs)
    often = counts.where(F.col("c") >= least)
    texts = coded(docs, seed, bitmap(often.select("number")))
    pairs = frequent(texts, least)
    triples = frequent(texts, least, pairs)
    phrases = cut(phrase_counts(windows(texts, pairs, triples), least), "phrases")
    discard(texts)
    kept = uncovered(scored(phrases), phrases)
    for i in range(ORDER):
        word = often.select(F.col("number").alias(f"_{i}"), F.col("word").alias(f"word{i}"), *([F.col("lang").alias("lang")] if i == 0 else []))
        kept = kept.withColumn(f"_{i}", F.get("words", F.lit(i))).join(word, f"_{i}", "inner" if i == 0 else "left")
    kept = kept.withColumn("phrase", F.concat_ws(" ", *[f"word{i}" for i in range(ORDER)])).select("lang", "phrase", "a", "l", "r", "score")
    totals = counts.groupBy("lang").agg(F.sum("c").alias("n"))
    return best_of(kept, best).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def best_of(phrases: DataFrame, best: int) -> DataFrame:
    """The first ``best`` phrases of each language with their rank: first of many parts of a language, then of what they send."""
    parts = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    dealt = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best).drop("part")


SQL = r"""
    WITH docs AS (
        SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
            string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS parts FROM documents WHERE text IS NOT NULL
    ), pieces AS (
        SELECT lang, list_filter(string_split_regex(part, '[ \t]+'), lambda w: w <> '') AS w FROM (SELECT lang, unnest(parts) AS part FROM docs)
    ), places AS (
        SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
    ), phrases AS (
        SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, any_value(w[i : i + m - 1]) AS words, count(*) AS f
        FROM places JOIN (VALUES (1), (2), (3), (4)) AS sizes(m) ON i + m - 1 <= len(w) GROUP BY ALL
    ), n AS (
        SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
    ), candidates AS (
        SELECT lang, m, phrase, words, f AS a FROM phrases WHERE m > 1 AND f >= 30
    ), cuts AS (
        SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (l.f + r.f) AS BIGINT) AS score
        FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) AS c
        JOIN phrases AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[: c.k], ' ') AND l.m = c.k
        JOIN phrases AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[c.k + 1 :], ' ') AND r.m = c.m - c.k
    ), lowest AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), longer AS (
        SELECT lang, array_to_string(words[i : i + s - 1], ' ') AS phrase, max(a) AS most
        FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM candidates) JOIN (VALUES (2), (3)) AS sizes(s) ON s < m AND i + s - 1 <= m GROUP BY ALL
    ), kept AS (
        SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT)
    )
    SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""
