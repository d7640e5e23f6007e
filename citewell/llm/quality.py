"""Quality of documents by a linear-chain conditional random field over their lines."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import column_of, mapped, texts_of, utf8
from citewell.llm.shingles import words

#: Labelled documents that the model is fitted on, at most; those of the smallest hashes.
SAMPLE_DOCUMENTS = 3_000
#: Lines of one sampled document that the fit sees, at most, spread evenly over it. Scoring sees all lines.
SAMPLE_LINES = 400

# Thresholds of each measure of a line; a line has a feature for each threshold that it reaches.
MEASURES = {
    "symbols by characters": (0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4),
    "upper case by letters": (0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "digits by characters": (0.002, 0.02, 0.1, 0.3),
    "words equal to the last": (0.005, 0.02, 0.1, 0.3, 0.6),
    "words equal to the one before the last": (0.02, 0.1, 0.3, 0.6),
    "words that end in a symbol": (0.01, 0.05, 0.2, 0.5, 0.8),
    "words of one symbol": (0.01, 0.05, 0.2, 0.4),
    "bytes by words": (2.5, 4.0, 5.0, 6.5, 8.0, 12.0, 20.0),
    "words": (1, 2, 4, 8, 16, 40, 120, 400),
    "letters by characters": (0.3, 0.5, 0.6, 0.7, 0.78, 0.84),
    "ends like a sentence": (1,),
    "words of up to three bytes": (0.05, 0.15, 0.3, 0.45, 0.6, 0.8),
}
N_FEATURES = 3 * sum(map(len, MEASURES.values())) + 3

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_LETTER = _UPPER | _LOWER | (_BYTES >= 192)
_CHARACTER = (_BYTES < 128) | (_BYTES >= 192)
_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~_DIGIT & ~np.isin(_BYTES, np.frombuffer(b".,;:'\"-", np.uint8))
_END = np.isin(_BYTES, np.frombuffer(b".!?:", np.uint8))


class Lines(NamedTuple):
    measures: np.ndarray
    counts: np.ndarray  # of the lines of each text, at least one
    weights: np.ndarray  # characters, and one more


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """The lines of texts laid one after another; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([offsets[1:], breaks]))
    counts = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1

    def within(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=sums[1:], dtype=np.int32)
        return (sums[ends] - sums[starts]).astype(np.float64)

    upper, letters, digits, symbols, characters = map(within, (_UPPER, _LETTER, _DIGIT, _SYMBOL, _CHARACTER))
    # Capitals of two bytes: C3 80 to C3 9E.
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) if len(data) else np.zeros(0, np.int64)
    upper += np.searchsorted(capital, ends) - np.searchsorted(capital, starts)
    w_start, w_end, _, hashes = words(data, offsets, lower=False)
    line = np.searchsorted(starts, w_start, side="right") - 1
    n = len(starts)

    def by_line(which: np.ndarray) -> np.ndarray:
        return np.bincount(line[which], minlength=n).astype(np.float64)

    same = [np.flatnonzero((hashes[d:] == hashes[:-d]) & (line[d:] == line[:-d])) + d for d in (1, 2)]
    last = _SYMBOL[data[w_end - 1]]
    sizes = w_end - w_start
    n_words = np.bincount(line, minlength=n).astype(np.float64)
    at_least = np.maximum(n_words, 1)
    chars = np.maximum(characters, 1)
    final = np.zeros(n)
    final[line] = _END[data[w_end - 1]]  # the last word of a line is assigned last
    measures = np.stack([
        symbols / chars, upper / np.maximum(letters, 1), digits / chars, by_line(same[0]) / at_least, by_line(same[1]) / at_least,
        by_line(last & (sizes > 1)) / at_least, by_line(last & (sizes == 1)) / at_least, np.bincount(line, sizes, minlength=n) / at_least,
        n_words, letters / chars, final, by_line(sizes <= 3) / at_least,
    ], axis=1)
    return Lines(measures.astype(np.float32), counts, characters + 1)


def features(lines: Lines) -> np.ndarray:
    """Indicators of a line's own measures, of those of the lines before and after it, and whether there are any."""
    own = np.concatenate([lines.measures[:, [i]] >= np.array(t, np.float32) for i, t in enumerate(MEASURES.values())], axis=1)
    first = np.zeros(len(own), bool)
    first[np.cumsum(lines.counts) - lines.counts] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = False, False
    return np.concatenate([own, before, after, first[:, None], last[:, None], np.ones((len(own), 1), bool)], axis=1).astype(np.float32)


class Model(NamedTuple):
    """Weights of features for a good line against a bad one, log transitions [from, to], and the calibration that makes
    a document's mean marginal its score."""

    weights: np.ndarray
    transitions: np.ndarray
    slope: float
    offset: float


def _products(matrices: np.ndarray, reach: int) -> np.ndarray:
    """Running products of 2 x 2 matrices, each over the last ``reach`` or more, scaled: log-many steps for all texts."""
    out = matrices / matrices.max(axis=(1, 2), keepdims=True)
    step = 1
    while step < min(reach, len(out)):
        out[step:] = out[:-step] @ out[step:]
        out /= out.max(axis=(1, 2), keepdims=True)
        step *= 2
    return out


def marginals(emission: np.ndarray, transitions: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every line the chance to be (bad, good), and the expected transitions [from, to] between all lines, by forward and
    backward products over the lines of each text."""
    a = np.exp(transitions - transitions.max())
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    starts = np.cumsum(counts) - counts
    step = a[None] * e[:, None, :]
    forward = step.copy()
    forward[starts] = e[starts][:, None, :]  # what stood before a text is forgotten
    alpha = _products(forward, int(counts.max(initial=1)))[:, 0]
    alpha /= alpha.sum(axis=1, keepdims=True)
    backward = step.copy()
    backward[starts] = 1.0
    # Reversed and transposed, the products run from the end of a text.
    after = _products(backward[::-1].transpose(0, 2, 1).copy(), int(counts.max(initial=1)))[::-1].transpose(0, 2, 1).sum(axis=2)
    beta = np.ones_like(alpha)
    beta[:-1] = after[1:]
    both = alpha * beta
    both /= both.sum(axis=1, keepdims=True)
    inner = np.ones(len(e), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    pairs = alpha[inner - 1][:, :, None] * step[inner] * beta[inner][:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return both, pairs.sum(axis=0)


def _emission(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    good = (x @ weights.astype(np.float32)).astype(np.float64)
    return np.stack([np.zeros(len(x)), good], axis=1)


def _fit(x: np.ndarray, counts: np.ndarray, good: np.ndarray, weights: np.ndarray, transitions: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of line labels with a weight penalty, by Adam steps on the exact gradient."""
    inner = np.ones(len(x), bool)
    inner[np.cumsum(counts) - counts] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[i - 1].astype(int), good[i].astype(int)), 1)
    m = [np.zeros_like(weights), np.zeros_like(transitions)]
    v = [np.zeros_like(weights), np.zeros_like(transitions)]
    for r in range(1, rounds + 1):
        p, expected = marginals(_emission(x, weights), transitions, counts)
        slopes = [x.T @ (good - p[:, 1]).astype(np.float32) / len(x) - 1e-4 * weights, (seen - expected) / len(x) - 1e-4 * transitions]
        for k, g in enumerate(slopes):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            move = 0.1 * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.99**r)) + 1e-6)
            if k == 0:
                weights = weights + move
            else:
                transitions = transitions + move
    return weights, transitions


def _means(p: np.ndarray, lines: Lines) -> np.ndarray:
    """The chance of a good line, weighted by length, over each text; as log odds."""
    starts = np.cumsum(lines.counts) - lines.counts
    mean = np.add.reduceat(p[:, 1] * lines.weights, starts) / np.add.reduceat(lines.weights, starts)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def fit(lines: Lines, labels: np.ndarray) -> Model | None:
    """From the lines of labelled documents (1 good, 0 bad). All lines of a good document are good. A bad document may
    have good lines: after a first fit, lines of bad documents that look good are taken for good, if others are left.
    None unless both labels occur."""
    if len(np.unique(labels)) < 2:
        return None
    x = features(lines)
    good = np.repeat(labels, lines.counts).astype(np.float64)
    weights, transitions = _fit(x, lines.counts, good, np.zeros(x.shape[1]), np.zeros((2, 2)), 90)
    starts = np.cumsum(lines.counts) - lines.counts
    p, _ = marginals(_emission(x, weights), transitions, lines.counts)
    worst = np.repeat(np.minimum.reduceat(p[:, 1], starts), lines.counts)
    good = np.where((good == 0) & (p[:, 1] > 0.5) & (worst < 0.5), 1.0, good)
    weights, transitions = _fit(x, lines.counts, good, weights, transitions, 40)
    p, _ = marginals(_emission(x, weights), transitions, lines.counts)
    z = _means(p, lines)
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method on two numbers, held close to (1, 0)
        s = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        d = s * (1 - s)
        g = np.array([((labels - s) * z).sum() - (slope - 1), (labels - s).sum() - 0.1 * offset])
        h = np.array([[(d * z * z).sum() + 1, (d * z).sum()], [(d * z).sum(), d.sum() + 0.1]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = slope + move[0], offset + move[1]
    return Model(weights, transitions, float(slope), float(offset))


def score_texts(data: np.ndarray, offsets: np.ndarray, model: Model | None) -> np.ndarray:
    """Of each text the score in [0, 1]."""
    if model is None:
        return np.ones(len(offsets) - 1)
    if len(offsets) == 1:
        return np.zeros(0)
    lines = lines_of(data, offsets)
    p, _ = marginals(_emission(features(lines), model.weights), model.transitions, lines.counts)
    return 1 / (1 + np.exp(-np.clip(model.slope * _means(p, lines) + model.offset, -30, 30)))


def held_out(doc_id) -> F.Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the documents with a label that are not held out, ``SAMPLE_DOCUMENTS`` at most, and of each on
    ``SAMPLE_LINES`` lines at most, spread evenly over it. Measures of these lines, not texts, go to the driver. Of rows with
    one doc_id the smallest text is taken. Labels that are NULL or neither 0 nor 1 are left out; of several, the smallest holds."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    sample = texts_of(docs).join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")

    def measure(piece: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(piece.column("text"))
        lines = lines_of(data, offsets)
        at = np.concatenate([[0], np.cumsum(lines.counts)])
        rows, weights = [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            some = np.unique(np.linspace(a, b - 1, min(b - a, SAMPLE_LINES)).astype(np.int64))
            rows.append(lines.measures[some].tobytes())
            weights.append(lines.weights[some].tobytes())
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), pa.array(rows, pa.binary()), pa.array(weights, pa.binary())], names=["doc_id", "label", "measures", "weights"])

    found = sorted(map(tuple, mapped(sample, measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, measures binary, weights binary").collect()))
    if not found:
        return None
    weights = [np.frombuffer(w, np.float64) for *_, w in found]
    measures = np.concatenate([np.frombuffer(m, np.float32).reshape(-1, len(MEASURES)) for _, _, m, _ in found])
    lines = Lines(measures, np.array([len(w) for w in weights]), np.concatenate(weights))
    return fit(lines, np.array([label for _, label, *_ in found], np.float64))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """For every row of docs: doc_id, score, predicted (1 from a score of 0.5 on). Whole texts are scored.

    NULL and empty texts are one empty line and have a score like others; a NULL doc_id stays; repeated rows are scored
    each; other columns are left aside. Without a model (no label of either kind to learn from) every score is 1.
    """

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        score = score_texts(*utf8(piece.column("text")), model)
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return mapped(texts_of(docs), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all columns, whose score is at least 0.5. The score is computed where the text lies, some
    megabytes at a time. NULL and empty texts are one empty line and have a score like others; rows that repeat are judged
    each; a NULL doc_id stays; without a model all rows stay; an empty table stays empty."""

    def good(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(*utf8(texts), model) >= 0.5, pa.bool_())

    return docs.where(column_of(F.coalesce("text", F.lit("")), good, "boolean"))
