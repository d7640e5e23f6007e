"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests tells from text."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import column_of, mapped, texts_of

# The patterns of the known kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
# Alphabets from small to large; a string's encoding is the first that has all its characters.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "hex upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower and digits": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper and digits": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64 url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "base64 both": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
_PLACES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}

# Letters in a thousand of English text, for tables with little text; other characters count as rare.
ENGLISH = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1), strict=True))
#: Letters of other documents that count beside a document's own, and the ASCII characters among which they are shared out.
PRIOR_LETTERS = 1000
VISIBLE = range(33, 127)

#: Share of text among the strings called random, and the combined p-value below which a string is not random.
FALSE_DISCOVERIES = 0.01
NOT_RANDOM = 0.001


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Matches of the known kinds, leftmost and without overlap within a kind, in order of (start, kind)."""
    spans = [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def encoding(token: str) -> str | None:
    """The smallest alphabet that has all characters of a string; None if none has."""
    letters = set(token)
    return next((name for name, places in _PLACES.items() if letters <= places.keys()), None)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, name: str) -> tuple[float, float, float]:
    """p-values of a string's symbols being uniform and independent over its alphabet: chi-squared (upper tail, with the
    exact mean and variance, since most strings are shorter than their alphabet is wide), runs above and below the middle
    of the alphabet, and correlation of neighbours (both two-sided)."""
    size, n = len(ALPHABETS[name]), len(token)
    values = np.fromiter((_PLACES[name][c] for c in token), np.float64, n)
    counts = np.bincount(values.astype(np.int64), minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    p_chi = _normal_tail((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (1 - 1 / n)))
    high = values >= size / 2
    above, runs = int(high.sum()), 1 + int((high[1:] != high[:-1]).sum())
    below = n - above
    mean = 1 + 2 * above * below / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = 2 * _normal_tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 2.0**-n * 2
    centred = values - values.mean()
    square = float((centred**2).sum())
    p_serial = 2 * _normal_tail(abs(float((centred[1:] * centred[:-1]).sum()) / square) * math.sqrt(n)) if square > 0 else 0.0
    return p_chi, p_runs, min(1.0, p_serial)


def fisher(p_values: tuple[float, ...]) -> float:
    """One p-value for several independent ones."""
    half = -sum(math.log(max(p, 1e-300)) for p in p_values)
    term, total = 1.0, 1.0
    for i in range(1, len(p_values)):
        term *= half / i
        total += term
    return math.exp(-half) * total


def text_p_value(token: str, name: str, letters: Counter, n_letters: float) -> float:
    """Bound on the chance that characters drawn as text uses them look so uniform: the likelihood ratio of
    uniform symbols against the frequencies of text exceeds t with a chance of at most 1/t. It falls with the length."""
    size = len(ALPHABETS[name])
    ratio = sum(math.log((n_letters + size) / size / (letters[c] + 1)) for c in token)
    return math.exp(-max(0.0, ratio))


def prior_letters(docs: DataFrame) -> dict[str, float]:
    """How often each visible ASCII character stands outside of candidates in all texts, in ``PRIOR_LETTERS`` letters.

    At most one row for each of 94 characters comes to the driver. Tables with little or no such text lean on English.
    """

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        outside = CANDIDATE.sub(" ", "\n".join(piece.column("text").to_pylist())).encode("utf-8")
        counts = np.bincount(np.frombuffer(outside, np.uint8), minlength=256)[VISIBLE.start : VISIBLE.stop]
        return pa.RecordBatch.from_arrays([pa.array(VISIBLE, pa.int64()), pa.array(counts, pa.int64())], names=["code", "n"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    found = Counter(ENGLISH)
    for r in mapped(texts, run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        found[chr(r.code)] += r.n
    share = PRIOR_LETTERS / sum(found.values())
    return {c: n * share for c, n in found.items()}


def random_spans(text: str, taken: list[Span], prior: dict[str, float] = ENGLISH) -> list[Span]:
    """Strings that pass the battery and are no text, with false discoveries controlled over the document's candidates;
    a candidate's share of the allowance is proportional to its length. What overlaps ``taken`` is left out. What text looks
    like is judged by the rest of the document and, beside it, by ``prior``, since a document can be all secrets."""
    found = []
    for m in CANDIDATE.finditer(text):
        if all(m.end() <= s.start or s.end <= m.start() for s in taken):
            token = m.group().rstrip("=")
            if (name := encoding(token)) is not None:
                found.append((m.start(), m.end(), token, name))
    if not found:
        return []
    letters = Counter(text)
    for _, _, token, _ in found:
        letters.subtract(token)
    rest = sum(n for c, n in letters.items() if n > 0 and not c.isspace()) + sum(prior.values())
    letters = Counter({c: letters[c] + prior.get(c, 0) for c in letters.keys() | prior.keys()})
    mean = sum(len(token) for _, _, token, _ in found) / len(found)
    weighed = sorted((text_p_value(token, name, letters, rest) * mean / len(token), start, end, token, name) for start, end, token, name in found)
    least = max((i for i, x in enumerate(weighed, 1) if x[0] <= FALSE_DISCOVERIES * i / len(weighed)), default=0)
    return [Span(start, 3, end) for _, start, end, token, name in weighed[:least] if fisher(battery(token, name)) >= NOT_RANDOM]


def all_spans(text: str, prior: dict[str, float] = ENGLISH) -> tuple[list[Span], list[Span]]:
    """The spans of the known kinds, and all spans in order of (start, kind)."""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, prior))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, and spans as kind:start:end, comma-joined; for every row of docs.

    Random strings are told from text by the letters of all texts (``prior_letters``) and of their own. Places count code
    points. NULL and empty texts have no spans; a NULL doc_id stays; repeated rows are answered as often;
    other columns are left aside.
    """
    prior = prior_letters(docs)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        counts, shas, spans = ([], [], []), [], []
        for text in piece.column("text").to_pylist():
            base, every = all_spans(text, prior)
            for kind, column in enumerate(counts):
                column.append(sum(s.kind == kind for s in base))
            shas.append(hashlib.sha256(listed(base).encode()).hexdigest())
            spans.append(listed(every))
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(texts_of(docs), run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def without(text: str, spans: list[Span], mark: str) -> str:
    """A text with every span, or several that overlap, replaced by ``mark``."""
    parts, at = [], 0
    for s in sorted(spans):
        if s.start >= at:
            parts += [text[at : s.start], mark]
        at = max(at, s.end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in its texts replaced; all columns stay, n_chars is counted anew where there is one.

    Texts without secrets, NULL and empty texts stay as they are, and so do all rows: those that repeat are each cleaned,
    a NULL doc_id stays, an empty table stays empty. Texts are looked at some megabytes at a time.
    """
    prior = prior_letters(docs)

    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([text if not text else without(text, all_spans(text, prior)[1], mark) for text in texts.to_pylist()], pa.string())

    cleaned = docs.withColumn("text", column_of(F.col("text"), clean, "string"))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
