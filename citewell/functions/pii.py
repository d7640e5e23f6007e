"""Personal-data detection and redaction.

Detection and redaction run over Arrow batches: every kind is one scan of a text, offsets come from the scan, and a redacted
text is joined once, so the work is linear in text and matches. Log records are redacted by built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word edges next to a word character, with letters and digits of every script as word characters.
_L = r"(?<![\p{L}\p{N}_])"
_R = r"(?![\p{L}\p{N}_])"
_D = r"\p{Nd}"
_SEP = r"[\s\x1C-\x1F\-]"

# What each kind of match looks like, in order of precedence for equal spans.
_LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
_LOCAL = "[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]"
_EMAIL = rf"{_LOCAL}+@{_LABEL}(?:\.{_LABEL})+"
PATTERNS = [
    ("email", _EMAIL),
    ("phone", r"\+(?:\d[\s-]?){1,15}\d"),
    ("us_ssn", r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b"),
    ("eu_national_id", r"\b[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\b"),
    ("eu_national_id", r"\b\d{8}[A-Z]\b"),
    ("eu_national_id", r"\b[A-Z][0-9A-Z]{8}\b"),
    ("eu_national_id", r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b"),
    ("credit_card", r"\b(?:\d[\s-]?){12,18}\d\b"),
]
PLACEHOLDERS = {
    "email": "[REDACTED_EMAIL]",
    "phone": "[REDACTED_PHONE]",
    "us_ssn": "[REDACTED_SSN]",
    "eu_national_id": "[REDACTED_EU_ID]",
    "credit_card": "[REDACTED_CARD]",
}
SENSITIVE_KEYS = ["api_key", "bearer_token", "password", "secret", "key_hash", "authorization"]
LOG_PATTERNS = [
    ("[REDACTED_EMAIL]", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("[REDACTED_PHONE]", rf"\+?1?{_D}{{10,15}}"),
    ("[REDACTED_SSN]", rf"{_L}{_D}{{3}}-?{_D}{{2}}-?{_D}{{4}}{_R}"),
    ("[REDACTED_CREDIT_CARD]", rf"(?U){_L}{_D}{{4}}{_SEP}?{_D}{{4}}{_SEP}?{_D}{{4}}{_SEP}?{_D}{{4}}{_R}"),
]

Span = tuple[int, int, int, str, str]
SPANS = T.ArrayType(
    T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("rank", T.IntegerType()),
        T.StructField("type", T.StringType()), T.StructField("value", T.StringType()),
    ])
)
_SCANS = [(rank, kind, re.compile(pattern)) for rank, (kind, pattern) in enumerate(PATTERNS)]
# What a text must hold to be scanned for a kind: most lack it.
_NEEDED = {"email": re.compile("@"), "phone": re.compile(r"\+")}
_FIGURE = re.compile(r"[\dA-Z]")
_HERE, _NEXT = re.compile(_EMAIL), re.compile(f"(?<!{_LOCAL}){_EMAIL}")
_BARE = str.maketrans("", "", " -")


def _emails(text: str) -> Iterator[re.Match]:
    """A local part can only begin where a run of its characters begins or the last match ended, which keeps the scan
    linear on long runs without an @."""
    at = 0
    while found := (_HERE.match(text, at) if at else None) or _NEXT.search(text, at):
        yield found
        at = found.end()


def passes_luhn(digits: str) -> bool:
    """Luhn checksum of a string of decimal digits of any script; false for anything else."""
    if not digits.isdecimal():
        return False
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 if v > 4 else 2 * v for v in values[1::2])) % 10 == 0


def _accepted(kind: str, value: str) -> bool:
    """Checks beyond the pattern."""
    bare = value.translate(_BARE)
    if kind == "phone":
        return len(bare.lstrip("+")) >= 7
    if kind == "us_ssn":
        return len(bare) == 9 and bare[:3] not in ("000", "666") and bare[0] != "9" and bare[3:5] != "00" and bare[5:] != "0000"
    if kind == "credit_card":
        return 13 <= len(bare) <= 19 and passes_luhn(bare)
    return True


def find(text: str, only: str | None = None) -> list[Span]:
    """Accepted (start, end, rank, kind, value) by position, of all kinds or one."""
    found = []
    for rank, kind, scan in _SCANS:
        if (only is None or kind == only) and _NEEDED.get(kind, _FIGURE).search(text):
            matches = _emails(text) if kind == "email" else scan.finditer(text)
            found += [(m.start(), m.end(), rank, kind, m.group()) for m in matches if _accepted(kind, m.group())]
    return sorted(found)


def distinct(spans: list[Span]) -> list[Span]:
    """Of equal spans the first."""
    return [s for i, s in enumerate(spans) if i == 0 or s[:2] != spans[i - 1][:2]]


def placeholder(kind: str) -> str:
    return PLACEHOLDERS.get(kind) or f"[REDACTED_{kind.upper()}]"


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Text with (start, end, kind) replaced from the last to the first, each at its original offsets.

    What stands behind a replaced span is a stack of pieces; a span that reaches into it takes off as much.
    """
    behind: list[str] = []
    upto = len(text)
    for start, end, kind in reversed(spans):
        if end <= upto:
            behind.append(text[end:upto])
        else:
            over = end - upto
            while behind and over >= len(behind[-1]):
                over -= len(behind.pop())
            if behind and over:
                behind[-1] = behind[-1][over:]
        behind.append(placeholder(kind))
        upto = start
    return text[:upto] + "".join(reversed(behind))


def _each(of, texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else of(t) for t in texts], dtype=object)


@F.pandas_udf(T.BooleanType())
def luhn(digits: pd.Series) -> pd.Series:
    return digits.map(passes_luhn, na_action="ignore")


def detect_one(c: Column, kind: str) -> Column:
    """Accepted spans of one kind, by position."""

    @F.pandas_udf(SPANS)
    def detect(texts: pd.Series) -> pd.Series:
        return _each(lambda t: find(t, kind), texts.fillna(""))

    return detect(c)


@F.pandas_udf(SPANS)
def detect_pii(texts: pd.Series) -> pd.Series:
    """All accepted spans by position; of equal spans the first kind in PATTERNS stays."""
    return _each(lambda t: distinct(find(t)), texts.fillna(""))


@F.pandas_udf(T.StringType())
def redact_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Replace spans from the last to the first, each at its original offsets."""
    pairs = zip(texts, spans, strict=True)
    return pd.Series([None if t is None or s is None else replaced(t, [(x["start"], x["end"], x["type"]) for x in s]) for t, s in pairs], dtype=object)


def _hidden(text: str) -> tuple[str, list[Span]]:
    spans = distinct(find(text))
    return replaced(text, [(s, e, kind) for s, e, _, kind, _ in spans]) if spans else text, spans


@F.pandas_udf(T.StringType())
def redact(texts: pd.Series) -> pd.Series:
    return _each(lambda t: _hidden(t)[0], texts)


_INFO = T.StructType([
    T.StructField("redacted_text", T.StringType()),
    T.StructField("redactions", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("placeholder", T.StringType()),
    ]))),
    T.StructField("had_pii", T.BooleanType()),
])


@F.pandas_udf(_INFO)
def redact_info(texts: pd.Series) -> pd.DataFrame:
    """Redacted text plus kinds, spans and placeholders, without the values."""
    rows = []
    for text in texts:
        hidden, spans = (None, []) if text is None else _hidden(text)
        rows.append((hidden, [(kind, s, e, placeholder(kind)) for s, e, _, kind, _ in spans], bool(spans)))
    return pd.DataFrame(rows, columns=["redacted_text", "redactions", "had_pii"])


def redact_log_value(c: Column) -> Column:
    for replacement, pattern in LOG_PATTERNS:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def redact_log(fields: Column) -> Column:
    """Map column of a log record: sensitive keys blanked, other values redacted."""
    return F.transform_values(
        fields,
        lambda k, v: F.when(F.lower(k).isin(SENSITIVE_KEYS), F.lit("[REDACTED]")).otherwise(redact_log_value(v)),
    )
