"""Highlight spans of a query in a text."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SPANS = 5
FALLBACK_CHARS = 200
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@lru_cache(maxsize=1024)
def _finder(query: str) -> tuple[ahocorasick.Automaton, int] | None:
    """Automaton over the query's words of two or more characters, and the longest one's length."""
    terms = {w.lower() for w in query.split() if len(w) >= 2}
    if not terms:
        return None
    automaton = ahocorasick.Automaton()
    for term in terms:
        automaton.add_word(term, len(term))
    automaton.make_automaton()
    return automaton, max(map(len, terms))


def merged_matches(text: str, query: str, limit: int) -> list[tuple[int, int]]:
    """First ``limit`` merged runs of matches of the query's words; overlapping or touching matches are one run.

    The automaton gives all matches by their ends in one pass. The pass stops once a match can no longer reach back
    into the runs that count.
    """
    automaton, longest = _finder(query)
    runs: list[tuple[int, int]] = []
    for last, length in automaton.iter(text):
        start, end = last + 1 - length, last + 1
        while runs and start <= runs[-1][1]:
            start = min(start, runs.pop()[0])
        runs.append((start, end))
        if len(runs) > limit and end - longest > runs[limit - 1][1]:
            break
    return runs[:limit]


def widened(text: str, runs: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """Each run with ``reach`` characters more on both sides, and on to the next blank."""
    flat = text.replace("\n", " ").replace("\t", " ")
    spans = []
    for start, end in runs:
        blank = flat.rfind(" ", 0, max(0, start - reach + 1)) if start > reach else -1
        ahead = flat.find(" ", end + reach)
        begin, finish = blank + 1 if blank > 0 else 0, len(text) if ahead < 0 else ahead
        if begin < finish:
            spans.append((begin, finish))
    return spans


def extract(text: str | None, query: str | None, limit: int, reach: int) -> list[tuple[int, int]]:
    if not text or not query or limit <= 0 or _finder(query) is None:
        return []
    runs = merged_matches(text.lower(), query, limit)
    return widened(text, runs, reach) if runs else [(0, min(len(text), FALLBACK_CHARS))]


def highlights(text: Column, query: Column, max_spans: int = MAX_SPANS, reach: int = 50) -> Column:
    """Up to five half-open code-point spans around query words of two or more characters.

    Without any match the first 200 characters stand in. Every query's automaton is built once per Python worker, and texts
    come in Arrow batches.
    """
    limit = min(max_spans, MAX_SPANS)

    @F.pandas_udf(_SPANS)
    def found(texts: pd.Series, queries: pd.Series) -> pd.Series:
        return pd.Series([extract(t, q, limit, reach) for t, q in zip(texts, queries, strict=True)], dtype=object)

    return found(text, query)


def valid_spans(spans: Column, text: Column) -> Column:
    inside = F.forall(
        spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text))
    )
    return inside & (F.size(spans) <= MAX_SPANS)
