"""Heuristic credibility and machine-generation scores."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrases counted as transitions.
TRANSITIONS = [
    "furthermore", "moreover", "additionally", "in conclusion",
    "it is important to note", "it is worth noting",
]


_SENTENCE_ENDS = re.compile("[.!?]+")
_FIGURE = re.compile(r"\d+\.?\d*")
_SCORES = T.StructType([T.StructField("credibility", T.DoubleType()), T.StructField("ai_likelihood", T.DoubleType())])


def _variance(sizes: list[int]) -> float:
    """Population variance from exact sums."""
    n, total = len(sizes), sum(sizes)
    return (n * sum(x * x for x in sizes) - total * total) / (n * n)


def scores(text: str) -> tuple[float, float]:
    """Credibility and machine likelihood. Sentences, words and paragraphs are cut once and serve both."""
    sentences = [s for part in _SENTENCE_ENDS.split(text) if (s := part.strip())]
    lowered = text.lower()
    words = lowered.split()

    credible = 0.5 + (0.1 if len(text) > 500 else 0.0) + (0.1 if len(text) > 2000 else 0.0)
    figures = _FIGURE.finditer(text)
    credible += 0.1 if sum(1 for _, _ in zip(range(4), figures)) > 3 else 0.0
    credible += 0.05 if len(sentences) > 3 and _variance([len(s) for s in sentences]) > 100 else 0.0
    credible += 0.05 if words and len(set(words)) / len(words) > 0.6 else 0.0

    if len(sentences) < 3:
        return max(0.0, min(1.0, credible)), 0.3
    spread = _variance([len(s.split()) for s in sentences])
    written = 0.3 + (0.2 if spread < 20 else 0.1 if spread < 50 else 0.0)
    phrases = sum(t in lowered for t in TRANSITIONS)
    written += 0.15 if phrases >= 3 else 0.1 if phrases >= 2 else 0.0
    paragraphs = [len(p) for part in text.split("\n\n") if (p := part.strip())]
    written += 0.1 if len(paragraphs) > 2 and _variance(paragraphs) < 500 else 0.0
    return max(0.0, min(1.0, credible)), max(0.0, min(1.0, written))


@F.pandas_udf(_SCORES)
def _scored(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scores(t or "") for t in texts], columns=["credibility", "ai_likelihood"])


def credibility(c: Column) -> Column:
    """Rewards length, figures, varied sentences and a rich vocabulary. Both scores of one text come from one pass."""
    return _scored(c)["credibility"]


def ai_likelihood(c: Column) -> Column:
    """Rewards uniform sentences, transition phrases and uniform paragraphs; short texts keep the base."""
    return _scored(c)["ai_likelihood"]
