"""Composable result steps: filters, rerankers and transforms over rows with query_id and position."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewell.operators.ordered import top_n

StepFunction = Callable[[DataFrame, dict], DataFrame]
KINDS = ("filter", "reranker", "transform")
MAX_STEPS = 20


class StepError(ValueError):
    """A step list that cannot be run."""


@dataclass(frozen=True)
class Step:
    name: str
    kind: str
    fn: StepFunction


_REGISTRY: dict[str, Step] = {}


def register_step(name: str, kind: str, fn: StepFunction) -> None:
    """Make a DataFrame function available to step lists under a name."""
    if kind not in KINDS:
        raise StepError(f"kind must be one of {KINDS}")
    _REGISTRY[name] = Step(name, kind, fn)


def registered_steps() -> list[Step]:
    return list(_REGISTRY.values())


def _mentions_any(parts: list[str]) -> Column:
    url = F.coalesce("url", F.lit(""))
    return functools.reduce(operator.or_, (url.contains(p) for p in parts))


def _resort(rows: DataFrame) -> DataFrame:
    """New positions by falling score; equal scores keep their order. A result list is bounded by the
    request's result limit, so a query's rows fit one window."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("position"))
    return rows.withColumn("position", F.row_number().over(order) - 1)


def _renumber(rows: DataFrame) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("position")) - 1)


def domain_filter(rows: DataFrame, config: dict) -> DataFrame:
    """Keep (or with ``exclude`` drop) rows whose URL contains one of ``domains``."""
    if not config.get("domains"):
        return rows
    hit = _mentions_any(config["domains"])
    return _renumber(rows.where(~hit if config.get("exclude") else hit))


def freshness_filter(rows: DataFrame, config: dict) -> DataFrame:
    """Drop rows older than ``max_age_days`` before ``now``; undated rows stay."""
    if config.get("max_age_days") is None:
        return rows
    cutoff = config["now"] - F.make_dt_interval(days=F.lit(config["max_age_days"]))
    return _renumber(rows.where(F.col("published_at").isNull() | (F.col("published_at") >= cutoff)))


def language_filter(rows: DataFrame, config: dict) -> DataFrame:
    """Keep the listed languages; rows without one stay."""
    if not config.get("languages"):
        return rows
    return _renumber(rows.where(F.col("language").isNull() | F.col("language").isin(config["languages"])))


def score_reranker(rows: DataFrame, config: dict) -> DataFrame:
    """Multiply the scores of ``boost_domains`` by ``boost_factor``, up to one, and sort again."""
    if not config:
        return rows
    if config.get("boost_domains"):
        boosted = F.least(F.lit(1.0), F.col("score") * config.get("boost_factor", 1.0))
        rows = rows.withColumn("score", F.when(_mentions_any(config["boost_domains"]), boosted).otherwise(F.col("score")))
    return _resort(rows)


def credibility_reranker(rows: DataFrame, config: dict) -> DataFrame:
    """Blend the score with credibility, which is 0.5 where unknown."""
    weight = config.get("credibility_weight", 0.3)
    trust = F.coalesce("provenance.credibility_score", F.lit(0.5))
    return _resort(rows.withColumn("score", F.least(F.lit(1.0), (1 - weight) * F.col("score") + weight * trust)))


def reciprocal_rank_reranker(rows: DataFrame, config: dict) -> DataFrame:
    """Score by position: 1 / (k + position + 1)."""
    shared = F.lit(1.0) / (F.lit(config.get("k", 60)) + F.col("position") + 1)
    return _resort(rows.withColumn("score", F.least(F.lit(1.0), shared)))


def title_transform(rows: DataFrame, config: dict) -> DataFrame:
    """Add ``prefix`` and ``suffix`` to titles and cut them at ``max_length``."""
    if not config:
        return rows
    full = F.concat(F.lit(config.get("prefix", "")), F.coalesce("title", F.lit("")), F.lit(config.get("suffix", "")))
    return rows.withColumn("title", F.substring(full, 1, config.get("max_length", 100)))


def snippet_transform(rows: DataFrame, config: dict) -> DataFrame:
    """Passes rows through."""
    return rows


def dedup_transform(rows: DataFrame, config: dict) -> DataFrame:
    """First row per value of ``field`` (the URL unless given) in each query; a missing field is one value."""
    field = config.get("field", "url")
    value = F.coalesce(F.col(field).cast("string"), F.lit("None")) if field in rows.columns else F.lit("")
    keyed = rows.withColumn("_value", value)
    firsts = top_n(keyed, ["query_id", "_value"], [F.col("position")], 1, "_r")
    return _renumber(firsts.drop("_value", "_r"))


for _name, _kind, _fn in [
    ("domain_filter", "filter", domain_filter),
    ("freshness_filter", "filter", freshness_filter),
    ("language_filter", "filter", language_filter),
    ("score_reranker", "reranker", score_reranker),
    ("credibility_reranker", "reranker", credibility_reranker),
    ("reciprocal_rank_reranker", "reranker", reciprocal_rank_reranker),
    ("title_transform", "transform", title_transform),
    ("snippet_transform", "transform", snippet_transform),
    ("dedup_transform", "transform", dedup_transform),
]:
    register_step(_name, _kind, _fn)


def define_steps(steps: list[tuple[str, dict] | str]) -> list[tuple[Step, dict]]:
    """Check a step list: one to twenty known names; a missing config is empty."""
    if not 1 <= len(steps) <= MAX_STEPS:
        raise StepError(f"a step list takes 1 to {MAX_STEPS} steps")
    pairs = [(s, {}) if isinstance(s, str) else s for s in steps]
    unknown = [name for name, _ in pairs if name not in _REGISTRY]
    if unknown:
        raise StepError(f"unknown steps: {', '.join(unknown)}")
    return [(_REGISTRY[name], config or {}) for name, config in pairs]


def ordered_steps(steps: list[tuple[Step, dict]]) -> list[tuple[Step, dict]]:
    """Filters, then rerankers, then transforms, each in the order given."""
    return sorted(steps, key=lambda s: KINDS.index(s[0].kind))


def run_steps(rows: DataFrame, steps: list[tuple[str, dict] | str]) -> DataFrame:
    """Feed each step's output to the next."""
    chain = ordered_steps(define_steps(steps))
    return functools.reduce(lambda df, s: df.transform(s[0].fn, s[1]), chain, rows)
