"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import cut

DIMENSIONS = ("source", "lang", "topic")
#: A value's target is its share of the tokens to this power, scaled to sum to one: 1 leaves shares, 0 makes them equal.
SOFTENING = 0.5
ROUNDS = 12
CALIBRATIONS = 12
#: Share of all tokens that the sample has on average.
BUDGET = 0.5
SEED = "mixture"

WORD = r"[^\x20\x09-\x0D]+"
# The topic of a text without a topic column: the part of the alphabet in which most of its words begin.
INITIALS = {"a-f": r"[\x20\x09-\x0D][a-fA-F]", "g-o": r"[\x20\x09-\x0D][g-oG-O]", "p-z": r"[\x20\x09-\x0D][p-zP-Z]"}


def measured(docs: DataFrame) -> DataFrame:
    """docs with the columns _tokens (words), _source, _lang and _topic; a NULL value is one of its own, named "".

    A ``topic`` column is used where there is one; otherwise the topic is made of the initials of the words.
    """
    text = F.coalesce("text", F.lit(""))
    tokens = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    counts = {name: F.regexp_count(F.concat(F.lit(" "), text), F.lit(pattern)).cast("bigint") for name, pattern in INITIALS.items()}
    with_counts = docs.withColumns({"_tokens": tokens} | ({} if "topic" in docs.columns else {f"_{i}": c for i, c in enumerate(counts.values())}))
    if "topic" in docs.columns:
        topic = F.coalesce(F.col("topic").cast("string"), F.lit(""))
    else:
        held = [F.col(f"_{i}") for i in range(len(counts))]
        rest = F.col("_tokens") - sum(held[1:], held[0])
        most = F.greatest(*held, rest)
        topic = F.lit("other")
        for name, c in reversed(list(zip(counts, held, strict=True))):
            topic = F.when(c == most, F.lit(name)).otherwise(topic)
    named = {f"_{d}": F.coalesce(F.col(d).cast("string"), F.lit("")) if d in docs.columns else F.lit("") for d in ("source", "lang")}
    return with_counts.withColumns(named | {"_topic": topic}).drop(*[f"_{i}" for i in range(len(counts))])


def targets(cells: DataFrame, dimension: str, softening: float = SOFTENING) -> DataFrame:
    """value and target: how many tokens of all should be of each value."""
    shares = cut(cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("t")).withColumn("soft", F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(softening))).otherwise(0.0)), "targets")
    soft, total = shares.agg(F.sum("soft"), F.sum("t")).first()
    return shares.select("value", (F.col("soft") / F.lit(float(soft or 1)) * F.lit(float(total or 0))).alias("target"))


def raked(cells: DataFrame, wanted: dict[str, DataFrame]) -> DataFrame:
    """cells (one row for each combination, with tokens) with their weight: tokens, scaled in turn to each dimension's
    targets, ``ROUNDS`` times. Rounds work on combinations and not on documents, and each is written."""
    for dimension, target in wanted.items():
        cells = cells.join(target.select(F.col("value").alias(dimension), F.col("target").alias(f"target{dimension}")), dimension, "left")
    cells = cut(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for _ in range(ROUNDS):
        for dimension in wanted:
            have = cells.groupBy(dimension).agg(F.sum("weight").alias("have"))
            scaled = F.when(F.col("have") > 0, F.col("weight") * F.coalesce(f"target{dimension}", F.lit(0.0)) / F.col("have")).otherwise(0.0)
            cells = cells.join(have, dimension).withColumn("weight", scaled).drop("have")
        cells = cut(cells, "cells")
    return cells.drop(*(f"target{d}" for d in wanted))


def probabilities(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """cells with ratio (weight by token) and probability: min(1, c * ratio), with c such that the expected tokens are the
    budget; what combinations at 1 cannot take goes to the others. A combination without tokens has the probability 1."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    cells = cut(cells.withColumn("ratio", ratio), "ratios")
    wanted = (cells.agg(F.sum("tokens")).first()[0] or 0) * budget
    c = 0.0
    for _ in range(CALIBRATIONS):
        full = F.col("ratio") * F.lit(c) >= 1
        at_most, rest = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("ratio") * F.col("tokens")))).first()
        c = c if not rest else (wanted - at_most) / rest
    return cells.withColumn("probability", F.round(F.coalesce(F.least(F.lit(1.0), F.col("ratio") * F.lit(c)), F.lit(1.0)), 6)).withColumn("ratio", F.round("ratio", 6))


def draw(doc_id) -> Column:
    """A number in [0, 1) that depends on the document's id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(2.0**32)


def cell_probabilities(documents: DataFrame, budget: float = BUDGET, wanted: dict[str, DataFrame] | None = None) -> DataFrame:
    """From the result of ``measured``: ratio and probability of each combination of source, language and topic."""
    names = [f"_{d}" for d in DIMENSIONS]
    cells = cut(documents.groupBy(*names).agg(F.sum("_tokens").alias("tokens")), "cells")
    return probabilities(raked(cells, wanted or {name: targets(cells, name) for name in names}), budget)


def mixture(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """For every row of docs: doc_id, n_tokens, topic, weight (by token), probability and kept.

    NULL values of source, lang or topic count as a value of their own; NULL and empty texts have no tokens and are kept
    if their combination has none, else with its probability; rows of one doc_id share their draw; a NULL doc_id has one
    too; other columns are left aside; an empty table gives no rows.
    """
    columns = [c for c in ("doc_id", "text", *DIMENSIONS) if c in docs.columns]
    documents = cut(measured(docs.select(*columns)).drop("text"), "measured")
    cells = cell_probabilities(documents, budget).select(*[f"_{d}" for d in DIMENSIONS], "ratio", "probability")
    return documents.join(cells, [f"_{d}" for d in DIMENSIONS]).select(
        "doc_id", F.col("_tokens").alias("n_tokens"), F.col("_topic").alias("topic"), F.col("ratio").alias("weight"), "probability", (draw(F.col("doc_id")) < F.col("probability")).alias("kept")
    )


def sampled(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of docs that ``mixture`` keeps, with all columns."""
    columns = [c for c in ("doc_id", "text", *DIMENSIONS) if c in docs.columns]
    cells = cell_probabilities(measured(docs.select(*columns)), budget).select(*[f"_{d}" for d in DIMENSIONS], F.col("probability").alias("_probability"))
    return measured(docs).join(cells, [f"_{d}" for d in DIMENSIONS]).where(draw(F.col("doc_id")) < F.col("_probability")).select(*docs.columns)


def sql() -> str:
    """The same in SQL, with the rounds written out."""
    words = "len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))"
    counts = [f"len(regexp_extract_all(' ' || text, '{p}')) AS c{i}" for i, p in enumerate(INITIALS.values())]
    cases = " ".join(f"WHEN c{i} = greatest(c0, c1, c2, n - c0 - c1 - c2) THEN '{name}'" for i, name in enumerate(INITIALS))
    parts = [
        f"texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS _source, coalesce(lang, '') AS _lang FROM documents)",
        f"counted AS (SELECT doc_id, _source, _lang, {words} AS n, {', '.join(counts)} FROM texts)",
        f"measured AS (SELECT doc_id, _source, _lang, n, CASE {cases} ELSE 'other' END AS _topic FROM counted)",
        "cells AS (SELECT _source, _lang, _topic, sum(n) AS tokens FROM measured GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        parts.append(f"shares_{d} AS (SELECT _{d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE, {SOFTENING}) ELSE 0 END AS soft, sum(tokens) AS t FROM cells GROUP BY 1)")
        parts.append(f"target_{d} AS (SELECT _{d}, soft / sum(soft) OVER () * (sum(t) OVER ())::DOUBLE AS target_{d} FROM shares_{d})")
    parts.append("w0 AS (SELECT *, tokens::DOUBLE AS weight FROM cells JOIN target_source USING (_source) JOIN target_lang USING (_lang) JOIN target_topic USING (_topic))")
    n = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY _{d}) > 0 THEN weight * target_{d} / sum(weight) OVER (PARTITION BY _{d}) ELSE 0 END AS weight) FROM w{n})")
            n += 1
    parts.append(f"ratios AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens::DOUBLE END AS ratio FROM w{n})")
    parts.append("k0 AS (SELECT 0::DOUBLE AS c)")
    for i in range(CALIBRATIONS):
        full = "ratio * c >= 1"
        rest = f"sum(CASE WHEN {full} THEN 0 ELSE ratio * tokens::DOUBLE END)"
        parts.append(f"k{i + 1} AS MATERIALIZED (SELECT CASE WHEN coalesce({rest}, 0) = 0 THEN any_value(c) ELSE (sum(tokens)::DOUBLE * {BUDGET} - sum(CASE WHEN {full} THEN tokens ELSE 0 END)::DOUBLE) / {rest} END AS c FROM ratios, k{i})")
    digits = f"('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296"
    parts.append(f"p AS (SELECT _source, _lang, _topic, round(ratio, 6) AS weight, round(coalesce(least(1.0, ratio * c), 1.0), 6) AS probability FROM ratios, k{CALIBRATIONS})")
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, n::BIGINT AS n_tokens, _topic AS topic, weight, probability, {digits} < probability AS kept "
        "FROM measured JOIN p USING (_source, _lang, _topic)"
    )
