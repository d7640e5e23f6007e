"""Running values over ordered rows of a key, safe when one key holds a large share of all rows.

A plain window puts a whole key into one task. Here a key's rows are cut into segments of the ordering
column (so many seconds, so many ids), the window runs inside (key, segment), and one row per segment
carries totals across segments. Only those summaries, a few per key and segment, ever meet in one task.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewell.sources.tables import cut

SEGMENT = "_segment"
SEGMENT_ROWS = 1_000_000


def time_segment(ts: Column, seconds: int) -> Column:
    """Segment number of a timestamp."""
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000))


def id_segment(number: Column, width: int) -> Column:
    """Segment number of an integer position."""
    return F.floor(number / width)


MOST_SEGMENTS = 10_000
GROUPED = 100


def segment_of(df: DataFrame, ts: str, seconds: int | None = None, rows: int = SEGMENT_ROWS, of: str | None = None) -> Column:
    """Segment number of a timestamp (``of``, if it is not ``ts`` itself): of a fixed width, or bounded by quantiles so that a segment of all keys together
    holds about ``rows`` rows, wherever in time they lie; a key can then have no more than that, however hot it is.

    Only rows of one instant stay together. The bounds, ``MOST_SEGMENTS`` at most (segments of more rows beyond that), are
    looked up in two steps: among groups of them, then within the group.
    """
    at = F.col(of or ts)
    if seconds:
        return time_segment(at, seconds)
    micros = F.unix_micros(at)
    n = df.where(F.col(ts).isNotNull()).count()
    parts = min(MOST_SEGMENTS, -(-n // rows))
    if parts < 2:
        return F.when(at.isNotNull(), F.lit(0)).cast("bigint")
    found = df.agg(F.percentile_approx(F.unix_micros(ts), [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    bounds = sorted(set(found))
    groups = [bounds[i : i + GROUPED] for i in range(0, len(bounds), GROUPED)]
    coarse = F.lit([g[0] for g in groups[1:]]) if len(groups) > 1 else F.array().cast("array<bigint>")
    group = F.size(F.filter(coarse, lambda b: b <= micros))
    within = F.size(F.filter(F.element_at(F.array(*[F.lit(g) for g in groups]), group + 1), lambda b: b <= micros))
    return F.when(at.isNotNull(), (group * GROUPED + within).cast("bigint"))


def fitting_width(df: DataFrame, number: str, rows: int = SEGMENT_ROWS) -> int:
    """The same for integer positions."""
    bounds = df.agg(F.count("*"), F.min(number), F.max(number)).first()
    if bounds[1] is None:
        return 1
    return max(1, int((bounds[2] - bounds[1] + 1) / -(-bounds[0] // rows)))


def _null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, (left[n].eqNullSafe(right["_k_" + n]) for n in names))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    segment: Column,
    *,
    previous: dict[str, tuple[str, int]] | None = None,
    total: dict[str, str] | None = None,
    peak_before: dict[str, str] | None = None,
    stored: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Add running columns per key in the total order ``order``; ``segment`` must not decrease along it.

    The rows are read twice, once for themselves and once for the summaries, so they are written out
    first unless they are ``stored`` already or cheaper to work out again. Sums and maxima of earlier segments join a
    segment as a row before its first one; with ``previous`` a join brings them.

    previous     out -> (column, k): the value k rows earlier
    total        out -> column: sum up to and including the row
    peak_before  out -> column: maximum over all earlier rows
    parts        how many tasks order the segments, where the session's number would give them too much (not with ``previous``)
    """
    previous, total, peak_before = previous or {}, total or {}, peak_before or {}
    depth = max((k for _, k in previous.values()), default=0)
    kept = sorted({column for column, _ in previous.values()})

    df = df if stored else cut(df, "running")
    rows = df.withColumn(SEGMENT, segment)
    if not previous:
        return _carried_as_rows(df.columns, rows, keys, order, total, peak_before, parts)
    local = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    before = local.rowsBetween(Window.unboundedPreceding, -1)

    within = {"_row_in_segment": F.row_number().over(local)}
    for out, (column, k) in previous.items():
        within["_in_" + out] = F.lag(column, k).over(local)
    for out, column in total.items():
        within["_in_" + out] = F.sum(column).over(upto)
    for out, column in peak_before.items():
        within["_in_" + out] = F.max(column).over(before)
    rows = rows.withColumns(within)

    # One summary per (key, segment): its last few values, its sums and its maxima.
    last_first = F.struct(*[F.col(o) for o in order])
    summary_cols = [F.sum(column).alias("_sum_" + out) for out, column in total.items()]
    summary_cols += [F.max(column).alias("_max_" + out) for out, column in peak_before.items()]
    summaries = df.withColumn(SEGMENT, segment)
    if depth:
        tail = Window.partitionBy(*keys, SEGMENT).orderBy(*[F.desc(o) for o in order])
        ending = summaries.withColumn("_from_end", F.row_number().over(tail)).where(F.col("_from_end") <= depth)
        carried = F.struct(*[F.col(c).alias(c) for c in kept])
        tails = ending.groupBy(*keys, SEGMENT).agg(
            F.array_sort(F.collect_list(F.struct(last_first.alias("at"), carried.alias("v")))).alias("_tail")
        )
        if summary_cols:
            # Brought together by a union, which unlike a join also keeps rows without a key.
            sums = summaries.groupBy(*keys, SEGMENT).agg(*summary_cols)
            both = tails.unionByName(sums, allowMissingColumns=True)
            parts = [c for c in both.columns if c not in (*keys, SEGMENT)]
            summaries = both.groupBy(*keys, SEGMENT).agg(*[F.any_value(c, F.lit(True)).alias(c) for c in parts])
        else:
            summaries = tails
    else:
        summaries = summaries.groupBy(*keys, SEGMENT).agg(*summary_cols)

    across = Window.partitionBy(*keys).orderBy(SEGMENT)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = {}
    if depth:
        # Segments may be shorter than the lag, so as many of them as the lag is deep are joined up.
        carry["_tails"] = F.flatten(F.collect_list("_tail").over(across.rowsBetween(-depth, -1)))
    for out in total:
        carry["_carry_" + out] = F.coalesce(F.sum("_sum_" + out).over(earlier), F.lit(0))
    for out in peak_before:
        carry["_carry_" + out] = F.max("_max_" + out).over(earlier)
    carried = summaries.select(
        *[F.col(k).alias("_k_" + k) for k in [*keys, SEGMENT]], *[c.alias(name) for name, c in carry.items()]
    )

    joined = rows.join(carried, _null_safe(rows, carried, [*keys, SEGMENT]), "left")
    out_cols = []
    for out, (column, k) in previous.items():
        back = F.try_element_at("_tails", F.col("_row_in_segment") - k - 1)["v"][column]
        out_cols.append(F.when(F.col("_row_in_segment") > k, F.col("_in_" + out)).otherwise(back).alias(out))
    for out in total:
        # A row inside its segment adds the carried total of the segments before it.
        out_cols.append((F.coalesce(F.col("_in_" + out), F.lit(0)) + F.col("_carry_" + out)).alias(out))
    for out in peak_before:
        out_cols.append(F.greatest("_in_" + out, "_carry_" + out).alias(out))
    return joined.select(*[F.col(c) for c in df.columns], *out_cols)


def _carried_as_rows(columns: list[str], rows: DataFrame, keys: list[str], order: list[str], total: dict[str, str], peak_before: dict[str, str], parts: int | None) -> DataFrame:
    """Running sums and maxima with one shuffle of the rows."""
    sums = {out: F.sum(column) for out, column in total.items()} | {out: F.max(column) for out, column in peak_before.items()}
    summaries = rows.groupBy(*keys, SEGMENT).agg(*[value.alias("_of_" + out) for out, value in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carry = {"_carry_" + out: F.coalesce(F.sum("_of_" + out).over(earlier), F.lit(0)) for out in total}
    carry |= {"_carry_" + out: F.max("_of_" + out).over(earlier) for out in peak_before}
    carried = summaries.select(*keys, SEGMENT, *[value.alias(name) for name, value in carry.items()])

    both = rows.withColumn("_row", F.lit(True)).unionByName(carried, allowMissingColumns=True)
    both = both if parts is None else both.repartition(parts, *keys, SEGMENT)
    local = Window.partitionBy(*keys, SEGMENT).orderBy(F.col("_row").asc_nulls_first(), *order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    within = {"_in_" + out: F.sum(column).over(upto) for out, column in total.items()}
    within |= {"_in_" + out: F.max(column).over(before) for out, column in peak_before.items()}
    within |= {name: F.first(name).over(upto) for name in carry}
    ran = both.withColumns(within).where(F.col("_row"))
    out_cols = [(F.coalesce(F.col("_in_" + out), F.lit(0)) + F.col("_carry_" + out)).alias(out) for out in total]
    out_cols += [F.greatest("_in_" + out, "_carry_" + out).alias(out) for out in peak_before]
    return ran.select(*columns, *out_cols)


def position(
    df: DataFrame, keys: list[str], order: list[str], segment: Column, out: str, stored: bool = False, parts: int | None = None
) -> DataFrame:
    """1-based position of each row within its key."""
    counted = running(df.withColumn("_one", F.lit(1)), keys, order, segment, total={out: "_one"}, stored=stored, parts=parts)
    return counted.drop("_one")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First n rows per key. The literal bound lets every map task drop all but n rows per key first."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= n)
