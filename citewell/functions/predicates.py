"""Typed filter predicates over document fields, composed as ordinary Columns.

A predicate carries its Column plus its depth and number of comparisons, so that bounds are checked
while composing: ``docs.where(all_of(eq("language", "en"), gt("published_at", date)).column)``.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 32
MAX_COMPARISONS = 1024
MAX_SET_SIZE = 256
MAX_STRING = 1024
MAX_KEY_SEGMENT = 128

# Fields a filter may name besides metadata.<key>.
FIELDS = ["domain", "url", "published_at", "language", "category"]


class FilterError(ValueError):
    """A predicate outside the allowed fields, types or sizes."""


@dataclass(frozen=True)
class Predicate:
    column: Column
    depth: int = 1
    comparisons: int = 1

    def __post_init__(self):
        if self.depth > MAX_DEPTH:
            raise FilterError(f"filter nests deeper than {MAX_DEPTH}")
        if self.comparisons > MAX_COMPARISONS:
            raise FilterError(f"filter has more than {MAX_COMPARISONS} comparisons")


def field(name: str) -> Column:
    """Column of a filter field; ``metadata.a.b`` reads key ``a.b`` of the metadata map."""
    head, *keys = name.split(".")
    if head == "metadata":
        if not keys or any(not 1 <= len(k) <= MAX_KEY_SEGMENT for k in keys):
            raise FilterError(f"bad metadata key in {name!r}")
        return F.col("metadata").getItem(".".join(keys))
    if head not in FIELDS or keys:
        raise FilterError(f"unknown field {name!r}")
    return F.col(head)


def _operands(name: str, value) -> tuple[Column, Column]:
    """The field and the literal, brought to one type; values kept as text are cast with try_cast."""
    column = field(name)
    stored_as_text = name != "published_at"
    if isinstance(value, bool) or not isinstance(value, (str, int, float, dt.date)):
        raise FilterError(f"unsupported literal {value!r}")
    if isinstance(value, str):
        if len(value) > MAX_STRING:
            raise FilterError("string literal too long")
        if name == "published_at":
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?", value):
                raise FilterError(f"not a timestamp: {value!r}")
            return column, F.lit(value).cast("timestamp")
        return column, F.lit(value)
    if isinstance(value, dt.date):
        return (column.try_cast("timestamp") if stored_as_text else column), F.lit(value).cast("timestamp")
    if not stored_as_text:
        raise FilterError("published_at compares with timestamps only")
    return column.try_cast("double"), F.lit(float(value))


def _compare(op, name, value) -> Predicate:
    left, right = _operands(name, value)
    return Predicate(op(left, right))


def eq(name, value) -> Predicate:
    return _compare(operator.eq, name, value)


def ne(name, value) -> Predicate:
    return _compare(operator.ne, name, value)


def lt(name, value) -> Predicate:
    return _compare(operator.lt, name, value)


def le(name, value) -> Predicate:
    return _compare(operator.le, name, value)


def gt(name, value) -> Predicate:
    return _compare(operator.gt, name, value)


def ge(name, value) -> Predicate:
    return _compare(operator.ge, name, value)


def is_in(name, values) -> Predicate:
    values = list(values)
    if not 1 <= len(values) <= MAX_SET_SIZE:
        raise FilterError(f"a set takes 1 to {MAX_SET_SIZE} values")
    pairs = [_operands(name, v) for v in values]
    if len({type(v) for v in values}) == 1:
        return Predicate(pairs[0][0].isin([right for _, right in pairs]))
    return Predicate(functools.reduce(operator.or_, (left == right for left, right in pairs)))


def not_(p: Predicate) -> Predicate:
    return Predicate(~p.column, p.depth + 1, p.comparisons)


def _fold(op, parts) -> Predicate:
    if not parts:
        raise FilterError("nothing to combine")
    return Predicate(
        functools.reduce(op, (p.column for p in parts)),
        max(p.depth for p in parts) + 1,
        sum(p.comparisons for p in parts),
    )


def all_of(*parts: Predicate) -> Predicate:
    return _fold(operator.and_, parts)


def any_of(*parts: Predicate) -> Predicate:
    return _fold(operator.or_, parts)
