"""Tests on a column. All are two-valued: a null fails every test but ``ne``, ``not_in`` and ``absent``."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNARY = ("present", "absent", "is_null")
NUMERIC = ("lt", "le", "gt", "ge")


def comparable(value: Any, kind: T.DataType | None) -> bool:
    """Whether a literal can equal a value of the column's type; no type is coerced to another."""
    if kind is None or isinstance(kind, T.NullType):
        return True
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    return isinstance(kind, (T.StringType, T.DateType, T.TimestampType))


def _equal(c: Column, value: Any, kind: T.DataType | None) -> Column:
    return F.coalesce(c == F.lit(value), F.lit(False)) if value is not None and comparable(value, kind) else F.lit(False)


def _among(c: Column, values: Any, kind: T.DataType | None) -> Column:
    usable = [v for v in values if v is not None and comparable(v, kind)]
    return F.coalesce(c.isin(usable), F.lit(False)) if usable else F.lit(False)


def _ordered(compare: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    def test(c: Column, value: Any, kind: T.DataType | None) -> Column:
        try:
            bound = float(value)
        except (TypeError, ValueError):
            return F.lit(False)
        number = c.cast("double") if isinstance(kind, (T.NumericType, T.BooleanType)) else c.cast("string").try_cast("double")
        return F.coalesce(compare(number, F.lit(bound)) & ~F.isnan(number), F.lit(False))

    return test


OPS: dict[str, Callable[[Column, Any, T.DataType | None], Column]] = {
    "eq": _equal,
    "ne": lambda c, v, kind: ~_equal(c, v, kind),
    "in": _among,
    "not_in": lambda c, v, kind: ~_among(c, v, kind),
    "present": lambda c, v, kind: c.isNotNull(),
    "absent": lambda c, v, kind: c.isNull(),
    "is_null": lambda c, v, kind: c.isNull(),
    "lt": _ordered(lambda a, b: a < b),
    "le": _ordered(lambda a, b: a <= b),
    "gt": _ordered(lambda a, b: a > b),
    "ge": _ordered(lambda a, b: a >= b),
}


def holds(op: str, actual: Any, value: Any) -> bool:
    """The same tests on a plain Python value (None for null), for analysis and as a yardstick in tests."""
    if op in ("absent", "is_null"):
        return actual is None
    if op == "present":
        return actual is not None
    same = lambda v: actual is not None and v is not None and isinstance(actual, bool) == isinstance(v, bool) and isinstance(actual, str) == isinstance(v, str) and actual == v
    if op in ("eq", "ne"):
        return same(value) == (op == "eq")
    if op in ("in", "not_in"):
        return any(same(v) for v in value) == (op == "in")
    if op not in NUMERIC:
        raise ValueError(f"no such test: {op}")
    try:
        a, b = float(actual), float(value)
    except (TypeError, ValueError):
        return False
    return {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]
