"""Arithmetic that minds its domain.

``strict`` raises an error where an operand lies outside the domain; otherwise the
result is NULL there. A NULL operand gives NULL either way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | float | int


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it doesn't, NULL where it is unknown."""
    return condition.cast("double")


def ratio(a: Column, b: Column, strict: bool = False, name: str = "a divisor") -> Column:
    if strict:
        return F.when((b == 0) & a.isNotNull(), F.raise_error(F.lit(f"{name} is 0")).cast("double")).otherwise(F.try_divide(a, b))
    return F.try_divide(a, b)


def _log(f, x: Column, strict: bool, name: str) -> Column:
    bad = F.raise_error(F.lit(f"{name} of a number <= 0")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(x > 0, f(x)).when(x <= 0, bad)


def ln(x: Column, strict: bool = False) -> Column:
    return _log(F.ln, x, strict, "ln")


def log10(x: Column, strict: bool = False) -> Column:
    return _log(F.log10, x, strict, "log10")


def lesser(a: Column, b: Column) -> Column:
    """The smaller of two; NULL if either is (the built-in one skips NULL)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
