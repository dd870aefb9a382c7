"""Null rules of the analyses: missing equals missing, and a missing answer is never a hit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same(a, b) -> Column:
    """True when both are equal or both are null."""
    return _c(a).eqNullSafe(_c(b))


def is_value(c, value) -> Column:
    """c = value, false for null."""
    return F.coalesce(_c(c) == F.lit(value), F.lit(False))


def truthy(c) -> Column:
    """A boolean with null as false."""
    return F.coalesce(_c(c), F.lit(False))


def rate(hits: Column, n: Column) -> Column:
    """hits / n, null when n is zero."""
    return F.try_divide(hits.cast("double"), n.cast("double"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
