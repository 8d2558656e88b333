"""Aggregates with the null rules of the study scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.functions.clean import col


def _only_if_complete(values: Column, result: Column, where: Column | None) -> Column:
    rows = F.count_if(where) if where is not None else F.count(F.lit(1))
    return F.when(F.count(values) == rows, result)


def _picked(c: Column | str, where: Column | None) -> Column:
    return F.when(where, col(c)) if where is not None else col(c)


def sum_strict(c: Column | str, where: Column | None = None) -> Column:
    """Sum that is null as soon as one value is null."""
    v = _picked(c, where)
    return _only_if_complete(v, F.sum(v), where)


def min_strict(c: Column | str, where: Column | None = None) -> Column:
    v = _picked(c, where)
    return _only_if_complete(v, F.min(v), where)


def max_strict(c: Column | str, where: Column | None = None) -> Column:
    v = _picked(c, where)
    return _only_if_complete(v, F.max(v), where)


def sum_or_zero(c: Column | str) -> Column:
    """Sum that skips nulls and is zero when nothing is left."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def count_true(c: Column | str) -> Column:
    return F.count_if(col(c))


def any_true(c: Column | str) -> Column:
    """True if any row is true; false also for no rows and all-null rows."""
    return F.coalesce(F.bool_or(col(c)), F.lit(False))


def first_by(value: Column | str, *order: Column | str) -> Column:
    """Value on the earliest row, null if that row's value is null."""
    return F.min_by(col(value), F.struct(*[col(o) for o in order]))


def last_by(value: Column | str, *order: Column | str) -> Column:
    return F.max_by(col(value), F.struct(*[col(o) for o in order]))


def row_sum(*cols: Column | str) -> Column:
    """Per-row sum that counts nulls as zero."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(col(c), F.lit(0.0))
    return total
