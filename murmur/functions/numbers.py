"""Exact rounding of ratios of counts, half up, without going through binary fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, total: Column) -> Column:
    """``100 * part / total`` with one decimal; null when ``total`` is 0."""
    total = F.when(total > 0, total)
    return F.call_function("div", part * 2000 + total, total * 2) / F.lit(10.0)


def mean2(total: Column, count: Column) -> Column:
    """``total / count`` with two decimals; null when ``count`` is 0."""
    count = F.when(count > 0, count)
    return F.call_function("div", total * 200 + count, count * 2) / F.lit(100.0)
