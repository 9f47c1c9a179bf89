"""Scalar rules that several reports share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a requirement of each status counts for in coverage.
STATUS_WEIGHT = {"covered": 1.0, "partial": 0.5}
STATUSES = ("covered", "partial", "missing", "ambiguous")


def finite(x: Column) -> Column:
    """The number, or null where it is NaN."""
    return F.when(~F.isnan(x), x)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def weight_of(status: Column) -> Column:
    return F.coalesce(*(F.when(status == s, F.lit(w)) for s, w in STATUS_WEIGHT.items()), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, rounded; null where there is no whole."""
    return F.round(F.try_divide(100.0 * part, whole.cast("double")), digits)


def coverage(covered: Column, partial: Column, total: Column) -> Column:
    """Percentage of requirements covered, a partial one counting half; 0 without requirements."""
    return F.coalesce(percent(covered + 0.5 * partial, total), F.lit(0.0))


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def squeeze(text: Column) -> Column:
    """Lower case, inner white space as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\\s+", " "))


def content_key(category: Column, subdomain: Column, title: Column) -> Column:
    return F.sha2(F.concat_ws("||", squeeze(category), squeeze(subdomain), squeeze(title)), 256)
