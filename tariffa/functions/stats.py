"""Aggregate expressions with the panel's null rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tariffa import fixed_values as fv
from tariffa.functions.text import col


def pearson(x: Column, y: Column, where: Column) -> Column:
    """Pearson r over the rows that pass `where`; null for n < 2 or zero variance.

    Spark's own corr raises on a constant side, so the ratio is written out.
    """
    a, b = F.when(where, x), F.when(where, y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def status_counts() -> list[Column]:
    """One count per excluded status (zeros kept), plus `other` for unlisted words."""
    status = col("availability_status")
    return [F.count_if(status == s).alias(s) for s in fv.EXCLUDED_STATUSES] + [
        F.count_if(~status.isin(*fv.STATUSES)).alias("other")
    ]


def over(x: Column, limit: float) -> Column:
    """x > limit, with null as false."""
    return F.coalesce(x > limit, F.lit(False))


def distinct_weekdays(date) -> Column:
    """How many weekdays occur: a bit per weekday, so no distinct shuffle is needed."""
    return F.bit_count(F.bit_or(F.expr(f"shiftleft(1, weekday({date}))")))


def cv_percent(x: Column) -> Column:
    """Sample deviation over mean in percent; null for n < 2 or a zero mean."""
    return F.try_divide(F.stddev_samp(x), F.avg(x)) * 100
