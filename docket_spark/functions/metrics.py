"""Additive measures and the ratios computed from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


COUNTS = ("complaint_count", "timely_response_count", "timely_response_known_count")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, NULL when the denominator is zero or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def complaint_measures(timely: Column) -> list[Column]:
    """Measures of a detail table. All three are counts, so coarser tables can add them up."""
    return [
        F.count(F.lit(1)).alias("complaint_count"),
        F.count_if(timely).alias("timely_response_count"),
        F.count(timely).alias("timely_response_known_count"),
    ]


def summed_measures() -> list[Column]:
    """The same measures from an already aggregated table."""
    return [F.sum(name).alias(name) for name in COUNTS]


def timely_rate() -> Column:
    return ratio(F.col("timely_response_count"), F.col("timely_response_known_count")).alias(
        "timely_response_rate"
    )


def metric_rollup(metric: str) -> Column:
    """Metric over metric-table rows; a rate is a ratio of sums, never a mean of rates."""
    if metric == "complaint_count":
        return F.sum("complaint_count")
    return ratio(F.sum("timely_response_count"), F.sum("timely_response_known_count"))


def sum_between(measure: Column, month: Column, start, end) -> Column:
    """Sum inside a half-open month window, zero when nothing falls in it."""
    inside = (month >= F.lit(start)) & (month < F.lit(end))
    return F.coalesce(F.sum(F.when(inside, measure)), F.lit(0))


def relative_change(baseline: Column, change: Column) -> Column:
    return ratio(change, baseline)
