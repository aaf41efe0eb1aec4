"""Date expressions and calendar arithmetic."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# A calendar date, alone or followed by a complete ISO time. Year-only and year-month texts are
# rejected here because Spark's own cast would read them as the first day.
_ISO_DATE = (
    r"^([0-9]{4}([-/ ])[0-9]{1,2}\2[0-9]{1,2})"
    r"(?: *|[T ](?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?"
    r"(?: ?(?:Z|UTC|[+-][0-9]{2}(?::?[0-9]{2})?))?)$"
)


def parse_date(value: Column) -> Column:
    """Date of a DATE or ISO timestamp text; NULL for anything else.

    Plain ten-character dates skip the pattern, which is the costly part.
    """
    other = F.translate(F.regexp_extract(value, _ISO_DATE, 1), "/ ", "--")
    return F.when(value.like("____-__-__"), value).otherwise(other).try_cast("date")


def month_of(value: Column) -> Column:
    return F.trunc(value, "MM")


def date_ordinal(value: Column) -> Column:
    """Days counted from 0001-01-01 as day 1."""
    return F.datediff(value, F.lit("0001-01-01").cast("date")) + 1


def add_months(start: date, months: int) -> date:
    total = start.year * 12 + (start.month - 1) + months
    return start.replace(year=total // 12, month=total % 12 + 1)
