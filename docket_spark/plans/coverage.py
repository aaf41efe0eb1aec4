"""Whether a snapshot can answer a request at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: refusal texts and the capability each one names. ---
NO_RELIEF_AMOUNT = (
    "The CFPB response category does not contain a verified dollar amount of relief paid."
)
NO_AUTO_CLAIMS = "This CFPB snapshot does not establish coverage of auto-insurance claims."
NO_NARRATIVES = "The snapshot contains no consumer narratives."
NO_BOUNDS = "The snapshot manifest does not establish date coverage."
INVALID_RANGE = "The requested date range is invalid: start must precede exclusive end."
BEGINS_BEFORE = "The requested period begins before this snapshot's "
EXTENDS_BEYOND = "The requested period extends beyond this snapshot's "
COVERAGE_SUFFIX = " coverage."

CAPABILITIES = (
    "snapshot_start",
    "snapshot_end",
    "has_consumer_narratives",
    "has_verified_relief_amount",
    "supports_auto_insurance_claims",
)


def decide(requests: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Answerability, reason and missing capability of every request; the first rule that fails
    decides.

    ``requests`` has ``requested_start``, ``requested_end`` (exclusive) and the flags
    ``needs_relief_amount`` and ``needs_auto_claims``. ``capabilities`` is one row, read as scalar
    subqueries, so no join is involved.
    """
    have = {name: capabilities.select(name).scalar() for name in CAPABILITIES}
    known = requests.withColumns(have)
    start, end = F.col("requested_start"), F.col("requested_end")
    low, high = F.col("snapshot_start"), F.col("snapshot_end")

    def unless(name: str) -> Column:
        return ~F.coalesce(F.col(name), F.lit(False))

    def text(prefix: str, day: Column) -> Column:
        return F.concat(F.lit(prefix), day.cast("string"), F.lit(COVERAGE_SUFFIX))

    rules = [
        (
            F.col("needs_relief_amount") & unless("has_verified_relief_amount"),
            F.lit(NO_RELIEF_AMOUNT),
            "verified_relief_amount",
        ),
        (
            F.col("needs_auto_claims") & unless("supports_auto_insurance_claims"),
            F.lit(NO_AUTO_CLAIMS),
            "auto_insurance_claims",
        ),
        (unless("has_consumer_narratives"), F.lit(NO_NARRATIVES), "consumer_narratives"),
        (low.isNull() | high.isNull(), F.lit(NO_BOUNDS), "date_range"),
        (start >= end, F.lit(INVALID_RANGE), "date_range"),
        (start < low, text(BEGINS_BEFORE, low), "date_range"),
        (end > F.date_add(high, 1), text(EXTENDS_BEYOND, high), "date_range"),
    ]
    reason = F.coalesce(*[F.when(failed, words) for failed, words, _ in rules])
    capability = F.coalesce(*[F.when(failed, F.lit(name)) for failed, _, name in rules])
    return known.select(
        *requests.columns,
        reason.isNull().alias("answerable"),
        reason.alias("reason"),
        capability.alias("required_capability"),
    )
