"""Bronze manifests as a source: validated snapshot capabilities in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DATE_CRITERIA = "$.population_criteria.date_received"
_COUNTS = ("row_count", "distinct_complaint_id_count", "narrative_count")


def _kind(path: str) -> Column:
    """Variant type of a manifest field, empty when it is absent."""
    return F.coalesce(
        F.expr(f"schema_of_variant(try_variant_get(document, '{path}', 'variant'))"), F.lit("")
    )


def _text(path: str) -> Column:
    return F.when(
        _kind(path) == "STRING", F.expr(f"try_variant_get(document, '{path}', 'string')")
    )


def _iso_date(path: str) -> Column:
    text = _text(path)
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def read_capabilities(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot bounds and narrative availability; an invalid manifest is an error, not a guess."""
    document = spark.read.text(path, wholetext=True).select(
        F.try_parse_json("value").alias("document")
    )
    start, end = _iso_date(f"{_DATE_CRITERIA}.start"), _iso_date(f"{_DATE_CRITERIA}.end")
    problem = (
        F.when(F.col("document").isNull(), "manifest is not JSON")
        .when(~_kind("$").startswith("OBJECT"), "root must be an object")
        .when(
            ~_kind("$.population_criteria").startswith("OBJECT"),
            "population_criteria must be an object",
        )
        .when(
            ~_kind(_DATE_CRITERIA).startswith("OBJECT"),
            "population_criteria.date_received must be an object",
        )
        .when(start.isNull(), "population_criteria.date_received.start must be an ISO date string")
        .when(end.isNull(), "population_criteria.date_received.end must be an ISO date string")
        .when(start > end, "population_criteria.date_received start must not exceed end")
    )
    for name in _COUNTS:
        number = F.expr(f"try_variant_get(document, '$.{name}', 'bigint')")
        problem = problem.when(
            (_kind(f"$.{name}") != "BIGINT") | number.isNull() | (number < 0),
            f"{name} must be a nonnegative integer",
        )
    row = document.select(
        problem.alias("problem"),
        start.alias("snapshot_start"),
        end.alias("snapshot_end"),
        F.expr("try_variant_get(document, '$.narrative_count', 'bigint') > 0").alias(
            "has_consumer_narratives"
        ),
    )
    found = row.select("problem").collect()
    if len(found) != 1:
        raise ValueError("invalid Bronze manifest: exactly one file expected")
    if found[0]["problem"]:
        raise ValueError(f"invalid Bronze manifest: {found[0]['problem']}")
    return row.drop("problem").withColumns(
        {
            "has_verified_relief_amount": F.lit(False),
            "supports_auto_insurance_claims": F.lit(False),
        }
    )
