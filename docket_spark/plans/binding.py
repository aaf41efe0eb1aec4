"""Requests whose company is a value of their own structured result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket_spark.functions.text import alphanumeric_fold, is_nonblank

MISSING_ROW = "the bound row is not among the structured rows"
BLANK_COMPANY = "the bound row names no company"
OTHER_COMPANY = "the bound company is not the one the request names"


def bind_companies(
    requests: DataFrame, rows: DataFrame, request: str = "question_id", column: str = "company"
) -> DataFrame:
    """``requests`` with the company of the structured row they are bound to, and ``binding_error``.

    ``requests``: request id, ``bind_row`` (NULL for a request that is not bound) and ``company`` (the one
    it names itself, if any). ``rows``: request id, ``row_index`` and the column that holds companies. A
    bound company replaces the named one; names that differ in more than case and punctuation, a
    missing row and a blank company are errors, and such a request keeps what it named.
    """
    bound = rows.select(
        F.col(request).alias("_of"),
        F.col("row_index").alias("_row"),
        F.col(column).cast("string").alias("_bound"),
        F.lit(True).alias("_found"),
    )
    same = (F.col(request) == F.col("_of")) & (F.col("bind_row") == F.col("_row"))
    named = F.coalesce(is_nonblank(F.col("company")), F.lit(False))
    differs = alphanumeric_fold(F.col("company")) != alphanumeric_fold(F.col("_bound"))
    error = F.when(
        F.col("bind_row").isNotNull(),
        F.when(F.col("_found").isNull(), MISSING_ROW)
        .when(~F.coalesce(is_nonblank(F.col("_bound")), F.lit(False)), BLANK_COMPANY)
        .when(named & differs, OTHER_COMPANY),
    )
    joined = requests.join(bound, same, "left").withColumn("binding_error", error)
    takes = F.col("bind_row").isNotNull() & F.col("binding_error").isNull()
    company = F.when(takes, F.col("_bound")).otherwise(F.col("company"))
    return joined.withColumn("company", company).drop("_of", "_row", "_bound", "_found")
