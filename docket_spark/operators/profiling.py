"""One-pass profiles and schema guards."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket_spark.functions.text import canonical_text


def require_columns(frame: DataFrame, required: Iterable[str], what: str) -> DataFrame:
    """Fail with the sorted list of missing columns; otherwise return the frame unchanged."""
    missing = sorted(set(required) - set(frame.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")
    return frame


def schema_profile(frame: DataFrame) -> DataFrame:
    """Name, type and nullability of every column. Parquet has no column defaults."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable, None)
        for i, f in enumerate(frame.schema.fields)
    ]
    return frame.sparkSession.createDataFrame(
        rows,
        "ordinal int, name string, type string, nullable boolean, column_default string",
    )


def null_profile(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL count per column from a single aggregate; columns without NULLs are left out."""
    names = list(columns or frame.columns)
    counts = frame.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in names])
    return counts.unpivot([], names, "column_name", "null_count").where("null_count > 0")


def fingerprint_parts(frame: DataFrame) -> list[Column]:
    """Two whole numbers of each row, from the MD5 of its ``canonical_text``."""
    row_hash = F.md5(canonical_text(sorted(frame.columns)))
    return [F.conv(F.substring(row_hash, at, 15), 16, 10).cast("bigint") for at in (1, 17)]


def fingerprint_figures(first: str, second: str) -> list[Column]:
    """Aggregates over the columns that hold the parts."""
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor(first).alias("xor_hash"),
        F.sum(F.pmod(F.col(second), F.lit(1_000_000_007))).alias("sum_hash"),
    ]


def content_fingerprint(frame: DataFrame) -> DataFrame:
    """Row count and an order-free checksum, equal for equal contents in any file layout.

    Rows are hashed as ``canonical_text``, so another engine can compute the same figures.
    """
    first, second = fingerprint_parts(frame)
    parts = frame.select(first.alias("first"), second.alias("second"))
    return parts.agg(*fingerprint_figures("first", "second"))
