"""Canonical complaints: clean text, typed dates and flags, one row per complaint id."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from docket_spark.constants import COMPANY_REGISTRY, SOURCE_COLUMNS
from docket_spark.functions.dates import parse_date
from docket_spark.functions.text import (
    blank_to_null,
    company_key,
    packed_texts,
    unpacked_texts,
    yes_no,
)
from docket_spark.operators.profiling import require_columns
from docket_spark.operators.ranking import first_rows
from docket_spark.plans.companies import brand_of, registry_entries
from docket_spark.plans.parts import read_current
from docket_spark.plans.publish import publish_generation, require_separate
from docket_spark.sources.complaints import ROW_ORDER

TABLE = "complaints"
SUPERSEDED = "superseded"
DIGEST = "_digest"
DATE_COLUMNS = ("date_received", "date_sent_to_company")
SILVER_COLUMNS = (
    "complaint_id",
    "date_received",
    "product",
    "sub_product",
    "issue",
    "sub_issue",
    "consumer_complaint_narrative",
    "company_public_response",
    "company",
    "company_key",
    "brand_name",
    "state",
    "zip_code",
    "tags",
    "submitted_via",
    "date_sent_to_company",
    "company_response_to_consumer",
    "timely_response",
)


def clean(raw: DataFrame) -> DataFrame:
    """All source columns trimmed, blanks as NULL; the row order is kept."""
    require_columns(raw, SOURCE_COLUMNS, "raw complaints")
    extra = [name for name in (ROW_ORDER,) if name in raw.columns]
    return raw.select(*[blank_to_null(F.col(name)).alias(name) for name in SOURCE_COLUMNS], *extra)


def is_invalid(timely: Column | None = None) -> Column:
    """A cleaned row no canonical record can be made of."""
    flag = F.col("timely_response")
    unreadable = [F.col(name).isNotNull() & parse_date(F.col(name)).isNull() for name in DATE_COLUMNS]
    return (
        unreadable[0]
        | unreadable[1]
        | (flag.isNotNull() & yes_no(flag).isNull())
        | F.col("complaint_id").isNull()
    )


def count_invalid(cleaned: DataFrame) -> DataFrame:
    """Invalid rows, duplicates included."""
    return cleaned.agg(F.count_if(is_invalid()).alias("invalid_rows"))


def canonical(cleaned: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """The first row of every trimmed complaint id in source order."""
    return first_rows(cleaned, ["complaint_id"], order or [F.col(ROW_ORDER).asc()])


def superseded(cleaned: DataFrame, *facts: Column) -> DataFrame:
    """Rows that lose to an earlier row of the same complaint id, with the row that is kept.

    Needs a unique row order and no NULL ids. Only ids and positions are shuffled, and counts are
    combined before that, so neither wide rows nor a very frequent id weigh on the exchange.
    ``facts`` are further columns to take from the rows that lose.
    """
    narrow = cleaned.select("complaint_id", ROW_ORDER, *facts)
    repeated = (
        narrow.groupBy("complaint_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(ROW_ORDER).alias("kept_row"))
        .where(F.col("_n") > 1)
    )
    return (
        narrow.join(repeated, "complaint_id")
        .where(F.col(ROW_ORDER) > F.col("kept_row"))
        .select(*narrow.columns, "kept_row")
    )


def kept_rows(cleaned: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """``cleaned`` without the rows in ``lost``, by default those that ``superseded`` finds.

    Without a list that was written before, the rows that win are told where rows of an id meet: one scan and
    one exchange, which moves their texts as one, and before which an id is cut to its first rows in every
    partition. As there, rows without an id or a place are kept, and so are rows that share the first place.
    """
    if lost is not None:
        return cleaned.join(lost.select(ROW_ORDER), ROW_ORDER, "left_anti").select(*cleaned.columns)
    unplaced = F.col("complaint_id").isNull() | F.col(ROW_ORDER).isNull()

    def firsts(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_alone", F.when(unplaced, F.monotonically_increasing_id()))
        first = F.rank().over(Window.partitionBy("complaint_id", "_alone").orderBy(ROW_ORDER))
        return rows.withColumn("_rank", first).where(F.col("_rank") == 1)

    return texts_as_one(cleaned, firsts)


def texts_as_one(rows: DataFrame, meet: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``meet`` keeps of rows whose texts, but for the id, are one column meanwhile.

    All columns are moved, also those that are not used later.
    """
    texts = [name for name, kind in rows.dtypes if kind == "string" and name != "complaint_id"]
    if len(texts) < 2:
        return meet(rows).select(*rows.columns)
    others = [name for name in rows.columns if name not in texts]
    met = meet(rows.select(*others, *packed_texts(texts, "_texts", "_lengths")))
    return met.select(*others, *unpacked_texts(texts, "_texts", "_lengths")).select(*rows.columns)


def readable(cleaned: DataFrame) -> DataFrame:
    """Cleaned rows with dates and flags instead of their texts, which are longer."""
    read = {name: parse_date(F.col(name)) for name in DATE_COLUMNS}
    return cleaned.withColumns({**read, "timely_response": yes_no(F.col("timely_response"))})


def typed(rows: DataFrame, registry=COMPANY_REGISTRY) -> DataFrame:
    """Typed silver columns of cleaned rows."""
    return with_companies(readable(rows), registry)


def with_companies(
    rows: DataFrame,
    registry=COMPANY_REGISTRY,
    keep: Sequence[str] = (),
    columns: Sequence[str] = SILVER_COLUMNS,
) -> DataFrame:
    """Silver columns of readable rows, and those to keep."""
    key = company_key(F.col("company"))
    derived = {
        "company_key": key,
        "brand_name": brand_of(key, registry),
    }
    return rows.select(*[derived.get(name, F.col(name)).alias(name) for name in (*columns, *keep)])


def silver_table(
    raw: DataFrame,
    order: Sequence[Column] | None = None,
    registry=COMPANY_REGISTRY,
    columns: Sequence[str] | None = None,
    digest: bool = False,
) -> DataFrame:
    """Silver of raw rows; of those that go by the row order, ``columns`` only and a ``DIGEST`` of all columns.

    A row is digested before it meets the others of its id, so that no column is moved for its digest only.
    """
    if columns:
        if order:
            raise ValueError("columns are named for rows that go by the row order")
        rows = with_companies(readable(clean(raw)), registry, keep=(ROW_ORDER,))
        told = [F.xxhash64(*SILVER_COLUMNS).alias(DIGEST)] if digest else []
        return texts_as_one(rows.select(*columns, *told, ROW_ORDER), canonical).drop(ROW_ORDER)
    if order:  # it may go by texts that are not readable as dates or flags
        return typed(canonical(clean(raw), order), registry)
    # Rows are brought together by id once they are as short as they get.
    return with_companies(canonical(readable(clean(raw))), registry)


def brands_of(registry=COMPANY_REGISTRY) -> list[str]:
    return sorted({brand for _, brand, _ in registry_entries(registry).values() if brand})


def quality_figures(registry=COMPANY_REGISTRY) -> list[Column]:
    """Aggregates over silver rows that need no shuffle; brands are those of the registry."""
    return [
        F.count(F.lit(1)).alias("silver_rows"),
        *[F.count_if(F.col(name).isNull()).alias(f"null {name}") for name in SILVER_COLUMNS],
        *[F.count_if(F.col("brand_name") == name).alias(f"brand {name}") for name in brands_of(registry)],
    ]


def quality_report(figures: Mapping[str, int], skipped: int, invalid: int) -> dict[str, Any]:
    """Report from the figures of the rows kept and the number of duplicates skipped."""
    nulls = {name: figures[f"null {name}"] for name in SILVER_COLUMNS}
    brands = {name: figures[f"brand {name}"] for name in brands_of()}
    return {
        "source_rows": figures["silver_rows"] + skipped,
        "silver_rows": figures["silver_rows"],
        "duplicate_rows_skipped": skipped,
        "duplicate_policy": "first row in source order wins after trimming the complaint id",
        "invalid_rows": invalid,
        "null_counts": {name: many for name, many in nulls.items() if many},
        "brand_alias_counts": {name: many for name, many in brands.items() if many},
    }


def brand_counts(silver: DataFrame) -> DataFrame:
    return (
        silver.where(F.col("brand_name").isNotNull())
        .groupBy("brand_name")
        .agg(F.count(F.lit(1)).alias("complaint_count"))
    )


def duplicate_accounting(raw: DataFrame, silver: DataFrame) -> DataFrame:
    """Source rows, kept rows and the difference, in one row."""
    kept = silver.agg(F.count(F.lit(1))).scalar()
    return raw.agg(F.count(F.lit(1)).alias("source_rows")).select(
        "source_rows",
        kept.alias("silver_rows"),
        (F.col("source_rows") - kept).alias("duplicate_rows_skipped"),
    )


def rebuild_silver(spark: SparkSession, bronze_root: str, root: str) -> dict[str, Any]:
    """Build silver from the current bronze generation and publish it with its quality report.

    Any invalid row, duplicate or not, aborts the build and leaves the previous silver current. Ids
    and positions are read twice and whole rows once: the losing rows are written first, and what is
    said of the rows kept is counted while they are written. That write's last stage counts them, so
    a task that runs again adds nothing.
    """
    require_separate(spark, bronze_root, root)
    cleaned = clean(read_current(spark, bronze_root, TABLE))
    valid, quality = Observation(), Observation()

    def write(folder: str) -> None:
        # The real size of the losing rows decides how they are joined, and when they are few the
        # wide rows are filtered where they lie.
        superseded(cleaned, is_invalid().alias("invalid")).write.parquet(f"{folder}/{SUPERSEDED}")
        lost = spark.read.parquet(f"{folder}/{SUPERSEDED}")
        kept = kept_rows(cleaned, lost).observe(valid, F.count_if(is_invalid()).alias("invalid_rows"))
        typed(kept).observe(quality, *quality_figures()).write.parquet(f"{folder}/{TABLE}")

    def report(folder: str) -> dict[str, Any]:
        lost = spark.read.parquet(f"{folder}/{SUPERSEDED}")
        skipped, invalid = lost.agg(F.count(F.lit(1)), F.count_if("invalid")).first()
        invalid += valid.get["invalid_rows"]
        if invalid:
            raise ValueError(f"source contains {invalid} invalid canonical records")
        return quality_report(quality.get, skipped, invalid)

    return publish_generation(spark, root, write, report)
