"""Monthly metric tables.

Counts are additive, so only three tables are computed from complaints, in one scan; the other four add
up the rows of the already aggregated company-product-state-issue table. Rates are recomputed from the
counts everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docket_spark.constants import GOLD_REQUIRED, METRIC_TABLES, MONTH
from docket_spark.functions.dates import month_of
from docket_spark.functions.metrics import COUNTS, complaint_measures, summed_measures, timely_rate
from docket_spark.operators.profiling import require_columns
from docket_spark.plans.bronze import utc_text
from docket_spark.plans.parts import generation_of, read_current, read_table
from docket_spark.plans.publish import (
    current_folder,
    publish_generation,
    require_separate,
)
from docket_spark.session import cut_lineage

DETAIL = "company_product_state_issue_month_metrics"
SILVER_TABLE = "complaints"


def needed_columns(tables: Iterable[str]) -> list[str]:
    """Silver columns that metric tables are made of, and the id."""
    dimensions = [name for table in tables for name in METRIC_TABLES[table] if name != MONTH]
    return list(dict.fromkeys(("complaint_id", "date_received", "timely_response", *dimensions)))


def dated(silver: DataFrame, needed: Sequence[str] = GOLD_REQUIRED) -> DataFrame:
    """Rows with a received date, and their month."""
    require_columns(silver, needed, "silver complaints")
    return silver.where(F.col("date_received").isNotNull()).withColumn(
        MONTH, month_of(F.col("date_received"))
    )


def derives_from_detail(table: str) -> bool:
    return table != DETAIL and set(METRIC_TABLES[table]) <= set(METRIC_TABLES[DETAIL])


def metrics_from_complaints(silver: DataFrame, table: str) -> DataFrame:
    dimensions = METRIC_TABLES[table]
    return (
        dated(silver, needed_columns([table]))
        .groupBy(*dimensions)
        .agg(*complaint_measures(F.col("timely_response")))
        .withColumn("timely_response_rate", timely_rate())
    )


def metrics_from_detail(detail: DataFrame, table: str) -> DataFrame:
    return (
        detail.groupBy(*METRIC_TABLES[table])
        .agg(*summed_measures())
        .withColumn("timely_response_rate", timely_rate())
    )


def metric_tables(silver: DataFrame) -> dict[str, DataFrame]:
    """All seven tables, each lazily from complaints."""
    return {name: metrics_from_complaints(silver, name) for name in METRIC_TABLES}


def _every() -> list[str]:
    """All dimension columns of the metric tables."""
    return list(dict.fromkeys(name for dims in METRIC_TABLES.values() for name in dims))


def base_metrics(
    silver: DataFrame, tables: Iterable[str] = METRIC_TABLES, total: str | None = None
) -> DataFrame:
    """The tables that the named ones are or add up, from one scan, tagged with their names.

    Grouping ids tell a grouped-out dimension from a NULL label. ``total`` names one more row, which counts
    all dated complaints.
    """
    sources = {DETAIL if derives_from_detail(name) else name for name in tables}
    base = {name: dims for name, dims in METRIC_TABLES.items() if name in sources}
    base |= {total: ()} if total else {}
    columns = list(dict.fromkeys(name for dims in base.values() for name in dims))
    width = len(columns)
    grouped = (
        dated(silver, needed_columns(sources))
        .groupingSets([[F.col(c) for c in dims] for dims in base.values()], *[F.col(c) for c in columns])
        .agg(F.grouping_id().cast("bigint").alias("_set"), *complaint_measures(F.col("timely_response")))
    )
    outside = {
        name: sum(1 << (width - 1 - i) for i, c in enumerate(columns) if c not in dims)
        for name, dims in base.items()
    }
    names = F.coalesce(*[F.when(F.col("_set") == bits, F.lit(name)) for name, bits in outside.items()])
    return grouped.withColumn("table_name", names).drop("_set")


def from_base(base: DataFrame, table: str) -> DataFrame:
    """One metric table from the rows of ``base_metrics``."""
    if derives_from_detail(table):
        return metrics_from_detail(base.where(F.col("table_name") == DETAIL), table)
    rows = base.where(F.col("table_name") == table).withColumn("timely_response_rate", timely_rate())
    return rows.select(*METRIC_TABLES[table], *COUNTS, "timely_response_rate")


def all_metrics(silver: DataFrame, total: str | None = None) -> DataFrame:
    """Every metric table from one scan, tagged with its table name.

    Complaints are expanded by the base tables only; the detail table's aggregated rows are dealt out to
    the tables that add them up. ``total`` names one more row, the number of all dated complaints.
    """
    derived = [name for name in METRIC_TABLES if derives_from_detail(name)]
    base = base_metrics(silver, total=total)
    targets = F.when(
        F.col("table_name") == DETAIL, F.array(*[F.lit(name) for name in (DETAIL, *derived)])
    ).otherwise(F.array("table_name"))
    dealt = base.withColumn("table_name", F.explode(targets))
    keys = []
    for name in _every():
        holders = [t for t, dims in METRIC_TABLES.items() if name in dims]
        keys.append(F.when(F.col("table_name").isin(holders), F.col(name)).alias(name))
    return (
        dealt.select("table_name", *keys, *COUNTS)
        .groupBy("table_name", *_every())
        .agg(*summed_measures())
    )


def reconciliation(silver: DataFrame) -> DataFrame:
    """Complaint total of every metric table against the dated rows, which the same scan counts."""
    counted = "dated rows"
    totals = (
        all_metrics(silver, total=counted)
        .groupBy("table_name")
        .agg(F.sum("complaint_count").alias("metric_total"))
    )
    # One row a table: eight.
    dated_rows = F.max(F.when(F.col("table_name") == counted, F.col("metric_total"))).over(Window.partitionBy())
    return totals.withColumn("matches_dated_silver_rows", F.col("metric_total") == dated_rows).where(
        F.col("table_name") != counted
    )


def written_totals(tables: dict[str, DataFrame]) -> dict[str, int]:
    totals = None
    for name, frame in tables.items():
        part = frame.agg(F.coalesce(F.sum("complaint_count"), F.lit(0)).alias("total")).select(
            F.lit(name).alias("table_name"), "total"
        )
        totals = part if totals is None else totals.unionByName(part)
    return {row["table_name"]: row["total"] for row in totals.collect()}


def write_metric_table(frame: DataFrame, path: str) -> None:
    # Months lie together inside every file, so a month range skips row groups by their
    # statistics; a folder per month would only add small files to tables this size.
    frame.sortWithinPartitions(MONTH).write.parquet(path)


def write_metric_tables(silver: DataFrame, folder: str) -> None:
    """One scan of complaints for the base tables; all seven are then written from its rows at once."""
    base = cut_lineage(base_metrics(silver))

    def write(name: str) -> None:
        write_metric_table(from_base(base, name), f"{folder}/{name}")

    with ThreadPoolExecutor(len(METRIC_TABLES)) as pool:
        list(pool.map(inheritable_thread_target(silver.sparkSession)(write), METRIC_TABLES))


def read_metric_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name)


def read_metric_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_metric_table(spark, folder, name) for name in METRIC_TABLES}


def rebuild_gold(spark: SparkSession, silver_root: str, root: str) -> dict[str, Any]:
    """Build the seven tables from current silver; publish only when each one reconciles."""
    require_separate(spark, silver_root, root)
    source = generation_of(current_folder(spark, silver_root))
    silver = read_current(spark, silver_root, SILVER_TABLE)
    require_columns(silver, GOLD_REQUIRED, "silver complaints")
    counts = silver.agg(
        F.count(F.lit(1)).alias("silver_rows"), F.count("date_received").alias("dated_rows")
    ).first()

    def report(folder: str) -> dict[str, Any]:
        totals = written_totals(read_metric_tables(spark, folder))
        wrong = [name for name in METRIC_TABLES if totals[name] != counts["dated_rows"]]
        if wrong:
            raise RuntimeError(f"reconciliation failed for {', '.join(wrong)}")
        return {
            "built_at": utc_text(datetime.now(UTC)),
            "source": silver_root,
            "source_generation": source,
            "silver_rows": counts["silver_rows"],
            "dated_silver_rows": counts["dated_rows"],
            "tables": list(METRIC_TABLES),
            "reconciliation": {
                name: {"metric_total": total, "matches_dated_silver_rows": True}
                for name, total in totals.items()
            },
        }

    return publish_generation(
        spark, root, lambda folder: write_metric_tables(silver, folder), report
    )
