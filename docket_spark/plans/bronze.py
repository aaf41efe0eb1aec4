"""Landing a raw snapshot with its population profile."""

from __future__ import annotations

import hashlib
from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docket_spark.constants import BRONZE_REQUIRED, POPULATION_END, POPULATION_START
from docket_spark.functions.dates import parse_date
from docket_spark.functions.text import blank_to_null
from docket_spark.operators.profiling import (
    content_fingerprint,
    fingerprint_figures,
    fingerprint_parts,
    require_columns,
)
from docket_spark.plans.publish import publish_generation, require_separate
from docket_spark.sources.complaints import ROW_ORDER, file_digests, read_snapshot

TABLE = "complaints"


def out_of_population(received: Column, start: str, end: str) -> Column:
    """True for a missing, unreadable or out-of-range date; both bounds are inside."""
    return (
        received.isNull()
        | (received < F.lit(start).cast("date"))
        | (received > F.lit(end).cast("date"))
    )


def population_facts() -> dict[str, Column]:
    """What a profile needs of each raw row."""
    return {
        "_narrated": blank_to_null(F.col("consumer_complaint_narrative")).isNotNull(),
        "_received": parse_date(blank_to_null(F.col("date_received"))),
    }


def population_figures(start: str, end: str) -> list[Column]:
    """Aggregates over the facts that need no shuffle."""
    outside = out_of_population(F.col("_received"), start, end)
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("_narrated").alias("narrative_count"),
        F.min("_received").alias("date_received_min"),
        F.max("_received").alias("date_received_max"),
        F.count_if(~outside).alias("date_received_in_range_count"),
        F.count_if(outside).alias("date_received_out_of_range_or_invalid_count"),
        F.count_if(~F.col("_narrated")).alias("blank_narrative_count"),
    ]


def distinct_ids(raw: DataFrame) -> DataFrame:
    """The number of different complaint ids as they are, untrimmed."""
    return raw.agg(F.countDistinct("complaint_id").alias("distinct_complaint_id_count"))


def population_profile(
    raw: DataFrame, start: str = POPULATION_START, end: str = POPULATION_END
) -> DataFrame:
    """Counts, date bounds and population violations of a snapshot in one aggregate.

    Complaint ids are counted as they are, untrimmed.
    """
    facts = [value.alias(name) for name, value in population_facts().items()]
    return raw.select("complaint_id", *facts).agg(
        *population_figures(start, end),
        F.countDistinct("complaint_id").alias("distinct_complaint_id_count"),
    )


def _criteria(start: str, end: str) -> dict[str, Any]:
    if date.fromisoformat(start) > date.fromisoformat(end):
        raise ValueError("population date_received criterion must have ordered ISO date bounds")
    return {
        "date_received": {"start": start, "end": end, "inclusive": True},
        "consumer_complaint_narrative": "non-empty",
    }


def utc_text(value: datetime | None) -> str | None:
    if value is None:
        return None
    aware = value if value.tzinfo else value.replace(tzinfo=UTC)
    return aware.astimezone(UTC).isoformat().replace("+00:00", "Z")


def counted(raw: DataFrame, start: str, end: str) -> tuple[DataFrame, Observation]:
    """``raw`` unchanged, and what a manifest says of it, counted by whatever writes it.

    Each row is counted where the write's last stage takes it, so a task that runs again adds nothing.
    """
    observation = Observation()
    first, second = fingerprint_parts(raw.drop(ROW_ORDER))
    facts = {**population_facts(), "_first": first, "_second": second}
    figures = [*population_figures(start, end), *fingerprint_figures("_first", "_second")[1:]]
    return raw.withColumns(facts).observe(observation, *figures).select(*raw.columns), observation


def manifest(
    raw: DataFrame,
    start: str = POPULATION_START,
    end: str = POPULATION_END,
    counts: dict[str, Any] | None = None,
    **provenance: Any,
) -> dict[str, Any]:
    """Manifest of a snapshot: provenance, schema, profile and checksum.

    ``counts`` are the figures of ``counted``; without them the rows are read for them.
    """
    criteria = _criteria(start, end)
    if counts is None:
        facts = population_profile(raw, start, end).first().asDict()
        facts |= content_fingerprint(raw.drop(ROW_ORDER)).first().asDict()
    else:
        facts = counts | distinct_ids(raw).first().asDict()
    columns = raw.drop(ROW_ORDER).schema.fields
    bounds = {
        name: facts[name].isoformat() if facts[name] else None
        for name in ("date_received_min", "date_received_max")
    }
    return {
        **provenance,
        "table": TABLE,
        "schema": [
            {
                "name": column.name,
                "type": column.dataType.simpleString(),
                "nullable": column.nullable,
                "default": None,
            }
            for column in columns
        ],
        "row_count": facts["row_count"],
        "distinct_complaint_id_count": facts["distinct_complaint_id_count"],
        "narrative_count": facts["narrative_count"],
        **bounds,
        "population_observed": {
            "date_received_in_range_count": facts["date_received_in_range_count"],
            "nonblank_narrative_count": facts["narrative_count"],
        },
        "population_violations": {
            name: facts[name]
            for name in ("date_received_out_of_range_or_invalid_count", "blank_narrative_count")
        },
        "content_fingerprint": f"{facts['xor_hash']}:{facts['sum_hash']}",
        "population_criteria": criteria,
    }


def combined_digest(files: DataFrame) -> str | None:
    """One file's digest, or a digest of the sorted digests joined in 256 prefix groups."""
    grouped = files.groupBy(F.substring("sha256", 1, 2).alias("prefix")).agg(
        F.array_sort(F.collect_list("sha256")).alias("digests")
    )
    rows = grouped.select(
        "prefix",
        F.size("digests").alias("n"),
        F.when(F.size("digests") == 1, F.col("digests")[0])
        .otherwise(F.sha2(F.array_join("digests", ","), 256))
        .alias("digest"),
    ).collect()
    if not rows:
        return None
    if len(rows) == 1:
        return rows[0]["digest"]
    joined = ",".join(row["digest"] for row in sorted(rows, key=lambda row: row["prefix"]))
    return hashlib.sha256(joined.encode()).hexdigest()


def create_bronze(
    spark: SparkSession,
    source_path: str,
    root: str,
    *,
    fmt: str = "parquet",
    start: str = POPULATION_START,
    end: str = POPULATION_END,
    allow_population_violations: bool = False,
    source_url: str | None = None,
    acquisition_method: str | None = "snapshot",
    source_version: str | None = None,
    snapshot_at: datetime | None = None,
    **options: str,
) -> dict[str, Any]:
    """Land a snapshot verbatim, with its row order, and publish it with its manifest.

    The profile is counted while the rows are written; only their ids are read again. Rows outside
    the declared population abort the landing unless they are explicitly allowed.
    """
    require_separate(spark, source_path, root)
    _criteria(start, end)
    raw = require_columns(read_snapshot(spark, source_path, fmt, **options), BRONZE_REQUIRED, TABLE)

    rows, observation = counted(raw, start, end)

    def report(folder: str) -> dict[str, Any]:
        digest = combined_digest(file_digests(spark, source_path))
        landed = manifest(
            spark.read.parquet(f"{folder}/{TABLE}"),
            start,
            end,
            counts=dict(observation.get),
            source_path_configured=source_path,
            source_url=source_url,
            acquisition_method=acquisition_method,
            source_version=source_version,
            retrieval_snapshot_at=utc_text(snapshot_at),
            sha256=digest,
        )
        if any(landed["population_violations"].values()) and not allow_population_violations:
            raise ValueError(
                "snapshot violates declared population criteria: "
                f"{landed['population_violations']}"
            )
        return landed

    return publish_generation(
        spark, root, lambda folder: rows.write.parquet(f"{folder}/{TABLE}"), report
    )
