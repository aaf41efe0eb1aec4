"""Incremental refresh: new snapshots merged by complaint id, everything behind them brought up to date.

Silver lies in id buckets, the metric tables in months, the narrative index in segments. A refresh reads
and writes the buckets its complaints fall into, recomputes the months whose complaints differ,
and embeds the narratives that are new or altered. Each table's report names the silver generation it was
made from, so a refresh that died half way is made up for by the next one.

The stream form reads arriving snapshot folders with a file source, processes everything available
and stops. Its merge is the batch merge, so replaying a batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docket_spark.constants import COMPANY_REGISTRY, EMBED_BATCH, METRIC_TABLES, MONTH
from docket_spark.functions.dates import add_months
from docket_spark.functions.embedding import Embedder, with_embedding
from docket_spark.functions.metrics import ratio
from docket_spark.functions.text import is_nonblank
from docket_spark.operators.profiling import null_profile
from docket_spark.operators.ranking import first_rows
from docket_spark.plans.bronze import utc_text
from docket_spark.plans.companies import registry_entries
from docket_spark.plans.gold import (
    base_metrics,
    dated,
    from_base,
    metrics_from_complaints,
    needed_columns,
)
from docket_spark.plans.index_segments import (
    GONE,
    LONGEST,
    SEGMENTS,
    compare,
    read_index,
    read_rows,
    segments_of,
    write_rows,
)
from docket_spark.plans.parts import (
    LISTED,
    PART,
    Parts,
    PartTable,
    changed_parts,
    current_parts,
    folder_of,
    generation_of,
    parts_of,
    publish_parts,
    read_parts,
    read_table,
    report_of,
    total,
)
from docket_spark.plans.publish import (
    current_folder,
    has_current,
    publish_generation,
    require_separate,
)
from docket_spark.plans.retrieval import eligible, index_rows
from docket_spark.plans.silver import (
    DIGEST,
    SILVER_COLUMNS,
    TABLE,
    clean,
    is_invalid,
    readable,
    silver_table,
    with_companies,
)
from docket_spark.session import cut_lineage
from docket_spark.sources.complaints import ROW_ORDER, SNAPSHOT_SCHEMA

BUCKETS = 64
# A bucket is brought together in so many pieces, each in one task, and written as at most so many files.
PIECES = 16


class DriftRefused(RuntimeError):
    """A generation whose profile moved too far from its predecessor's."""


def canonical_arrivals(arriving: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed rows of an arriving snapshot, one per complaint id; of named columns, with a digest of all."""
    return silver_table(arriving, columns=columns, digest=columns is not None)


def merge(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Canonical rows after a refresh: the newest generation of a complaint wins.

    ``existing`` and ``fresh`` are silver rows, each with one row per id. The existing side only
    loses the ids that arrived again, so when those are few it is filtered where it lies and never
    shuffled. Only silver columns that ``existing`` has are taken.
    """
    columns = _silver_columns(existing)
    kept = existing.join(fresh.select("complaint_id"), "complaint_id", "left_anti")
    return kept.select(*columns).unionByName(fresh.select(*columns))


def _digest(frame: DataFrame, side: str) -> DataFrame:
    """Ids, months and digests of all columns, which rows that have fewer columns carry."""
    digest = F.col(DIGEST) if DIGEST in frame.columns else F.xxhash64(*SILVER_COLUMNS)
    return frame.select(
        "complaint_id",
        F.trunc("date_received", "MM").alias(f"{side}_month"),
        digest.alias(f"{side}_hash"),
    )


def _differing(pairs: DataFrame) -> DataFrame:
    return pairs.where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select(
        "complaint_id", "old_month", "new_month"
    )


def changed_complaints(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids that were added, removed or altered between two silver tables, with the months they
    belonged and belong to."""
    return _differing(_digest(old, "old").join(_digest(new, "new"), "complaint_id", "full"))


def changes_from_arrivals(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """The same for a merge, where only arriving ids can change.

    The old table is first reduced to those ids, so it is not shuffled when they are few.
    """
    before = old.join(fresh.select("complaint_id"), "complaint_id", "left_semi")
    return _differing(_digest(fresh, "new").join(_digest(before, "old"), "complaint_id", "left"))


def affected_months(changes: DataFrame) -> DataFrame:
    """Months whose metrics can differ, from both the old and the new version of a complaint."""
    return (
        changes.select(F.explode(F.array("old_month", "new_month")).alias(MONTH))
        .where(F.col(MONTH).isNotNull())
        .distinct()
    )


def refreshed_metrics(
    old_table: DataFrame, new_silver: DataFrame, months: DataFrame, table: str
) -> DataFrame:
    """A metric table after refresh: affected months recomputed, all others as they were."""
    touched = dated(new_silver, needed_columns([table])).join(months, MONTH, "left_semi")
    return old_table.join(months, MONTH, "left_anti").unionByName(
        metrics_from_complaints(touched, table)
    )


def month_ranges(months: Iterable[date]) -> list[tuple[date, date]]:
    """Half-open day ranges that cover the months, neighbouring months joined."""
    ranges: list[tuple[date, date]] = []
    for month in sorted(months):
        end = add_months(month, 1)
        if ranges and ranges[-1][1] == month:
            ranges[-1] = (ranges[-1][0], end)
        else:
            ranges.append((month, end))
    return ranges


def in_months(months: Iterable[date], day: str = "date_received") -> Column:
    """Literal day ranges, which reach the scan."""
    inside = F.lit(False)
    for start, end in month_ranges(months):
        inside = inside | ((F.col(day) >= F.lit(start)) & (F.col(day) < F.lit(end)))
    return inside


def buckets_since(spark: SparkSession, silver_root: str, source: str | None) -> frozenset[str] | None:
    """Buckets that current silver does not share with the generation ``source``, None if not in buckets."""
    new = current_parts(spark, silver_root, TABLE)[1]
    old = parts_of(spark, folder_of(silver_root, source), TABLE) if source else None
    return None if new is None or old is None else frozenset(changed_parts(old, new))


def month_digests(silver: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows every month has, and two digests of these columns of them, whatever their order.

    An id is in one row only, so equal rows do not cancel out. A hash passes over NULLs, so which columns
    are NULL is hashed too.
    """
    told = [*[F.col(name) for name in columns], *[F.col(name).isNull() for name in columns]]
    digests = (F.bit_xor(F.xxhash64(*salt, *told)) for salt in ((), (F.lit("second"),)))
    return dated(silver, columns).groupBy(MONTH).agg(F.array(F.count(F.lit(1)), *digests).alias("digest"))


def months_since(
    spark: SparkSession, silver_root: str, source: str | None, tables: Iterable[str] = METRIC_TABLES
) -> list[date] | None:
    """Months whose metrics can differ between two silver generations, None if that cannot be told.

    Only buckets that the generations do not share are read, and digests of their months compared, so that
    no complaint is moved.
    """
    touched = buckets_since(spark, silver_root, source)
    if touched is None:
        return None
    old, new = (
        month_digests(read_parts(spark, folder, TABLE, touched), needed_columns(tables))
        for folder in (folder_of(silver_root, source), current_folder(spark, silver_root))
    )
    pairs = old.withColumnRenamed("digest", "before").join(new, MONTH, "full")
    # One row a month: a few hundred at most.
    return sorted(row[MONTH] for row in pairs.where(~F.col("before").eqNullSafe(F.col("digest"))).collect())


def refresh_gold(
    spark: SparkSession, silver_root: str, root: str, only: Iterable[str] | None = None
) -> dict[str, Any]:
    """Publish gold for current silver, recomputing the months that differ from those gold was made of.

    The base tables come from one scan of these months' complaints, the others add up the refreshed
    detail rows. All months are computed for the first gold in months, and where the difference between
    two silver generations cannot be told. Gold in months keeps the tables it has: all, or those that its
    first refresh named as ``only``.
    """
    require_separate(spark, silver_root, root)
    folder = current_folder(spark, silver_root)
    base = current_folder(spark, root) if has_current(spark, root) else None
    before = report_of(spark, base) if base else {}
    held = before.get(LISTED)
    wanted = set(only or held or METRIC_TABLES)
    if unknown := wanted - set(METRIC_TABLES):
        raise ValueError(f"no metric tables: {', '.join(sorted(unknown))}")
    if held is not None and wanted != set(held):
        raise ValueError(f"gold holds other tables: {', '.join(sorted(held))}")
    names = [name for name in METRIC_TABLES if name in wanted]
    months = None
    if held is not None:
        months = months_since(spark, silver_root, before.get("source_generation"), names)
    silver = read_table(spark, folder, TABLE)
    rows = silver if months is None else silver.where(in_months(months))
    if len(names) == 1:
        metrics = {name: metrics_from_complaints(rows, name) for name in names}
    else:
        shared = cut_lineage(base_metrics(rows, names))
        metrics = {name: from_base(shared, name) for name in names}
    replaced = None if months is None else frozenset(str(month) for month in months)
    figures = {"complaints": F.sum("complaint_count")}
    tables = {name: PartTable(metrics[name], F.col(MONTH), replaced, figures) for name in names}
    listed = parts_of(spark, folder, TABLE)
    if listed is None:
        dated_rows = silver.where(F.col("date_received").isNotNull()).count()
    else:
        dated_rows = total(listed) - total(listed, "null:date_received")

    def report(parts: Parts) -> dict[str, Any]:
        wrong = sorted(name for name in tables if total(parts[name], "complaints") != dated_rows)
        if wrong:
            raise RuntimeError(f"totals differ from {dated_rows} dated complaints in {', '.join(wrong)}")
        return {
            "built_at": utc_text(datetime.now(UTC)),
            "source": silver_root,
            "source_generation": generation_of(folder),
            "dated_silver_rows": dated_rows,
            "tables": names,
            "refreshed_months": None if months is None else [str(month) for month in months],
        }

    return publish_parts(spark, root, tables, report, base=base)


def stale_narratives(silver: DataFrame, index: DataFrame) -> DataFrame:
    """Eligible narratives that are new or whose text changed since the index was built.

    ``silver`` and ``index`` both carry ``complaint_id`` and the narrative text hash.
    """
    return silver.join(index, ["complaint_id", "narrative_hash"], "left_anti")


def narrative_hashes(silver: DataFrame) -> DataFrame:
    return eligible(silver).select(
        "complaint_id", F.sha2("consumer_complaint_narrative", 256).alias("narrative_hash")
    )


def refresh_index(
    spark: SparkSession, silver_root: str, root: str, embedder: Embedder, batch: int = EMBED_BATCH
) -> dict[str, Any]:
    """Publish the narrative index of current silver as one more segment.

    Ids and hashes of the buckets that changed are compared; new and altered narratives are embedded,
    and rows that no longer count are named. All other rows stay as and where they are.
    """
    require_separate(spark, silver_root, root)
    base, source = current_folder(spark, root), current_folder(spark, silver_root)
    before = report_of(spark, base)
    held = read_index(spark, base)
    touched = buckets_since(spark, silver_root, before.get("source_generation"))
    if touched is None:
        wanted = index_rows(read_table(spark, source, TABLE))
        expected, theirs = wanted.count(), held
    else:
        wanted = index_rows(read_parts(spark, source, TABLE, touched))
        expected = total(parts_of(spark, source, TABLE), "eligible")
        buckets = report_of(spark, source)["buckets"]
        theirs = held.where(bucket_of(buckets).cast("string").isin(sorted(touched)))
    stale, gone = (cut_lineage(ids) for ids in compare(wanted, theirs))
    embedded_rows, removed_rows = stale.count(), gone.count()
    indexed = before["documents_indexed"] - removed_rows + embedded_rows
    segments = segments_of(spark, base) or [generation_of(base)]
    whole = len(segments) >= LONGEST
    written = expected if whole else embedded_rows

    def write(folder: str) -> None:
        rows = with_embedding(wanted.join(stale, "complaint_id", "left_semi"), "document", embedder, batch)
        if whole:
            rows = held.join(gone, "complaint_id", "left_anti").unionByName(rows)
        if written:
            write_rows(rows.select(*held.columns), folder)
        (gone.limit(0) if whole else gone).write.parquet(f"{folder}/{GONE}")

    def report(folder: str) -> dict[str, Any]:
        found = read_rows(spark, folder).select("complaint_id").distinct().count() if written else 0
        if (found, indexed) != (written, expected):
            raise RuntimeError(f"{found} rows written for {written}, {indexed} would count for {expected}")
        kept = {name: value for name, value in before.items() if name != SEGMENTS}
        own = generation_of(folder)
        return {
            **kept,
            "source": silver_root,
            "source_generation": generation_of(source),
            "built_at_utc": utc_text(datetime.now(UTC)),
            "documents_indexed": indexed,
            "collection_count": indexed,
            "eligible_silver_narratives": expected,
            "reconciles_to_eligible_silver": True,
            "segment_rows": written,
            "embedded_rows": embedded_rows,
            "removed_rows": removed_rows,
            SEGMENTS: [own] if whole else [*segments, own],
        }

    return publish_generation(spark, root, write, report, base=base)


def table_profile(frame: DataFrame) -> DataFrame:
    """Row count and NULL count of every column as (metric, column_name, value)."""
    rows = frame.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("row_count").alias("metric"), F.lit("*").alias("column_name"), "value"
    )
    present = frame.sparkSession.createDataFrame(
        [("column", name, 1) for name in frame.columns],
        "metric string, column_name string, value bigint",
    )
    nulls = null_profile(frame).select(
        F.lit("null_count").alias("metric"), "column_name", F.col("null_count").alias("value")
    )
    return rows.unionByName(nulls).unionByName(present)


def drift(old_profile: DataFrame, new_profile: DataFrame, tolerance: float) -> DataFrame:
    """Profile differences between generations; ``breached`` marks those beyond the tolerance.

    A column on one side only is schema drift and always a breach.
    """
    joined = old_profile.withColumnRenamed("value", "old_value").join(
        new_profile.withColumnRenamed("value", "new_value"), ["metric", "column_name"], "full"
    )
    counted = F.col("metric") != "column"
    old = F.when(counted, F.coalesce("old_value", F.lit(0))).otherwise(F.col("old_value"))
    new = F.when(counted, F.coalesce("new_value", F.lit(0))).otherwise(F.col("new_value"))
    change = ratio(new - old, old)
    schema_drift = ~counted & (old.isNull() | new.isNull())
    jumped = counted & F.when(old == 0, new > 0).otherwise(F.abs(change) > tolerance)
    return joined.select(
        "metric",
        "column_name",
        old.alias("old_value"),
        new.alias("new_value"),
        change.alias("relative_change"),
        F.coalesce(schema_drift | jumped, F.lit(False)).alias("breached"),
    )


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("complaint_id"), F.lit(buckets))


def in_buckets(existing: DataFrame, cleaned: DataFrame, buckets: int) -> DataFrame:
    """Silver rows after a batch, dealt to their buckets: the rows of ``merge`` from one exchange.

    ``existing`` are silver rows, ``cleaned`` the arriving ones. Both go to the pieces of their buckets once,
    where the first arriving row of an id comes before the one that is there. Only columns that ``existing``
    has are made and moved.
    """
    columns = _silver_columns(existing)
    names = [name for name in columns if name not in ("company_key", "brand_name")]
    place = cleaned.schema[ROW_ORDER].dataType
    held = existing.select(F.lit(1).alias("_age"), F.lit(None).cast(place).alias(ROW_ORDER), *names)
    fresh = readable(cleaned).select(F.lit(0).alias("_age"), ROW_ORDER, *names)
    # Bucket and piece follow from the id, so they are not moved with the rows.
    bucket = bucket_of(buckets).cast("string")
    by_piece = (bucket, F.pmod(F.xxhash64("complaint_id", F.lit("piece")), F.lit(PIECES)))
    pieces = held.unionByName(fresh).repartition(*by_piece)
    # Sorted by id first: the start of an id tells rows apart, that of a bucket hardly any.
    newest = first_rows(pieces, ["complaint_id", *by_piece], [F.col("_age").asc(), F.col(ROW_ORDER).asc()])
    return with_companies(newest.withColumn(PART, bucket), keep=(PART,), columns=columns)


def _silver_columns(rows: DataFrame) -> list[str]:
    return [name for name in SILVER_COLUMNS if name in rows.columns]


def _brands() -> list[str]:
    return sorted({brand for _, brand, _ in registry_entries(COMPANY_REGISTRY).values()})


def silver_figures(columns: Sequence[str] = SILVER_COLUMNS) -> dict[str, Column]:
    """What the report keeps of every bucket: narratives to index, NULLs by column, complaints by brand."""
    figures = {f"null:{name}": F.count_if(F.col(name).isNull()) for name in columns}
    if "consumer_complaint_narrative" in columns:
        figures["eligible"] = F.count_if(is_nonblank(F.col("consumer_complaint_narrative")))
    if "brand_name" in columns:
        figures |= {f"brand:{b}": F.count_if(F.col("brand_name").eqNullSafe(F.lit(b))) for b in _brands()}
    return figures


def listed_profile(
    spark: SparkSession, parts: dict[str, dict[str, Any]], columns: Sequence[str] = SILVER_COLUMNS
) -> DataFrame:
    """``table_profile`` of a silver table, from the figures of its buckets."""
    rows = [("row_count", "*", total(parts))]
    for name in columns:
        rows.append(("column", name, 1))
        if nulls := total(parts, f"null:{name}"):
            rows.append(("null_count", name, nulls))
    return spark.createDataFrame(rows, "metric string, column_name string, value bigint")


def gate(old: DataFrame, new: DataFrame, tolerance: float) -> list[dict[str, Any]]:
    """All differences of two profiles; raises if one is beyond the tolerance."""
    found = [row.asDict() for row in drift(old, new, tolerance).orderBy("metric", "column_name").collect()]
    breached = [f"{x['metric']} of {x['column_name']}: {x['old_value']} to {x['new_value']}" for x in found if x["breached"]]
    if breached:
        raise DriftRefused(f"beyond a tolerance of {tolerance:g}: {'; '.join(breached)}")
    return found


def apply_batch(
    spark: SparkSession,
    silver_root: str,
    arriving: DataFrame,
    tolerance: float | None = None,
    buckets: int = BUCKETS,
) -> dict[str, Any]:
    """Merge one batch of raw rows into current silver and publish the result as a generation.

    Only the buckets of arriving ids are read and written; the first batch after a full build deals the
    whole table into buckets. With a ``tolerance`` the profiles of the new and the current table are
    compared after the write, and a breach leaves the current generation as it is.
    """
    base = current_folder(spark, silver_root)
    before = report_of(spark, base)
    listed = parts_of(spark, base, TABLE)
    buckets = before.get("buckets", buckets)
    checked, hit = _checked(arriving, buckets)
    if listed is None:
        touched, held = None, read_table(spark, base, TABLE)
        profile = table_profile(held.select(*SILVER_COLUMNS)) if tolerance is not None else None
    else:
        touched = hit
        held = read_parts(spark, base, TABLE, touched)
        profile = listed_profile(spark, listed, _silver_columns(held)) if tolerance is not None else None

    def report(parts: Parts) -> dict[str, Any]:
        new = parts[TABLE]
        moved = None
        if tolerance is not None:
            moved = gate(profile, listed_profile(spark, new, _silver_columns(held)), tolerance)
        return {
            "silver_rows": total(new),
            "arrived_rows": checked["rows"],
            "invalid_rows": checked["invalid"],
            "null_counts": {n: c for n in SILVER_COLUMNS if (c := total(new, f"null:{n}"))},
            "brand_alias_counts": {b: c for b in _brands() if (c := total(new, f"brand:{b}"))},
            "buckets": buckets,
            "buckets_written": None if touched is None else sorted(touched, key=int),
            "previous_generation": generation_of(base),
            "drift": moved,
        }

    table = _bucket_table(held, clean(arriving), buckets, touched)
    return publish_parts(spark, silver_root, {TABLE: table}, report, base=base)


def _checked(arriving: DataFrame, buckets: int) -> tuple[dict[str, int], frozenset[str]]:
    """Counts of raw rows and the buckets they fall into, one row a bucket; invalid rows are refused."""
    invalid = F.count_if(is_invalid()).alias("invalid")
    by_bucket = clean(arriving).groupBy(bucket_of(buckets).cast("string").alias("bucket"))
    found = by_bucket.agg(F.count(F.lit(1)).alias("rows"), invalid).collect()
    checked = {name: sum(row[name] for row in found) for name in ("rows", "invalid")}
    if checked["invalid"]:
        raise ValueError(f"{checked['invalid']} of {checked['rows']} arriving rows are no canonical records")
    return checked, frozenset(row["bucket"] for row in found)


def _bucket_table(
    held: DataFrame, cleaned: DataFrame, buckets: int, touched: frozenset[str] | None
) -> PartTable:
    rows = in_buckets(held, cleaned, buckets)
    order = ("date_received", "complaint_id")
    return PartTable(rows, F.col(PART), touched, silver_figures(_silver_columns(rows)), order, dealt=True)


def build_buckets(
    spark: SparkSession,
    silver_root: str,
    rows: DataFrame,
    buckets: int = BUCKETS,
    columns: Sequence[str] = SILVER_COLUMNS,
) -> dict[str, Any]:
    """Publish silver of raw rows, dealt into buckets as it is made.

    Silver that serves certain metric tables only can be made of fewer ``columns``, which batches then
    keep to. Every row is validated whole. Invalid rows are counted in the write and refuse the generation; a task that runs again may count
    some twice, which changes nothing.
    """
    seen = Observation()
    none = spark.createDataFrame([], silver_table(rows).select(*columns).schema)
    cleaned = clean(rows).observe(seen, F.count_if(is_invalid()).alias("invalid"))

    def report(parts: Parts) -> dict[str, Any]:
        new = parts[TABLE]
        if invalid := seen.get["invalid"]:
            raise ValueError(f"source contains {invalid} invalid records")
        return {
            "silver_rows": total(new),
            "invalid_rows": 0,
            "null_counts": {n: c for n in SILVER_COLUMNS if (c := total(new, f"null:{n}"))},
            "brand_alias_counts": {b: c for b in _brands() if (c := total(new, f"brand:{b}"))},
            "buckets": buckets,
        }

    return publish_parts(spark, silver_root, {TABLE: _bucket_table(none, cleaned, buckets, None)}, report)


def refresh_all(
    spark: SparkSession,
    silver_root: str,
    arriving: DataFrame,
    gold_root: str | None = None,
    index_root: str | None = None,
    embedder: Embedder | None = None,
    tolerance: float | None = None,
) -> dict[str, dict[str, Any]]:
    """Merge a batch into silver, then bring gold and the narrative index up to it."""
    reports = {"silver": apply_batch(spark, silver_root, arriving, tolerance)}
    if gold_root:
        reports["gold"] = refresh_gold(spark, silver_root, gold_root)
    if index_root:
        if embedder is None:
            raise ValueError("an index is refreshed with the embedder it was built with")
        reports["index"] = refresh_index(spark, silver_root, index_root, embedder)
    return reports


def refresh_stream(
    spark: SparkSession,
    arrivals: str,
    silver_root: str,
    checkpoint: str,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    gold_root: str | None = None,
    index_root: str | None = None,
    embedder: Embedder | None = None,
    tolerance: float | None = None,
) -> None:
    """Process every snapshot file that arrived since the last run, then stop.

    Each micro batch goes through ``refresh_all``; a batch that drifts too far stops the stream and is
    tried again by the next run. Inside a batch the newest file comes first,
    then rows in the order of their file, so a complaint ends as its newest snapshot has it whether
    snapshots are processed one by one or together. Files of the same moment go by path.
    """
    stream = (
        spark.readStream.schema(SNAPSHOT_SCHEMA)
        .parquet(arrivals)
        .select(
            "*",
            F.struct(
                (-F.unix_micros("_metadata.file_modification_time")).alias("newest"),
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.row_index").alias("row"),
            ).alias(ROW_ORDER),
        )
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        if on_batch:
            on_batch(batch, batch_id)
        else:
            refresh_all(spark, silver_root, batch, gold_root, index_root, embedder, tolerance)

    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
