"""A narrative index in segments: a base and, for each refresh, the rows it added and the ids it took out.

A segment holds index rows and ``gone``, the complaint ids whose rows in earlier segments no longer
count: removed, no longer eligible, or altered and therefore written again. The report of a generation
lists the segments in order, each by the generation that wrote it; a reader leaves out the rows that a
later segment has taken out. So a refresh embeds and writes what changed and nothing else. After
``LONGEST`` segments the rows that count are written together, with the vectors they have.

Rows carry ``narrative_hash`` of the whole narrative, of which only the first part is embedded, and
``row_hash`` of everything else in the row, so that an altered label counts as a change too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket_spark.plans.parts import folder_of, report_of, root_of

ROWS, GONE, SEGMENTS = "narratives", "gone", "segments"
LONGEST = 16


def narrative_hash() -> Column:
    return F.sha2("consumer_complaint_narrative", 256).alias("narrative_hash")


def row_hash(rows: DataFrame) -> Column:
    """Over all columns but the hash of the narrative."""
    names = [name for name in rows.columns if name not in ("narrative_hash", "row_hash", "embedding")]
    return F.xxhash64(*names).alias("row_hash")


def segments_of(spark: SparkSession, folder: str) -> list[str] | None:
    """Generations that hold the segments of an index, oldest first; None for an index in one piece."""
    return report_of(spark, folder).get(SEGMENTS)


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one segment, with product labels as the texts they are: folder names make 007 a 7."""
    path = f"{folder}/{ROWS}"
    fields = [
        T.StructField(f.name, T.StringType()) if f.name == "product" else f
        for f in spark.read.parquet(path).schema.fields
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_segments(spark: SparkSession, root: str, segments: list[str]) -> DataFrame:
    """The rows that count."""
    found: DataFrame | None = None
    gone: DataFrame | None = None
    for name in reversed(segments):
        folder = folder_of(root, name)
        if report_of(spark, folder).get("segment_rows") != 0:
            rows = read_rows(spark, folder)
            if gone is not None:
                rows = rows.join(gone.distinct(), "complaint_id", "left_anti")
            found = rows if found is None else rows.unionByName(found)
        own = spark.read.parquet(f"{folder}/{GONE}")
        gone = own if gone is None else own.unionByName(gone)
    if found is None:
        raise ValueError("the index has no rows")
    return found


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """An index in one piece or in segments."""
    segments = segments_of(spark, folder)
    return read_rows(spark, folder) if segments is None else read_segments(spark, root_of(folder), segments)


def write_rows(rows: DataFrame, folder: str) -> None:
    """Rows of a product lie together, so an equality filter on product reads one folder."""
    rows.hint("rebalance", "product").write.partitionBy("product").parquet(f"{folder}/{ROWS}")


def compare(wanted: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids to embed (new or altered) and ids of rows that no longer count, from ids and hashes alone."""
    hashes = ["narrative_hash", "row_hash"]
    new = wanted.select("complaint_id", F.struct(*hashes).alias("new"))
    old = held.select("complaint_id", F.struct(*hashes).alias("old"))
    differing = new.join(old, "complaint_id", "full").where(~F.col("new").eqNullSafe(F.col("old")))
    return (
        differing.where(F.col("new").isNotNull()).select("complaint_id"),
        differing.where(F.col("old").isNotNull()).select("complaint_id"),
    )
