"""Reading complaint snapshots and checking what was read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket_spark.constants import SOURCE_COLUMNS

SNAPSHOT_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in SOURCE_COLUMNS])
ROW_ORDER = "_row_order"
# Below the two gigabytes that one value can hold.
WHOLE_FILE, CHUNK = 1 << 30, 1 << 20
# A value is held several times over where it is read, by each task of an executor.
VALUE = 16 << 20
# Names of files that are unpacked when they are read in lines.
CODED = r"(?i)\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd|xz|lzo|lzo_deflate)$"
# Left out by a reader of lines at the start of a file.
MARK = b"\xef\xbb\xbf"


def read_snapshot(
    spark: SparkSession, path: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """A raw snapshot with a unique row order column: file path, then place in the file.

    Neither file sizes nor the way Spark splits and packs files change it, and it costs no shuffle.
    Text formats are read with the fixed schema; they know the start of the block a row was read
    from, and rows of a block keep their order by a running number inside the task.
    """
    reader = spark.read.options(**options)
    if fmt == "parquet":
        frame, place = reader.parquet(path), F.col("_metadata.row_index")
    elif fmt in {"csv", "json", "orc"}:
        frame = reader.format(fmt).schema(SNAPSHOT_SCHEMA).load(path)
        place = F.col("_metadata.file_block_start")
    else:
        raise ValueError(f"unsupported snapshot format: {fmt}")
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        place.alias("place"),
        # The upper bits name the task; below them rows of one block count up.
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"),
    )
    return frame.withColumn(ROW_ORDER, order)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """A catalogue table by its single-part name."""
    if not table or "." in table or "\x00" in table:
        raise ValueError("table must be one non-empty identifier")
    return spark.table(f"`{table.replace('`', '``')}`")


def file_digests(
    spark: SparkSession,
    path: str,
    pattern: str = "*",
    whole: int = WHOLE_FILE,
    chunk: int = CHUNK,
    value: int = VALUE,
) -> DataFrame:
    """Path, length and SHA-256 of every file under a path, computed where the files are read.

    Files of up to ``value`` bytes are one value each. Longer ones are read in ranges, and up to ``whole``
    bytes their lines go through one digest in order, a batch at a time. Packed files cannot be read so, and
    are one value up to ``whole`` bytes. Beyond that the digest is over
    its length and a tree of digests (lines, chunks of lines, a thousand chunks, a million chunks), which
    does not depend on how Spark cut the file, and starts with ``tree:``. No task holds more than the lines of a
    range one by one, and the digests of a chunk; a line itself has to fit into one value.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    length, size = F.col("length"), F.col("_metadata.file_size")
    coded = F.col("_metadata.file_name").rlike(CODED)
    # What is asked of the metadata leaves files out before any is opened.
    short = files.where((size <= whole) & ((size <= value) | coded)).select(
        "path", "length", F.sha2("content", 256).alias("sha256")
    )
    # Without their content, files are only listed.
    listed = files.select("path", "length", F.col("_metadata.file_path").alias("place"), coded.alias("coded"))
    passing = listed.where((length > value) & (length <= whole) & ~F.col("coded")).drop("coded")
    long = listed.where(length > whole).drop("coded")
    if not passing.isEmpty():
        in_ranges = (size > value) & (size <= whole) & ~coded
        short = short.unionByName(_passed_digests(spark, path, pattern, passing, in_ranges))
    if long.isEmpty():
        return short
    return short.unionByName(_tree_digests(spark, path, pattern, long, chunk))


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Bytes between line feeds."""
    return spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(path)


def _place() -> list[Column]:
    """Where a line is: by range and row, lines are in the order of their file."""
    return [
        F.col("_metadata.file_path").alias("place"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("row"),
    ]


def _passed_digests(
    spark: SparkSession, path: str, pattern: str, files: DataFrame, chosen: Column
) -> DataFrame:
    line = F.concat(F.col("value").cast("binary"), F.unhex(F.lit("0A"))).alias("line")
    lines = (
        _lines(spark, path, pattern)
        .where(chosen)
        .select(*_place(), F.col("_metadata.file_size").alias("length"), line)
    )
    # A file is one task's, which sorts on disk what does not fit, and hands its lines on by batches.
    in_order = lines.repartition("place").sortWithinPartitions("place", "range", "row")
    digests = in_order.select("place", "length", "line").mapInArrow(
        _digests_in_order, "place string, sha256 string"
    )
    return files.join(digests, "place").select("path", "length", "sha256")


class _Passing:
    """The digest of a file whose lines pass by, each with a line feed behind it."""

    def __init__(self, place: str, length: int):
        self.place, self.length, self.passed = place, length, 0
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(MARK)

    def add(self, lines: memoryview) -> None:
        # The last line feed waits: the file may end without it.
        for digest in (self.plain, self.marked):
            digest.update(b"\n" if self.passed else b"")
            digest.update(lines[:-1])
        self.passed += len(lines)

    def row(self) -> dict[str, str]:
        endings = {0: b"\n", 1: b""}
        for digest, left_out in ((self.plain, 0), (self.marked, len(MARK))):
            ending = endings.get(self.passed + left_out - self.length)
            if ending is not None:
                digest.update(ending)
                return {"place": self.place, "sha256": digest.hexdigest()}
        raise ValueError(f"{self.place}: {self.passed} bytes were read of {self.length}")


def _digests_in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of files from batches of (place, length, line), all lines of a file together and in order."""
    passing = None
    for batch in batches:
        places, lengths, lines = batch.columns
        runs = pa.compute.run_end_encode(places)
        start = 0
        for end, place in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
            if passing is None or passing.place != place:
                if passing:
                    yield pa.RecordBatch.from_pylist([passing.row()])
                passing = _Passing(place, lengths[start].as_py())
            passing.add(_joined(lines.slice(start, end - start)))
            start = end
    if passing:
        yield pa.RecordBatch.from_pylist([passing.row()])


def _joined(lines: pa.Array) -> memoryview:
    """The bytes of neighbouring values, which lie together."""
    wide = np.int64 if pa.types.is_large_binary(lines.type) else np.int32
    at = np.frombuffer(lines.buffers()[1], wide)[lines.offset : lines.offset + len(lines) + 1]
    return memoryview(lines.buffers()[2])[int(at[0]) : int(at[-1])]


def _tree_digests(
    spark: SparkSession, path: str, pattern: str, files: DataFrame, chunk: int
) -> DataFrame:
    lines = _lines(spark, path, pattern).select(
        *_place(),
        (F.octet_length("value") + 1).cast("long").alias("bytes"),
        F.sha2(F.col("value").cast("binary"), 256).alias("digest"),
    )
    long = files.withColumnRenamed("path", "listed")
    lines = lines.join(long.drop("length"), "place")
    ranges = lines.groupBy("listed", "range").agg(F.sum("bytes").alias("in_range"))
    before = F.sum("in_range").over(Window.partitionBy("listed").orderBy("range")) - F.col("in_range")
    in_range = Window.partitionBy("listed", "range").orderBy("row").rowsBetween(
        Window.unboundedPreceding, -1
    )
    level = (
        lines.join(ranges.select("listed", "range", before.alias("before")), ["listed", "range"])
        .withColumn("at", F.col("before") + F.coalesce(F.sum("bytes").over(in_range), F.lit(0)))
        .select("listed", "at", "digest")
    )
    for size in (chunk, chunk * 1000, chunk * 1_000_000):
        group = (F.floor(F.col("at") / size) * size).alias("chunk")
        level = (
            level.groupBy("listed", group)
            .agg(_digest_of("at").alias("digest"))
            .withColumnRenamed("chunk", "at")
        )
    top = level.groupBy("listed").agg(_digest_of("at").alias("digest"))
    return long.join(top, "listed").select(
        F.col("listed").alias("path"),
        "length",
        F.concat(
            F.lit("tree:"), F.sha2(F.concat_ws(",", F.col("length").cast("string"), "digest"), 256)
        ).alias("sha256"),
    )


def _digest_of(order: str) -> Column:
    listed = F.array_sort(F.collect_list(F.struct(order, "digest")))
    return F.sha2(F.array_join(F.transform(listed, lambda x: x["digest"]), ","), 256)
