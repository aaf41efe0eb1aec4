"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def column(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    return F.coalesce(column(name).cast("string"), F.lit(""))


def ascii_folded(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole_row(frame: DataFrame) -> Column:
    return F.struct(*[column(name) for name in frame.columns])


def row_rank(frame: DataFrame) -> Column:
    """A hash of every column that can be hashed: a fixed order among rows of one id."""
    kept = [
        column(f.name)
        for f in frame.schema.fields
        if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()
    ]
    return F.xxhash64(*kept)


def fold_of(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fold a document belongs to."""
    return F.crc32(F.coalesce(column(doc_id).cast("string"), F.lit(""))) % parts


def field(frame: DataFrame, name: str, alias: str | None = None) -> T.StructField:
    return T.StructField(alias or name, frame.schema[name].dataType, True)


def _cuts(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop - start
        start = stop


def by_bytes(batch: pa.RecordBatch, name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``name`` holds about ``limit`` bytes; a longer row stands alone."""
    for start, many in _cuts(batch.column(name), limit):
        yield batch.slice(start, many)
    pa.default_memory_pool().release_unused()


def rows_by_bytes(
    batch: pa.RecordBatch, row: str, text: str, limit: int
) -> Iterator[pa.RecordBatch]:
    """The same by field ``text`` of the struct ``row``."""
    for start, many in _cuts(batch.column(row).field(text), limit):
        yield batch.slice(start, many)
    pa.default_memory_pool().release_unused()


def utf8(array: pa.Array) -> list[bytes]:
    """The bytes of each text; null is empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def rows_kept(
    docs: DataFrame, text: str, keep: Callable[[Iterator], Iterator], limit: int
) -> DataFrame:
    """The rows of ``docs`` that ``keep`` says, with all their columns, whatever their names.

    ``keep`` is called once per task with the texts' batches, each of about ``limit`` bytes, and
    yields for each an array of booleans.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for batch in batches for part in rows_by_bytes(batch, "row", text, limit))
        here, ahead = itertools.tee(parts)
        texts = (utf8(part.column("row").field(text)) for part in ahead)
        for part, stays in zip(here, keep(texts), strict=True):
            yield part.filter(pa.array(stays, pa.bool_()))

    schema = T.StructType([T.StructField("row", docs.schema, False)])
    return docs.select(whole_row(docs).alias("row")).mapInArrow(work, schema).select("row.*")
