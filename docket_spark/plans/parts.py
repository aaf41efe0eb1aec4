"""Tables in parts: a generation writes the parts that changed and names the folders of all others.

A part is one folder of a table, told by a value of its rows (an id bucket, a month). The report of a
generation lists for each table the parts it consists of, the generation that wrote each, and additive
figures of its rows. A reader opens the listed folders; figures of the whole table are sums over the list,
so that neither needs the parts that did not change.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket_spark.plans.publish import (
    GENERATIONS,
    REPORT,
    SharedFiles,
    current_folder,
    publish_generation,
)

PART, SCHEMAS, LISTED = "_part", "_schemas", "parts"

# table -> part -> {"generation": ..., "rows": ..., further additive figures}
Parts = dict[str, dict[str, dict[str, Any]]]


@dataclass(frozen=True)
class PartTable:
    """New rows of a table: ``part`` tells the part of a row, ``replaced`` the parts that these rows are
    all of (None: every part), ``figures`` are additive aggregates to keep per part. Rows that are
    ``dealt`` carry their part as the column ``PART`` and lie as they are to be written."""

    rows: DataFrame
    part: Column
    replaced: frozenset[str] | None = None
    figures: Mapping[str, Column] = field(default_factory=dict)
    sort: tuple[str, ...] = ()
    dealt: bool = False

    def schema(self) -> T.StructType:
        """Of the rows without their part."""
        return self.rows.drop(PART).schema


def root_of(folder: str) -> str:
    return folder.rsplit(f"/{GENERATIONS}/", 1)[0]


def generation_of(folder: str) -> str:
    return folder.rsplit("/", 1)[-1]


def folder_of(root: str, generation: str) -> str:
    return f"{root}/{GENERATIONS}/{generation}"


def report_of(spark: SparkSession, folder: str) -> dict[str, Any]:
    """The report of a generation; empty while it is being written."""
    files = SharedFiles(spark)
    path = f"{folder}/{REPORT}"
    return json.loads(files.read_text(path)) if files.exists(path) else {}


def parts_of(spark: SparkSession, folder: str, table: str) -> dict[str, dict[str, Any]] | None:
    """The parts of a table as a generation lists them, None for a table in one piece."""
    return report_of(spark, folder).get(LISTED, {}).get(table)


def read_parts(
    spark: SparkSession, folder: str, table: str, only: Iterable[str] | None = None
) -> DataFrame:
    """A table in parts, or the named parts of it."""
    listed = parts_of(spark, folder, table)
    if listed is None:
        raise ValueError(f"{table} is not in parts")
    names = listed if only is None else sorted(set(only) & set(listed))
    text = SharedFiles(spark).read_text(f"{folder}/{SCHEMAS}/{table}.json")
    schema = T.StructType.fromJson(json.loads(text))
    paths = [
        f"{folder_of(root_of(folder), listed[name]['generation'])}/{table}/{PART}={name}" for name in names
    ]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a generation, in one piece or in parts."""
    if parts_of(spark, folder, table) is None:
        return spark.read.parquet(f"{folder}/{table}")
    return read_parts(spark, folder, table)


def changed_parts(
    old: Mapping[str, Mapping[str, Any]], new: Mapping[str, Mapping[str, Any]]
) -> set[str]:
    """Parts that two lists do not take from the same generation."""
    source = lambda listed, name: listed.get(name, {}).get("generation")
    return {name for name in {*old, *new} if source(old, name) != source(new, name)}


def total(listed: Mapping[str, Mapping[str, Any]], figure: str = "rows") -> int:
    return sum(part.get(figure, 0) for part in listed.values())


def _write(table: PartTable, folder: str, name: str) -> None:
    files = SharedFiles(table.rows.sparkSession)
    files.write_text(f"{folder}/{SCHEMAS}/{name}.json", table.schema().json())
    rows = table.rows
    if not table.dealt:
        # A part that is much larger than the others is split over several tasks and files.
        rows = rows.withColumn(PART, table.part.cast("string")).hint("rebalance", PART)
    rows.sortWithinPartitions(PART, *table.sort).write.partitionBy(PART).parquet(f"{folder}/{name}")


def _measured(spark: SparkSession, table: PartTable, folder: str, name: str) -> dict[str, dict[str, Any]]:
    """The parts just written, with their figures."""
    schema = T.StructType([*table.schema().fields, T.StructField(PART, T.StringType())])
    written = spark.read.schema(schema).parquet(f"{folder}/{name}")
    figures = [aggregate.alias(key) for key, aggregate in table.figures.items()]
    counted = written.groupBy(PART).agg(F.count(F.lit(1)).alias("rows"), *figures)
    return {
        row[PART]: {"generation": generation_of(folder), "rows": row["rows"], **{k: row[k] for k in table.figures}}
        for row in counted.collect()
    }


def publish_parts(
    spark: SparkSession,
    root: str,
    tables: Mapping[str, PartTable],
    report: Callable[[Parts], Mapping[str, Any]],
    base: str | None = None,
) -> dict[str, Any]:
    """Publish a generation that writes ``tables`` and takes all parts not replaced from ``base``.

    ``report`` gets the parts of every table as they will be, before the pointer is switched; what it
    raises refuses the generation.
    """
    held = report_of(spark, base).get(LISTED, {}) if base else {}

    def at_once(work: Callable[[str], Any]) -> dict[str, Any]:
        """Tables do not wait for each other, so small ones do not leave the cluster idle."""
        with ThreadPoolExecutor(len(tables)) as pool:
            return dict(zip(tables, pool.map(inheritable_thread_target(spark)(work), tables), strict=True))

    def write(folder: str) -> None:
        at_once(lambda name: _write(tables[name], folder, name))

    def content(folder: str) -> dict[str, Any]:
        fresh = at_once(lambda name: _measured(spark, tables[name], folder, name))
        parts: Parts = {}
        for name, table in tables.items():
            gone = held.get(name, {}) if table.replaced is None else table.replaced
            kept = {key: part for key, part in held.get(name, {}).items() if key not in gone}
            parts[name] = {**kept, **fresh[name]}
        return {**report(parts), LISTED: parts}

    return publish_generation(spark, root, write, content, base=base)


def current_parts(spark: SparkSession, root: str, table: str) -> tuple[str, dict[str, dict[str, Any]] | None]:
    """The current generation's folder and its list of a table's parts."""
    folder = current_folder(spark, root)
    return folder, parts_of(spark, folder, table)


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the current generation, in one piece or in parts."""
    return read_table(spark, current_folder(spark, root), table)
