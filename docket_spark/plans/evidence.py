"""Evidence tables: numbered structured rows and narrative items, one set per question.

structured rows: ``question_id, row_index`` (from 0), ``row_columns`` (the result's column names in
order) and the result's columns. narrative items: ``question_id, position`` (from 1),
``complaint_id, excerpt, truncated`` and metadata as text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docket_spark.constants import AUDITED_FIELDS, MAX_THEMES
from docket_spark.functions.metrics import metric_rollup, ratio
from docket_spark.functions.text import canonical_text, collapse_whitespace
from docket_spark.operators.ranking import first_rows, repeated_themes
from docket_spark.plans.retrieval import metadata_text

METADATA = (*AUDITED_FIELDS, "timely_response", "date_received")


def number_rows(result: DataFrame, question_id: str, order: Sequence[Column]) -> DataFrame:
    """Rows of one bounded result, numbered in its order."""
    names = F.array(*[F.lit(name) for name in result.columns])
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return result.select(
        F.lit(question_id).alias("question_id"),
        place.alias("row_index"),
        names.alias("row_columns"),
        "*",
    )


def label_rows(
    metric_table: DataFrame,
    questions: DataFrame,
    label: str,
    keys: Sequence[str] = ("company",),
    limit: int | None = None,
) -> DataFrame:
    """Counts and shares by label for many questions at once.

    ``questions`` holds one row per question with its key values. Shares relate to all labels of
    the question, also when only the first ``limit`` labels are kept.
    """
    counts = (
        metric_table.join(questions.select("question_id", *keys), list(keys))
        .groupBy("question_id", label)
        .agg(metric_rollup("complaint_count").alias("complaint_count"))
    )
    totals = counts.groupBy("question_id").agg(
        F.sum("complaint_count").alias("total_complaints")
    )
    ranked = counts.join(totals, "question_id").withColumn(
        "share", ratio(F.col("complaint_count"), F.col("total_complaints"))
    )
    order = [F.col("complaint_count").desc(), F.col(label).asc_nulls_last()]
    if limit is None:
        place = F.row_number().over(Window.partitionBy("question_id").orderBy(*order))
        ranked = ranked.withColumn("_place", place)
    else:
        ranked = first_rows(ranked, ["question_id"], order, limit, "_place")
    columns = (label, "complaint_count", "total_complaints", "share")
    return ranked.select(
        "question_id",
        (F.col("_place") - 1).alias("row_index"),
        F.array(*[F.lit(name) for name in columns]).alias("row_columns"),
        *columns,
    )


def stack_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Structured rows of differently shaped results in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def narrative_items(ranked: DataFrame, position: str = "position") -> DataFrame:
    """Retrieved index rows as evidence items with text metadata."""
    return ranked.select(
        "question_id",
        F.col(position).alias("position"),
        "complaint_id",
        "excerpt",
        F.col("narrative_truncated").alias("truncated"),
        "distance",
        *[metadata_text(name).alias(name) for name in METADATA],
    )


def themes(items: DataFrame) -> DataFrame:
    """Label pairs repeated in a question's evidence, numbered."""
    return repeated_themes(
        items,
        "question_id",
        collapse_whitespace(F.col("issue")),
        collapse_whitespace(F.col("sub_issue")),
        MAX_THEMES,
    )


def theme_lists(items: DataFrame) -> DataFrame:
    """The repeated labels of a question as one short array, at most three entries."""
    entry = F.struct("theme_no", "issue", "sub_issue", "retrieved_count")
    return (
        themes(items)
        .groupBy("question_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
        .select(
            "question_id",
            F.transform(
                "_entries",
                lambda e: F.struct(
                    e["issue"].alias("issue"),
                    e["sub_issue"].alias("sub_issue"),
                    e["retrieved_count"].alias("retrieved_count"),
                ),
            ).alias("expected_themes"),
        )
    )


FANOUT = 1000


def fingerprint(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """SHA-256 per question over its evidence rows in order, as a tree of digests.

    A row is hashed as the canonical text of its columns by name. The digests of a thousand places of
    the first ``order`` column are hashed together, then those of a thousand such groups, and so on; no
    row or string ever holds a question. Places are numbers below 10^12.
    """
    values = sorted(set(rows.columns) - {"question_id"})
    place = F.col(order[0]).cast("bigint")
    level = rows.select(
        "question_id",
        F.struct(place.alias("place"), *order[1:]).alias("at"),
        place.alias("place"),
        F.sha2(canonical_text(values), 256).alias("line"),
    )

    def together(*keys: Column | str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("at", "line")))
        digests = F.array_join(F.transform(listed, lambda x: x["line"]), ",")
        return level.groupBy(*keys).agg(F.sha2(digests, 256).alias("line"))

    for _ in range(3):
        above = F.floor(F.col("place") / FANOUT).alias("at")
        level = together("question_id", above).withColumn("place", F.col("at"))
    return together("question_id").select("question_id", F.col("line").alias("evidence_sha256"))
