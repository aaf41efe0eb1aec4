"""Grand totals and ordered texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket_spark.functions.metrics import ratio


def with_share(counts: DataFrame, measure: str = "complaint_count") -> DataFrame:
    """Attach the grand total and every row's share of it.

    The total is an uncorrelated scalar subquery: one aggregated value, no join, and no window
    over all rows in a single task.
    """
    total = counts.agg(F.sum(measure)).scalar()
    return counts.withColumn("total_complaints", total).withColumn(
        "share", ratio(F.col(measure), F.col("total_complaints"))
    )


def joined_text(
    parts: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    separator: str,
    name: str,
    chunk: Column | None = None,
) -> DataFrame:
    """Concatenate the texts of a group in order.

    With ``chunk``, a value that never decreases in the order, texts are first joined per chunk in
    parallel, so a long group is not collected part by part in one task.
    """

    def join(frame: DataFrame, by: list[str], sort: list[str]) -> DataFrame:
        row = F.struct(*dict.fromkeys([*sort, text]))
        return frame.groupBy(*by).agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(row)), lambda item: item[text]), separator
            ).alias(text)
        )

    if chunk is not None:
        parts = join(parts.withColumn("_chunk", chunk), [*keys, "_chunk"], list(order))
        order = ["_chunk"]
    return join(parts, list(keys), list(order)).withColumnRenamed(text, name)
