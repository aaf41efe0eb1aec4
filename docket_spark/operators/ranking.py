"""Ranking operators that stay bounded when one group holds a large part of the rows.

``row_number() <= n`` lets Spark cut every group to n rows inside each input partition before
anything is shuffled (window group limit), so a hot group costs n rows per partition and not all
of them. That only happens up to ``spark.sql.optimizer.windowGroupLimitThreshold``; beyond it the
same cut is made here in an explicit first step over salted groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_THRESHOLD = "spark.sql.optimizer.windowGroupLimitThreshold"


def first_rows(
    frame: DataFrame,
    keys: Sequence[str | Column],
    order: Sequence[Column],
    n: int = 1,
    rank: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of every group; ``rank`` keeps the 1-based position as a column."""
    name = rank or "_rank"
    threshold = int(frame.sparkSession.conf.get(_THRESHOLD, "1000"))
    if n > threshold:
        salt = Window.partitionBy(*keys, F.spark_partition_id()).orderBy(*order)
        frame = frame.withColumn(name, F.row_number().over(salt)).where(F.col(name) <= n)
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = frame.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def ranked_top(
    frame: DataFrame, order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of the whole frame, each partition cut to n before they meet."""
    top = frame.orderBy(*order).limit(n)
    if rank is None:
        return top
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def diversify(
    evidence: DataFrame,
    query: str,
    labels: Sequence[str],
    rank: str,
    target: int,
    position: str = "position",
) -> DataFrame:
    """Keep ``target`` rows per query, one per label combination first.

    A query with no more than ``target`` rows keeps its order. Otherwise the first row of every
    label comes first in rank order and the remaining places go to the other rows in rank order.
    Both cuts keep one row more than can be selected, which shows whether a query overflows; no
    query is gathered whole.
    """
    keyed = evidence.withColumns(
        {f"_label{i}": F.coalesce(F.col(name), F.lit("")) for i, name in enumerate(labels)}
    )
    label_keys = [f"_label{i}" for i in range(len(labels))]
    by_rank = [F.col(rank).asc()]
    per_label = first_rows(keyed, [query, *label_keys], by_rank, target + 1, "_nth")
    bounded = first_rows(
        per_label.withColumn("_repeat", F.col("_nth") > 1),
        [query],
        [F.col("_repeat").asc(), *by_rank],
        target + 1,
        "_place",
    )
    in_query = Window.partitionBy(query)
    overflow = F.count(F.lit(1)).over(in_query) > target
    plain = F.row_number().over(in_query.orderBy(*by_rank))
    return (
        bounded.withColumn(position, F.when(overflow, F.col("_place")).otherwise(plain))
        .where(F.col(position) <= target)
        .drop(*label_keys, "_nth", "_repeat", "_place")
    )


def pick_examples(
    evidence: DataFrame, query: str, item: str, quote: str, fingerprint: str, rank: str, n: int
) -> DataFrame:
    """Walk each query in rank order, skip blank quotes and repeated ids or fingerprints, take n.

    A row after the n-th different id of its fingerprint, or after the n-th different fingerprint
    of its id, can never be taken. With those gone every taken row blocks at most 2(n-1) others,
    so the choice lies within the first (n-1)(2n-1)+1 rows and the walk itself is over a short
    array.
    """
    order = [F.col(rank).asc()]
    pairs = (
        evidence.where(F.length(quote) > 0)
        .groupBy(query, item, fingerprint)
        .agg(F.min(F.struct(F.col(rank), F.col(quote))).alias("_best"))
        .select(query, item, fingerprint, F.col(f"_best.{rank}"), F.col(f"_best.{quote}"))
    )
    bounded = first_rows(pairs, [query, fingerprint], order, n)
    bounded = first_rows(bounded, [query, item], order, n)
    bounded = first_rows(bounded, [query], order, (n - 1) * (2 * n - 1) + 1)
    fields = F.struct(F.col(rank), F.col(item), F.col(fingerprint), F.col(quote))
    short = bounded.groupBy(query).agg(F.array_sort(F.collect_list(fields)).alias("_walk"))

    def take(taken, row):
        blocked = F.exists(
            taken,
            lambda seen: (seen[item] == row[item]) | (seen[fingerprint] == row[fingerprint]),
        )
        return F.when((F.size(taken) < n) & ~blocked, F.concat(taken, F.array(row))).otherwise(
            taken
        )

    walked = short.select(
        query, F.aggregate("_walk", F.slice("_walk", 1, 0), take).alias("_taken")
    )
    return walked.select(query, F.posexplode("_taken").alias("_index", "_row")).select(
        query,
        (F.col("_index") + 1).alias("example_no"),
        F.col(f"_row.{item}").alias(item),
        F.col(f"_row.{quote}").alias(quote),
        F.col(f"_row.{rank}").alias(rank),
    )


def repeated_themes(
    evidence: DataFrame, query: str, issue: Column, sub_issue: Column, n: int
) -> DataFrame:
    """Label pairs that occur at least twice in a query's evidence, the ``n`` most frequent."""
    counts = (
        evidence.select(query, issue.alias("issue"), sub_issue.alias("sub_issue"))
        .where(F.coalesce(F.length("issue") > 0, F.lit(False)))
        .withColumn("sub_issue", F.nullif(F.col("sub_issue"), F.lit("")))
        .groupBy(query, "issue", "sub_issue")
        .agg(F.count(F.lit(1)).alias("retrieved_count"))
        .where(F.col("retrieved_count") >= 2)
    )
    order = [
        F.col("retrieved_count").desc(),
        F.lower("issue").asc(),
        F.lower(F.coalesce("sub_issue", F.lit(""))).asc(),
        F.col("issue").asc(),
        F.coalesce("sub_issue", F.lit("")).asc(),
    ]
    return first_rows(counts, [query], order, n, "theme_no")


def stratified_sample(
    frame: DataFrame, strata: Sequence[str], key: str, per_stratum: int
) -> DataFrame:
    """A reproducible sample: in every stratum the rows whose hashed key sorts first."""
    order = [F.md5(F.col(key)).asc(), F.col(key).asc()]
    return first_rows(frame, list(strata), order, per_stratum)
