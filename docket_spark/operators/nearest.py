"""Exact nearest neighbours with metadata filters applied before any distance.

* One request: filters become scan predicates, the distance is a column, ordering is a top-k.
* Many requests that each name a value of a filter column: an equi-join on that column.

Requests with filters of their own each are searched by ``blocks``, with few comparisons by ``pivots``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket_spark.functions.vectors import squared_l2
from docket_spark.operators.ranking import first_rows, ranked_top


def nearest(
    index: DataFrame,
    vector: Sequence[float] | Column,
    k: int,
    predicate: Column | None = None,
    key: str = "complaint_id",
) -> DataFrame:
    """The k documents nearest to one vector among those that satisfy the predicate."""
    if k < 1:
        raise ValueError("k below 1: a search returns at least one row")
    if not isinstance(vector, Column):
        vector = F.lit([float(x) for x in vector])
    candidates = index if predicate is None else index.where(predicate)
    scored = (
        candidates.withColumn("_vector", vector)
        .withColumn("distance", squared_l2(F.col("embedding"), F.col("_vector")))
        .drop("_vector")
    )
    return ranked_top(scored, [F.col("distance").asc(), F.col(key).asc()], k, "rank")


def nearest_by_key(
    index: DataFrame,
    requests: DataFrame,
    on: Sequence[str],
    k: int,
    request: str = "question_id",
    key: str = "complaint_id",
    predicate: Column | None = None,
) -> DataFrame:
    """The k nearest documents of every request among documents with the same key columns.

    ``requests`` holds one row per request with its ``query_vector`` and the key columns.
    """
    if k < 1:
        raise ValueError("k below 1: a search returns at least one row")
    candidates = index if predicate is None else index.where(predicate)
    # Only ids and distances are sorted; documents join the k ids that are left.
    scored = (
        candidates.select(key, "embedding", *on)
        .join(requests.select(request, "query_vector", *on), list(on))
        .select(request, key, squared_l2(F.col("embedding"), F.col("query_vector")).alias("distance"))
    )
    hits = first_rows(scored, [request], [F.col("distance").asc(), F.col(key).asc()], k, "rank")
    found = hits.join(candidates.drop("embedding"), key)
    asked = [c for c in requests.columns if c not in {"query_vector", *on, *candidates.columns}]
    return found.join(requests.select(*asked), request) if len(asked) > 1 else found
