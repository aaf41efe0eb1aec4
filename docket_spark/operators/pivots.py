"""A layout of vectors around pivots, and exact searches that leave out what cannot be near.

Every row lies with its nearest pivot p and carries its distance to it. For a request q and a row x of p
the triangle inequality gives |d(q, p) - d(x, p)| <= d(q, x): once k rows within t of q are known, a row
whose distance to p is not within t of d(q, p) is farther than all of them. Rows are written in one folder
a pivot, sorted by that distance, so for one request the inequality is a range per folder: it prunes folders
by name and row groups by their statistics. For many requests it says which pivots a request has to meet.
Both return the rows of a full search.

Pivots come from a sample of at most ``sample_rows`` rows, those with the smallest hashed keys, by a few
rounds of averaging on the driver. That bound does not grow with the table, every row is laid out, and the
choice of pivots affects how much is left out, never what is found.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket_spark.operators.blocks import BLOCK_BYTES, CELL_BYTES, merged, search, wanted_rows
from docket_spark.operators.nearest import nearest
from docket_spark.session import cut_lineage

PIVOTS, SAMPLE_ROWS, ROUNDS = 64, 16_384, 8
TABLE, PIVOT_TABLE, SCHEMA = "rows", "pivots", "schema"
# Rounding of distances: bounds are taken a little wider than the inequality asks for.
WIDER = 1e-9


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, row by pivot, each as a plain sum of squares."""
    return np.sqrt(
        np.stack([np.einsum("ij,ij->i", vectors - p, vectors - p) for p in pivots], axis=1)
    )


def choose_pivots(
    index: DataFrame,
    key: str = "complaint_id",
    pivots: int = PIVOTS,
    sample_rows: int = SAMPLE_ROWS,
    rounds: int = ROUNDS,
) -> np.ndarray:
    """At most ``pivots`` points amid a bounded sample of the vectors."""
    drawn = (
        index.where(F.col("embedding").isNotNull())
        .select(F.md5(F.col(key).cast("string")).alias("_hash"), "embedding")
        .orderBy("_hash", "embedding")
        .limit(sample_rows)
        .toPandas()
    )
    if drawn.empty:
        return np.zeros((0, 0))
    vectors = np.stack(drawn["embedding"]).astype("float64")
    found = np.unique(vectors[:pivots], axis=0)
    for _ in range(rounds):
        nearest_one = _distances(vectors, found).argmin(axis=1)
        found = np.stack(
            [
                vectors[nearest_one == p].mean(axis=0) if (nearest_one == p).any() else found[p]
                for p in range(len(found))
            ]
        )
    return found


def with_pivot(index: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``index`` with ``pivot`` (the nearest one) and ``pivot_distance``; only vectors go to Python."""

    @F.pandas_udf("pivot int, distance double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        if vectors.empty:
            return pd.DataFrame({"pivot": [], "distance": []})
        far = _distances(np.stack(vectors).astype("float64"), pivots)
        which = far.argmin(axis=1)
        return pd.DataFrame({"pivot": which, "distance": far[np.arange(len(far)), which]})

    known = F.size("embedding") == pivots.shape[1]
    return (
        index.where(known)
        .withColumn("_place", place("embedding"))
        .select(
            *index.columns,
            F.col("_place.pivot").alias("pivot"),
            F.col("_place.distance").alias("pivot_distance"),
        )
    )


def write_layout(
    index: DataFrame, folder: str, key: str = "complaint_id", pivots: int = PIVOTS, **sample: int
) -> None:
    """Write ``index`` around pivots: its rows by pivot and distance, and a small table of the pivots
    with the least and greatest distance of their rows."""
    spark = index.sparkSession
    points = choose_pivots(index, key, pivots, **sample)
    placed = with_pivot(index, points)
    # Folders of no rows, or of one pivot, do not tell their columns.
    placed.limit(0).write.parquet(f"{folder}/{SCHEMA}")
    placed.hint("rebalance", "pivot").sortWithinPartitions("pivot", "pivot_distance").write.partitionBy(
        "pivot"
    ).parquet(f"{folder}/{TABLE}")
    reach = read_rows(spark, folder).groupBy("pivot").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("pivot_distance").alias("low"),
        F.max("pivot_distance").alias("high"),
    )
    named = spark.createDataFrame(
        [(number, point.tolist()) for number, point in enumerate(points)],
        "pivot int, point array<double>",
    )
    named.join(reach, "pivot").write.parquet(f"{folder}/{PIVOT_TABLE}")


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{SCHEMA}").schema
    return spark.read.schema(schema).parquet(f"{folder}/{TABLE}")


def read_pivots(spark: SparkSession, folder: str) -> pd.DataFrame:
    """The pivots that have rows, by number; as many as were asked for when the layout was written."""
    return spark.read.parquet(f"{folder}/{PIVOT_TABLE}").orderBy("pivot").toPandas()


def _within(pivots: pd.DataFrame, to_pivot: np.ndarray, reach: float) -> Column:
    """Rows that can be within ``reach`` of a point at the distances ``to_pivot`` from the pivots."""
    terms = F.lit(False)
    for number, low, high, far in zip(pivots["pivot"], pivots["low"], pivots["high"], to_pivot):
        wide = reach + WIDER * (1 + far + reach)
        if low - wide <= far <= high + wide:
            terms = terms | (
                (F.col("pivot") == int(number))
                & (F.col("pivot_distance") >= float(far - wide))
                & (F.col("pivot_distance") <= float(far + wide))
            )
    return terms


def candidates(
    spark: SparkSession,
    folder: str,
    vector: Sequence[float],
    k: int,
    predicate: Column | None = None,
    key: str = "complaint_id",
) -> DataFrame:
    """The rows of the layout that can be among the k nearest: the only ones a search has to read.

    The nearest pivots with k rows give a first bound; with too few matches there every row stays.
    """
    rows, pivots = read_rows(spark, folder), read_pivots(spark, folder)
    if pivots.empty:
        return rows
    point = np.asarray(vector, dtype="float64")
    to_pivot = _distances(point[None], np.stack(pivots["point"]))[0]
    by_distance = np.argsort(to_pivot, kind="stable")
    enough = int(np.searchsorted(pivots["rows"].to_numpy()[by_distance].cumsum(), k)) + 1
    near = [int(x) for x in pivots["pivot"].to_numpy()[by_distance[:enough]]]
    first = nearest(rows.where(F.col("pivot").isin(near)), vector, k, predicate, key)
    bound = first.agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).first()
    if bound["n"] < k:
        return rows
    return rows.where(_within(pivots, to_pivot, float(np.sqrt(bound["far"]))))


def nearest_pruned(
    spark: SparkSession,
    folder: str,
    vector: Sequence[float],
    k: int,
    predicate: Column | None = None,
    key: str = "complaint_id",
) -> DataFrame:
    """The k nearest rows of a layout, as ``nearest`` finds them, from fewer rows read."""
    return nearest(candidates(spark, folder, vector, k, predicate, key), vector, k, predicate, key)


def aimed_at(requests: DataFrame, pivots: pd.DataFrame, request: str) -> DataFrame:
    """``requests`` with their distances to all pivots, in the order of ``pivots``."""
    points = np.stack(pivots["point"])

    @F.pandas_udf("array<double>")
    def far(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(_distances(np.stack(vectors).astype("float64"), points)) if len(vectors) else [])

    same = F.size("query_vector") == points.shape[1]
    return requests.where(same).withColumn("_far", far("query_vector"))


def nearest_batch_pruned(
    spark: SparkSession,
    folder: str,
    requests: DataFrame,
    k: int | str,
    filters: Sequence[str] = (),
    ranges: Mapping[str, tuple[str, str]] | None = None,
    request: str = "question_id",
    key: str = "complaint_id",
    cell_bytes: int = CELL_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k nearest rows of a layout for every request, as ``nearest_batch`` finds them.

    A request first meets the rows of its nearest pivot. If these give k matches, the k-th bounds its
    distance, and it meets only those other pivots whose rows can be as near; otherwise it meets all.
    """
    wanted, same = wanted_rows(k)
    rows, pivots = read_rows(spark, folder), read_pivots(spark, folder)
    placed = rows.withColumn("_route", F.col("pivot").cast("int"))
    if pivots.empty:
        aimed = requests.withColumn("_routes", F.array(F.lit(0)))
        return merged(search(placed, aimed.withColumn("_k", wanted), key, request, filters, ranges), request, key, same)
    aimed = aimed_at(requests.withColumn("_k", wanted), pivots, request)
    reach = F.array(
        *[
            F.struct(F.lit(int(p)).alias("pivot"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
            for p, low, high in zip(pivots["pivot"], pivots["low"], pivots["high"])
        ]
    )
    cells = F.arrays_zip(F.col("_far").alias("far"), reach.alias("of"))
    home = F.array_min(F.transform(cells, lambda x: F.struct(x["far"], x["of"]["pivot"])))["pivot"]
    aimed = aimed.withColumn("_home", home)
    common = dict(key=key, request=request, equal=filters, ranges=ranges, cell_bytes=cell_bytes, block_bytes=block_bytes)
    # At most k rows a cell and request, and needed twice.
    first = cut_lineage(search(placed, aimed.withColumn("_routes", F.array("_home")), **common))
    bound = (
        first.groupBy(request)
        .agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list("distance")).alias("_all"))
        .select(request, "_n", "_all")
    )
    bounded = aimed.join(bound, request, "left")
    # The k-th distance of the home pivot, or nothing that bounds.
    kth = F.when(F.col("_n") >= F.col("_k"), F.sqrt(F.get("_all", F.col("_k") - 1)))
    wide = F.col("_t") + WIDER * (F.lit(1.0) + F.col("_t"))

    def can_be_near(x: Column) -> Column:
        more = wide + WIDER * x["far"]
        fits = (x["far"] >= x["of"]["low"] - more) & (x["far"] <= x["of"]["high"] + more)
        return (x["of"]["pivot"] != F.col("_home")) & F.coalesce(fits, F.lit(True))

    others = bounded.withColumn("_t", kth).withColumn(
        "_routes", F.transform(F.filter(cells, can_be_near), lambda x: x["of"]["pivot"])
    )
    second = search(placed, others.drop("_n", "_all", "_t"), **common)
    return merged(first.unionByName(second), request, key, same)
