"""Exact nearest neighbours of many requests, block against block.

Documents are dealt into cells by (route, salt), requests into blocks, and every block meets the cells
it has to be compared with in one ``cogroup``. A route is a small number that both sides carry: the
hash of a filter column here, a pivot in ``pivots``. A request names the routes it needs, so documents
of other routes never meet it, and documents of routes that nobody asks for do not leave the scan's
stage. How many salts and blocks a route gets follows from its counts, so a route with a third of all
documents has as many cells as its size asks for, and a task holds one cell and one block of requests,
both of bounded bytes.

Inside a meeting one matrix product gives all distances up to rounding. What is within the rounding
error of a request's k-th distance is computed again as a plain sum of squares and ranked exactly. A
meeting leaves at most k rows per request, and the rows of all meetings are merged by one more ranking.
Counts travel as scalar subqueries, so the whole search is one plan and nothing comes to the driver.

Copies: a document goes once to every block of requests of its route, a request once to every cell of its
routes. Their share in the cost falls with the block size, since a meeting costs their product.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket_spark.operators.ranking import first_rows

ROUTES = 64
CELL_BYTES = 64 << 20
BLOCK_BYTES = 32 << 20
# Distances held at once inside a meeting.
PRODUCT = 1 << 22


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """An array column without nulls, all of one length, as rows of 64-bit floats."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _allowed(asked: pa.Table, held: pa.Table, equal: Sequence[str], ranges: Mapping) -> list:
    """Functions from a slice of requests to the documents that one of their filters allows."""
    tests = []
    for name in equal:
        codes = held[name].combine_chunks().dictionary_encode()
        of = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        wanted = asked[name].combine_chunks()
        free = wanted.is_null().to_numpy(zero_copy_only=False)
        code = pc.fill_null(pc.index_in(wanted, value_set=codes.dictionary), -2)
        code = code.to_numpy(zero_copy_only=False)
        if not free.all():
            tests.append(lambda s, code=code, free=free, of=of: (code[s, None] == of) | free[s, None])
    for name, bounds in ranges.items():
        days = held[name].combine_chunks().cast(pa.date32()).cast(pa.int32())
        known = days.is_valid().to_numpy(zero_copy_only=False)
        day = days.fill_null(0).to_numpy(zero_copy_only=False)
        for column, inside in zip(bounds, (np.greater_equal, np.less), strict=True):
            edge = asked[column].combine_chunks().cast(pa.date32()).cast(pa.int32())
            free = edge.is_null().to_numpy(zero_copy_only=False)
            edge = edge.fill_null(0).to_numpy(zero_copy_only=False)
            if not free.all():
                tests.append(
                    lambda s, edge=edge, free=free, day=day, known=known, inside=inside: (
                        inside(day, edge[s, None]) & known
                    )
                    | free[s, None]
                )
    return tests


def meet(
    asked: pa.Table, held: pa.Table, key: str, equal: Sequence[str] = (), ranges: Mapping = {}
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per request the first ``_k`` documents by (distance, key) among those its filters allow:
    positions of requests and documents, and distances."""
    queries, documents = matrix(asked["query_vector"]), matrix(held["embedding"])
    many = asked["_k"].to_numpy()
    order = pc.sort_indices(held[key].combine_chunks()).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    tests = _allowed(asked, held, equal, ranges)
    norms = np.einsum("ij,ij->i", documents, documents)
    own = np.einsum("ij,ij->i", queries, queries)
    # The product's rounding error, generously.
    slack = 1e-14 * (queries.shape[1] + 8) * (own + norms.max(initial=0.0) + 1e-300)
    found = [np.zeros((3, 0))]
    step = max(1, PRODUCT // max(1, len(documents)))
    for start in range(0, len(queries), step):
        s = slice(start, min(start + step, len(queries)))
        near = own[s, None] + norms - 2 * (queries[s] @ documents.T)
        for test in tests:
            near[~test(s)] = np.inf
        k = int(min(many[s].max(initial=1), near.shape[1]))
        edge = np.partition(near, k - 1, axis=1)[:, k - 1] + slack[s]
        i, j = np.nonzero((near <= edge[:, None]) & np.isfinite(near))
        i += start
        apart = documents[j] - queries[i]
        distance = np.einsum("ij,ij->i", apart, apart)
        ranked = np.lexsort((place[j], distance, i))
        i, j, distance = i[ranked], j[ranked], distance[ranked]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        first = nth < many[i]
        found.append(np.array([i[first], j[first], distance[first]]))
    i, j, distance = np.concatenate(found, axis=1)
    return i.astype(np.int64), j.astype(np.int64), distance


def route_of(value: Column, routes: int = ROUTES) -> Column:
    """The route of a filter value, that of null included."""
    return F.pmod(F.xxhash64(value), F.lit(routes)).cast("int")


def search(
    documents: DataFrame,
    requests: DataFrame,
    key: str,
    request: str,
    equal: Sequence[str] = (),
    ranges: Mapping[str, tuple[str, str]] | None = None,
    cell_bytes: int = CELL_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per meeting and request its first ``_k`` documents: request, key, distance and _k.

    ``documents``: key, embedding, _route and the columns that are filtered. ``requests``: request,
    query_vector, _k, _routes (an array) and the values to filter by, NULL meaning any. Vectors that are
    null or not as long as the longest request's take no part.
    """
    ranges = dict(ranges or {})
    requests = requests.where(F.col("_k") > 0)
    held = documents.groupBy("_route").agg(F.count(F.lit(1)).alias("n"))
    asked = (
        requests.select(F.explode("_routes").alias("_route"), F.size("query_vector").alias("width"))
        .groupBy("_route")
        .agg(F.count(F.lit(1)).alias("m"), F.max("width").alias("width"))
    )
    # One entry a route; the number of routes is fixed.
    counts = F.struct("_route", F.struct("n", "m"))
    plan = held.join(asked, "_route").agg(
        F.struct(
            F.max("width").alias("width"), F.map_from_entries(F.collect_list(counts)).alias("cells")
        )
    )
    plan = plan.scalar()

    def parts(count: str, size: int) -> Column:
        """How many parts of ``size`` bytes the vectors of a route make."""
        found = F.ceil(F.col(f"_cell.{count}") * F.col("_plan.width") * 8 / size)
        return F.greatest(found, F.lit(1)).cast("int")

    def dealt(frame: DataFrame, vector: str) -> DataFrame:
        planned = frame.withColumn("_plan", plan).where(F.size(vector) == F.col("_plan.width"))
        with_cell = planned.withColumn("_cell", F.try_element_at(F.col("_plan.cells"), F.col("_route")))
        return (
            with_cell.where(F.col("_cell").isNotNull())
            .withColumns({"_salts": parts("n", cell_bytes), "_blocks": parts("m", block_bytes)})
            .drop("_plan", "_cell")
        )

    def count_up(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    sides = ("_route", "_salt", "_block")
    by_cell = (
        dealt(documents, "embedding")
        .select(
            key,
            "embedding",
            *equal,
            *ranges,
            "_route",
            F.pmod(F.xxhash64(key), "_salts").cast("int").alias("_salt"),
            count_up("_blocks").alias("_block"),
        )
    )
    edges = [name for pair in ranges.values() for name in pair]
    by_block = dealt(requests.withColumn("_route", F.explode("_routes")), "query_vector").select(
        request,
        "query_vector",
        "_k",
        *[F.col(name).alias(f"_want_{name}") for name in (*equal, *edges)],
        "_route",
        count_up("_salts").alias("_salt"),
        F.pmod(F.xxhash64(request), "_blocks").cast("int").alias("_block"),
    )
    wants = {name: f"_want_{name}" for name in (*equal, *edges)}
    schema = T.StructType(
        [
            T.StructField(request, requests.schema[request].dataType),
            T.StructField(key, documents.schema[key].dataType),
            T.StructField("distance", T.DoubleType()),
            T.StructField("_k", T.IntegerType()),
        ]
    )

    def solve(asked: pa.Table, held: pa.Table) -> pa.Table:
        back = {want: name for name, want in wants.items()}
        asked = asked.rename_columns([back.get(name, name) for name in asked.column_names])
        if not (asked.num_rows and held.num_rows):
            i = j = np.zeros(0, dtype=np.int64)
            distance = np.zeros(0)
        else:
            i, j, distance = meet(asked, held, key, equal, ranges)
        return pa.table(
            [asked[request].take(i), held[key].take(j), pa.array(distance), asked["_k"].take(i)],
            names=schema.names,
        )

    return by_block.groupBy(*sides).cogroup(by_cell.groupBy(*sides)).applyInArrow(solve, schema)


def merged(found: DataFrame, request: str, key: str, k: int | None) -> DataFrame:
    """The first rows of every request over all meetings, with their rank."""
    order = [F.col("distance").asc(), F.col(key).asc()]
    if k is not None:
        return first_rows(found, [request], order, k, "rank").drop("_k")
    # A meeting leaves no more than _k rows, so what is ranked here is short.
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(request).orderBy(*order)))
    return ranked.where(F.col("rank") <= F.col("_k")).drop("_k")


def wanted_rows(k: int | str) -> tuple[Column, int | None]:
    """How many rows a request wants: a number for all, or the name of a column of theirs."""
    if isinstance(k, str):
        return F.coalesce(F.col(k).cast("int"), F.lit(0)), None
    if k < 1:
        raise ValueError("k below 1: a search returns at least one row")
    return F.lit(k), k


def nearest_batch(
    index: DataFrame,
    requests: DataFrame,
    k: int | str,
    filters: Sequence[str] = (),
    ranges: Mapping[str, tuple[str, str]] | None = None,
    request: str = "question_id",
    key: str = "complaint_id",
    route: str | None = None,
    routes: int = ROUTES,
    cell_bytes: int = CELL_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k nearest documents of every request: request, key, distance, rank.

    ``requests`` has one row per request: its id, ``query_vector`` and the columns named by ``filters``
    and ``ranges``, NULL meaning no filter. ``filters`` are equal columns of both sides; ``ranges`` maps a
    date column of the index to the columns of its first day and the day after its last. ``k`` is a number
    or a column of the requests. ``route`` is the filter that most requests set (the first one by
    default): requests that set it meet documents of the same route only.
    """
    wanted, same = wanted_rows(k)
    route = route or (filters[0] if filters else None)
    if route is None:
        placed = index.withColumn("_route", F.lit(0))
        aimed = requests.withColumn("_routes", F.array(F.lit(0)))
    else:
        placed = index.withColumn("_route", route_of(F.col(route), routes))
        own = F.array(route_of(F.col(route), routes))
        aimed = requests.withColumn(
            "_routes",
            F.when(F.col(route).isNull(), F.sequence(F.lit(0), F.lit(routes - 1))).otherwise(own),
        )
    found = search(
        placed, aimed.withColumn("_k", wanted), key, request, filters, ranges, cell_bytes, block_bytes
    )
    return merged(found, request, key, same)
