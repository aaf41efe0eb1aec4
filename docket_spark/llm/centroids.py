"""Centroid clustering by Lloyd's rounds over blocks of columns, in exact whole numbers.

Components are turned into whole numbers, so sums and distances are exact and do not depend on the order
in which tasks add them. Vectors are cut once into blocks of rows, and each block into shards of
``shard_width`` columns; a shard of a block is one row (block, shard, matrix). Shards are written once, as a
table in the shared folder that is bucketed by (block, shard).

A round is one job. A task takes a shard of a block and that shard's slice of the centroids, and computes
the partial squared distances of the block's vectors to all centroids. The partial distances are added by
block and the smallest is taken, ties to the smaller number. The choices go back to the shards by (block,
shard), where the matrices already lie, so that only choices move. Each shard sums its own columns by
centroid, the sums are added over the blocks, and each slice is replaced by floor(sum / count). A slice is
one row; no task holds a whole centroid unless there is one shard only. Slices are broadcast below
``BROADCAST_BYTES`` and joined on (shard, part) otherwise, each part being a share of the blocks.

Nothing grows with a frequent vector or a large cluster: rows are keyed by block, and sums are made per
task before they move.

Defined cases: vectors that are null, of another length, or hold a null or a component that is not finite
are left out. Ids may be null or repeat; each row is a vector of its own. First centroids go by the hash of the
id, then by components. Equal vectors get the same centroid. With fewer vectors than ``clusters`` there
are as many centroids as vectors. A centroid without vectors stays where it is. An empty table gives an
empty result. Components so large that a distance would not fit into 64 bits stop the job with a message.
Further columns of any name are not read and do not pass.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket_spark.llm.columns import column, field
from docket_spark.plans.publish import SharedFiles
from docket_spark.session import checkpoint_folder, cut_lineage

SHARD_WIDTH, BLOCK_ROWS = 16, 4096
BROADCAST_BYTES = 16 << 20
# With slices too large to broadcast, blocks are dealt into so many parts a shard.
PARTS = 64
IDS = -1


def _largest(width: int) -> int:
    """The largest absolute component for which squared distances fit into 64 bits."""
    return math.isqrt((2**63 - 1) // max(width, 1)) // 2


def whole_vectors(
    vectors: DataFrame, key: str, vector: str, width: int, scale: int
) -> DataFrame:
    """The vectors that are kept, as (id, cells), cells being floor(scale * component)."""
    cells = column(vector).cast("array<double>")
    finite = F.forall(cells, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    # NaN is above all numbers here, so it is not finite either.
    rows = vectors.select(column(key).alias("id"), F.when((F.size(cells) == width) & finite, cells).alias("cells"))
    bound = float(_largest(width))

    def whole(x: Column) -> Column:
        y = F.floor(x * scale)
        return F.when(F.abs(x * scale) < bound, y).otherwise(
            F.raise_error(F.lit(f"a component is beyond {bound / scale:g}: distances need over 64 bits")).cast("long")
        )

    return rows.where(F.col("cells").isNotNull()).select("id", F.transform("cells", whole).alias("cells"))


def blocks_of(
    kept: DataFrame, width: int, shard_width: int = SHARD_WIDTH, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``kept`` as rows (block, shard, ids, matrix): one row of ids and one matrix a shard for each
    block. A matrix holds its columns one after another, as 64-bit numbers in bytes."""
    shards = [(k, at, min(at + shard_width, width)) for k, at in enumerate(range(0, width, shard_width))]
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("shard", T.IntegerType()),
            T.StructField("ids", T.ArrayType(kept.schema["id"].dataType)),
            T.StructField("matrix", T.BinaryType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                cells = part.column("cells").flatten().to_numpy().reshape(-1, width)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                many = len(shards) + 1
                yield pa.record_batch(
                    [
                        pa.array([number] * many, pa.int64()),
                        pa.array([IDS, *[k for k, *_ in shards]], pa.int32()),
                        pa.concat_arrays([ids, pa.nulls(many - 1, ids.type)]),
                        pa.array([None, *[cells[:, a:b].tobytes("F") for _, a, b in shards]], pa.binary()),
                    ],
                    names=schema.names,
                )
                number += 1

    # A task that is run again must cut the same blocks, whatever order its rows come in.
    return kept.sortWithinPartitions("id", "cells").mapInArrow(cut, schema)


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> DataFrame:
    """(cluster, cells) of the vectors with the smallest hashes of their ids."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(hashed.alias("hash"), "cells").orderBy("hash", "cells").limit(clusters)
    # These are ``clusters`` rows, so one task may number them.
    number = F.row_number().over(Window.orderBy("hash", "cells")) - 1
    return first.select(number.alias("cluster"), "cells")


def slices_of(centroids: DataFrame, width: int, shard_width: int) -> DataFrame:
    """Centroids (cluster, cells) as (shard, cluster, cells), each with the shard's columns."""
    parts = [F.slice("cells", at + 1, shard_width) for at in range(0, width, shard_width)]
    return centroids.select("cluster", F.posexplode(F.array(*parts)).alias("shard", "cells")).select(
        "shard", "cluster", "cells"
    )


def _matrix(raw: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(columns, -1)


def partial_distances(with_slices: DataFrame) -> DataFrame:
    """Per shard of a block, from its matrix and slice: block, and distances to each centroid as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw, rows in zip(batch["matrix"], batch["slice"], strict=True):
                centers = np.array(rows.values.field("cells").to_pylist(), dtype=np.int64)
                cells = _matrix(raw.as_py(), centers.shape[1])
                total = np.zeros((len(centers), cells.shape[1]), dtype=np.int64)
                for j, values in enumerate(cells):
                    apart = values - centers[:, j, None]
                    total += apart * apart
                found.append(total.tobytes())
            yield pa.record_batch([batch["block"], pa.array(found, pa.binary())], names=["block", "partial"])

    return with_slices.select("block", "matrix", "slice").mapInArrow(work, "block long, partial binary")


def choices(partial: DataFrame, clusters: int) -> DataFrame:
    """Per block: the number of the nearest centroid and the distance of each of its vectors."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in table["partial"])
        total = total.reshape(clusters, -1)
        nearest = total.argmin(axis=0)  # the first of equal ones
        least = total[nearest, np.arange(total.shape[1])]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(least)], pa.int32()), pa.array(x)) for x in (nearest.astype(np.int32), least)]
        return pa.table([table["block"].slice(0, 1), *lists], names=["block", "cluster", "distance"])

    return partial.groupBy("block").applyInArrow(add, "block long, cluster array<int>, distance array<long>")


def shard_sums(joined: DataFrame, clusters: int, shard_width: int) -> DataFrame:
    """Per shard and centroid: count and the sums s0, s1, ... of its columns, added over all blocks."""
    sums = [f"s{j}" for j in range(shard_width)]
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("cluster", T.IntegerType()),
            *[T.StructField(name, T.LongType()) for name in ("count", *sums)],
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, raw, chosen in zip(*(batch[x] for x in ("shard", "matrix", "cluster")), strict=True):
                of = chosen.values.to_numpy()
                order = np.argsort(of, kind="stable")
                present, at = np.unique(of[order], return_index=True)
                cells = np.frombuffer(raw.as_py(), "<i8").reshape(-1, len(of))
                table = held.setdefault(shard.as_py(), np.zeros((clusters, shard_width + 1), dtype=np.int64))
                table[present, 0] += np.diff(np.append(at, len(of)))
                table[present, 1 : len(cells) + 1] += np.add.reduceat(cells[:, order], at, axis=1).T
        for shard, table in held.items():
            some = np.flatnonzero(table[:, 0])
            columns = [np.full(len(some), shard, np.int32), some.astype(np.int32), *table[some].T]
            yield pa.record_batch([pa.array(x) for x in columns], names=schema.names)

    return (
        joined.select("shard", "matrix", "cluster")
        .mapInArrow(work, schema)
        .groupBy("shard", "cluster")
        .agg(*[F.sum(name).alias(name) for name in ("count", *sums)])
    )


def _floored(total: Column, count: Column) -> Column:
    """floor(total / count) of whole numbers."""
    return ((total - F.pmod(total, count)) / count).cast("long")


class Lloyd:
    """The state of one clustering: where the blocks lie and what the slices are."""

    def __init__(self, kept: DataFrame, width: int, clusters: int, seed: int, shard_width: int, block_rows: int):
        self.width, self.shard_width = width, shard_width
        self.session = kept.sparkSession
        self.table = f"lloyd_{uuid.uuid4().hex}"
        self.folder = f"{checkpoint_folder(self.session)}/{self.table}"
        buckets = int(self.session.conf.get("spark.sql.shuffle.partitions"))
        keys = ("block", "shard")
        placed = blocks_of(kept, width, shard_width, block_rows).repartition(buckets, *keys)
        bucketed = placed.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", self.folder)
        bucketed.saveAsTable(self.table)
        self.placed = self.session.table(self.table)
        self.blocks = self.placed.where(F.col("shard") != IDS).select("block", "shard", "matrix")
        first = cut_lineage(first_centroids(kept, clusters, seed))
        self.clusters = first.count()
        self.slices = cut_lineage(slices_of(first, width, shard_width))

    def _with_slices(self) -> DataFrame:
        rows = self.slices.groupBy("shard").agg(
            F.array_sort(F.collect_list(F.struct("cluster", "cells"))).alias("slice")
        )
        if 8 * self.clusters * self.width <= BROADCAST_BYTES:
            return self.blocks.join(F.broadcast(rows), "shard")
        part = F.pmod("block", F.lit(PARTS))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))
        return self.blocks.withColumn("part", part).join(
            rows.withColumn("part", every), ["shard", "part"]
        )

    def assigned(self) -> DataFrame:
        """Per block: centroid and distance of each of its vectors."""
        return choices(partial_distances(self._with_slices()), self.clusters)

    def with_choices(self) -> DataFrame:
        """Each matrix with the centroids that its block's vectors chose."""
        count = -(-self.width // self.shard_width)
        shards = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        chosen = self.assigned().select("block", shards.alias("shard"), "cluster")
        return self.blocks.join(chosen, ["block", "shard"])

    def round(self) -> None:
        """Assign every vector, then replace every slice."""
        sums = shard_sums(self.with_choices(), self.clusters, self.shard_width)
        means = F.array(*[_floored(F.col(f"s{j}"), F.col("count")) for j in range(self.shard_width)])
        fresh = sums.select("shard", "cluster", means.alias("means"))
        self.slices = cut_lineage(
            self.slices.join(fresh, ["shard", "cluster"], "left").select(
                "shard",
                "cluster",
                F.coalesce(F.slice("means", 1, F.size("cells")), "cells").alias("cells"),
            )
        )

    def drop(self) -> None:
        """Remove the written blocks; slices and checkpointed results stay."""
        self.session.sql(f"DROP TABLE {self.table}")
        SharedFiles(self.session).delete(self.folder)

    def centroids(self) -> DataFrame:
        """(cluster, cells), the slices put together."""
        parts = F.array_sort(F.collect_list(F.struct("shard", "cells")))
        return self.slices.groupBy("cluster").agg(
            F.flatten(F.transform(parts, lambda x: x["cells"])).alias("cells")
        )


def cluster(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    width: int = 64,
    clusters: int = 8,
    rounds: int = 10,
    scale: int = 1024,
    seed: int = 3,
    shard_width: int = SHARD_WIDTH,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Members (key, cluster, distance), one row per vector that is kept, and the final centroids
    (cluster, cells). Distances are squared, in units of 1 / scale."""
    if min(width, clusters, shard_width, block_rows) < 1 or rounds < 0:
        raise ValueError("width, clusters, shard_width and block_rows must be positive")
    kept = whole_vectors(vectors, key, vector, width, scale)
    state = Lloyd(kept, width, clusters, seed, shard_width, block_rows)
    for _ in range(rounds if state.clusters else 0):
        state.round()
    ids = state.placed.where(F.col("shard") == IDS).select("block", "ids")
    members = ids.join(state.assigned(), "block").select(
        F.inline(F.arrays_zip("ids", "cluster", "distance"))
    )
    members = cut_lineage(members.select(F.col("ids").alias(key), "cluster", "distance"))
    state.drop()
    return members, state.centroids()


def with_inertia(members: DataFrame, centroids: DataFrame) -> DataFrame:
    """``members`` with cluster_inertia and inertia (distances summed over its cluster and over all)
    and centroid_sha256 (of the centroid's components, joined by commas)."""
    summed = members.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = summed.agg(F.sum("cluster_inertia")).scalar()
    listed = F.array_join(F.transform("cells", lambda x: x.cast("string")), ",")
    named = centroids.select("cluster", F.sha2(listed, 256).alias("centroid_sha256"))
    # One row per centroid, so this side may be broadcast.
    by_cluster = summed.join(named, "cluster").select("*", total.alias("inertia"))
    return members.join(F.broadcast(by_cluster), "cluster")
