"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Lengths are integers from 1 to the capacity, so how many pieces there are of each length describes
the whole corpus: at most ``capacity`` numbers reach the driver, whatever the size of the data. The
plan is made from these counts by large-item matching. Pieces above one third of the capacity meet at
most twice in a sequence: from the longest down, each is matched with the longest partner that fits.
Shorter pieces then go, from the longest down, into the tightest gap that still takes them; a new
sequence is opened only when no gap does. A plan line is a kind of sequence with its multiplicity, and
there are at most about 2.4 lines per possible length. The pieces themselves stay distributed: each
gets its number among the pieces of its length, counted inside salted groups and shifted by the earlier
groups' totals, and that number decides its sequence and place. A length has the more salts the more
pieces it has, so a group stays near GROUP_ROWS rows however long the documents are; the totals of the
groups are a table that is joined, not gathered.

Defined cases: a null text is the empty text, which is the closing id alone. Ids are passed on as they
are; rows that repeat are packed each. An empty table gives no pieces. Columns of any other name are never
read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket_spark.llm.columns import by_bytes, column, field, utf8
from docket_spark.llm.tokens import BATCH_BYTES, encoder
from docket_spark.session import cut_lineage

SALTS = 64
GROUP_ROWS = 100_000


def pieces_of(
    docs: DataFrame,
    vocabulary: str,
    capacity: int,
    doc_id: str = "doc_id",
    text: str = "text",
    closing_id: int = 0,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32. A long document's first piece takes the rest."""
    names = ("piece", "start", "length", "ids_crc32")
    schema = T.StructType(
        [
            field(docs, doc_id, "id"),
            T.StructField("piece", T.IntegerType()),
            *[T.StructField(name, T.LongType()) for name in names[1:]],
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        for batch in batches:
            for part in by_bytes(batch, "body", BATCH_BYTES):
                owner, rows = [], []
                texts = [x.decode("utf-8", "replace") for x in utf8(part.column("body"))]
                for k, found in enumerate(encode(texts)):
                    total = len(found) + 1
                    ids = np.append(found, closing_id).astype("<u4").tobytes()
                    first = total % capacity or capacity
                    for n, end in enumerate(range(first, total + 1, capacity)):
                        start = max(0, end - capacity) if n else 0
                        owner.append(k)
                        rows.append((n, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                made = np.array(rows, dtype=np.int64).reshape(-1, 4)
                yield pa.record_batch(
                    [
                        part.column("id").take(pa.array(owner, pa.int64())),
                        pa.array(made[:, 0].astype(np.int32)),
                        *[pa.array(made[:, c]) for c in (1, 2, 3)],
                    ],
                    names=["id", *names],
                )

    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("body"))
    return rows.mapInArrow(cut, schema)


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple]]:
    """Kinds of sequences as (how many, ((length, times), ...)) that hold all pieces counted."""
    left = dict(counts)
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    kinds: dict[int, list[tuple[int, tuple]]] = {}

    def add(gap: int, many: int, held: tuple) -> None:
        if many:
            kinds.setdefault(gap, []).append((many, held))

    ascending = sorted(large)
    for a in large:
        while left[a]:
            at = bisect.bisect_right(ascending, capacity - a) - 1
            while at >= 0 and not left[ascending[at]]:
                ascending.pop(at)
                at -= 1
            b = ascending[at] if at >= 0 else None
            if b == a and left[a] == 1:
                at -= 1
                while at >= 0 and not left[ascending[at]]:
                    ascending.pop(at)
                    at -= 1
                b = ascending[at] if at >= 0 else None
            if b is None:
                add(capacity - a, left[a], ((a, 1),))
                left[a] = 0
            elif b == a:
                add(capacity - 2 * a, left[a] // 2, ((a, 2),))
                left[a] %= 2
            else:
                many = min(left[a], left[b])
                add(capacity - a - b, many, ((a, 1), (b, 1)))
                left[a] -= many
                left[b] -= many

    gaps = sorted(kinds)
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(gaps, s)
            if at == len(gaps):
                gap, many, held = capacity, -(-left[s] // (capacity // s)), ()
            else:
                gap = gaps[at]
                many, held = kinds[gap].pop()
                if not kinds[gap]:
                    del kinds[gap]
                    gaps.pop(at)
            fits = gap // s
            full = min(many, left[s] // fits)
            rest = left[s] - full * fits if full < many else 0
            put = [(full, fits)] + ([(1, rest)] if rest else [])
            used = full + bool(rest)
            for n, times in put:
                if n:
                    into = gap - times * s
                    if into not in kinds:
                        bisect.insort(gaps, into)
                    add(into, n, (*held, (s, times)))
            if many > used:
                if gap not in kinds:
                    bisect.insort(gaps, gap)
                add(gap, many - used, held)
            left[s] -= full * fits + rest
    return [kind for gap in sorted(kinds) for kind in kinds[gap]]


def _slots(plan: list[tuple[int, tuple]]) -> np.ndarray:
    """Runs of places per length: length, first rank, first sequence, places each, first offset."""
    taken: dict[int, int] = {}
    runs, sequence = [], 0
    for many, held in plan:
        offset = 0
        for length, times in held:
            first = taken.get(length, 0)
            runs.append((length, first, sequence, times, offset))
            taken[length] = first + many * times
            offset += length * times
        sequence += many
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def _salted(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``pieces`` with a salt: more salts for a length that more pieces have, SALTS at least."""
    salts = [(n, max(SALTS, -(-many // GROUP_ROWS))) for n, many in counts.items()]
    dealt = pieces.sparkSession.createDataFrame(salts, "length long, salts long")
    # One row per length, at most capacity of them.
    joined = pieces.join(F.broadcast(dealt), "length")
    salt = F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.col("salts"))
    return joined.select(*pieces.columns, salt.alias("salt"))


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (columns id, piece, start, length, ids_crc32) with sequence_id and offset.

    ``pieces`` must give the same rows each time it is read, as a checkpoint does.
    """
    # At most capacity rows: the only ones that leave the executors.
    counts = {r["length"]: r["many"] for r in _counted(pieces, "length").collect()}
    slots = _slots(plan_sequences(counts, capacity))
    keys = slots[:, 0] << 44 | slots[:, 1]
    shared = pieces.sparkSession.sparkContext.broadcast((slots, keys))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        slots, keys = shared.value
        size, rank = length.to_numpy(), rank.to_numpy()
        run = slots[np.searchsorted(keys, size << 44 | rank, "right") - 1]
        k = rank - run[:, 1]
        return pd.DataFrame(
            {
                "sequence_id": run[:, 2] + k // run[:, 3],
                "offset": run[:, 4] + k % run[:, 3] * size,
            }
        )

    salted = _salted(pieces, counts)
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = _counted(salted, "length", "salt").select(
        "length", "salt", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("before")
    )
    order = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("number", F.row_number().over(order).cast("long") - 1)
    placed = numbered.join(groups, ["length", "salt"]).withColumn(
        "slot", slot("length", F.col("before") + F.col("number"))
    )
    return placed.select(*pieces.columns, "slot.sequence_id", "slot.offset")


def _counted(pieces: DataFrame, *keys: str) -> DataFrame:
    return pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("many"))


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
    closing_id: int = 0,
) -> DataFrame:
    """Per piece: its document's id, piece, start, length, ids_crc32, sequence_id and offset."""
    pieces = cut_lineage(pieces_of(docs, vocabulary, capacity, doc_id, text, closing_id))
    return place(pieces, capacity).withColumnRenamed("id", doc_id)
