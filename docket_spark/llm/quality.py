"""Quality scores: random-indexing word vectors, pooled, and a small calibrated network.

Words are runs of letters and digits, or runs of other marks, case kept, hashed into ``BUCKETS``. Every
bucket has a fixed sparse random index vector. A bucket's word vector is the sum of the index vectors
of the words up to two places away, over all documents, scaled to unit length: counted in Spark as
whole numbers in blocks of fixed size, so the table that reaches the driver does not grow with the
corpus. A document is the mean of its words' vectors and the mean of their index vectors.

The network (one hidden layer of tanh units, one logistic output) is fitted with numpy on at most
``sample`` labelled documents, drawn by a hash of the id. A fifth of them is set apart: it chooses the
number of steps, then the temperature that makes the probabilities fit it best. Scores are computed in
Arrow batches over all whole texts.

Defined cases: a null or empty text has a zero vector and gets the network's score for it. Labels that
are null are not learned; several labels of one id count as their rounded mean. Without labels of both
kinds every score is the share of label 1, or one half without labels. Ids are passed on as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket_spark.llm.columns import by_bytes, column, field, utf8
from docket_spark.llm.words import runs

BUCKETS, SIZE, MARKS, REACH = 1 << 13, 64, 4, 2
BLOCKS = 64
SAMPLE = 12_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 40, 128, 3e-3
TEXT_BYTES = 1 << 19
_WORD = np.array([2 if c >= 128 or chr(c).isalnum() else 0 if c <= 32 else 1 for c in range(256)])


@functools.cache
def index_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and signs of each bucket's marks, and the same as a dense table."""
    random = np.random.default_rng(7)
    places = np.argsort(random.random((BUCKETS, SIZE)), axis=1)[:, :MARKS]
    signs = random.choice(np.array([-1.0, 1.0], dtype=np.float32), (BUCKETS, MARKS))
    dense = np.zeros((BUCKETS, SIZE), dtype=np.float32)
    np.put_along_axis(dense, places, signs, axis=1)
    return places, signs, dense


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word and the number of words of each text."""
    *_, hashed, many = runs(texts, _WORD)
    return (hashed >> np.uint64(64 - int(BUCKETS).bit_length() + 1)).astype(np.int64), many


def _contexts(texts: list[bytes], table: np.ndarray) -> None:
    """Adds the index vectors of each word's neighbours to the word's row of ``table``."""
    places, signs, _ = index_vectors()
    bucket, many = words_of(texts)
    text = np.repeat(np.arange(len(texts)), many)
    for step in range(1, REACH + 1):
        together = text[step:] == text[:-step]
        left, right = bucket[:-step][together], bucket[step:][together]
        # Pairs that recur are counted first: a repeated phrase costs one addition.
        pair, times = np.unique(left * BUCKETS + right, return_counts=True)
        left, right = pair // BUCKETS, pair % BUCKETS
        for here, there in ((left, right), (right, left)):
            cells = here[:, None] * SIZE + places[there]
            sums = np.bincount(
                cells.ravel(), (signs[there] * times[:, None]).ravel(), minlength=table.size
            )
            table += sums.astype(np.int64).reshape(table.shape)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The unit word vector of each bucket, from all texts."""
    rows = BUCKETS // BLOCKS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((BUCKETS, SIZE), dtype=np.int64)
        held: list[bytes] = []
        for batch in batches:
            for part in by_bytes(batch, "body", TEXT_BYTES):
                held += utf8(part.column("body"))
                if sum(map(len, held)) > TEXT_BYTES:
                    _contexts(held, table)
                    held = []
        if held:
            _contexts(held, table)
        yield from _blocks({k: table[k * rows : (k + 1) * rows] for k in range(BLOCKS)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, np.int64).reshape(rows, SIZE)
                sums[k] = sums[k] + own if k in sums else own
        yield from _blocks(sums)

    parts = docs.select(column(text).cast("string").alias("body")).mapInArrow(
        gather, "block int, sums binary"
    )
    table = np.zeros((BLOCKS, rows, SIZE))
    for k, raw in parts.repartition("block").mapInArrow(add, "block int, sums binary").collect():
        table[k] = np.frombuffer(raw, np.int64).reshape(rows, SIZE)
    table = table.reshape(BUCKETS, SIZE)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(length, 1)).astype(np.float32)


def _blocks(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if sums:
        yield pa.record_batch(
            [
                pa.array(list(sums), pa.int32()),
                pa.array([x.tobytes() for x in sums.values()], pa.binary()),
            ],
            names=["block", "sums"],
        )


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Per text the mean word vector and the mean index vector."""
    bucket, many = words_of(texts)
    result = np.zeros((len(texts), 2 * SIZE), dtype=np.float32)
    full = np.flatnonzero(many)
    if len(full):
        text = np.repeat(np.arange(len(texts)), many)
        pair, times = np.unique(text * BUCKETS + bucket, return_counts=True)
        text, bucket = pair // BUCKETS, pair % BUCKETS
        begin = np.searchsorted(text, full)
        weight = (times / many[text]).astype(np.float32)[:, None]
        both = np.concatenate([vectors, index_vectors()[2]], axis=1)
        result[full] = np.add.reduceat(both[bucket] * weight, begin, axis=0)
    return result


class Network:
    """Scaled inputs, one hidden layer, one logistic output divided by a temperature."""

    def __init__(self, inputs: np.ndarray, labels: np.ndarray, constant: float | None = None):
        self.constant = constant
        if constant is not None:
            return
        random = np.random.default_rng(11)
        apart = np.arange(len(inputs)) % 5 == 4
        self.mean, self.scale = inputs.mean(axis=0), inputs.std(axis=0) + 1e-6
        x = (inputs - self.mean) / self.scale
        width = x.shape[1]
        weights = [
            random.normal(0, 1 / np.sqrt(width), (width, HIDDEN)),
            np.zeros(HIDDEN),
            random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            np.zeros(1),
        ]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        best, step = (np.inf, weights), 0
        train = np.flatnonzero(~apart)
        for _ in range(EPOCHS):
            random.shuffle(train)
            for at in range(0, len(train), BATCH):
                rows = train[at : at + BATCH]
                step += 1
                for k, slope in enumerate(self._slopes(weights, x[rows], labels[rows])):
                    first, second = moments[k]
                    first = 0.9 * first + 0.1 * slope
                    second = 0.999 * second + 0.001 * slope**2
                    moments[k] = first, second
                    rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    weights[k] = weights[k] - rate * first / (np.sqrt(second) + 1e-8)
            loss = _loss(self._output(weights, x[apart]), labels[apart])
            if loss < best[0]:
                best = loss, list(weights)
        self.weights = best[1]
        output = self._output(self.weights, x[apart])
        steps = np.geomspace(0.25, 8, 61)
        self.temperature = steps[np.argmin([_loss(output / t, labels[apart]) for t in steps])]

    @staticmethod
    def _output(weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ weights[0] + weights[1]) @ weights[2] + weights[3]

    @staticmethod
    def _slopes(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        hidden = np.tanh(x @ weights[0] + weights[1])
        off = (_logistic(hidden @ weights[2] + weights[3]) - y) / len(y)
        back = np.outer(off, weights[2]) * (1 - hidden**2)
        decay = [1e-4 * weights[0], 0, 1e-4 * weights[2], 0]
        slopes = [x.T @ back, back.sum(axis=0), hidden.T @ off, off.sum(keepdims=True)]
        return [s + d for s, d in zip(slopes, decay, strict=True)]

    def score(self, inputs: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(inputs), self.constant)
        output = self._output(self.weights, (inputs - self.mean) / self.scale)
        return _logistic(output / self.temperature)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _loss(output: np.ndarray, labels: np.ndarray) -> float:
    chance = np.clip(_logistic(output), 1e-9, 1 - 1e-9)
    return float(-np.mean(labels * np.log(chance) + (1 - labels) * np.log(1 - chance)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    vectors: np.ndarray,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    learn_from: Column | None = None,
    sample: int = SAMPLE,
) -> Network:
    """A network from at most ``sample`` documents whose label row satisfies ``learn_from``."""
    usable = column(label).isNotNull() & column(doc_id).isNotNull()
    chosen = (
        labels.where(usable if learn_from is None else usable & learn_from)
        .groupBy(column(doc_id).alias("id"))
        .agg(F.round(F.avg(column(label))).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("body"))
    # At most ``sample`` ids and labels: a proven bound for the broadcast.
    drawn = rows.join(F.broadcast(chosen), "id").select("id", "label", "body")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "body", TEXT_BYTES):
                found = pooled(utf8(part.column("body")), vectors)
                yield pa.record_batch(
                    [
                        part.column("id"),
                        part.column("label"),
                        pa.array([x.tobytes() for x in found], pa.binary()),
                    ],
                    names=["id", "label", "vector"],
                )

    schema = T.StructType(
        [
            field(rows, "id"),
            T.StructField("label", T.IntegerType()),
            T.StructField("vector", T.BinaryType()),
        ]
    )
    pooled_rows = drawn.mapInArrow(pool, schema).orderBy(F.xxhash64("id"), "id", "vector")
    found = pooled_rows.limit(sample).select("label", "vector").toArrow()
    target = found.column("label").to_numpy().astype(float)
    inputs = np.frombuffer(b"".join(found.column("vector").to_pylist()), np.float32)
    ones = target.sum()
    if min(ones, len(target) - ones) < 5:
        share = (ones / len(target)) if len(target) else 0.5
        return Network(inputs, target, constant=float(share))
    return Network(inputs.reshape(-1, 2 * SIZE).astype(float), target)


def scores(
    docs: DataFrame,
    vectors: np.ndarray,
    network: Network,
    doc_id: str = "doc_id",
    text: str = "text",
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: its id, the columns of ``also``, score and predicted (1 if score >= 0.5)."""
    rows = docs.select(
        column(doc_id).alias(doc_id),
        *[value.alias(name) for name, value in (also or {}).items()],
        column(text).cast("string").alias("__body"),
    )
    kept = [name for name in rows.columns if name != "__body"]
    schema = T.StructType(
        [
            *[field(rows, name) for name in kept],
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            for part in by_bytes(batch, "__body", TEXT_BYTES):
                found = network.score(pooled(utf8(part.column("__body")), vectors))
                yield pa.record_batch(
                    [
                        *[part.column(name) for name in kept],
                        pa.array(found, pa.float64()),
                        pa.array((found >= 0.5).astype(np.int32)),
                    ],
                    names=[*kept, "score", "predicted"],
                )

    return rows.mapInArrow(judge, schema)
