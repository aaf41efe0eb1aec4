"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, which are put in another order.

A unit is a word with the white space before it; white space at the end of a text is a unit of its own.
A text of n units has n + 1 places to cut, and two of them are drawn from a hash of its id. To find them,
a text's bytes are cut into fixed blocks. A Fenwick tree over the blocks stores how many units end in
each and how many code points begin there. A descent by binary lifting finds the block in which a cut
lies, in the logarithm of the number of blocks, and only that block is looked at to find the place. Python
returns counts and places; Spark cuts and joins the texts.

Forms: ``psm`` is prefix, suffix, middle; ``spm`` is suffix, prefix, middle; ``plain`` is the text as it
is. Each part stands behind its mark. Texts that contain a mark stay plain, so an output has each mark
once and ``restored`` cuts it there again.

Defined cases: a null text is the empty text, which stays plain, and so does a null id draw like an empty
one. Rows that repeat an id and a text get the same result each. White space is the six ASCII characters;
a text of white space only is one unit. Texts of any length are cut as a whole. An empty table gives an
empty result. Further columns of any name are not read and do not pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket_spark.llm.columns import by_bytes, column, field, text_of, utf8

BLOCK_BYTES = 1024
TEXT_BYTES = 1 << 20
MARKS = ("<P>", "<S>", "<M>")
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


class Fenwick:
    """Prefix sums over blocks of several counts at once; ``counts`` has one row per block."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        before = np.zeros((n + 1, counts.shape[1]), dtype=np.int64)
        np.cumsum(counts, axis=0, out=before[1:])
        node = np.arange(1, n + 1)
        self.tree = np.zeros_like(before)
        self.tree[1:] = before[1:] - before[node - (node & -node)]
        self.total = before[-1]

    def before_reaching(self, wanted: int) -> tuple[int, np.ndarray]:
        """The first block by whose end the first count has reached ``wanted``, and the sums before it."""
        at, sums = 0, np.zeros_like(self.total)
        step = 1 << (len(self.tree) - 1).bit_length()
        while step:
            ahead = at + step
            if ahead < len(self.tree) and sums[0] + self.tree[ahead, 0] < wanted:
                at, sums = ahead, sums + self.tree[ahead]
            step >>= 1
        return at, sums


class Units:
    """The units of one text and where they end."""

    def __init__(self, text: bytes, block: int = BLOCK_BYTES):
        self.text, self.block = np.frombuffer(text, np.uint8), block
        starts = np.arange(0, len(text), block)
        counts = [[len(self._ends(at)), self._points(at, at + block)] for at in starts]
        self.tree = Fenwick(np.array(counts, dtype=np.int64).reshape(-1, 2))
        self.many = int(self.tree.total[0])

    def _ends(self, at: int) -> np.ndarray:
        """The last bytes of units in the block that begins at ``at``, counted from there."""
        part = _SPACE[self.text[at : at + self.block + 1]]
        if at + self.block >= len(self.text):
            # The text's last byte ends a unit, be it a word or white space.
            last = ~part & np.append(part[1:], True)
            last[-1] = True
        else:
            last = ~part[:-1] & part[1:]
        return np.flatnonzero(last)

    def _points(self, at: int, end: int) -> int:
        return int(np.count_nonzero((self.text[at:end] & 0xC0) != 0x80))

    def points_until(self, unit: int) -> int:
        """Code points in the first ``unit`` units."""
        if not unit:
            return 0
        block, (units, points) = self.tree.before_reaching(unit)
        at = block * self.block
        end = at + int(self._ends(at)[unit - units - 1]) + 1
        return int(points) + self._points(at, end)


def cuts(text: bytes, first: int, second: int, block: int = BLOCK_BYTES) -> tuple[int, int, int]:
    """The number of units, and the code points before each cut; a draw is taken modulo units + 1."""
    units = Units(text, block)
    low, high = sorted((first % (units.many + 1), second % (units.many + 1)))
    return units.many, units.points_until(low), units.points_until(high)


def drawn(doc_id: Column, seed: int, nth: int) -> Column:
    """The ``nth`` of the eight whole numbers below 2^32 that the seed and an id give."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * nth + 1, 8), 16, 10).cast("long")


def check_marks(marks: tuple[str, str, str]) -> None:
    """No mark may end in what another, or itself, begins with: an output could be cut in two ways."""
    for a, b in itertools.product(marks, marks):
        shared = any(a.endswith(b[:n]) for n in range(1, len(b)))
        if not a or shared or (a != b and a in b):
            raise ValueError(f"marks overlap: {a!r} and {b!r}")
    if len(set(marks)) < 3:
        raise ValueError("marks must differ")


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = 42,
    percent: int = 50,
    percent_spm: int = 80,
    marks: tuple[str, str, str] = MARKS,
    block: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row: its id, n (units), form, prefix_chars and middle_chars (null if plain), and output."""
    check_marks(marks)
    rows = docs.select(
        column(doc_id).alias("id"),
        text_of(text).alias("body"),
        *[drawn(column(doc_id), seed, k).alias(f"h{k + 1}") for k in range(4)],
    )
    counts = ("n", "before", "until")
    schema = T.StructType(
        [
            *[field(rows, name) for name in ("id", "body", "h3", "h4")],
            *[T.StructField(name, T.LongType()) for name in counts],
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "body", TEXT_BYTES):
                draws = (part.column(name).to_pylist() for name in ("h1", "h2"))
                found = [
                    cuts(x, a, b, block)
                    for x, a, b in zip(utf8(part.column("body")), *draws, strict=True)
                ]
                places = np.array(found, dtype=np.int64).reshape(-1, 3)
                yield pa.record_batch(
                    [
                        *[part.column(name) for name in ("id", "body", "h3", "h4")],
                        *[pa.array(places[:, k]) for k in range(3)],
                    ],
                    names=schema.names,
                )

    placed = rows.mapInArrow(cut, schema)
    body = F.col("body")
    whole = (F.col("h3") % 100 >= percent) | (F.length(body) == 0)
    for mark in marks:
        whole = whole | body.contains(mark)
    form = F.when(whole, "plain").when(F.col("h4") % 100 < percent_spm, "spm").otherwise("psm")
    after, before, until = F.length(body), F.col("before"), F.col("until")

    def piece(start: Column, end: Column) -> Column:
        return F.substring(body, (start + 1).cast("int"), (end - start).cast("int"))

    prefix = F.concat(F.lit(marks[0]), piece(F.lit(0), before))
    suffix = F.concat(F.lit(marks[1]), piece(until, after))
    middle = F.concat(F.lit(marks[2]), piece(before, until))
    return placed.withColumn("form", form).select(
        F.col("id").alias(doc_id),
        "n",
        "form",
        F.when(F.col("form") != "plain", before).alias("prefix_chars"),
        F.when(F.col("form") != "plain", until - before).alias("middle_chars"),
        F.when(F.col("form") == "plain", body)
        .when(F.col("form") == "spm", F.concat(suffix, prefix, middle))
        .otherwise(F.concat(prefix, suffix, middle))
        .alias("output"),
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of."""
    parts = F.split(output, "|".join(rf"\Q{mark}\E" for mark in marks), -1)
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(first, middle, second))
        .otherwise(F.concat(second, middle, first))
    )
