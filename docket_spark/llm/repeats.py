"""Substring deduplication by sliding spans of sentences.

A sentence ends at a line break or at . ! ? before white space. Inside a sentence, of every ``STRETCH``
consecutive words that lie ``MARGIN`` or more words from both its ends, the last one with the smallest
hash ends a part, and parts count as sentences. Whether a word does depends on the words around it only,
never on the length of the sentence, so a passage is cut alike wherever it stands, but for
``MARGIN + STRETCH`` words at each of its ends; no part has more than ``2 * MARGIN + STRETCH`` words. A span starts at every sentence and takes as many following
ones as make at least two sentences and ``least_words`` words. With ``both_ends`` another one ends at
every sentence and takes as many before it: the two families cover every repeated run of sentences that
holds a span, also its short last sentences. Spans are equal when their words are, A-Z
lower-cased and white space apart. Every span is hashed to 128 bits, spans are joined globally, and the
sentences of every span that is not the first of its kind are removed. First is the smallest document
id, then the earliest place.

Python emits each different span of a document once, with its later places beside it, so a line that
fills a document is one row. The first document of a span is a minimum that Spark aggregates inside
every task before the shuffle, and the join back has one row per span on its side, so adaptive execution
can split a frequent one. Removed places are gathered per document only, and ``remove_repeats`` cuts.

Defined cases: a null text has no sentences. Texts without a span of ``least_words`` words lose nothing.
``repeats`` takes rows with equal ids, or without one, as one document. ``remove_repeats`` tells rows by
id and text, so each row loses places of its own text only; rows that repeat both keep what the first of
them keeps. An empty table gives an empty result. Further columns pass through ``remove_repeats`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket_spark.llm.columns import by_bytes, column, field, utf8, whole_row
from docket_spark.llm.words import mixed, powers, runs

LEAST_WORDS, MARGIN, STRETCH = 20, 8, 8
TEXT_BYTES = 1 << 19
_WORD = np.array([0 if c == 32 or 9 <= c <= 13 else 1 for c in range(256)])
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def inner_ends(word: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Words that end a part inside a sentence, by hashes and by which words end a sentence."""
    if len(word) < STRETCH:
        return np.zeros(0, np.int64)
    until = np.flatnonzero(last)
    number = np.cumsum(last) - last
    place = np.arange(len(word))
    before = place - np.append(0, until[:-1] + 1)[number]
    behind = until[number] - place
    opening = np.flatnonzero((before >= MARGIN) & (behind >= MARGIN + STRETCH - 1))
    stretches = np.lib.stride_tricks.sliding_window_view(word, STRETCH)[opening, ::-1]
    return opening + STRETCH - 1 - np.argmin(stretches, axis=1)


def sentence_spans(
    texts: list[bytes], least_words: int, both_ends: bool = False
) -> tuple[np.ndarray, ...]:
    """Per different span: its text, two hashes, and its first and end code point in the text."""
    joined, start, stop, word, many = runs([x.translate(_LOWER) for x in texts], _WORD)
    if not len(word):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    text = np.repeat(np.arange(len(texts)), many)
    breaks = np.cumsum(joined == 10)
    stopped = np.isin(joined[stop - 1], np.frombuffer(b".!?", np.uint8))
    last = np.append(breaks[start[1:]] != breaks[stop[:-1] - 1], True) | stopped
    last[inner_ends(word, last)] = True
    end = np.flatnonzero(last) + 1
    begin = np.append(0, end[:-1])
    # The sentence that holds the span's least_words-th word, but at least the next one.
    until = np.searchsorted(end, begin + least_words, "left")
    until = np.maximum(until, np.arange(len(begin)) + 1)
    inside = until < len(end)
    of, until = np.flatnonzero(inside), until[inside]
    if both_ends:
        # The sentence that holds the least_words-th word from the end, but at least the one before.
        since = np.searchsorted(begin, end - least_words, "right") - 1
        since = np.minimum(since, np.arange(len(end)) - 1)
        inside = since >= 0
        ends_here = np.flatnonzero(inside)
        both = np.unique(
            np.array([np.append(of, since[inside]), np.append(until, ends_here)]), axis=1
        )
        of, until = both
    inside = text[begin[of]] == text[end[until] - 1]
    begin, finish = begin[of[inside]], end[until[inside]]
    hashes = []
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        up, down = powers(1 << int(len(word)).bit_length(), odd)
        total = np.append(np.uint64(0), np.cumsum(word * up[: len(word)]))
        hashes.append(mixed((total[finish] - total[begin]) * down[begin]))
    points = np.cumsum((joined & 0xC0) != 0x80)
    base = np.append(0, np.cumsum([len(x) + 1 for x in texts]))[text[begin]]
    first = points[start[begin]] - points[base] - 1
    until_point = points[stop[finish - 1] - 1] - points[base]
    return text[begin], *hashes, first, until_point


def _spans(
    docs: DataFrame, doc_id: str, text: str, least_words: int, both_ends: bool
) -> DataFrame:
    """Per document and different span: id, h1, h2, start, end, and later (its later places)."""
    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("body"))
    place = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType(
        [
            field(rows, "id"),
            T.StructField("h1", T.LongType()),
            T.StructField("h2", T.LongType()),
            *place.fields,
            T.StructField("later", T.ArrayType(place)),
        ]
    )
    arrow_place = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "body", TEXT_BYTES):
                owner, h1, h2, start, end = sentence_spans(
                    utf8(part.column("body")), least_words, both_ends
                )
                order = np.lexsort((start, h2, h1, owner))
                owner, h1, h2, start, end = (x[order] for x in (owner, h1, h2, start, end))
                new = np.ones(len(owner), dtype=bool)
                new[1:] = (
                    (owner[1:] != owner[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                )
                at = np.flatnonzero(new)
                offsets = np.append(0, np.cumsum(np.diff(np.append(at, len(owner))) - 1))
                places = pa.StructArray.from_arrays(
                    [pa.array(x[~new], pa.int32()) for x in (start, end)], fields=list(arrow_place)
                )
                yield pa.record_batch(
                    [
                        part.column("id").take(pa.array(owner[at])),
                        pa.array(h1[at].view(np.int64)),
                        pa.array(h2[at].view(np.int64)),
                        pa.array(start[at], pa.int32()),
                        pa.array(end[at], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), places),
                    ],
                    names=["id", "h1", "h2", "start", "end", "later"],
                )

    return rows.mapInArrow(emit, schema)


def merged_places(places: Column) -> Column:
    """Sorted places with those that overlap or are a white space apart made one."""

    def step(held: Column, x: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        longer = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")
        )
        joins = last["end"] >= x["start"] - 1
        return F.when(
            F.coalesce(joins, F.lit(False)),
            F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(longer)),
        ).otherwise(F.concat(held, F.array(x)))

    return F.aggregate(places, F.array().cast("array<struct<start:int,end:int>>"), step)


def repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_words: int = LEAST_WORDS,
    both_ends: bool = False,
) -> DataFrame:
    """Per document that loses sentences: its id, the stretches removed (start, end, in code points,
    merged and in order), and the smallest first document of its repeated spans."""
    spans = _spans(docs, doc_id, text, least_words, both_ends)
    firsts = (
        spans.groupBy("h1", "h2")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("many"))
        .where("many > 1")
        .select(F.struct("h1", "h2").alias("key"), "first_id")
    )
    keyed = spans.select(F.struct("h1", "h2").alias("key"), "id", "start", "end", "later")
    known = keyed.join(firsts, "key", "left").where(
        (F.size("later") > 0) | ~F.coalesce(F.col("id").eqNullSafe(F.col("first_id")), F.lit(True))
    )
    here = F.array(F.struct("start", "end"))
    repeated = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    places = F.when(repeated, F.concat(here, "later")).otherwise(F.col("later"))
    removed = known.select(
        "id", F.coalesce("first_id", "id").alias("first_id"), F.inline(places)
    )
    sorted_places = F.array_sort(F.collect_set(F.struct("start", "end")))
    return (
        removed.groupBy("id")
        .agg(sorted_places.alias("places"), F.min("first_id").alias("first_id"))
        .select(
            F.col("id").alias(doc_id),
            F.col("first_id").alias("first_" + doc_id),
            merged_places(F.col("places")).alias("removed"),
        )
    )


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_words: int = LEAST_WORDS,
    both_ends: bool = False,
) -> DataFrame:
    """``docs`` with all columns, its texts without the sentences that an earlier place has."""
    body_of = column(text).cast("string")
    own = column(doc_id)
    digest = F.sha2(F.coalesce(body_of, F.lit("")), 256)
    # Rows without an id come last, so another row is the first of a span where there is one.
    key = F.struct(own.isNull().alias("none"), own.alias("id"), digest.alias("digest"))
    rows = docs.select(whole_row(docs).alias("row"), key.alias("key"), body_of.alias("body"))
    found = repeats(rows, "key", "body", least_words, both_ends).select(
        F.col("key").alias("found"), "removed"
    )
    body = F.col("body")
    joined = rows.join(found, F.col("key").eqNullSafe(F.col("found")), "left")
    # The stretches between those removed, put together again.
    edges = F.concat(
        F.array(F.lit(0)), F.transform("removed", lambda x: x["end"])
    )
    kept = F.array_join(
        F.zip_with(
            edges,
            F.concat(F.transform("removed", lambda x: x["start"]), F.array(F.length(body))),
            lambda a, b: F.substring(body, a + 1, F.greatest(b - a, F.lit(0))),
        ),
        "",
    )
    cut = F.when(F.col("removed").isNull(), body).otherwise(kept)
    fields = [
        (cut if name == text else F.col("row")[name]).alias(name)
        for name in docs.columns
    ]
    return joined.select(*fields)
