"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the ``ranks`` most frequent n-grams (one to three letters, words padded by a
blank) of a language's training texts, most frequent first. A document's own list is compared with each
profile by out-of-place distance: the sum of the differences in rank, an n-gram that a profile lacks
counting ``ranks``. The nearest profile names the language. Its score is the share of exp(-distance)
among all profiles, distances being scaled by the largest possible one and ``SHARPNESS``.

Profiles are counted in Spark over about ``per_language`` training documents of each language, drawn by
a hash of the id; only the ranked lists, ``ranks`` rows a language, reach the driver. Every whole text
is scored in Arrow batches of bounded size.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text when
there is nothing to learn from. Equal counts rank by code points, equal distances by language name. Ids
are passed on as they are; rows that repeat are scored each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket_spark.llm.columns import by_bytes, column, field, rows_kept, utf8

UNKNOWN = "und"
RANKS = 300
PER_LANGUAGE = 4000
SHARPNESS = 40.0
TEXT_BYTES = 1 << 18
_CODE = 21  # bits of a code point


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ranked_ngrams(texts: list[bytes], ranks: int | None) -> tuple[np.ndarray, ...]:
    """The n-grams of each text as (text, gram, count, rank), by text and rank.

    A gram has the code points of its letters, 21 bits each; a blank is 0. With ``ranks`` None the
    texts count as one and no rank is cut.
    """
    lowered = [x.decode("utf-8", "replace").lower() for x in texts]
    sizes = np.array([len(x) + 1 for x in lowered])
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le"), np.uint32)
    owner = np.append(0, np.repeat(np.arange(len(texts)), sizes))
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:] & ~letter[:-1]
    codes, owner, letter = codes[keep], owner[keep], letter[keep]
    if ranks is None:
        owner = np.zeros_like(owner)
    alphabet, small = np.unique(np.where(letter, codes, 0), return_inverse=True)
    if not letter.any():
        return (np.zeros(0, np.int64),) * 4
    if alphabet[0]:  # no blank, so that code 0 stays free for "no letter"
        alphabet, small = np.append(0, alphabet), small + 1
    bits = int(len(alphabet) - 1).bit_length()
    small = small.astype(np.int64)
    two = small[:-1] << bits | small[1:]
    three = two[:-1] << bits | small[2:]
    # A single letter is written as a gram whose last two places are empty.
    place = owner << (3 * bits + 2)
    one = place[letter] | 1 << (3 * bits) | small[letter]
    # The blank between two texts serves both; a gram belongs to the text of its letters.
    of_pair = np.where(letter[:-1], place[:-1], place[1:])
    lettered = letter[:-1] | letter[1:]
    pair = of_pair[lettered] | 2 << (3 * bits) | two[lettered]
    inner = letter[1:-1]
    triple = place[1:-1][inner] | 3 << (3 * bits) | three[inner]
    found = np.sort(np.concatenate([one, pair, triple]))
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    count = np.diff(np.append(first, len(found)))
    found = found[first]
    text = found >> (3 * bits + 2)
    mask = (1 << bits) - 1
    gram = np.zeros(len(found), dtype=np.int64)
    length = found >> (3 * bits) & 3
    for k in (2, 1, 0):
        code = np.where(k < length, alphabet[found >> (k * bits) & mask], 0).astype(np.int64)
        gram = gram << _CODE | code
    gram |= np.where(length == 2, np.int64(1) << 62, 0)  # pairs with a blank are not single letters
    order = np.lexsort((gram, -count, text))
    text, gram, count = text[order], gram[order], count[order]
    begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    rank = np.arange(len(text)) - np.repeat(begin, np.diff(np.append(begin, len(text))))
    if ranks is not None:
        top = rank < ranks
        text, gram, count, rank = text[top], gram[top], count[top], rank[top]
    return text, gram, count, rank


def learn_profiles(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    learn_from: Column | None = None,
    ranks: int = RANKS,
    per_language: int = PER_LANGUAGE,
) -> dict[str, list[int]]:
    """The ranked n-grams of each language among the rows of ``learn_from``."""
    usable = column(lang).isNotNull() & column(text).isNotNull()
    rows = docs.where(usable if learn_from is None else usable & learn_from).select(
        column(doc_id).alias("id"), column(lang).alias("lang"), column(text).alias("body")
    )
    sizes = {name: n for name, n in rows.groupBy("lang").agg(F.count(F.lit(1))).collect()}
    if not sizes:
        return {}
    share = F.create_map(
        *[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_language / n))]
    )
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for name in sorted(set(langs)):
                own = batch.filter(pa.array([x == name for x in langs]))
                for part in by_bytes(own, "body", TEXT_BYTES):
                    _, gram, many, _ = ranked_ngrams(utf8(part.column("body")), None)
                    yield pa.record_batch(
                        [pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(many)],
                        names=["lang", "gram", "many"],
                    )

    counted = (
        rows.where(drawn)
        .select("lang", "body")
        .mapInArrow(count, "lang string, gram long, many long")
        .groupBy("lang", "gram")
        .agg(F.sum("many").alias("many"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("many"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    profiles: dict[str, list[int]] = {name: [] for name in sorted(sizes)}
    for name, gram in top.select("lang", "gram").orderBy("lang", "rank").collect():
        profiles[name].append(gram)
    return profiles


class Profiles:
    """Ranks of all profiles' n-grams as one table: a row per n-gram, a column per language."""

    def __init__(self, profiles: dict[str, list[int]], ranks: int):
        self.names = sorted(name for name, grams in profiles.items() if grams)
        self.ranks = ranks
        self.grams = np.unique(np.array(sum(profiles.values(), []), dtype=np.int64))
        self.table = np.full((len(self.grams) + 1, len(self.names)), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            at = np.searchsorted(self.grams, np.array(profiles[name], dtype=np.int64))
            self.table[at, k] = np.arange(len(at))

    def judge(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        text, gram, _, rank = ranked_ngrams(texts, self.ranks)
        if not len(text) or not self.names:
            return names, scores
        at = np.searchsorted(self.grams, gram)
        known = np.append(self.grams, -1)[at] == gram
        theirs = self.table[np.where(known, at, len(self.grams))]
        apart = np.where(theirs < 0, self.ranks, np.abs(theirs - rank[:, None]))
        begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        many = np.diff(np.append(begin, len(text)))
        distance = np.add.reduceat(apart, begin, axis=0) / (many * self.ranks)[:, None]
        best = np.argmin(distance, axis=1)
        weight = np.exp(-SHARPNESS * (distance - distance.min(axis=1, keepdims=True)))
        share = weight.max(axis=1) / weight.sum(axis=1)
        for k, owner in enumerate(text[begin]):
            names[owner] = self.names[best[k]]
        scores[text[begin]] = share
        return names, scores


def identify(
    docs: DataFrame,
    profiles: dict[str, list[int]],
    doc_id: str = "doc_id",
    text: str = "text",
    ranks: int = RANKS,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: its id, the columns of ``also``, lang_pred and score."""
    rows = docs.select(
        column(doc_id).alias(doc_id),
        *[value.alias(name) for name, value in (also or {}).items()],
        column(text).cast("string").alias("__body"),
    )
    kept = [name for name in rows.columns if name != "__body"]
    schema = T.StructType(
        [
            *[field(rows, name) for name in kept],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, ranks)
        for batch in batches:
            for part in by_bytes(batch, "__body", TEXT_BYTES):
                names, scores = model.judge(utf8(part.column("__body")))
                yield pa.record_batch(
                    [
                        *[part.column(name) for name in kept],
                        pa.array(names, pa.string()),
                        pa.array(scores),
                    ],
                    names=[*kept, "lang_pred", "score"],
                )

    return rows.mapInArrow(judge, schema)


def keep_known(
    docs: DataFrame,
    profiles: dict[str, list[int]],
    text: str = "text",
    ranks: int = RANKS,
) -> DataFrame:
    """The rows of ``docs`` that have a language, with all their columns.

    Rejected are texts that are null or without a letter. The rows themselves pass through the batches,
    so the decision needs no join.
    """

    def keep(texts: Iterator[list[bytes]]) -> Iterator[list[bool]]:
        model = Profiles(profiles, ranks)
        for part in texts:
            yield [name != UNKNOWN for name in model.judge(part)[0]]

    return rows_kept(docs, text, keep, TEXT_BYTES)
