"""Benchmark decontamination by edit distance: CGK embedding, bit sampling, exact verification.

An item leaks into a document where some stretch of the document is at most ``edits`` word insertions,
deletions or replacements away from it, ``edits`` being a fifth of the item's words (similarity 0.8).
Words are runs of letters and digits, lower-cased; other marks separate them.

Windows of an item's size are embedded by the CGK random walk: at step j a walker writes the word under
it and moves on if random function j says so for that word, so that two walkers over texts a few edits
apart fall into step again and write mostly the same. A key samples ``SAMPLED`` steps of such a walk;
walks are repeated with other random functions until a pair with ``AGREEMENT`` of its steps equal has
some key in common with probability ``recall``. The keys of all items, by size and walk, are one sorted
table; a window's candidates are the items found there under its own keys. Candidates that have too
few of the item's words to be within its edits are left out, the others verified by exact edit distance.

Windows are laid only where a leak is possible: an item cut into ``edits`` + 1 stretches keeps at least
one of them whole under that many edits, so a window starts where one of the stretches occurs, as far
before it as in the item. This loses nothing and leaves the walks to a small share of the places. A place
is a start and a size, however many items have the stretch; equal windows walk once, equal items are one,
and an item is verified once against equal surroundings.

The benchmark is shipped in blocks of a fixed number of words, one pass over the documents for each.
Documents are never shuffled or joined.

Items of fewer than ``SHORTEST`` words have no walks to speak of: every place where one of their stretches
occurs is verified, so they are found exactly, verbatim below five words and within one edit above.

Defined cases: null texts are empty and never leak. Items that are null or have no word are not searched
for. Ids are passed on as they are, null and repeated
ones too; rows that repeat are searched each. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket_spark.llm.columns import by_bytes, column, field, rows_kept, utf8
from docket_spark.llm.words import mixed, runs

SIMILARITY, RECALL = 0.8, 0.99
SAMPLED, AGREEMENT = 2, 0.35
SHORTEST = 8
BLOCK_WORDS = 1 << 20
TEXT_BYTES = 1 << 18
PLACES, CANDIDATES = 4096, 1 << 20
_WORD = np.array([1 if c >= 128 or chr(c).isalnum() else 0 for c in range(256)])
_FILTER_BITS = 22


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in a row, and the number of words of each."""
    *_, hashed, many = runs([x.lower().encode() for x in texts], _WORD)
    return hashed, many


def edits_within(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """The least edits between ``item`` and a stretch of ``text``, with the stretch, or None.

    Of equal ones the stretch that ends first, then the one that starts last.
    """
    m, n = len(item), len(text)
    offsets = np.arange(n + 1)
    cost, start = np.zeros(n + 1, dtype=np.int64), offsets.copy()
    for i in range(m):
        best = np.empty(n + 1, dtype=np.int64)
        come = np.empty(n + 1, dtype=np.int64)
        best[0], come[0] = i + 1, 0
        aside = cost[:-1] + (text != item[i])
        take = aside <= cost[1:] + 1
        best[1:] = np.where(take, aside, cost[1:] + 1)
        come[1:] = np.where(take, start[:-1], start[1:])
        # Insertions run along the row: the least of best[k] - k so far.
        slack = best - offsets
        least = np.minimum.accumulate(slack)
        origin = np.maximum.accumulate(np.where(slack == least, offsets, 0))
        cost, start = least + offsets, come[origin]
    end = int(np.argmin(cost))
    return (int(cost[end]), int(start[end]), end) if cost[end] <= most else None


class Items:
    """The different items of one block, their stretches and their keys."""

    def __init__(self, texts: list[str], similarity: float, recall: float):
        hashed, many = words_of(texts)
        ends = np.cumsum(many)
        self.rows: dict[bytes, list[int]] = {}
        for k, (e, n) in enumerate(zip(ends, many, strict=True)):
            if n:
                self.rows.setdefault(hashed[e - n : e].tobytes(), []).append(k)
        self.words = [np.frombuffer(own, np.uint64) for own in self.rows]
        self.edits = [math.floor(round((1 - similarity) * len(w), 9)) for w in self.words]
        self.sorted = [np.sort(w) for w in self.words]
        walks = math.ceil(math.log(1 - recall) / math.log(1 - AGREEMENT**SAMPLED))
        # Of a stretch: the item if it is a short one, the item's size, and the words before it.
        stretches: dict[int, set[tuple[int, int, int, int]]] = {}
        for k, own in enumerate(self.words):
            size = len(own) // (self.edits[k] + 1)
            item = k if len(own) < SHORTEST else -1
            for offset in range(0, size * (self.edits[k] + 1), size):
                key = int(_stretch(own[offset : offset + size], size)[0])
                stretches.setdefault(size, set()).add((key, item, len(own), offset))
        self.stretches = []
        for size, found in sorted(stretches.items()):
            ordered = sorted(found)
            keys = np.array([f[0] for f in ordered], dtype=np.uint64)
            self.stretches.append((size, keys, np.array([f[1:] for f in ordered]), _filter(keys)))
        longest = max(map(len, self.words), default=0)
        random = np.random.default_rng(5)
        self.steps = 2 * longest
        self.functions = random.integers(1, 1 << 63, (max(self.steps, 1), walks), np.uint64) | 1
        self.sampled = random.random((walks, SAMPLED))
        walked = np.array([k for k, w in enumerate(self.words) if len(w) >= SHORTEST], dtype=int)
        keys = [np.zeros((0, walks), np.uint64)]
        for at in range(0, len(walked), PLACES):
            keys.append(self.walk_keys([self.words[k] for k in walked[at : at + PLACES]]))
        keys = np.concatenate(keys).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_items = keys[order], np.repeat(walked, walks)[order]
        self.key_filter = _filter(self.keys)

    def walk_keys(self, windows: list[np.ndarray], sizes: list[int] | None = None) -> np.ndarray:
        """The keys of each window (a row) under each walk (a column).

        ``sizes`` has the words of the items that each window is compared with, by default its own:
        the steps that a walk samples are drawn from twice as many. Keys of different sizes or walks
        have nothing in common.
        """
        sizes = np.array([len(w) for w in windows] if sizes is None else sizes, dtype=np.int64)
        width = max(map(len, windows)) + 1
        padded = np.zeros((len(windows), width), dtype=np.uint64)
        for k, window in enumerate(windows):
            padded[k, : len(window)] = window
        steps = np.floor(self.sampled[None] * (2 * sizes)[:, None, None]).astype(int)
        walks = self.functions.shape[1]
        at = np.zeros((len(windows), walks), dtype=np.int64)
        keys = np.zeros((len(windows), walks), dtype=np.uint64)
        keys += mixed(np.arange(1, walks + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keys += mixed(sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[:, None]
        row = np.arange(len(windows))[:, None]
        for j in range(int(steps.max()) + 1):
            word = padded[row, at]
            for s in range(SAMPLED):
                keys = np.where(steps[:, :, s] == j, mixed(keys * np.uint64(3) ^ word), keys)
            move = (word * self.functions[j]) >> np.uint64(63)
            at = np.minimum(at + move.astype(np.int64), width - 1)
        return keys

    def _places(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of text, item (-1: to be found), size and start, where a stretch of an item occurs."""
        places = [np.zeros((0, 4), dtype=np.int64)]
        for size, keys, owners, maybe in self.stretches:
            if len(text) < size:
                continue
            found = _stretch(text, size)
            hit = np.flatnonzero(maybe[found >> np.uint64(64 - _FILTER_BITS)])
            of = np.searchsorted(ends, hit, "right")
            inside = hit + size <= ends[np.minimum(of, len(ends) - 1)]
            hit, of = hit[inside], of[inside]
            which, entry = _matches(keys, found[hit])
            item, words, offset = owners[entry].T
            places.append(np.column_stack([of[which], item, words, hit[which] - offset]))
        return np.unique(np.concatenate(places), axis=0)

    def _candidates(self, windows: list[np.ndarray], sizes: list[int]) -> Iterator[tuple[int, int]]:
        """Pairs of a window's number and an item that has a key in common with it."""
        keys = self.walk_keys(windows, sizes)
        walks = keys.shape[1]
        maybe = np.flatnonzero(self.key_filter[keys.ravel() >> np.uint64(64 - _FILTER_BITS)])
        keys = keys.ravel()[maybe]
        many = np.searchsorted(self.keys, keys, "right") - np.searchsorted(self.keys, keys, "left")
        held, part = many > 0, np.cumsum(many) // CANDIDATES
        for number in np.unique(part[held]):
            own = np.flatnonzero(held & (part == number))
            which, entry = _matches(self.keys, keys[own])
            pairs = np.column_stack([maybe[own][which] // walks, self.key_items[entry]])
            yield from np.unique(pairs, axis=0).tolist()

    def leaks(self, text: np.ndarray, many: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, edits) of the best place of each item in each text."""
        ends = np.cumsum(many)
        places = self._places(text, ends)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for at in range(0, len(places), PLACES):
            part = places[at : at + PLACES].tolist()
            alike: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
            pairs: set[tuple[int, int, int]] = set()
            for d, item, size, p in part:
                if item >= 0:
                    pairs.add((d, item, p))
                else:
                    lo, hi = int(ends[d] - many[d]), int(ends[d])
                    window = text[max(lo, p) : min(hi, p + size)]
                    alike.setdefault((size, window.tobytes()), []).append((d, p))
            if alike:
                owners = list(alike.values())
                windows = [np.frombuffer(own, np.uint64) for _, own in alike]
                for k, item in self._candidates(windows, [size for size, _ in alike]):
                    pairs.update((d, item, p) for d, p in owners[k])
            verified: dict[tuple[int, int, bytes], tuple[int, int, int] | None] = {}
            for d, item, p in sorted(pairs):
                lo, hi = int(ends[d] - many[d]), int(ends[d])
                own, most = self.words[item], self.edits[item]
                left, right = max(lo, p - most), min(hi, p + len(own) + most)
                around = text[left:right]
                key = (item, p - left, around.tobytes())
                if key not in verified:
                    verified[key] = self._verify(item, around, p - left)
                if found := verified[key]:
                    result = (found[0], left + found[1] - lo, found[2] - found[1])
                    best[d, item] = min(best.get((d, item), result), result)
        rows = list(self.rows.values())
        return sorted(
            (d, row, start, n, cost)
            for (d, item), (cost, start, n) in best.items()
            for row in rows[item]
        )

    def _verify(self, item: int, around: np.ndarray, at: int) -> tuple[int, int, int] | None:
        own, most = self.words[item], self.edits[item]
        if np.array_equal(around[at : at + len(own)], own):
            return 0, at, at + len(own)
        # Each of the item's words that is nowhere around costs an edit.
        there = np.sort(around)
        place = np.searchsorted(there, self.sorted[item])
        absent = there[np.minimum(place, len(there) - 1)] != self.sorted[item]
        return None if np.count_nonzero(absent) > most else edits_within(own, around, most)


def _filter(keys: np.ndarray) -> np.ndarray:
    """Whether any key has these first bits."""
    maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
    maybe[keys >> np.uint64(64 - _FILTER_BITS)] = True
    return maybe


def _matches(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a place in ``keys`` and one in the sorted ``table`` that hold the same."""
    low = np.searchsorted(table, keys, "left")
    many = np.searchsorted(table, keys, "right") - low
    which = np.repeat(np.arange(len(keys)), many)
    within = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    return which, low[which] + within


def _stretch(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words that follow each other."""
    total = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k]
    return mixed(total)


@functools.lru_cache(maxsize=2)
def _items(texts: tuple[str, ...], similarity: float, recall: float) -> Items:
    return Items(list(texts), similarity, recall)


def _blocks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, in blocks of about ``BLOCK_WORDS`` words."""
    items = benchmark.select(
        column(item_id).alias("id"), column(item_text).cast("string").alias("body")
    ).where("body is not null")
    words = items.agg(F.sum(F.size(F.split("body", r"\s+")))).first()[0] or 0
    count = math.ceil(words / BLOCK_WORDS)
    for k in range(count):
        block = items.where(F.pmod(F.xxhash64("id", "body"), F.lit(count)) == k)
        rows = block.orderBy("id", "body").collect()
        yield [r.id for r in rows], [r.body for r in rows]


def _found(items: Items, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    return items.leaks(*words_of([x.decode("utf-8", "replace") for x in texts]))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """Per document and item that leaks into it: both ids, the first word of the best place, its
    number of words, and the edits."""
    numbers = ("first_word", "n_words", "edits")
    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("body"))
    schema = T.StructType(
        [
            field(docs, doc_id),
            T.StructField(item_id, benchmark.schema[item_id].dataType),
            *[T.StructField(name, T.IntegerType()) for name in numbers],
        ]
    )
    result = docs.sparkSession.createDataFrame([], schema)
    for ids, texts in _blocks(benchmark, item_id, item_text):
        texts = tuple(texts)

        def search(batches, ids=ids, texts=texts):
            items = _items(texts, similarity, recall)
            for batch in batches:
                for part in by_bytes(batch, "body", TEXT_BYTES):
                    found = _found(items, utf8(part.column("body")))
                    item_type = pa.array(ids).type if ids else pa.null()
                    yield pa.record_batch(
                        [
                            part.column("id").take(pa.array([f[0] for f in found], pa.int64())),
                            pa.array([ids[f[1]] for f in found], item_type),
                            *[pa.array([f[c] for f in found], pa.int32()) for c in (2, 3, 4)],
                        ],
                        names=[doc_id, item_id, *numbers],
                    )

        result = result.union(rows.mapInArrow(search, schema))
    return result


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_text: str = "text",
    item_id: str = "item_id",
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns."""
    for _, texts in _blocks(benchmark, item_id, item_text):
        texts = tuple(texts)

        def keep(parts: Iterator[list[bytes]], texts=texts) -> Iterator[np.ndarray]:
            items = _items(texts, similarity, recall)
            for part in parts:
                clean = np.ones(len(part), dtype=bool)
                clean[[f[0] for f in _found(items, part)]] = False
                yield clean

        docs = rows_kept(docs, text, keep, TEXT_BYTES)
    return docs
