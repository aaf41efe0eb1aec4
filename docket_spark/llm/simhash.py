"""Near-duplicate groups by SimHash and a self-join of binary tries.

A fingerprint has 64 bits; two documents are linked when at most ``budget`` bits differ, and groups are
the connected components. Links are found on the different fingerprints only, so exact copies cost
nothing here, by traversing pairs of trie nodes together: a pair starts with one node and itself, each
level extends both nodes by one bit and adds one to the pair's difference where the bits differ, and a
pair whose difference exceeds the budget is dropped with all that lies below it. Where two nodes hold
few keys (``SMALL`` combinations), the keys themselves are compared.

One trie over all fingerprints would visit a number of node pairs that grows with the square of the
corpus before pruning bites. So the bits are cut into ``budget + 2`` blocks; of these at least two agree
in any linked pair, and there is one forest for each choice of two blocks: its tries hold the
fingerprints that agree on both, the budget of those bits being zero. Every link lies in at least one
trie. Tries are spread over the cluster by their agreeing bits. A trie above about ``leaf`` fingerprints
is dealt in salted parts, and every two parts meet in a task of their own, so no group is gathered. The
list of such tries is broadcast if it is short, and joined otherwise.

A trie yields a spanning forest of its links, not all of them: node pairs whose leaves are already one
component are dropped too, which keeps large groups of near copies from costing all their pairs.

``keep_one`` keeps the smallest id of each group, which is the id that names the group.

Defined cases: a null text has no words; texts without words have fingerprint zero and are linked like
all others. Null ids are ignored in the choice of the smallest id unless a group has no other. Rows that
repeat count once. Empty tables give empty results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket_spark.llm.columns import by_bytes, column, field, row_rank, utf8, whole_row
from docket_spark.llm.components import connected_components
from docket_spark.llm.words import mixed
from docket_spark.session import cut_lineage

BITS = 64
SEED = 42
LEAF = 20_000
SHARE, LISTED = 16, 10_000
CHUNK = 1 << 16
SMALL = 1024
TEXT_BYTES = 1 << 20
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, words: int) -> bytes:
    """XXH64 of each run of ``words`` words, big-endian, one after another."""
    parts = text.lower().split()
    if not parts:
        return b""
    joined = b" ".join(parts)
    ends = list(itertools.accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_digest
    if len(parts) <= words:
        return digest(joined, SEED)
    last = ends[words - 1 :]
    return b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, last)])


def majority_bits(hashes: list[bytes], prints: int = 1) -> np.ndarray:
    """Per item and print the 64 bits that are set in over half of its hashes, as unsigned integers.

    The first print takes the hashes as they are, each further one mixes them anew.
    """
    counts = np.array([len(x) // 8 for x in hashes], dtype=np.int64)
    result = np.zeros((len(hashes), prints), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return result
    all_hashes = np.frombuffer(b"".join(hashes), dtype=">u8").astype(np.uint64)
    size = counts[full]
    begin = np.cumsum(size) - size
    # Sums of up to 255 hashes fit into eight one-byte lanes of a word.
    groups = -(-size // 255)
    of = np.repeat(np.arange(len(full)), groups)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(groups) - groups, groups)
    cuts = begin[of] + 255 * nth
    first_group = np.cumsum(groups) - groups
    for p in range(prints):
        drawn = mixed(mixed(all_hashes + np.uint64(p))) if p else all_hashes
        bits = np.zeros((len(full), BITS), dtype=np.int64)
        for k in range(8):
            lanes = np.add.reduceat((drawn >> np.uint64(k)) & _LANES, cuts)
            by_lane = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
            bits[:, k::8] = np.add.reduceat(by_lane, first_group, axis=0)
        packed = np.packbits(2 * bits > size[:, None], axis=1, bitorder="little")
        result[full, p] = packed.view("<u8")[:, 0]
    return result


def fingerprints(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 4,
    prints: int = 1,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: id, the columns of ``also``, and the fingerprints print0, print1, ... (signed)."""
    rows = docs.select(
        column(doc_id).alias("id"),
        *[value.alias(name) for name, value in (also or {}).items()],
        column(text).cast("string").alias("body"),
    )
    kept = [name for name in rows.columns if name != "body"]
    names = [f"print{p}" for p in range(prints)]
    schema = T.StructType(
        [*[field(rows, name) for name in kept], *[T.StructField(n, T.LongType()) for n in names]]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "body", TEXT_BYTES):
                hashes = [shingle_hashes(x, words) for x in utf8(part.column("body"))]
                found = majority_bits(hashes, prints).view(np.int64)
                yield pa.record_batch(
                    [
                        *[part.column(name) for name in kept],
                        *[pa.array(found[:, p]) for p in range(prints)],
                    ],
                    names=[*kept, *names],
                )

    return rows.mapInArrow(sign, schema)


def agreeing_masks(budget: int) -> list[int]:
    """For each choice of two of ``budget + 2`` blocks of bits, the mask of these bits (signed)."""
    edges = [BITS * k // (budget + 2) for k in range(budget + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    masks = [x | y for x, y in itertools.combinations(blocks, 2)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``labels`` (each the smallest index of its component) after linking i and j."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := labels[labels], labels):
            labels = further


def _near(
    keys: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, budget: int
) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked keys, one in [a, b) and one in [c, d), of small node pairs."""
    across = d - c
    many = (b - a) * across
    found = [np.zeros((2, 0), dtype=np.int64)]
    cuts = np.searchsorted(np.cumsum(many), np.arange(CHUNK, many.sum() + CHUNK, CHUNK))
    for at, end in itertools.pairwise([0, *(cuts + 1)]):
        size = many[at:end]
        pair = np.repeat(np.arange(at, at + len(size)), size)
        inside = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        i, j = a[pair] + inside // across[pair], c[pair] + inside % across[pair]
        linked = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        found.append(np.array([i[linked], j[linked]]))
    return tuple(np.concatenate(found, axis=1))


def trie_components(keys: np.ndarray, starts: np.ndarray, budget: int) -> np.ndarray:
    """Component labels of ``keys`` inside each trie.

    ``keys`` are unsigned, ascending and different inside a trie; ``starts`` has the position where
    each trie begins. A label is the position of the component's first key.
    """
    labels = np.arange(len(keys))
    for left, right in _traverse(keys, starts, budget, labels):
        labels[:] = _merge(labels, left, right)
    return labels


def _traverse(
    keys: np.ndarray, starts: np.ndarray, budget: int, labels: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked keys that span the components; node pairs of one label only are left out.

    The caller merges ``labels`` in between.
    """
    n = len(keys)
    ends = np.append(starts[1:], n)
    many = ends - starts > 1
    a, b = starts[many], ends[many]
    changes = np.append(0, np.cumsum(labels[1:] != labels[:-1]))
    zeros_before: dict[int, np.ndarray] = {}
    stack = [(0, a, b, a, b, np.zeros(len(a), dtype=np.int64))]
    while stack:
        level, a, b, c, d, differ = stack.pop()
        one = (
            (changes[b - 1] == changes[a])
            & (changes[d - 1] == changes[c])
            & (labels[a] == labels[c])
        )
        a, b, c, d, differ = (x[~one] for x in (a, b, c, d, differ))
        if not len(a):
            continue
        small = (b - a) * (d - c) <= SMALL
        close = ~small & (differ + (BITS - level) <= budget)
        left, right = _near(keys, a[small], b[small], c[small], d[small], budget)
        if close.any():  # whatever lies below, it is within the budget
            for lo, hi in ((a[close], b[close]), (c[close], d[close])):
                size = hi - lo
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                left = np.append(left, np.repeat(a[close], size))
                right = np.append(right, np.repeat(lo, size) + inside)
        if len(left):
            yield left, right
            changes = np.append(0, np.cumsum(labels[1:] != labels[:-1]))
        go = ~small & ~close
        a, b, c, d, differ = (x[go] for x in (a, b, c, d, differ))
        if not len(a):
            continue
        if level not in zeros_before:
            is_zero = (keys >> np.uint64(BITS - 1 - level)) & np.uint64(1) == 0
            zeros_before[level] = np.append(0, np.cumsum(is_zero, dtype=np.int32))
        zeros = zeros_before[level]
        m, o = a + zeros[b] - zeros[a], c + zeros[d] - zeros[c]
        crossed = a != c  # a node with itself has its mixed pair once
        children = (
            (a, m, o, d, differ + 1),
            *[tuple(x[crossed] for x in (m, b, c, o, differ + 1))],
            (a, m, c, o, differ),
            (m, b, o, d, differ),
        )
        a, b, c, d, differ = (np.concatenate(x) for x in zip(*children, strict=True))
        live = (a < b) & (c < d) & (differ <= budget) & ~((a == c) & (b - a == 1))
        a, b, c, d, differ = (x[live] for x in (a, b, c, d, differ))
        for at in range(0, len(a), CHUNK):
            part = slice(at, at + CHUNK)
            stack.append((level + 1, a[part], b[part], c[part], d[part], differ[part]))


def trie_links(signed: DataFrame, budget: int, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) between nodes that span the components of all links.

    ``signed``: print, node and fingerprint, all whole numbers; fingerprints are compared within a
    print, and nodes of equal ones are linked as well.
    """
    return shared_links(trie_stars(signed, budget, leaf))


def shared_links(links: DataFrame) -> DataFrame:
    """Links with the same components as ``links`` (columns a, b), but fewer."""
    # A node has at most one link a trie. Its smallest partner takes over the others, which keeps the
    # components: the tries of one large group then agree on nearly all links but the nodes' first.
    least = F.min("b").over(Window.partitionBy("a"))
    return links.withColumn("least", least).select(
        F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("least")).alias("a"), "b"
    )


def trie_stars(signed: DataFrame, budget: int, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) of nodes with the smallest node of their component in each trie."""
    different = signed.groupBy("print", "fingerprint").agg(F.min("node").alias("node"))

    def solve(keys: np.ndarray, starts: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
        labels = trie_components(keys, starts, budget)
        # The smallest node stands for a component, so that tries with the same group agree on it.
        least = nodes.copy()
        np.minimum.at(least, labels, nodes)
        linked = np.flatnonzero(least[labels] != nodes)
        return nodes[linked], least[labels[linked]]

    close = _in_tries(different, budget, leaf, solve)
    same = signed.distinct().join(
        different.withColumnRenamed("node", "first"), ["print", "fingerprint"]
    )
    links = close.union(
        same.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    )
    return links.distinct()


def _in_tries(signed: DataFrame, budget: int, leaf: int, solve_keys) -> DataFrame:
    """The links (a, b) that ``solve_keys`` finds from the keys of whole tries, where each trie
    starts, and the further columns of ``signed``."""
    masks = agreeing_masks(budget)
    carried = [name for name in signed.columns if name not in ("print", "fingerprint")]
    choices = F.array(
        *[F.struct(F.lit(k).alias("choice"), F.lit(m).alias("mask")) for k, m in enumerate(masks)]
    )
    rows = signed.select("print", "fingerprint", *carried, F.inline(choices)).select(
        (F.col("print") * len(masks) + F.col("choice")).cast("long").alias("forest"),
        F.col("fingerprint").bitwiseAND(F.col("mask")).alias("agreed"),
        "fingerprint",
        *carried,
    )
    # How many parts a trie is dealt in follows from the count of every SHARE-th fingerprint. That
    # only decides where rows are compared, never whether.
    large = cut_lineage(
        rows.where(F.pmod(F.xxhash64("fingerprint"), F.lit(SHARE)) == 0)
        .groupBy("forest", "agreed")
        .agg(F.ceil(F.count(F.lit(1)) * SHARE / leaf).cast("int").alias("parts"))
        .where("parts > 1")
    )
    if large.count() <= LISTED:
        large = F.broadcast(large)
    own = F.pmod(F.xxhash64("fingerprint"), "parts").cast("long")
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = (
        rows.join(large, ["forest", "agreed"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
        .select("forest", "agreed", "fingerprint", *carried, own.alias("own"), meets.alias("other"))
        .select(
            # forest and the two parts in one number
            (
                F.shiftleft("forest", 40)
                + F.shiftleft(F.least("own", "other"), 20)
                + F.greatest("own", "other")
            ).alias("meeting"),
            "fingerprint",
            *carried,
        )
    )
    every_mask = F.array(*[F.lit(m) for m in masks])
    choice = F.pmod(F.shiftright("meeting", 40), F.lit(len(masks))).cast("int")
    agreed = F.col("fingerprint").bitwiseAND(F.get(every_mask, choice))
    by_choice = np.array(masks, dtype=np.int64)

    def solve(table: pa.Table) -> pa.RecordBatch:
        meeting, signed_keys, *more = (c.to_numpy() for c in table.columns)
        same = signed_keys & by_choice[(meeting >> 40) % len(masks)]
        new = np.ones(len(meeting), dtype=bool)
        new[1:] = (meeting[1:] != meeting[:-1]) | (same[1:] != same[:-1])
        # Flipping the first bit makes signed order unsigned; differences stay the same.
        keys = signed_keys.view(np.uint64) ^ np.uint64(1 << 63)
        found = solve_keys(keys, np.flatnonzero(new), *more)
        return pa.record_batch([pa.array(x) for x in found], names=["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            if many > leaf:
                # The last trie may go on in this batch; what lies before it can be solved.
                table = pa.Table.from_batches(held).combine_chunks()
                meeting, keys = (c.to_numpy() for c in table.columns[:2])
                same = keys & by_choice[(meeting >> 40) % len(masks)]
                last = (meeting == meeting[-1]) & (same == same[-1])
                cut = int(np.argmax(last))
                if cut:
                    yield solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
            held.append(batch)
            many = sum(x.num_rows for x in held)
        if many:
            yield solve(pa.Table.from_batches(held))

    placed = dealt.repartition(F.col("meeting"), agreed).sortWithinPartitions(
        F.col("meeting"), agreed, F.col("fingerprint")
    )
    return placed.mapInArrow(join, "a long, b long")


def _with_root(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` with root, the smallest node that the links reach from its node."""
    members = connected_components(links)
    return known.join(members, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _grouped(signed: DataFrame, budget: int) -> DataFrame:
    """``signed`` with root (a fingerprint) and component_id (the smallest id of the group)."""
    signed = signed.withColumn("node", F.col("print0"))
    links = trie_links(
        signed.select(F.lit(0).alias("print"), "node", F.col("print0").alias("fingerprint")), budget
    )
    return _least_ids(signed, links)


def _least_ids(signed: DataFrame, links: DataFrame) -> DataFrame:
    known = signed.groupBy("node").agg(F.min("id").alias("least"))
    rooted = _with_root(known, links)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("node", "root").join(least, "root")
    return signed.join(of, "node")


def _picked(docs: DataFrame, doc_id: str, wanted: DataFrame, row: Column) -> DataFrame:
    """``wanted`` (columns id and rank, and others) with ``row`` of one such row of ``docs``."""
    wanted = wanted.withColumnsRenamed({"id": "of_id", "rank": "of_rank"})
    rows = docs.select(
        row.alias("row"), row_rank(docs).alias("rank"), column(doc_id).alias("id")
    )
    same = rows["rank"].eqNullSafe(wanted["of_rank"]) & rows["id"].eqNullSafe(wanted["of_id"])
    return rows.join(wanted, same)


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 4,
    budget: int = 4,
) -> DataFrame:
    """Per row: its id, fingerprint (16 hex digits) and component_id."""
    signed = cut_lineage(fingerprints(docs, doc_id, text, words))
    return _grouped(signed, budget).select(
        F.col("id").alias(doc_id),
        F.lower(F.lpad(F.hex("print0"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 4,
    budget: int = 4,
) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group: the smallest id, then smallest row hash."""
    signed = cut_lineage(fingerprints(docs, doc_id, text, words, also={"rank": row_rank(docs)}))
    stays = (
        _grouped(signed, budget)
        .where(F.col("id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min(F.struct("id", "rank")).alias("kept"))
        .select("kept.*")
    )
    found = _picked(docs, doc_id, stays, whole_row(docs))
    return found.groupBy("rank", "id").agg(F.any_value("row").alias("row")).select("row.*")
