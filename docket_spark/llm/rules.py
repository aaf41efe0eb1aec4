"""Quality rules as a cascade: a document is rejected by the first rule it breaks, cheap and telling first.

``learn_order`` runs every rule on a sample (rows whose hash is divisible by ``one_in``) and records the
time of each rule, the time of what it needs (words, lines), and which rules each document breaks. From
these figures the order is chosen greedily: next comes the rule that rejects the most of the documents
still left per second, where words and lines are paid for by the first rule that needs them. ``judge`` runs the
rules in that order on every document and stops at the first one broken. A verdict is whether any rule is
broken, so the order decides what a run costs and never what it returns; with an empty sample the rules
stay in the order they are given in.

What goes to the driver is one row per combination of broken rules and sums of times: at most 2 to the
number of rules, whatever the documents.

The rules are those of public web corpora (word count, symbols, word length, alphabetic words, bullets,
ellipses, repeated lines and repeated word triples), compared in whole numbers.

Defined cases: a null text has no words, and a text without words breaks ``few_words``. White space is the
six ASCII characters, a line is what stands between line breaks, and a word is alphabetic if it has an
ASCII letter or anything beyond ASCII. Texts of any length are read whole. Rows are judged each, also
those that repeat or have no id. An empty table gives an empty result. Further columns of any name are
not read by the verdict; ``keep_good`` returns them.
"""

from __future__ import annotations

import functools
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket_spark.llm.columns import by_bytes, column, field, rows_kept, utf8

ONE_IN = 64
TEXT_BYTES = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_FOLLOWING = bytes(range(0x80, 0xC0))
_ALPHABETIC = re.compile(rb"[A-Za-z\x80-\xff]")
_LOWER, _TWO_CAPITALS = re.compile(rb"[a-z]"), re.compile(rb"[A-Z].*[A-Z]")
_BULLET = re.compile(rb"[ \t\x0b\x0c\r]*(?:[-*]|\xe2\x80\xa2)")
_ELLIPSIS = (b"...", "…".encode())


class Text:
    """What rules look at, each computed when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @functools.cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @functools.cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.raw.split(b"\n") if x.strip(SPACES)]

    @property
    def n_words(self) -> int:
        return len(self.words)

    @functools.cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, SPACES + _FOLLOWING))

    @functools.cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @functools.cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @functools.cached_property
    def n_repeat_words(self) -> int:
        """Words in runs of three that the text has twice or more."""
        words = self.words
        if len(words) < 4:
            return 0
        number = {word: k for k, word in enumerate(dict.fromkeys(words))}
        of = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        pairs = of[:-1] * len(number) + of[1:]
        if len(number) > 1 << 20:  # three numbers of one vocabulary no longer fit into one
            pairs = np.unique(pairs, return_inverse=True)[1]
        runs = pairs[:-1] * len(number) + of[2:]
        _, which, many = np.unique(runs, return_inverse=True, return_counts=True)
        again = np.flatnonzero(many[which] > 1)
        inside = np.zeros(len(words), dtype=bool)
        for k in range(3):
            inside[again + k] = True
        return int(inside.sum())

    @property
    def n_alphabetic(self) -> int:
        return sum(1 for x in self.words if _ALPHABETIC.search(x))

    @property
    def n_capital(self) -> int:
        return sum(1 for x in self.words if _TWO_CAPITALS.search(x) and not _LOWER.search(x))

    @property
    def n_bullets(self) -> int:
        return sum(1 for x in self.lines if _BULLET.match(x))

    @property
    def n_ellipses(self) -> int:
        return sum(1 for x in self.lines if x.rstrip(SPACES).endswith(_ELLIPSIS))


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Callable[[Text], bool]
    needs: tuple[str, ...] = ("words",)


FEW_WORDS = Rule("few_words", lambda x: x.n_words < 50)
REPEATED_WORDS = Rule("repeated_words", lambda x: 100 * x.n_repeat_words > 50 * x.n_words)
# These two fail a document whatever the others say.
BASE = (FEW_WORDS, REPEATED_WORDS)
RULES = (
    *BASE,
    Rule("symbols", lambda x: 10 * x.n_symbols > x.n_words),
    Rule(
        "word_length", lambda x: not 3 * x.n_words <= x.word_chars <= 10 * x.n_words
    ),
    Rule("alphabetic", lambda x: 10 * x.n_alphabetic < 8 * x.n_words),
    Rule("capitals", lambda x: 10 * x.n_capital > 5 * x.n_words),
    Rule("bullets", lambda x: 10 * x.n_bullets > 9 * len(x.lines), ("lines",)),
    Rule("ellipses", lambda x: 10 * x.n_ellipses > 3 * len(x.lines), ("lines",)),
    Rule("repeated_lines", lambda x: 10 * x.n_dup_lines > 3 * len(x.lines), ("lines",)),
)
NEEDS = ("words", "lines")


def _times_and_breaks(raw: bytes, rules: Sequence[Rule]) -> tuple[int, list[int]]:
    """Which rules ``raw`` breaks, as bits, and nanoseconds by need and by rule."""
    text, took, broken = Text(raw), [], 0
    clock = time.perf_counter_ns
    for name in NEEDS:
        begin = clock()
        getattr(text, name)
        took.append(clock() - begin)
    for k, rule in enumerate(rules):
        fresh = Text(raw)
        fresh.words, fresh.lines = text.words, text.lines
        begin = clock()
        broken |= bool(rule.broken(fresh)) << k
        took.append(clock() - begin)
    return broken, took


def sample_figures(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", one_in: int = ONE_IN
) -> DataFrame:
    """Per combination of broken rules in the sample: broken (bits), documents and nanoseconds."""
    if len(rules) > 16:
        raise ValueError("at most 16 rules")
    chosen = docs.select(column(text).cast("string").alias("body")).where(
        F.pmod(F.xxhash64("body"), F.lit(one_in)) == 0
    )
    clocks = [f"t{k}" for k in range(len(NEEDS) + len(rules))]
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("broken", "documents", *clocks)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, spent = Counter(), {}
        for batch in batches:
            for part in by_bytes(batch, "body", TEXT_BYTES):
                for raw in utf8(part.column("body")):
                    broken, took = _times_and_breaks(raw, rules)
                    seen[broken] += 1
                    spent[broken] = spent.get(broken, 0) + np.array(took)
        rows = [[broken, many, *map(int, spent[broken])] for broken, many in seen.items()]
        yield pa.record_batch(
            [pa.array([x[k] for x in rows], pa.int64()) for k in range(len(schema))],
            names=schema.names,
        )

    return (
        chosen.mapInArrow(measure, schema)
        .groupBy("broken")
        .agg(*[F.sum(name).alias(name) for name in ("documents", *clocks)])
    )


def ordered(rules: Sequence[Rule], figures: list[tuple[int, int, list[int]]]) -> list[Rule]:
    """``rules`` by rejections per cost, from (broken bits, documents, nanoseconds) of the sample."""
    total = sum(many for _, many, _ in figures)
    if not total:
        return list(rules)
    cost = [max(1.0, sum(took[k] for *_, took in figures) / total) for k in range(len(figures[0][2]))]
    need = dict(zip(NEEDS, cost, strict=False))
    own = cost[len(NEEDS) :]
    left, paid, result = list(figures), set(), []
    rest = list(range(len(rules)))
    while rest:

        def price(k: int) -> float:
            return own[k] + sum(need[x] for x in rules[k].needs if x not in paid)

        def worth(k: int) -> tuple[float, float]:
            rejected = sum(many for broken, many, _ in left if broken >> k & 1)
            return rejected / price(k), -price(k)

        best = max(rest, key=worth)
        rest.remove(best)
        result.append(rules[best])
        paid.update(rules[best].needs)
        left = [x for x in left if not x[0] >> best & 1]
    return result


def learn_order(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", one_in: int = ONE_IN
) -> list[Rule]:
    """``rules`` in the order in which they reject most per second on the sample."""
    rows = sample_figures(docs, rules, text, one_in).collect()
    return ordered(rules, [(row[0], row[1], list(row[2:])) for row in rows])


def first_broken(text: Text, rules: Sequence[Rule]) -> str | None:
    """The name of the first rule that ``text`` breaks; the rules behind it are not tried."""
    return next((rule.name for rule in rules if rule.broken(text)), None)


def judge(
    docs: DataFrame,
    rules: Sequence[Rule],
    doc_id: str = "doc_id",
    text: str = "text",
    measures: Sequence[str] = (),
    base: Sequence[Rule] = (),
) -> DataFrame:
    """Per row: its id, the ``measures`` (whole-number properties of ``Text``), base_failed (a rule of
    ``base`` is broken) and kept (no rule is broken)."""
    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("body"))
    schema = T.StructType(
        [
            field(rows, "id", doc_id),
            *[T.StructField(name, T.LongType()) for name in measures],
            T.StructField("base_failed", T.BooleanType()),
            T.StructField("kept", T.BooleanType()),
        ]
    )
    others = [rule for rule in rules if rule.name not in {x.name for x in base}]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "body", TEXT_BYTES):
                values, failed, kept = [], [], []
                for raw in utf8(part.column("body")):
                    seen = Text(raw)
                    values.append([getattr(seen, name) for name in measures])
                    failed.append(first_broken(seen, base) is not None)
                    kept.append(not failed[-1] and first_broken(seen, others) is None)
                yield pa.record_batch(
                    [
                        part.column("id"),
                        *[pa.array([x[k] for x in values], pa.int64()) for k in range(len(measures))],
                        pa.array(failed, pa.bool_()),
                        pa.array(kept, pa.bool_()),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(work, schema)


def keep_good(docs: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that break no rule, with all their columns."""

    def keep(batches: Iterator[list[bytes]]) -> Iterator[list[bool]]:
        for texts in batches:
            yield [first_broken(Text(x), rules) is None for x in texts]

    return rows_kept(docs, text, keep, TEXT_BYTES)
