"""Secret scans: known forms, and windows of high Shannon entropy in unknown ones.

Known forms are assignments to a telling name, access keys and long hexadecimal strings. Beyond these, a
candidate is a run of 20 or more characters that keys and tokens are written in, with a letter and a
digit. It belongs to a character class (hexadecimal, alphanumeric, or with marks), a window of ``WINDOW``
characters slides over it, and it is a secret if the entropy of some window reaches the class's bits.
The sum of n log n over a window's characters is updated from the counts of the two characters that
leave and enter, which are looked up by their place in an array, so a window costs the same wherever it
is and a candidate as much as it is long. What the allow list names (UUIDs, pieces between = / _ - with a
placeholder's word, runs of the alphabet, of digits, of x or 0) is taken out of a candidate, and what
is left of it on either side still counts. Candidates that overlap a known form are suppressed, as that is
reported already.

Everything is a column expression on the row itself: no shuffle, no Python on the executors.

Defined cases: a null text is the empty text. Places are code points, end exclusive. Ids are passed on as
they are; rows that repeat are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket_spark.llm import spans
from docket_spark.llm.columns import column, text_of

ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
CLASSES = ((r"^[0-9a-fA-F]+$", 3.0), (r"^[A-Za-z0-9]+$", 3.8), (r"", 3.9))
ALLOWED = (
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])",
    r"(?i)[^=/_-]*(?:example|sample|dummy|placeholder|changeme)[^=/_-]*|(?<![a-z0-9])your(?=[_-])",
    r"(?i)x{4,}+|0{4,}+|0123456789|1234567890|abcdefghij|qwertyuiop",
)


def _weight(count: Column) -> Column:
    """n log2 n, zero for n = 0."""
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def _count(window: Column, char: Column) -> Column:
    return F.size(F.filter(window, lambda x: x == char))


def highest_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest entropy, in bits, of any ``window`` characters that follow each other."""

    def of(chars: Column, length: Column) -> Column:
        first = F.slice(chars, 1, window)
        initial = F.aggregate(
            F.array_distinct(first), F.lit(0.0), lambda total, char: total + _weight(_count(first, char))
        )

        def slide(held: Column, k: Column) -> Column:
            before = F.slice(chars, k, window)
            out, into = F.get(chars, k - 1), F.get(chars, k - 1 + window)
            gone, come = _count(before, out), _count(before, into)
            change = _weight(gone - 1) - _weight(gone) + _weight(come + 1) - _weight(come)
            total = held["total"] + F.when(out == into, F.lit(0.0)).otherwise(change)
            return F.struct(total.alias("total"), F.least(held["least"], total).alias("least"))

        steps = F.when(length > window, F.sequence(F.lit(1), length - window))
        start = F.struct(initial.alias("total"), initial.alias("least"))
        slid = F.aggregate(
            F.coalesce(steps, F.array().cast("array<int>")), start, slide, lambda held: held["least"]
        )
        return F.lit(math.log2(window)) - slid / window

    # The characters once, not at every step; an empty text at the end is not one of them.
    chars = F.slice(F.split(value, ""), F.lit(1), F.length(value))
    return spans.let(chars, lambda known: of(known, F.size(known)))


def _stretch_is_secret(value: Column) -> Column:
    bits = F.lit(CLASSES[-1][1])
    for pattern, least in reversed(CLASSES[:-1]):
        bits = F.when(value.rlike(pattern), F.lit(least)).otherwise(bits)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= WINDOW)
    return F.when(mixed, highest_entropy(value) >= bits).otherwise(F.lit(False))


def _is_secret(value: Column) -> Column:
    left = value
    for pattern in ALLOWED:
        left = F.regexp_replace(left, pattern, " ")
    return F.exists(F.split(left, " "), _stretch_is_secret)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, known (the known forms) and added (entropy), arrays of
    (number, kind, start, end)."""
    body = F.col("body")
    rows = docs.select(column(doc_id).alias("id"), text_of(text).alias("body"))
    assigned = F.filter(spans.find(body, ASSIGN, 2), lambda x: F.length(x["part"]) >= 6)
    known = F.concat(
        spans.marked(assigned, 0, "assign"),
        spans.marked(spans.find(body, ACCESS), 1, "access"),
        spans.marked(spans.find(body, HEX), 2, "hex"),
    )
    found = rows.select("id", known.alias("known"), spans.find(body, CANDIDATE).alias("candidates"))

    def clear(x: Column) -> Column:
        hit = F.exists("known", lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
        return F.when(hit, F.lit(False)).otherwise(_is_secret(x["value"]))

    added = F.when(F.size("candidates") > 0, F.filter("candidates", clear)).otherwise(
        F.col("candidates")
    )
    return found.select(
        F.col("id").alias(doc_id), "known", spans.marked(added, 3, "entropy").alias("added")
    )
