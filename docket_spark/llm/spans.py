"""Regular-expression matches with their places, in built-in column functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_FOUND = "array<struct<start:long,end:long,value:string,part:string,before:string,after:string>>"
BLOCK = 128


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once however often ``then`` mentions it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def sums_before(sizes: Column) -> Column:
    """For each element of ``sizes`` the sum of those before it.

    Sums are kept per block, so that many elements cost little more each than few.
    """
    zero = F.lit(0).cast("long")

    def total(first: Column, many: Column | int) -> Column:
        return F.aggregate(F.slice(sizes, first, many), zero, lambda x, y: x + y)

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(sizes) / BLOCK).cast("int")),
        lambda b: total(b * BLOCK + 1, BLOCK),
    )
    before = F.aggregate(
        blocks, F.array(zero), lambda held, x: F.array_append(held, F.element_at(held, -1) + x)
    )
    return let(
        before,
        lambda known: F.transform(
            sizes,
            lambda _, i: F.get(known, F.floor(i / BLOCK).cast("int"))
            + total(i - i % BLOCK + 1, i % BLOCK),
        ),
    )


def find(text: Column, pattern: str, part: int = 0) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` in ``text``, in order.

    Each is (start, end, value, part, before, after): code points with end exclusive, the match, its
    group ``part``, and the text from the previous match to this one and from this one to the next.
    The places follow from the lengths of the matches and of the stretches between them. ``pattern``
    must not match an empty string. Texts without a match are looked at once.
    """

    def zipped(between: Column) -> Column:
        return F.arrays_zip(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(part)).alias("part"),
            F.slice(between, 1, F.size(between) - 1).alias("before"),
            F.slice(between, 2, F.size(between) - 1).alias("after"),
        )

    def one(x: Column, at: Column) -> Column:
        start = at + F.length(x["before"])
        return F.struct(
            start.alias("start"),
            (start + F.length(x["value"])).alias("end"),
            x["value"].alias("value"),
            x["part"].alias("part"),
            x["before"].alias("before"),
            x["after"].alias("after"),
        )

    def placed(parts: Column) -> Column:
        sizes = F.transform(
            parts, lambda x: (F.length(x["before"]) + F.length(x["value"])).cast("long")
        )
        return F.zip_with(parts, let(sizes, sums_before), one)

    found = let(let(F.split(text, pattern, -1), zipped), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_FOUND))


def marked(found: Column, number: int, kind: str) -> Column:
    """``found`` as (number, kind, start, end), ready to be put together and sorted."""
    return F.transform(
        found,
        lambda x: F.struct(
            F.lit(number).alias("number"),
            F.lit(kind).alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
        ),
    )


def by_start(found: Column) -> Column:
    return F.sort_array(
        F.transform(found, lambda x: F.struct(x["start"], x["number"], x["end"], x["kind"]))
    )


def by_kind(found: Column) -> Column:
    return F.sort_array(
        F.transform(found, lambda x: F.struct(x["number"], x["start"], x["end"], x["kind"]))
    )


def listed(found: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
