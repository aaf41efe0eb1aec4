"""Text expressions. All are built-in JVM expressions; none leaves code generation for Python."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from docket_spark.constants import QUOTE_CHARS, QUOTE_MIN_SENTENCE

# Unicode space separators (category Zs): what the source engine's trim strips. Tabs and newlines
# are not in it.
SPACE_SEPARATORS = "".join(
    chr(code) for code in (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
)
# Whitespace in the wide sense, used when text is collapsed for comparison and quotation.
WHITESPACE = r"(?U)[\s\x1c-\x1f]"


def trim_spaces(value: Column) -> Column:
    """Text without surrounding space separators.

    Pure ASCII text, recognised by one byte per character, only needs the plain trim, which does
    not look at the middle of the text.
    """
    ascii_only = F.octet_length(value) == F.length(value)
    return F.when(ascii_only, F.trim(value)).otherwise(F.btrim(value, F.lit(SPACE_SEPARATORS)))


def blank_to_null(value: Column) -> Column:
    """Text without surrounding spaces; NULL when nothing is left."""
    return F.nullif(trim_spaces(value.cast("string")), F.lit(""))


def is_nonblank(value: Column) -> Column:
    return F.coalesce(trim_spaces(value) != "", F.lit(False))


def yes_no(value: Column) -> Column:
    """Tri-state flag: yes, no, or unknown."""
    folded = F.lower(value)
    return F.when(folded == "yes", F.lit(True)).when(folded == "no", F.lit(False))


def company_key(value: Column) -> Column:
    """Lower-case key in which every run of other characters counts as one space."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " ")), F.lit(""))


def collapse_whitespace(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, WHITESPACE + "+", " "))


def fold(value: Column) -> Column:
    """Collapsed, case-insensitive form used to compare labels."""
    return F.lower(collapse_whitespace(value))


def alphanumeric_fold(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def bounded_quote(excerpt: Column) -> Column:
    """At most about 280 characters of the excerpt, ending at a sentence where one is near.

    The last full stop within the first 281 characters ends the quote if it is far enough in,
    so a quote can be 281 characters long.
    """
    text = collapse_whitespace(excerpt)
    window = F.substring(text, 1, QUOTE_CHARS + 1)
    from_end = F.instr(F.reverse(window), ".")
    stop = F.when(from_end > 0, QUOTE_CHARS + 2 - from_end).otherwise(0)
    cut = F.when(stop > QUOTE_MIN_SENTENCE, stop).otherwise(QUOTE_CHARS)
    return F.when(F.length(text) <= QUOTE_CHARS, text).otherwise(
        F.rtrim(F.substring(text, F.lit(1), cut))
    )


def quote_fingerprint(quote: Column) -> Column:
    return F.lower(F.regexp_replace(quote, WHITESPACE, ""))


def contains_quote(excerpt: Column, quote: Column) -> Column:
    return F.coalesce(
        (F.length(quote) > 0)
        & F.contains(collapse_whitespace(excerpt), collapse_whitespace(quote)),
        F.lit(False),
    )


def is_canonical_id(value: Column) -> Column:
    return value.rlike("^(0|[1-9][0-9]*)$")


def format_number(value: Column) -> Column:
    """Up to four decimals with trailing zeros removed.

    The binary value is what is rounded, a tie to the even digit (1/32 gives 0.0312), as C and Python do;
    ``format_string`` would round the shortest decimal form half up.
    """
    number = value.cast("double")
    finite = F.abs(number) < F.lit(float("inf"))
    fixed = F.when(finite, F.call_function("format_number", number, F.lit("0.0000"))).otherwise(
        number.cast("string")
    )
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")


def document_id(complaint_id: Column) -> Column:
    return F.sha2(complaint_id, 256)


def fill(sentence: str, /, **values: Column) -> Column:
    """``sentence`` with every name in braces replaced by its value; NULL where a value is NULL."""
    parts = []
    for literal, name, _, _ in Formatter().parse(sentence):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def canonical_text(names: Sequence[str]) -> Column:
    """The values of columns as one text from which each can be told: its length and itself, N for NULL."""
    values = [F.col("`" + name.replace("`", "``") + "`").cast("string") for name in names]
    told = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("N")) for x in values]
    return F.concat_ws(",", *told)


def packed_texts(names: Sequence[str], texts: str, lengths: str) -> list[Column]:
    """Text columns as one text and their lengths in bytes, which an exchange moves in fewer bytes.

    Lengths are of two bytes, and of four in rows with a longer text.
    """
    each = F.array(*[F.octet_length(name) for name in names]).cast("array<int>")
    short = F.coalesce(F.array_max(each), F.lit(0)) <= 32_767
    return [
        F.concat_ws("", *names).alias(texts),
        F.when(short, each.cast("array<smallint>")).alias(lengths),
        F.when(~short, each).alias(f"{lengths}_long"),
    ]


def unpacked_texts(names: Sequence[str], texts: str, lengths: str) -> list[Column]:
    """The columns that ``packed_texts`` put together, byte by byte; NULL where one was NULL."""
    found, at = [], F.lit(1)
    for i, name in enumerate(names):
        length = F.coalesce(F.get(f"{lengths}_long", F.lit(i)), F.get(lengths, F.lit(i)).cast("int"))
        found.append(F.substring(F.col(texts).cast("binary"), at, length).cast("string").alias(name))
        at = at + F.coalesce(length, F.lit(0))
    return found
