"""What a request text asks for: names, dates and intent flags, as columns over a text table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docket_spark.constants import BRAND_PHRASES, PRODUCT_PHRASES, STATE_TOKENS
from docket_spark.functions.text import fold


def normalise_request(text: Column) -> Column:
    return fold(text)


def _first_match(pairs, matches) -> Column:
    return F.coalesce(*[F.when(matches(phrase), F.lit(value)) for phrase, value in pairs])


def tagged_brand(text: Column) -> Column:
    return _first_match(BRAND_PHRASES, lambda phrase: F.contains(text, F.lit(phrase)))


def tagged_product(text: Column) -> Column:
    return _first_match(PRODUCT_PHRASES, lambda phrase: F.contains(text, F.lit(phrase)))


def tagged_state(text: Column) -> Column:
    """States match whole alphabetic tokens only, so "ca" is not found in "cash"."""
    tokens = F.split(text, "[^a-z]+")
    return _first_match(STATE_TOKENS, lambda token: F.array_contains(tokens, token))


def _years(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)),
        lambda year: year.cast("int"),
    )


def requested_period(text: Column) -> tuple[Column, Column]:
    """Half-open date range named in the text, NULL where none is.

    A named half year wins over a quarter, a quarter over years; several years span from the
    first to the end of the last.
    """
    second_half = F.contains(text, F.lit("second half of 2025")) | F.contains(
        text, F.lit("h2 2025")
    )
    quarter_pattern = r"\bq([1-4])\s*(20[0-9]{2})\b"
    quarter = F.regexp_extract(text, quarter_pattern, 1)
    quarter_start = F.make_date(
        F.regexp_extract(text, quarter_pattern, 2).try_cast("int"),
        quarter.try_cast("int") * 3 - 2,
        F.lit(1),
    )
    years = _years(text)
    has_year = F.size(years) > 0
    start = (
        F.when(second_half, F.lit("2025-07-01").cast("date"))
        .when(quarter != "", quarter_start)
        .when(has_year, F.make_date(F.array_min(years), F.lit(1), F.lit(1)))
    )
    end = (
        F.when(second_half, F.lit("2026-01-01").cast("date"))
        .when(quarter != "", F.add_months(quarter_start, 3))
        .when(has_year, F.make_date(F.array_max(years) + 1, F.lit(1), F.lit(1)))
    )
    return start, end


# --- Fixed values: phrases that signal an intent. ---
RELIEF_AMOUNT_PHRASES = ("how much money", "typically get back", "dollar amount")
SPIKE_PHRASES = ("biggest spike", "surge in complaints")
LATE_PHRASES = ("worst at responding on time", "late cases")
RELIEF_PHRASES = ("actual relief", "company resolve")
TREND_PHRASES = ("going up or down", "trend")
REGIONAL_PHRASES = ("regional-banking", "regional banking")
NARRATIVE_WORDS = (
    "what",
    "why",
    "how",
    "frustration",
    "scam",
    "fraud",
    "impact",
    "describe",
    "handling",
)


def _mentions(text: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(phrase)) for phrase in phrases])


def intent_flags(text: Column) -> dict[str, Column]:
    """One boolean column per recognised intent over normalised text."""
    whole_words = "|".join(rf"\b{phrase}\b" for phrase in RELIEF_AMOUNT_PHRASES)
    return {
        "asks_relief_amount": text.rlike(whole_words),
        "asks_auto_claims": F.contains(text, F.lit("auto insurance"))
        & F.contains(text, F.lit("claim")),
        "asks_spike": _mentions(text, SPIKE_PHRASES),
        "asks_late_response": _mentions(text, LATE_PHRASES),
        "asks_relief_outcome": _mentions(text, RELIEF_PHRASES),
        "asks_trend": _mentions(text, TREND_PHRASES),
        "asks_regional_banking": _mentions(text, REGIONAL_PHRASES),
        "asks_narrative": _mentions(text, NARRATIVE_WORDS),
    }
