"""Reading a rendered answer back into its parts, and shares for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket_spark.constants import SENTENCES
from docket_spark.functions.text import WHITESPACE

# --- Fixed values: markers in a rendered answer. ---
QUOTATION = "Complaint ([0-9]+) reported: [“\"]([^”\"]*)[”\"]"
DISPLAY_LABELS = ("issue", "sub_issue", "company_response_to_consumer", "company")
DISPLAY_ROWS = 5


def _prefix(name: str) -> str:
    """What a sentence says before its first value."""
    return SENTENCES[name].partition("{")[0]


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def _split_tail(text: Column, marker: str) -> tuple[Column, Column]:
    position = F.instr(text, marker)
    tail = F.when(
        position > 0,
        _strip(F.substring(text, position + F.lit(len(marker)), F.length(text))),
    )
    body = F.when(position > 0, _strip(F.substring(text, F.lit(1), position - 1))).otherwise(text)
    return body, tail


def parse_answer(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Body sentences, quotations and the two tails of every rendered answer."""
    body, limitations = _split_tail(F.coalesce(F.col(text), F.lit("")), _prefix("limitations"))
    body, interpretation = _split_tail(body, _prefix("interpretations"))
    step = answers.withColumns(
        {"_body": body, "interpretation": interpretation, "limitations": limitations}
    )
    sentences = F.split(_strip(F.regexp_replace("_body", QUOTATION, "")), r"(?<=[.!?])\s+")
    return step.withColumns(
        {
            "quoted_ids": F.regexp_extract_all("_body", F.lit(QUOTATION), F.lit(1)),
            "quotes": F.regexp_extract_all("_body", F.lit(QUOTATION), F.lit(2)),
            "sentences": F.filter(F.transform(sentences, _strip), lambda s: s != ""),
        }
    ).drop("_body")


def display_findings(result: DataFrame, *order: Column) -> DataFrame:
    """First rows of a ranked result as a label and a percentage with one decimal."""
    label = next((name for name in DISPLAY_LABELS if name in result.columns), None)
    if label is None or "share" not in result.columns:
        raise ValueError("findings need a share and one of the label columns")
    return (
        result.orderBy(*order)
        .limit(DISPLAY_ROWS)
        .select(
            F.col(label).alias("label"),
            (F.floor(F.coalesce(F.col("share"), F.lit(0.0)) * 1000 + 0.5) / 10).alias("value"),
        )
    )
