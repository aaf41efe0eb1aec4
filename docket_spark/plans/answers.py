"""Answer records: rendered drafts, or abstentions with their reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket_spark.constants import (
    NO_NARRATIVES_REASON,
    NO_ROWS_REASON,
    REJECTED_PREFIX,
    SENTENCES,
)
from docket_spark.functions.text import fill, is_nonblank


def answer_records(
    questions: DataFrame,
    coverage: DataFrame,
    entities: DataFrame,
    rows: DataFrame,
    items: DataFrame,
    verdicts: DataFrame,
    rendered: DataFrame,
    outcomes: DataFrame | None = None,
) -> DataFrame:
    """One record per question; the first thing that failed decides why it abstains.

    ``questions``: ``question_id, mode, query, company_or_brand``. ``coverage``: ``question_id,
    answerable, reason``. ``entities``: ``question_id, status`` of questions that name a company, with
    ``conflict`` where a question contradicts what was resolved. ``outcomes``: ``question_id, status,
    error`` of retrieval requests, failed bindings among them.
    A query that ran is kept on the record even when the question abstains later.
    """
    with_rows = rows.select("question_id").distinct().withColumn("has_rows", F.lit(True))
    with_items = items.select("question_id").distinct().withColumn("has_items", F.lit(True))
    if "conflict" not in entities.columns:
        entities = entities.withColumn("conflict", F.lit(None).cast("string"))
    facts = (
        questions.join(
            coverage.select("question_id", "answerable", F.col("reason").alias("uncovered")),
            "question_id",
        )
        .join(entities.select("question_id", "status", "conflict"), "question_id", "left")
        .join(with_rows, "question_id", "left")
        .join(with_items, "question_id", "left")
        .join(verdicts.select("question_id", "accepted", "reasons", "citations"), "question_id", "left")
        .join(rendered, "question_id", "left")
    )
    if outcomes is None:
        facts = facts.withColumn("failed", F.lit(None).cast("string"))
    else:
        wrong = F.when(F.col("status").endswith("_error"), F.col("error")).alias("failed")
        facts = facts.join(outcomes.select("question_id", wrong), "question_id", "left")
    uncovered = ~F.col("answerable")
    unresolved = F.col("company_or_brand").isNotNull() & (
        F.coalesce("status", F.lit("unresolved")) == "unresolved"
    )
    no_rows = F.col("mode").isin("structured", "combined") & F.col("has_rows").isNull()
    no_items = F.col("mode").isin("narrative", "combined") & F.col("has_items").isNull()
    rejected = ~F.coalesce("accepted", F.lit(False))
    refusal = (
        F.when(uncovered, F.col("uncovered"))
        .when(
            unresolved,
            fill(SENTENCES["unresolved"], name=F.col("company_or_brand")),
        )
        .when(
            F.col("conflict").isNotNull(),
            F.concat(F.lit("The question contradicts the company it names: "), "conflict", F.lit(".")),
        )
        .when(no_rows, NO_ROWS_REASON)
        .when(
            F.col("mode").isin("narrative", "combined") & F.col("failed").isNotNull(),
            F.concat(F.lit("Narratives could not be searched: "), "failed", F.lit(".")),
        )
        .when(no_items, NO_NARRATIVES_REASON)
        .when(rejected, F.concat(F.lit(REJECTED_PREFIX), "reasons"))
    )
    citations = F.transform(
        F.filter(F.split(F.coalesce("citations", F.lit("")), ","), lambda c: c != ""),
        lambda c: c.cast("bigint"),
    )
    asked = F.col("mode").isin("structured", "combined") & ~uncovered & ~unresolved
    asked = asked & F.col("conflict").isNull()
    return facts.select(
        "question_id",
        F.coalesce(refusal, F.col("answer")).alias("answer"),
        F.when(refusal.isNull(), citations)
        .otherwise(F.array().cast("array<bigint>"))
        .alias("citations"),
        F.when(asked, F.col("query")).alias("query"),
        refusal.isNotNull().alias("abstained"),
    )


def record_violations(answers: DataFrame) -> DataFrame:
    """Counts of records that break the answer contract; all must be zero."""
    return answers.agg(
        F.count_if(~F.coalesce(is_nonblank(F.col("question_id")), F.lit(False))).alias(
            "blank_question_ids"
        ),
        F.count_if(~F.coalesce(is_nonblank(F.col("answer")), F.lit(False))).alias("blank_answers"),
        F.count_if(F.exists("citations", lambda c: c.isNull())).alias("invalid_citations"),
        F.count_if(F.col("abstained") & (F.size("citations") > 0)).alias("cited_abstentions"),
    )
