"""Draft claims selected from evidence by fixed rules, and their rendering.

A draft is two tables. claims: one row per claim with ``claim_no`` (ascending in draft order),
kind, template and its references. remarks: per question the interpretation and limitation texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket_spark.constants import (
    COHORT_INTERPRETATION,
    MAX_EXAMPLES,
    NO_REPEATED_LABEL,
    NOT_PREVALENCE,
    RELIEF_INTERPRETATION,
    SENTENCES,
    TRUNCATED_NARRATIVE,
    UNKNOWN_EXCLUDED,
)
from docket_spark.functions.text import bounded_quote, fill, format_number, quote_fingerprint
from docket_spark.operators.ranking import pick_examples
from docket_spark.operators.totals import joined_text
from docket_spark.plans.evidence import theme_lists

THEMES_TYPE = "array<struct<issue:string,sub_issue:string,retrieved_count:bigint>>"
SECTION = 1_000_000_000_000
RANKED_ROWS = 5
DRIVER_ROWS = 4
CHUNK = 1000


def row_template(profile: Column, row_index: Column) -> Column:
    """Template of a structured row under a profile, NULL when the profile does not use the row."""
    first = row_index == 0
    return (
        F.when(profile == "ranked_issues", F.when(row_index < RANKED_ROWS, "ranked_issue_row"))
        .when(profile == "response_distribution", F.lit("response_category_row"))
        .when(
            profile == "trend_drivers",
            F.when(first, "comparison_total").when(row_index < DRIVER_ROWS, "issue_driver"),
        )
        .when(
            profile == "quarter_drivers",
            F.when(first, "quarter_comparison_total").when(
                row_index < DRIVER_ROWS, "quarter_issue_driver"
            ),
        )
        .otherwise(F.when(first, "structured_row"))
    )


def _claims(
    frame: DataFrame, number: Column, kind: str, template: Column, **references: Column
) -> DataFrame:
    empty = {
        "row_index": F.lit(None).cast("int"),
        "columns": F.lit(None).cast("array<string>"),
        "complaint_id": F.lit(None).cast("string"),
        "quote": F.lit(None).cast("string"),
        "themes": F.lit(None).cast(THEMES_TYPE),
    }
    given = {**empty, **references}
    return frame.select(
        "question_id",
        number.cast("bigint").alias("claim_no"),
        F.lit(kind).alias("kind"),
        template.alias("template"),
        F.lit(1 if "row_index" in references else 0).alias("structured_ref_count"),
        F.lit(1 if "complaint_id" in references else 0).alias("narrative_ref_count"),
        *[value.alias(name) for name, value in given.items()],
    )


def examples(items: DataFrame) -> DataFrame:
    """Up to three quotable examples per question in evidence order."""
    quoted = items.withColumn("quote", bounded_quote(F.col("excerpt"))).withColumn(
        "_print", quote_fingerprint(F.col("quote"))
    )
    return pick_examples(
        quoted, "question_id", "complaint_id", "quote", "_print", "position", MAX_EXAMPLES
    )


def draft_claims(questions: DataFrame, rows: DataFrame, items: DataFrame) -> DataFrame:
    """Claims of every question: structured rows, then repeated labels, then examples."""
    profiles = questions.select("question_id", "profile")
    quantitative = rows.join(profiles, "question_id").withColumn(
        "_template", row_template(F.col("profile"), F.col("row_index"))
    )
    sampled = profiles.where(F.col("profile") == "sample_themes")
    labelled = theme_lists(items).join(sampled, "question_id", "left_semi")
    cited = examples(items).join(profiles, "question_id")
    example_template = F.when(
        F.col("profile") == "sample_themes", "sample_complaint"
    ).otherwise("attributed_complaint")
    return (
        _claims(
            quantitative.where(F.col("_template").isNotNull()),
            F.col("row_index"),
            "quantitative",
            F.col("_template"),
            row_index=F.col("row_index"),
            columns=F.col("row_columns"),
        )
        .unionByName(
            _claims(
                labelled,
                F.lit(SECTION),
                "sample_theme",
                F.lit("retrieved_sample_themes"),
                themes=F.col("expected_themes"),
            )
        )
        .unionByName(
            _claims(
                cited,
                F.lit(2 * SECTION) + F.col("example_no"),
                "narrative",
                example_template,
                complaint_id=F.col("complaint_id"),
                quote=F.col("quote"),
            )
        )
    )


def draft_remarks(questions: DataFrame, rows: DataFrame, items: DataFrame) -> DataFrame:
    """Interpretation and limitation texts of every question."""
    first_row = rows.where(F.col("row_index") == 0).select(
        "question_id",
        F.array_contains("row_columns", "timely_response_known_count").alias("has_known_count"),
    )
    truncated = items.groupBy("question_id").agg(F.max("truncated").alias("any_truncated"))
    labelled = theme_lists(items).select("question_id", F.lit(True).alias("has_themes"))
    facts = (
        questions.select("question_id", "profile")
        .join(first_row, "question_id", "left")
        .join(truncated, "question_id", "left")
        .join(labelled, "question_id", "left")
    )
    profile = F.col("profile")
    fixed_rows = profile.isin(
        "ranked_issues", "response_distribution", "trend_drivers", "quarter_drivers"
    )
    relief = (profile == "response_distribution") & F.col("has_known_count").isNotNull()
    rate = ~fixed_rows & F.coalesce("has_known_count", F.lit(False))
    unlabelled = (profile == "sample_themes") & F.col("has_themes").isNull()

    def texts(*choices: tuple[Column, str]) -> Column:
        chosen = F.array(*[F.when(applies, F.lit(text)) for applies, text in choices])
        return F.filter(chosen, lambda text: text.isNotNull())

    return facts.select(
        "question_id",
        texts(
            (relief, RELIEF_INTERPRETATION),
            (rate, UNKNOWN_EXCLUDED),
            (rate, COHORT_INTERPRETATION),
        ).alias("interpretations"),
        texts(
            (unlabelled, NO_REPEATED_LABEL),
            (profile.isin("sample_themes", "narrative_examples"), NOT_PREVALENCE),
            (F.coalesce("any_truncated", F.lit(False)), TRUNCATED_NARRATIVE),
        ).alias("limitations"),
    )


def _value_texts(rows: DataFrame) -> dict[str, Column]:
    """Every result column of the structured rows as display text."""
    texts = {}
    for field in rows.schema.fields:
        if field.name in {"question_id", "row_index", "row_columns"}:
            continue
        value = F.col(field.name)
        kind = field.dataType.simpleString()
        text = format_number(value) if kind in {"double", "float"} else value.cast("string")
        texts[field.name] = F.coalesce(text, F.lit("None"))
    return texts


def claim_texts(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """The sentence of every claim, from the template it names."""
    texts = _value_texts(rows)

    def value(name: str) -> Column:
        return texts.get(name, F.lit("None"))

    pairs = [part for name, text in texts.items() for part in (F.lit(name), text)]
    change = F.col("absolute_change") if "absolute_change" in texts else F.lit(None).cast("bigint")
    share = F.col("share") if "share" in texts else F.lit(None).cast("double")
    shown = {
        "issue": value("issue"),
        "category": value("company_response_to_consumer"),
        "company": value("winner_company"),
        "count": value("complaint_count"),
        "percent": format_number(share * 100),
        "total": value("total_complaints"),
        "direction": F.when(change > 0, "up").when(change < 0, "down").otherwise("flat"),
        "baseline": value("baseline_complaints"),
        "comparison": value("comparison_complaints"),
        "change": value("absolute_change"),
    }
    sentences = ("ranked_issue_row", "response_category_row", "comparison_total")
    sentences += ("quarter_comparison_total", "driver")
    rendered_rows = rows.select(
        "question_id",
        "row_index",
        F.create_map(*pairs).alias("_values"),
        *[fill(SENTENCES[name], **shown).alias(f"_{name}") for name in sentences],
    )
    joined = claims.join(rendered_rows, ["question_id", "row_index"], "left")
    template = F.col("template")
    cells = F.transform(
        "columns", lambda name: F.concat(name, F.lit("="), F.element_at("_values", name))
    )
    labels = F.transform(
        "themes",
        lambda theme: F.concat(
            theme["issue"],
            F.coalesce(F.concat(F.lit(" / "), theme["sub_issue"]), F.lit("")),
            F.lit(" ("),
            theme["retrieved_count"].cast("string"),
            F.lit(")"),
        ),
    )
    cited = {"id": F.col("complaint_id"), "quote": F.col("quote")}
    text = (
        F.when(template == "ranked_issue_row", F.col("_ranked_issue_row"))
        .when(template == "response_category_row", F.col("_response_category_row"))
        .when(template == "comparison_total", F.col("_comparison_total"))
        .when(template == "quarter_comparison_total", F.col("_quarter_comparison_total"))
        .when(template.isin("issue_driver", "quarter_issue_driver"), F.col("_driver"))
        .when(
            F.col("kind") == "quantitative",
            fill(SENTENCES["structured_row"], cells=F.array_join(cells, ", ")),
        )
        .when(template == "sample_complaint", fill(SENTENCES["sample_complaint"], **cited))
        .when(F.col("kind") == "narrative", fill(SENTENCES["attributed_complaint"], **cited))
        .when(
            F.col("kind") == "sample_theme",
            fill(SENTENCES["themes"], labels=F.array_join(labels, "; ")),
        )
        .otherwise(fill(SENTENCES["limitation"], text=template))
    )
    return joined.select("question_id", "claim_no", text.alias("text"))


def render(claims: DataFrame, remarks: DataFrame, rows: DataFrame) -> DataFrame:
    """Answer text of every draft: its sentences, then interpretation and limitation tails."""
    sentences = joined_text(
        claim_texts(claims, rows),
        ["question_id"],
        ["claim_no"],
        "text",
        " ",
        "sentences",
        F.floor(F.col("claim_no") / CHUNK),
    )

    def tail(name: str) -> Column:
        return F.when(F.size(name) > 0, fill(SENTENCES[name], texts=F.array_join(name, " ")))

    return remarks.join(sentences, "question_id", "left").select(
        "question_id",
        F.concat_ws(
            " ",
            "sentences",
            tail("interpretations"),
            tail("limitations"),
        ).alias("answer"),
    )
