"""The grounding audit: every figure, citation and quotation of a draft against its evidence.

Each check yields rows ``question_id, stage, major, minor, reason``; the three numbers give the
order in which reasons are reported. A draft is accepted when it has none. Checks are joins and
aggregates over claim and evidence tables, so a question with very many claims is spread like any
other data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket_spark.constants import (
    AUDITED_FIELDS,
    CLAIM_TEMPLATES,
    MAX_EXAMPLES,
    MAX_THEMES,
    REASONS,
    SEQUENCE_REASONS,
    TEMPLATE_COLUMNS,
    THEME_LIMITATIONS,
)
from docket_spark.functions.text import (
    collapse_whitespace,
    contains_quote,
    fill,
    fold,
    is_canonical_id,
)
from docket_spark.operators.ranking import first_rows
from docket_spark.operators.totals import joined_text
from docket_spark.plans.drafts import CHUNK, DRIVER_ROWS, RANKED_ROWS, SECTION, row_template
from docket_spark.plans.evidence import theme_lists

REASON_COLUMNS = ("question_id", "stage", "major", "minor", "reason")
MISSING, EVIDENCE, CLAIMS, DRAFT = 0, 1, 2, 3


def _named(identifier: Column, reason: str, field: str = "") -> Column:
    return fill(REASONS[reason], id=identifier, field=F.lit(field))


def _checks(frame: DataFrame, stage: int, major: Column, *checks: Column) -> DataFrame:
    """One row per failed check; ``checks`` are texts that are NULL when the check passes."""
    reasons = F.filter(
        F.transform(F.array(*checks), lambda text, i: F.struct(i.alias("minor"), text.alias("reason"))),
        lambda entry: entry["reason"].isNotNull(),
    )
    return frame.select(
        "question_id",
        F.lit(stage).alias("stage"),
        major.cast("bigint").alias("major"),
        F.explode(reasons).alias("_entry"),
    ).select("question_id", "stage", "major", "_entry.minor", "_entry.reason")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(*REASON_COLUMNS) for p in parts])


def metadata_checks(identifier: Column) -> list[Column]:
    """Texts for metadata that breaks the question's filters (columns ``want_*``)."""
    checks = []
    for name in AUDITED_FIELDS:
        wanted, actual = F.col(f"want_{name}"), F.col(name)
        absent = F.coalesce(collapse_whitespace(actual) == "", F.lit(True))
        checks.append(
            F.when(
                wanted.isNotNull(),
                F.when(absent, _named(identifier, "missing_metadata", name)).when(
                    fold(actual) != fold(wanted), _named(identifier, "mismatched_filter", name)
                ),
            )
        )
    flag = fold(F.coalesce("timely_response", F.lit("")))
    checks.append(
        F.when(
            F.col("want_timely_response").isNotNull(),
            F.when(
                ~flag.isin("true", "false"),
                _named(identifier, "invalid_timely"),
            ).when(
                (flag == "true") != F.col("want_timely_response"),
                _named(identifier, "mismatched_timely"),
            ),
        )
    )
    text = F.col("date_received")
    day = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))
    ranged = F.col("want_start").isNotNull() | F.col("want_end").isNotNull()
    checks.append(
        F.when(ranged & day.isNull(), _named(identifier, "invalid_date"))
    )
    checks.append(
        F.when(day < F.col("want_start"), _named(identifier, "before_start"))
    )
    checks.append(
        F.when(day >= F.col("want_end"), _named(identifier, "outside_end"))
    )
    return checks


def evidence_reasons(items: DataFrame, filters: DataFrame) -> DataFrame:
    """Every returned item, cited or not, against the filters; identifiers canonical and unique.

    ``filters``: per question ``want_<field>`` for the audited fields, ``want_timely_response``,
    ``want_start`` and ``want_end``, NULL where nothing is asked.
    """
    identifier = F.col("complaint_id")
    wanted = items.join(filters, "question_id")
    single = _checks(
        wanted,
        EVIDENCE,
        F.col("position"),
        *metadata_checks(identifier),
        F.when(~is_canonical_id(identifier), _named(identifier, "not_canonical")),
    )
    again = first_rows(
        items.select("question_id", "complaint_id", "position"),
        ["question_id", "complaint_id"],
        [F.col("position").asc()],
        2,
        "_nth",
    ).where(F.col("_nth") == 2)
    repeated = again.select(
        "question_id",
        F.lit(EVIDENCE).alias("stage"),
        F.col("position").cast("bigint").alias("major"),
        F.lit(100).alias("minor"),
        _named(identifier, "duplicated_evidence").alias("reason"),
    )
    return _union([single, repeated])


def _template_allowed() -> Column:
    allowed = [
        F.when(F.col("kind") == kind, F.col("template").isin(*templates))
        for kind, templates in CLAIM_TEMPLATES.items()
    ]
    return F.coalesce(*allowed, F.lit(False))


def shape_reasons(claims: DataFrame) -> DataFrame:
    """Claims of unknown kind or with a template their kind does not allow."""
    known = F.col("kind").isin(*CLAIM_TEMPLATES)
    return _checks(
        claims,
        CLAIMS,
        F.col("claim_no"),
        F.when(~known, fill(REASONS["unknown_kind"], kind=F.col("kind"))).when(
            ~_template_allowed(),
            fill(
                REASONS["disallowed_template"],
                kind=F.col("kind"),
                template=F.col("template"),
            ),
        ),
    )


def _expected_columns() -> Column:
    return F.coalesce(
        *[
            F.when(F.col("template") == name, F.array(*[F.lit(c) for c in columns]))
            for name, columns in TEMPLATE_COLUMNS.items()
        ]
    )


def _quantitative_claims(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """Quantitative claims with the row they refer to."""
    usable = claims.where((F.col("kind") == "quantitative") & _template_allowed())
    known_rows = rows.select(
        "question_id",
        "row_index",
        "row_columns",
        F.col("row_type") if "row_type" in rows.columns else F.lit(None).cast("string").alias("row_type"),
    )
    return usable.join(known_rows, ["question_id", "row_index"], "left").withColumn(
        "_single",
        (F.col("structured_ref_count") == 1)
        & (F.col("narrative_ref_count") == 0)
        & F.col("themes").isNull(),
    )


def absent_rows(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """Row references to a row that the question's result does not have."""
    return (
        _quantitative_claims(claims, rows)
        .where(F.col("_single") & F.col("row_columns").isNull())
        .select("question_id", "claim_no", "row_index")
    )


def quantitative_reasons(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """Structured references: one per claim, an existing row, and exactly the template's columns."""
    joined = _quantitative_claims(claims, rows)
    single = F.col("_single")
    found = single & F.col("row_columns").isNotNull()
    template, row_type = F.col("template"), F.col("row_type")
    columns = F.coalesce("columns", F.array().cast("array<string>"))
    expected = _expected_columns()
    return _checks(
        joined,
        CLAIMS,
        F.col("claim_no"),
        F.when(~single, REASONS["one_row_reference"]).when(
            ~found, REASONS["absent_row"]
        ),
        F.when(
            found & (F.size(columns) == 0), REASONS["no_column"]
        ),
        F.when(
            found & (F.size(F.array_except(columns, F.col("row_columns"))) > 0),
            REASONS["absent_column"],
        ),
        F.when(
            found & expected.isNotNull() & (columns != expected),
            fill(REASONS["exact_columns"], template=template),
        ),
        F.when(
            found
            & template.isin("comparison_total", "quarter_comparison_total")
            & ~row_type.eqNullSafe(F.lit("total")),
            REASONS["total_row"],
        ),
        F.when(
            found
            & template.isin("issue_driver", "quarter_issue_driver")
            & ~row_type.eqNullSafe(F.lit("driver")),
            REASONS["driver_row"],
        ),
    )


def _narrative_claims(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Narrative claims with the excerpt they cite; the last item of a repeated id counts."""
    last = items.groupBy("question_id", "complaint_id").agg(
        F.max_by("excerpt", "position").alias("excerpt")
    )
    return (
        claims.where((F.col("kind") == "narrative") & _template_allowed())
        .withColumn(
            "_single",
            (F.col("narrative_ref_count") == 1)
            & (F.col("structured_ref_count") == 0)
            & F.col("themes").isNull(),
        )
        .join(last, ["question_id", "complaint_id"], "left")
    )


def citations(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct cited complaints that are in the evidence, in order of first citation."""
    return (
        _narrative_claims(claims, items)
        .where(F.col("_single") & F.col("excerpt").isNotNull())
        .groupBy("question_id", "complaint_id")
        .agg(F.min("claim_no").alias("claim_no"))
    )


def absent_citations(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Citations of a complaint that is not in the question's evidence."""
    return (
        _narrative_claims(claims, items)
        .where(F.col("_single") & F.col("excerpt").isNull())
        .select("question_id", "claim_no", "complaint_id")
    )


def narrative_reasons(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Citations: in evidence, canonical, not repeated, and quoted literally."""
    joined = _narrative_claims(claims, items)
    identifier = F.col("complaint_id")
    found = F.col("_single") & F.col("excerpt").isNotNull()
    single = _checks(
        joined,
        CLAIMS,
        F.col("claim_no"),
        F.when(
            ~F.col("_single"), REASONS["one_citation"]
        ).when(F.col("excerpt").isNull(), _named(identifier, "not_in_evidence")),
        F.when(
            found & ~is_canonical_id(identifier), _named(identifier, "not_canonical")
        ),
        F.lit(None).cast("string"),
        F.when(
            found & ~contains_quote(F.col("excerpt"), F.col("quote")),
            _named(identifier, "not_in_excerpt"),
        ),
    )
    again = first_rows(
        joined.where(found).select("question_id", "complaint_id", "claim_no"),
        ["question_id", "complaint_id"],
        [F.col("claim_no").asc()],
        2,
        "_nth",
    ).where(F.col("_nth") == 2)
    repeated = again.select(
        "question_id",
        F.lit(CLAIMS).alias("stage"),
        F.col("claim_no").alias("major"),
        F.lit(2).alias("minor"),
        _named(identifier, "duplicated").alias("reason"),
    )
    return _union([single, repeated])


def theme_reasons(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Repeated-label claims must equal the labels recomputed from the evidence."""
    joined = claims.where((F.col("kind") == "sample_theme") & _template_allowed()).join(
        theme_lists(items), "question_id", "left"
    )
    alone = (F.col("structured_ref_count") == 0) & (F.col("narrative_ref_count") == 0)
    sized = F.coalesce(F.size("themes").between(1, MAX_THEMES), F.lit(False))
    return _checks(
        joined,
        CLAIMS,
        F.col("claim_no"),
        F.when(~alone, REASONS["theme_references"])
        .when(~sized, REASONS["theme_size"])
        .when(
            ~F.col("themes").eqNullSafe(F.col("expected_themes")),
            REASONS["theme_mismatch"],
        ),
    )


def limitation_reasons(claims: DataFrame) -> DataFrame:
    referenced = (
        (F.col("structured_ref_count") > 0)
        | (F.col("narrative_ref_count") > 0)
        | F.col("themes").isNotNull()
    )
    return _checks(
        claims.where((F.col("kind") == "limitation") & _template_allowed()),
        CLAIMS,
        F.col("claim_no"),
        F.when(referenced, REASONS["limitation_references"]),
    )


def sequence_facts(questions: DataFrame, claims: DataFrame, rows: DataFrame) -> DataFrame:
    """Per question whether its structured claims are exactly the expected rows in order.

    Equality of two ordered lists without gathering either: the claims must name the rows
    0..m-1 once each with the right template, and every row's claim must come before the next
    row's claim.
    """
    by_row = (
        claims.where(F.col("kind") == "quantitative")
        .withColumn("_row", F.when(F.col("structured_ref_count") == 1, F.col("row_index")))
        .join(questions.select("question_id", "profile"), "question_id")
        .groupBy("question_id", "_row")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("claim_no").alias("first_no"),
            F.max("claim_no").alias("last_no"),
            F.max(
                ~F.coalesce(
                    F.col("template") == row_template(F.col("profile"), F.col("_row")),
                    F.lit(False),
                )
            ).alias("wrong"),
        )
    )
    following = by_row.select(
        "question_id", (F.col("_row") - 1).alias("_row"), F.col("first_no").alias("next_no")
    )
    claimed = (
        by_row.join(following, ["question_id", "_row"], "left")
        .groupBy("question_id")
        .agg(
            F.sum("n").alias("claimed"),
            F.max(
                F.col("wrong")
                | (F.col("n") > 1)
                | F.col("_row").isNull()
                | F.coalesce(F.col("last_no") >= F.col("next_no"), F.lit(False))
            ).alias("broken"),
            F.max("_row").alias("last_row"),
        )
    )
    sizes = rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("row_count"))
    row_count = F.coalesce("row_count", F.lit(0))
    profile = F.col("profile")
    expected = (
        F.when(profile == "response_distribution", row_count)
        .when(profile == "ranked_issues", F.least(row_count, F.lit(RANKED_ROWS)))
        .when(
            profile.isin("trend_drivers", "quarter_drivers"),
            F.greatest(F.lit(1), F.least(row_count, F.lit(DRIVER_ROWS))),
        )
    )
    claimed_count = F.coalesce("claimed", F.lit(0))
    complete = (
        (claimed_count == F.col("expected"))
        & ~F.coalesce("broken", F.lit(False))
        & (F.coalesce("last_row", F.lit(-1)) == F.col("expected") - 1)
    )
    return (
        questions.join(sizes, "question_id", "left")
        .join(claimed, "question_id", "left")
        .withColumn("expected", expected)
        .withColumn("in_sequence", F.col("expected").isNull() | complete)
        .select(
            "question_id", F.col("expected").alias("expected_rows"),
            claimed_count.alias("claimed_rows"), "in_sequence",
        )
    )


def draft_facts(
    questions: DataFrame, claims: DataFrame, remarks: DataFrame, rows: DataFrame, items: DataFrame
) -> DataFrame:
    """Per question the counts the draft-level checks need.

    ``questions``: ``question_id, mode, profile, has_structured, has_retrieval``.
    """
    kinds = claims.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("claim_count"),
        F.count_if(F.col("kind") == "sample_theme").alias("theme_claims"),
        F.count_if(
            (F.col("kind") == "narrative") & (F.col("template") != "sample_complaint")
        ).alias("plain_examples"),
    )
    cited = citations(claims, items).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("citation_count")
    )
    known = rows.where(
        (F.col("row_index") == 0) & F.array_contains("row_columns", "timely_response_known_count")
    ).select("question_id", F.lit(True).alias("rate_row"))
    return (
        questions.select("question_id", "mode", "profile", "has_structured", "has_retrieval")
        .join(kinds, "question_id", "left")
        .join(cited, "question_id", "left")
        .join(known, "question_id", "left")
        .join(theme_lists(items), "question_id", "left")
        .join(remarks, "question_id", "left")
        .join(
            sequence_facts(questions, claims, rows).select("question_id", "in_sequence"),
            "question_id",
        )
        .na.fill(0, ["claim_count", "theme_claims", "plain_examples", "citation_count"])
    )


def draft_reasons(facts: DataFrame) -> DataFrame:
    """Draft-level checks, in the order they are reported."""
    mode, profile = F.col("mode"), F.col("profile")
    structured = F.col("has_structured")
    sampled = profile == "sample_themes"
    expects_themes = F.col("expected_themes").isNotNull()
    themed = F.col("theme_claims")
    allowed = F.array(*[F.lit(text) for text in THEME_LIMITATIONS])
    discloses_unknown = F.exists(
        F.coalesce("interpretations", F.array().cast("array<string>")),
        lambda text: F.contains(F.lower(text), F.lit("unknown")),
    )
    missing = _checks(
        facts,
        MISSING,
        F.lit(0),
        F.when(
            mode.isin("structured", "combined") & ~structured,
            REASONS["missing_structured"],
        ),
        F.when(
            mode.isin("narrative", "combined") & ~F.col("has_retrieval"),
            REASONS["missing_narrative"],
        ),
    )
    sequence = [
        F.when(structured & (profile == name) & ~F.col("in_sequence"), F.lit(text))
        for name, text in SEQUENCE_REASONS.items()
    ]
    drafted = _checks(
        facts,
        DRAFT,
        F.lit(0),
        *sequence,
        F.when(
            sampled & expects_themes & (themed != 1),
            REASONS["one_theme_claim"],
        ),
        F.when(
            sampled & ~expects_themes & (themed > 0),
            REASONS["no_theme_claim"],
        ),
        F.when(
            sampled & (F.col("plain_examples") > 0),
            REASONS["sample_templates"],
        ),
        F.when(
            sampled & (F.size("interpretations") > 0),
            REASONS["no_interpretation"],
        ),
        F.when(
            sampled & (F.size(F.array_except("limitations", allowed)) > 0),
            REASONS["allowed_limitations"],
        ),
        F.when(
            F.col("citation_count") > MAX_EXAMPLES,
            REASONS["too_many_citations"],
        ),
        F.when(
            mode.isin("narrative", "combined") & (F.col("citation_count") == 0),
            REASONS["no_citation"],
        ),
        F.when(
            F.col("rate_row") & ~discloses_unknown,
            REASONS["no_denominator"],
        ),
    )
    return _union([missing, drafted])


def all_reasons(
    questions: DataFrame,
    claims: DataFrame,
    remarks: DataFrame,
    rows: DataFrame,
    items: DataFrame,
    filters: DataFrame,
) -> DataFrame:
    """Every distinct reason once per question, at the first place it occurs."""
    found = _union(
        [
            evidence_reasons(items, filters),
            shape_reasons(claims),
            quantitative_reasons(claims, rows),
            narrative_reasons(claims, items),
            theme_reasons(claims, items),
            limitation_reasons(claims),
            draft_reasons(draft_facts(questions, claims, remarks, rows, items)),
        ]
    )
    place = F.min(F.struct("stage", "major", "minor")).alias("_place")
    return (
        found.groupBy("question_id", "reason")
        .agg(place)
        .select("question_id", "_place.stage", "_place.major", "_place.minor", "reason")
    )


def template_hash(claims: DataFrame) -> DataFrame:
    """SHA-256 of the JSON list of kind and template pairs in draft order."""
    pair = F.concat(
        F.lit('["'), F.col("kind"), F.lit('","'), F.col("template"), F.lit('"]')
    )
    listed = joined_text(
        claims.select("question_id", "claim_no", pair.alias("pair")),
        ["question_id"],
        ["claim_no"],
        "pair",
        ",",
        "pairs",
        F.floor(F.col("claim_no") / CHUNK),
    )
    return listed.select(
        "question_id",
        F.sha2(F.concat(F.lit("["), F.col("pairs"), F.lit("]")), 256).alias("template_hash"),
    )


def verdicts(
    questions: DataFrame,
    claims: DataFrame,
    items: DataFrame,
    reasons: DataFrame,
) -> DataFrame:
    """One row per question: accepted or not, reasons in order, citations of accepted drafts."""
    text = joined_text(
        reasons,
        ["question_id"],
        ["stage", "major", "minor", "reason"],
        "reason",
        "; ",
        "reasons",
        F.col("stage") * SECTION * 10 + F.floor(F.col("major") / CHUNK),
    )
    counted = reasons.groupBy("question_id").agg(F.count(F.lit(1)).alias("reason_count"))
    kept = citations(claims, items).join(counted, "question_id", "left_anti")
    cited = joined_text(kept, ["question_id"], ["claim_no"], "complaint_id", ",", "cited")
    size = claims.groupBy("question_id").agg(F.count(F.lit(1)).alias("claim_count"))
    accepted = F.col("reason_count").isNull()
    return (
        questions.select("question_id")
        .join(counted, "question_id", "left")
        .join(text, "question_id", "left")
        .join(cited, "question_id", "left")
        .join(size, "question_id", "left")
        .join(template_hash(claims), "question_id", "left")
        .select(
            "question_id",
            accepted.alias("accepted"),
            F.coalesce("reason_count", F.lit(0)).cast("bigint").alias("reason_count"),
            F.coalesce("reasons", F.lit("")).alias("reasons"),
            F.when(accepted, F.coalesce("cited", F.lit(""))).otherwise("").alias("citations"),
            F.coalesce("claim_count", F.lit(0)).alias("claim_count"),
            F.coalesce("template_hash", F.sha2(F.lit("[]"), 256)).alias("template_hash"),
        )
    )
