"""Names, texts and limits that results depend on."""

from __future__ import annotations

# --- Fixed values: the sixteen source columns, in source order. ---
SOURCE_COLUMNS = (
    "date_received",
    "product",
    "sub_product",
    "issue",
    "sub_issue",
    "consumer_complaint_narrative",
    "company_public_response",
    "company",
    "state",
    "zip_code",
    "tags",
    "submitted_via",
    "date_sent_to_company",
    "company_response_to_consumer",
    "timely_response",
    "complaint_id",
)

# --- Fixed values: columns each stage cannot run without. ---
BRONZE_REQUIRED = ("complaint_id", "consumer_complaint_narrative", "date_received")
GOLD_REQUIRED = (
    "complaint_id",
    "company",
    "product",
    "issue",
    "company_response_to_consumer",
    "date_received",
    "timely_response",
    "state",
)
INDEX_REQUIRED = (
    "complaint_id",
    "consumer_complaint_narrative",
    "company",
    "company_key",
    "brand_name",
    "date_received",
)

# --- Fixed values: the declared population, both bounds inclusive. ---
POPULATION_START = "2024-01-01"
POPULATION_END = "2025-12-31"

# --- Fixed values: dimensions of the monthly metric tables, in declaration order. ---
MONTH = "complaint_month"
METRIC_TABLES = {
    "company_product_month_metrics": ("company", "product", MONTH),
    "company_month_metrics": ("company", MONTH),
    "product_month_metrics": ("product", MONTH),
    "company_issue_month_metrics": ("company", "issue", MONTH),
    "product_issue_sub_issue_month_metrics": ("product", "issue", "sub_issue", MONTH),
    "company_product_state_issue_month_metrics": ("company", "product", "state", "issue", MONTH),
    "company_response_month_metrics": ("company", "company_response_to_consumer", MONTH),
}

# --- Fixed values: curated companies as (legal name, brand, aliases). ---
COMPANY_REGISTRY = (
    ("Block, Inc.", "Cash App", ("Cash App",)),
    ("Early Warning Services, LLC", "Zelle", ("Zelle",)),
    ("TRANSUNION INTERMEDIATE HOLDINGS, INC.", "TransUnion", ("TransUnion",)),
    ("MOHELA", "MOHELA", ("MOHELA",)),
)

# --- Fixed values: phrases recognised in request text, first match in this order wins. ---
BRAND_PHRASES = (
    ("cash app", "Cash App"),
    ("zelle", "Zelle"),
    ("transunion", "TransUnion"),
    ("mohela", "MOHELA"),
)
PRODUCT_PHRASES = (
    ("debt collection", "Debt collection"),
    ("credit report", "Credit reporting or other personal consumer reports"),
    ("checking and savings", "Checking or savings account"),
    ("checking or savings", "Checking or savings account"),
    ("mortgage", "Mortgage"),
    ("student loan", "Student loan"),
)
STATE_TOKENS = (("california", "CA"), ("ca", "CA"))

# --- Fixed values: narrative index limits and schema version. ---
MAX_NARRATIVE_CHARS = 6000
EMBED_BATCH = 100
METADATA_SCHEMA_VERSION = 2
NARRATIVE_MARKER = "Consumer narrative:\n"

# --- Fixed values: quotation limits. ---
QUOTE_CHARS = 280
QUOTE_MIN_SENTENCE = 40
MAX_EXAMPLES = 3
MAX_THEMES = 3
DEFAULT_TOP_K = 8
OVERFETCH = 3

# --- Fixed values: which templates a claim kind may use. ---
CLAIM_TEMPLATES = {
    "quantitative": (
        "structured_row",
        "ranked_issue_row",
        "response_category_row",
        "comparison_total",
        "issue_driver",
        "quarter_comparison_total",
        "quarter_issue_driver",
    ),
    "narrative": ("attributed_complaint", "sample_complaint"),
    "sample_theme": ("retrieved_sample_themes",),
    "limitation": ("limitation",),
}

# --- Fixed values: exact ordered columns of a template's structured reference. ---
_RANKED = ("complaint_count", "total_complaints", "share")
_CHANGE = (
    "issue",
    "baseline_complaints",
    "comparison_complaints",
    "absolute_change",
    "percentage_change",
)
TEMPLATE_COLUMNS = {
    "ranked_issue_row": ("issue", *_RANKED),
    "response_category_row": ("company_response_to_consumer", *_RANKED),
    "comparison_total": ("row_type", *_CHANGE),
    "issue_driver": ("row_type", *_CHANGE),
    "quarter_comparison_total": ("row_type", "winner_company", *_CHANGE),
    "quarter_issue_driver": ("row_type", "winner_company", *_CHANGE),
}

# --- Fixed values: texts an answer may contain. ---
NO_REPEATED_LABEL = (
    "No issue/sub-issue label repeated among the retrieved examples; only individual examples "
    "are shown."
)
NOT_PREVALENCE = (
    "These are relevance-ranked retrieved examples, not population prevalence estimates."
)
TRUNCATED_NARRATIVE = "At least one cited narrative was truncated by the index excerpt limit."
THEME_LIMITATIONS = (NO_REPEATED_LABEL, NOT_PREVALENCE, TRUNCATED_NARRATIVE)
RELIEF_INTERPRETATION = (
    "Closed with monetary relief and Closed with non-monetary relief are CFPB relief categories; "
    "Closed with explanation is only a no-relief proxy, not proof of the consumer's actual "
    "outcome or dollar recovery."
)
UNKNOWN_EXCLUDED = (
    "Timely-response rates exclude records whose timely-response value is unknown."
)
COHORT_INTERPRETATION = (
    "The winner is the lowest timely-response rate within the ten highest-volume companies; ties "
    "are resolved by company name."
)
REJECTED_PREFIX = "The synthesized answer failed deterministic grounding validation: "
NO_ROWS_REASON = "The structured query returned no rows for the requested constraints."
NO_NARRATIVES_REASON = "No narratives matched the requested retrieval constraints."

# --- Fixed values: metadata fields compared as text during the audit, in order. ---
AUDITED_FIELDS = (
    "company",
    "brand_name",
    "product",
    "sub_product",
    "issue",
    "sub_issue",
    "state",
    "company_response",
)

# --- Fixed values: reasons an audit reports; a name in braces stands for its value. ---
REASONS = {
    "missing_structured": "required structured evidence is missing",
    "missing_narrative": "required narrative evidence is missing",
    "missing_metadata": "Complaint ID '{id}' is missing metadata {field}",
    "mismatched_filter": "Complaint ID '{id}' mismatches filter {field}",
    "invalid_timely": "Complaint ID '{id}' has invalid timely_response metadata",
    "mismatched_timely": "Complaint ID '{id}' mismatches filter timely_response",
    "invalid_date": "Complaint ID '{id}' has invalid date_received metadata",
    "before_start": "Complaint ID '{id}' predates retrieval start",
    "outside_end": "Complaint ID '{id}' is outside retrieval end",
    "not_canonical": "Complaint ID '{id}' is not canonical decimal",
    "duplicated_evidence": "Complaint ID '{id}' is duplicated in evidence",
    "unknown_kind": "unsupported claim kind: {kind}",
    "one_row_reference": "quantitative claim requires exactly one structured reference",
    "absent_row": "structured row reference does not exist",
    "no_column": "structured reference requires at least one column",
    "absent_column": "structured column reference does not exist",
    "exact_columns": "{template} requires exact ordered structured columns",
    "total_row": "comparison total must reference the total row",
    "driver_row": "issue driver must reference a driver row",
    "one_citation": "narrative claim requires exactly one narrative reference",
    "not_in_evidence": "Complaint ID '{id}' is not in evidence",
    "duplicated": "Complaint ID '{id}' is duplicated",
    "not_in_excerpt": "quote for Complaint ID '{id}' is not in excerpt",
    "theme_references": "sample theme must not contain row or complaint references",
    "theme_size": "sample theme requires between one and three repeated labels",
    "theme_mismatch": "sample themes do not match repeated retrieved metadata",
    "limitation_references": "limitation claim must not contain evidence references",
    "one_theme_claim": "sample themes require exactly one repeated-label summary",
    "no_theme_claim": "sample theme summary requires repeated retrieved labels",
    "sample_templates": "sample theme narratives require sample_complaint templates",
    "no_interpretation": "sample themes do not allow free-form interpretations",
    "allowed_limitations": "sample themes require allowlisted limitations",
    "too_many_citations": "narrative examples exceed the maximum of three citations",
    "no_citation": "narrative answer has no accepted citations",
    "no_denominator": "known-response denominator interpretation is missing",
    "disallowed_template": "claim kind '{kind}' does not allow template '{template}'",
}
SEQUENCE_REASONS = {
    "response_distribution": (
        "response distribution requires response_category_row for every row in order"
    ),
    "ranked_issues": (
        "ranked issues require ranked_issue_row for bounded rows in order"
    ),
    "trend_drivers": (
        "trend drivers require one comparison_total followed by issue_driver rows in order"
    ),
    "quarter_drivers": (
        "trend drivers require one comparison_total followed by issue_driver rows in order"
    ),
}

# --- Fixed values: rendered sentences, whole; a name in braces stands for its value. ---
SENTENCES = {
    "ranked_issue_row": "{issue}: {count} complaints ({percent}% of {total}).",
    "response_category_row": "{category}: {count} ({percent}% of {total}).",
    "comparison_total": (
        "Complaints were {direction}: {baseline} in the baseline year versus {comparison} in the "
        "comparison year, a change of {change}."
    ),
    "quarter_comparison_total": (
        "{company}: Complaints were {direction}: {baseline} in the baseline period versus "
        "{comparison} in the comparison period, a change of {change}."
    ),
    "driver": "Driver {issue}: change {change} ({baseline} to {comparison}).",
    "structured_row": "The executed analysis returned: {cells}.",
    "sample_complaint": "Among the retrieved examples, Complaint {id} reported: “{quote}”",
    "attributed_complaint": "Complaint {id} reported: “{quote}”",
    "themes": "Among the retrieved examples, repeated issue/sub-issue labels were: {labels}.",
    "limitation": "Limitation: {text}",
    "interpretations": "Interpretation: {texts}",
    "limitations": "Limitations: {texts}",
    "unresolved": "The explicit company or brand '{name}' could not be resolved.",
}
