"""Coverage decisions, drafts, the grounding audit and answer records.

Four questions per company of the narrative complaints, answered from metric tables and the eight
diverse nearest narratives. One company in ten keeps its draft; in the others one thing is
falsified, chosen by the company's number, so that every check has something to find.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql
from checks.registry import index, narratives, raw, register
from docket_spark.constants import (
    AUDITED_FIELDS,
    COHORT_INTERPRETATION,
    NO_NARRATIVES_REASON,
    NO_REPEATED_LABEL,
    NO_ROWS_REASON,
    NOT_PREVALENCE,
    REJECTED_PREFIX,
    RELIEF_INTERPRETATION,
    TEMPLATE_COLUMNS,
    THEME_LIMITATIONS,
    TRUNCATED_NARRATIVE,
    UNKNOWN_EXCLUDED,
)
from docket_spark.functions.metrics import complaint_measures, timely_rate
from docket_spark.operators.nearest import nearest_by_key
from docket_spark.plans import answers, bronze, coverage, drafts, evidence, grounding, retrieval
from docket_spark.plans.companies import resolve_companies
from docket_spark.plans.gold import metrics_from_complaints
from docket_spark.session import cut_lineage
from docket_spark.sources import testdata

PROFILES = ("ranked_issues", "response_distribution", "sample_themes", "structured_summary")
RATE_COLUMNS = (
    "company",
    "complaint_count",
    "timely_response_count",
    "timely_response_known_count",
    "timely_response_rate",
)
ABSENT = 5  # requests of companies with n_nationkey % 7 == ABSENT ask for a name nobody has


@dataclass(frozen=True)
class Desk:
    """Everything the audit reads, for all questions."""

    questions: DataFrame
    rows: DataFrame
    items: DataFrame
    filters: DataFrame
    good_claims: DataFrame
    good_remarks: DataFrame
    claims: DataFrame
    remarks: DataFrame


def _questions(spark, sf, complaints):
    nations = testdata.table(spark, sf, "nation").select(
        F.col("n_name").alias("company"), F.col("n_nationkey").alias("number")
    )
    profile = F.explode(F.array(*[F.lit(name) for name in PROFILES])).alias("profile")
    companies = complaints.where(F.col("company").isNotNull()).select("company").distinct()
    return (
        companies.join(nations, "company")
        .select("company", "number", profile)
        .select(
            F.concat_ws(":", "company", "profile").alias("question_id"),
            "company",
            "number",
            "profile",
            F.when(F.col("profile") == "sample_themes", "narrative")
            .otherwise("combined")
            .alias("mode"),
            (F.col("profile") != "sample_themes").alias("has_structured"),
            F.lit(True).alias("has_retrieval"),
            F.concat(F.col("profile"), F.lit(" of "), F.col("company")).alias("query"),
        )
    )


def _rate_rows(complaints, questions):
    asked = questions.where(F.col("profile") == "structured_summary")
    names = F.array(*[F.lit(name) for name in RATE_COLUMNS])
    return (
        complaints.groupBy("company")
        .agg(*complaint_measures(F.col("timely_response")))
        .withColumn("timely_response_rate", timely_rate())
        .join(asked.select("question_id", "company"), "company")
        .select("question_id", F.lit(0).alias("row_index"), names.alias("row_columns"), *RATE_COLUMNS)
    )


def _items(spark, sf, questions):
    vectors = testdata.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("number"), F.col("embedding").alias("query_vector")
    )
    companies = questions.select("company", "number").distinct()
    unknown = F.concat("company", F.lit(" (unknown)"))
    wanted = F.when(F.col("number") % 7 == ABSENT, unknown).otherwise(F.col("company"))
    asked = companies.join(vectors, "number").select(
        F.col("company").alias("question_id"), wanted.alias("company"), "query_vector"
    )
    ranked = nearest_by_key(index(spark, sf), asked, ["company"], 24)
    kept = retrieval.diverse(ranked, 8).drop("question_id")
    # The eight items of a company serve all its questions.
    return evidence.narrative_items(kept.join(questions.select("question_id", "company"), "company"))


def _falsified_claims(claims, questions):
    kind = F.col("number") % 10
    quantitative, narrative = F.col("kind") == "quantitative", F.col("kind") == "narrative"
    joined = claims.join(questions.select("question_id", "number", "profile"), "question_id")
    changed = joined.where(~((kind == 3) & quantitative & (F.col("row_index") == 1))).withColumns(
        {
            "quote": F.when((kind == 1) & narrative, F.concat("quote", F.lit(" altered"))).otherwise(
                F.col("quote")
            ),
            "complaint_id": F.when(
                (kind == 2) & narrative, F.concat(F.lit("0"), "complaint_id")
            ).otherwise(F.col("complaint_id")),
            "template": F.when((kind == 4) & quantitative, "attributed_complaint").otherwise(
                F.col("template")
            ),
            "columns": F.when(kind == 5, F.reverse("columns")).otherwise(F.col("columns")),
            "themes": F.when(
                (kind == 6) & F.col("themes").isNotNull(), F.slice("themes", 1, 1)
            ).otherwise(F.col("themes")),
        }
    )
    again = changed.where((kind == 9) & narrative).withColumn(
        "claim_no", F.col("claim_no") + 500
    )
    return changed.unionByName(again).select(*claims.columns)


def _falsified_remarks(remarks, questions):
    silent = F.col("number") % 10 == 8
    return remarks.join(questions.select("question_id", "number"), "question_id").select(
        "question_id",
        F.when(silent, F.array().cast("array<string>"))
        .otherwise(F.col("interpretations"))
        .alias("interpretations"),
        F.when(silent, F.array(F.lit("No caveats.")))
        .otherwise(F.col("limitations"))
        .alias("limitations"),
    )


def _filters(questions):
    strict = F.col("number") % 10 == 7
    wanted = {name: F.lit(None).cast("string") for name in AUDITED_FIELDS}
    wanted["company"] = F.lower("company")
    wanted["product"] = F.when(strict, "BUILDING")
    return questions.select(
        "question_id",
        *[value.alias(f"want_{name}") for name, value in wanted.items()],
        F.when(strict, F.lit(True)).alias("want_timely_response"),
        F.when(strict, F.lit("1996-01-01").cast("date")).alias("want_start"),
        F.when(strict, F.lit("1998-01-01").cast("date")).alias("want_end"),
    )


_DESKS: dict[tuple[str, str], Desk] = {}


def desk(spark, sf) -> Desk:
    """The evidence tables of a data set, written once per application and shared by the checks."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _DESKS:
        _DESKS[key] = _build_desk(spark, sf)
    return _DESKS[key]


def _build_desk(spark, sf) -> Desk:
    # Each table below is read by many later checks, so the scans behind it should run once.
    complaints = cut_lineage(narratives(spark, sf).drop("consumer_complaint_narrative"))
    questions = cut_lineage(_questions(spark, sf, complaints))
    of = lambda profile: questions.where(F.col("profile") == profile)
    issues = metrics_from_complaints(complaints, "company_issue_month_metrics")
    responses = metrics_from_complaints(complaints, "company_response_month_metrics")
    rows = evidence.stack_rows(
        [
            evidence.label_rows(issues, of("ranked_issues"), "issue", limit=5),
            evidence.label_rows(
                responses, of("response_distribution"), "company_response_to_consumer"
            ),
            _rate_rows(complaints, questions),
        ]
    )
    rows, items = cut_lineage(rows), cut_lineage(_items(spark, sf, questions))
    claims = cut_lineage(drafts.draft_claims(questions, rows, items))
    remarks = cut_lineage(drafts.draft_remarks(questions, rows, items))
    return Desk(
        questions,
        rows,
        items,
        _filters(questions),
        claims,
        remarks,
        _falsified_claims(claims, questions),
        _falsified_remarks(remarks, questions),
    )


# ---------------------------------------------------------------- oracle side


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _texts(values) -> str:
    return "[" + ", ".join(_text(value) for value in values) + "]"


_COUNTED = """SELECT q.question_id, {label}, count(*) AS complaint_count FROM narrative JOIN q
  ON q.company = narrative.company AND profile = '{profile}' WHERE date_received IS NOT NULL
  GROUP BY ALL"""


def _label_rows(label, profile, limit):
    return (
        f"SELECT *, complaint_count / total_complaints AS share, row_number() OVER (PARTITION BY "
        f"question_id ORDER BY complaint_count DESC, {label}) - 1 AS row_index FROM (SELECT *, "
        "CAST(sum(complaint_count) OVER (PARTITION BY question_id) AS BIGINT) AS total_complaints "
        f"FROM ({_COUNTED.format(label=label, profile=profile)})) QUALIFY row_index < {limit}"
    )


_RANKED_COLUMNS = _texts(TEMPLATE_COLUMNS["ranked_issue_row"])
_RESPONSE_COLUMNS = _texts(TEMPLATE_COLUMNS["response_category_row"])
_NUMBER = "rtrim(rtrim(printf('%.4f', {0}), '0'), '.')"
_SHARE = _NUMBER.format("share * 100")

DESK = {
    "q": "SELECT company || ':' || profile AS question_id, company, n_nationkey AS number, profile, "
    "CASE WHEN profile = 'sample_themes' THEN 'narrative' ELSE 'combined' END AS mode FROM (SELECT "
    "DISTINCT company, n_nationkey FROM narrative WHERE company IS NOT NULL), (SELECT "
    f"unnest({_texts(PROFILES)}) AS profile)",
    "rr": f"SELECT question_id, row_index, {_RANKED_COLUMNS} AS cols, issue || ': ' || "
    f"complaint_count || ' complaints (' || {_SHARE} || '% of ' || total_complaints || ').' AS "
    f"text FROM ({_label_rows('issue', 'ranked_issues', 5)})",
    "dr": f"SELECT question_id, row_index, {_RESPONSE_COLUMNS} AS cols, "
    "company_response_to_consumer || ': ' || complaint_count || ' (' || "
    f"{_SHARE} || '% of ' || total_complaints || ').' AS text FROM "
    f"({_label_rows('company_response_to_consumer', 'response_distribution', 1000000)})",
    "sr": f"SELECT question_id, 0 AS row_index, {_texts(RATE_COLUMNS)} AS cols, 'The executed "
    "analysis returned: company=' || company || ', complaint_count=' || n || "
    "', timely_response_count=' || t || ', timely_response_known_count=' || k || "
    f"', timely_response_rate=' || coalesce({_NUMBER.format('t / nullif(k, 0)')}, 'None') || '.' "
    "AS text FROM (SELECT question_id, q.company, count(*) AS n, count(*) FILTER (WHERE "
    "timely_response) AS t, count(timely_response) AS k FROM narrative JOIN q ON q.company = "
    "narrative.company AND profile = 'structured_summary' GROUP BY ALL)",
    "rows_": "SELECT * FROM rr UNION ALL SELECT * FROM dr UNION ALL SELECT * FROM sr",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY company ORDER BY distance, complaint_id) "
    f"AS rank FROM (SELECT idx.*, {sql.distance('idx.embedding', 'e.embedding')} AS distance FROM "
    f"idx JOIN nation ON n_name = company AND n_nationkey % 7 <> {ABSENT} JOIN embeddings e ON "
    "e.vec_id = n_nationkey) QUALIFY rank <= 24",
    "kept": "SELECT *, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN n > 8 THEN nth "
    "> 1 ELSE false END, rank) AS position FROM (SELECT *, count(*) OVER (PARTITION BY company) AS "
    "n, row_number() OVER (PARTITION BY company, issue, sub_issue ORDER BY rank) AS nth FROM "
    "ranked) QUALIFY position <= 8",
    "items": "SELECT q.question_id, q.number, q.profile, position, complaint_id, excerpt, "
    "narrative_truncated, kept.company, product, issue, sub_issue, timely_response, date_received "
    "FROM kept JOIN q USING (company)",
    "themes": "SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, issue, "
    "sub_issue) AS theme_no FROM (SELECT question_id, issue, sub_issue, count(*) AS n FROM items "
    "GROUP BY ALL HAVING count(*) >= 2) QUALIFY theme_no <= 3",
    "quoted": f"SELECT *, {sql.bounded_quote('c')} AS quote FROM (SELECT *, "
    f"{sql.collapse('excerpt')} AS c FROM items)",
    "examples": "SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY position) AS "
    "example_no FROM (SELECT *, row_number() OVER (PARTITION BY question_id, "
    "regexp_replace(lower(quote), '\\s+', '', 'g') ORDER BY position) AS nth FROM quoted WHERE "
    "quote <> '') WHERE nth = 1 QUALIFY example_no <= 3",
    "good": "SELECT question_id, row_index AS claim_no, 'quantitative' AS kind, CASE profile WHEN "
    "'ranked_issues' THEN 'ranked_issue_row' WHEN 'response_distribution' THEN "
    "'response_category_row' ELSE 'structured_row' END AS template, row_index, cols, NULL AS "
    "complaint_id, NULL AS quote, NULL AS theme_count, text FROM rows_ JOIN q USING (question_id) "
    "UNION ALL SELECT question_id, 1000000000000, 'sample_theme', 'retrieved_sample_themes', NULL, "
    "NULL, NULL, NULL, count(*), 'Among the retrieved examples, repeated issue/sub-issue labels "
    "were: ' || string_agg(issue || ' / ' || sub_issue || ' (' || n || ')', '; ' ORDER BY "
    "theme_no) || '.' FROM themes JOIN q USING (question_id) WHERE profile = 'sample_themes' GROUP "
    "BY question_id UNION ALL SELECT question_id, 2000000000000 + example_no, 'narrative', CASE "
    "WHEN profile = 'sample_themes' THEN 'sample_complaint' ELSE 'attributed_complaint' END, NULL, "
    "NULL, complaint_id, quote, NULL, CASE WHEN profile = 'sample_themes' THEN 'Among the "
    "retrieved examples, ' ELSE '' END || 'Complaint ' || complaint_id || ' reported: “' || quote "
    "|| '”' FROM examples",
    "remarks": "SELECT question_id, number, CASE WHEN profile = 'response_distribution' AND EXISTS "
    "(SELECT 1 FROM rows_ WHERE rows_.question_id = q.question_id) THEN "
    f"[{_text(RELIEF_INTERPRETATION)}] WHEN profile = 'structured_summary' THEN "
    f"[{_text(UNKNOWN_EXCLUDED)}, {_text(COHORT_INTERPRETATION)}] ELSE [] END AS interpretations, "
    f"list_filter([CASE WHEN profile = 'sample_themes' AND NOT EXISTS (SELECT 1 FROM themes WHERE "
    f"themes.question_id = q.question_id) THEN {_text(NO_REPEATED_LABEL)} END, CASE WHEN profile = "
    f"'sample_themes' THEN {_text(NOT_PREVALENCE)} END, CASE WHEN EXISTS (SELECT 1 FROM items WHERE "
    f"items.question_id = q.question_id AND narrative_truncated) THEN {_text(TRUNCATED_NARRATIVE)} "
    "END], lambda x: x IS NOT NULL) AS limitations FROM q",
    "changed": "SELECT question_id, claim_no, kind, CASE WHEN number % 10 = 4 AND kind = "
    "'quantitative' THEN 'attributed_complaint' ELSE template END AS template, row_index, CASE WHEN "
    "number % 10 = 5 THEN list_reverse(cols) ELSE cols END AS cols, CASE WHEN number % 10 = 2 AND "
    "kind = 'narrative' THEN '0' || complaint_id ELSE complaint_id END AS complaint_id, CASE WHEN "
    "number % 10 = 1 AND kind = 'narrative' THEN quote || ' altered' ELSE quote END AS quote, CASE "
    "WHEN number % 10 = 6 AND theme_count > 1 THEN 1 ELSE theme_count END AS theme_count, "
    "theme_count AS true_themes, number, profile FROM good JOIN q USING (question_id) WHERE NOT "
    "(number % 10 = 3 AND kind = 'quantitative' AND row_index = 1)",
    "claims": "SELECT * FROM changed UNION ALL SELECT * REPLACE (claim_no + 500 AS claim_no) FROM "
    "changed WHERE number % 10 = 9 AND kind = 'narrative'",
    "said": "SELECT question_id, number, CASE WHEN number % 10 = 8 THEN [] ELSE interpretations END "
    "AS interpretations, CASE WHEN number % 10 = 8 THEN ['No caveats.'] ELSE limitations END AS "
    "limitations FROM remarks",
    "evidence_reasons": "SELECT question_id, 1 AS stage, position AS major, minor, 'Complaint ID ''' "
    "|| complaint_id || ''' ' || r AS reason FROM (SELECT *, unnest([CASE WHEN coalesce(product, '') "
    "= '' THEN 'is missing metadata product' WHEN lower(product) <> 'building' THEN 'mismatches "
    "filter product' END, CASE WHEN timely_response IS NULL THEN 'has invalid timely_response "
    "metadata' WHEN NOT timely_response THEN 'mismatches filter timely_response' END, CASE WHEN "
    "date_received IS NULL THEN 'has invalid date_received metadata' END, CASE WHEN date_received < "
    "DATE '1996-01-01' THEN 'predates retrieval start' END, CASE WHEN date_received >= DATE "
    "'1998-01-01' THEN 'is outside retrieval end' END]) AS r, unnest([2, 8, 9, 10, 11]) AS minor "
    "FROM items WHERE number % 10 = 7) WHERE r IS NOT NULL",
    "cited": "SELECT c.question_id, c.complaint_id, min(c.claim_no) AS first_no, count(*) AS uses "
    "FROM claims c JOIN items i ON i.question_id = c.question_id AND i.complaint_id = "
    "c.complaint_id WHERE kind = 'narrative' GROUP BY ALL",
    "claim_reasons": "SELECT question_id, 2 AS stage, claim_no AS major, 0 AS minor, CASE WHEN kind "
    "= 'quantitative' AND template = 'attributed_complaint' THEN 'claim kind ''quantitative'' does "
    "not allow template ''attributed_complaint''' WHEN kind = 'narrative' AND NOT EXISTS (SELECT 1 "
    "FROM items i WHERE i.question_id = c.question_id AND i.complaint_id = c.complaint_id) THEN "
    "'Complaint ID ''' || complaint_id || ''' is not in evidence' WHEN kind = 'sample_theme' AND "
    "theme_count <> true_themes THEN 'sample themes do not match repeated retrieved metadata' END "
    "AS reason FROM claims c UNION ALL SELECT question_id, 2, claim_no, 3, template || ' requires "
    "exact ordered structured columns' FROM claims WHERE number % 10 = 5 AND kind = 'quantitative' "
    "AND template <> 'structured_row' UNION ALL SELECT question_id, 2, claim_no, 3, 'quote for "
    "Complaint ID ''' || complaint_id || ''' is not in excerpt' FROM claims WHERE number % 10 = 1 "
    "AND kind = 'narrative' UNION ALL SELECT question_id, 2, first_no + 500, 2, 'Complaint ID ''' "
    "|| complaint_id || ''' is duplicated' FROM cited WHERE uses > 1",
    "sequences": "SELECT q.question_id, q.profile, e.n AS expected_rows, coalesce(c.n, 0) AS "
    "claimed_rows, coalesce(c.l, []) = e.l AS in_sequence FROM q LEFT JOIN (SELECT question_id, "
    "count(*) AS n, list(template || row_index ORDER BY claim_no) AS l FROM claims WHERE kind = "
    "'quantitative' GROUP BY 1) c USING (question_id) LEFT JOIN (SELECT q.question_id, "
    "count(row_index) AS n, list(CASE profile WHEN 'ranked_issues' THEN 'ranked_issue_row' ELSE "
    "'response_category_row' END || row_index ORDER BY row_index) FILTER (WHERE row_index IS NOT "
    "NULL) AS l FROM q LEFT JOIN rows_ USING (question_id) GROUP BY q.question_id) e "
    "ON e.question_id = q.question_id",
    "draft_reasons": "SELECT question_id, 3 AS stage, 0 AS major, minor, reason FROM (SELECT "
    "q.question_id, unnest([CASE WHEN profile = 'response_distribution' AND NOT in_sequence THEN "
    f"{_text(grounding.SEQUENCE_REASONS['response_distribution'])} END, CASE WHEN profile = "
    f"'ranked_issues' AND NOT in_sequence THEN {_text(grounding.SEQUENCE_REASONS['ranked_issues'])} "
    "END, CASE WHEN profile = 'sample_themes' AND list_has_any(limitations, ['No caveats.']) THEN "
    "'sample themes require allowlisted limitations' END, CASE WHEN coalesce(n, 0) > 3 THEN "
    "'narrative examples exceed the maximum of three citations' END, CASE WHEN coalesce(n, 0) = 0 "
    "THEN 'narrative answer has no accepted citations' END, CASE WHEN profile = "
    "'structured_summary' AND len(interpretations) = 0 THEN 'known-response denominator "
    "interpretation is missing' END]) AS reason, unnest([0, 1, 8, 9, 10, 11]) AS minor FROM q JOIN "
    "sequences USING (question_id, profile) JOIN said USING (question_id) LEFT JOIN (SELECT "
    "question_id, count(*) AS n FROM cited GROUP BY 1) USING (question_id)) WHERE reason IS NOT NULL",
    "reasons": "SELECT question_id, reason, min((stage, major, minor)) AS place FROM (SELECT * FROM "
    "evidence_reasons UNION ALL SELECT * FROM claim_reasons WHERE reason IS NOT NULL UNION ALL "
    "SELECT * FROM draft_reasons) GROUP BY ALL",
    "verdicts": "SELECT q.question_id, r.n IS NULL AS accepted, coalesce(r.n, 0) AS reason_count, "
    "coalesce(r.reasons, '') AS reasons, CASE WHEN r.n IS NULL THEN coalesce(c.ids, '') ELSE '' END "
    "AS citations, coalesce(k.n, 0) AS claim_count, sha256('[' || coalesce(k.pairs, '') || ']') AS "
    "template_hash FROM q LEFT JOIN (SELECT question_id, count(*) AS n, string_agg(reason, '; ' "
    "ORDER BY place, reason) AS reasons FROM reasons GROUP BY 1) r USING (question_id) LEFT JOIN "
    "(SELECT question_id, string_agg(complaint_id, ',' ORDER BY first_no) AS ids FROM cited GROUP "
    "BY 1) c USING (question_id) LEFT JOIN (SELECT question_id, count(*) AS n, string_agg('[\"' || "
    "kind || '\",\"' || template || '\"]', ',' ORDER BY claim_no) AS pairs FROM claims GROUP BY 1) "
    "k USING (question_id)",
    "rendered": "SELECT remarks.question_id, concat_ws(' ', body, CASE WHEN len(interpretations) > 0 "
    "THEN 'Interpretation: ' || array_to_string(interpretations, ' ') END, CASE WHEN "
    "len(limitations) > 0 THEN 'Limitations: ' || array_to_string(limitations, ' ') END) AS answer "
    "FROM remarks LEFT JOIN (SELECT question_id, string_agg(text, ' ' ORDER BY claim_no) AS body "
    "FROM good GROUP BY 1) USING (question_id)",
}


def _desk_sql(body):
    return sql.query(body, "idx", **DESK)


@register(
    "aud_draft_claims",
    _desk_sql(
        "SELECT question_id, claim_no, kind, template, row_index, array_to_string(cols, ',') AS "
        "cols, complaint_id, quote, theme_count FROM good"
    ),
)
def _(spark, sf):
    return desk(spark, sf).good_claims.select(
        "question_id",
        "claim_no",
        "kind",
        "template",
        F.col("row_index").cast("bigint").alias("row_index"),
        F.array_join("columns", ",").alias("cols"),
        "complaint_id",
        "quote",
        F.when(F.col("themes").isNotNull(), F.size("themes").cast("bigint")).alias("theme_count"),
    )


@register("aud_rendered_answers", _desk_sql("SELECT * FROM rendered"))
def _(spark, sf):
    d = desk(spark, sf)
    return drafts.render(d.good_claims, d.good_remarks, d.rows)


@register(
    "aud_filter_compliance",
    _desk_sql("SELECT question_id, major, minor, reason FROM evidence_reasons"),
)
def _(spark, sf):
    d = desk(spark, sf)
    return grounding.evidence_reasons(d.items, d.filters).select(
        "question_id", "major", "minor", "reason"
    )


_DIGITS = (
    "CASE n_chars % 5 WHEN 0 THEN '0' || doc_id WHEN 1 THEN CAST(doc_id - doc_id % 4 AS VARCHAR) "
    "ELSE CAST(doc_id AS VARCHAR) END"
)


@register(
    "aud_evidence_ids",
    f"""WITH e AS (SELECT source AS question_id, doc_id AS position, {_DIGITS} AS id FROM documents)
SELECT question_id, CAST(major AS BIGINT) AS major, minor, reason FROM (
  SELECT question_id, position AS major, 12 AS minor,
    'Complaint ID ''' || id || ''' is not canonical decimal' AS reason FROM e
    WHERE NOT regexp_full_match(id, '0|[1-9][0-9]*')
  UNION ALL SELECT question_id, position, 100, 'Complaint ID ''' || id ||
    ''' is duplicated in evidence' FROM (SELECT *, row_number() OVER (PARTITION BY question_id, id
    ORDER BY position) AS nth FROM e) WHERE nth = 2)""",
)
def _(spark, sf):
    number, part = F.col("doc_id"), F.col("n_chars") % 5
    items = testdata.table(spark, sf, "documents").select(
        F.col("source").alias("question_id"),
        number.alias("position"),
        F.when(part == 0, F.concat(F.lit("0"), number.cast("string")))
        .when(part == 1, (number - number % 4).cast("string"))
        .otherwise(number.cast("string"))
        .alias("complaint_id"),
        *[F.lit("").alias(name) for name in evidence.METADATA],
    )
    absent = {name: F.lit(None).cast("string") for name in AUDITED_FIELDS}
    filters = items.select("question_id").distinct().select(
        "question_id",
        *[value.alias(f"want_{name}") for name, value in absent.items()],
        F.lit(None).cast("boolean").alias("want_timely_response"),
        F.lit(None).cast("date").alias("want_start"),
        F.lit(None).cast("date").alias("want_end"),
    )
    return grounding.evidence_reasons(items, filters).select(
        "question_id", "major", "minor", "reason"
    )


@register(
    "aud_claim_shape",
    _desk_sql(
        "SELECT question_id, claim_no AS major, reason FROM (SELECT question_id, major AS claim_no, "
        "reason FROM claim_reasons WHERE reason LIKE 'claim kind%' OR reason LIKE '%requires exact%')"
    ),
)
def _(spark, sf):
    d = desk(spark, sf)
    return (
        grounding.shape_reasons(d.claims)
        .unionByName(grounding.quantitative_reasons(d.claims, d.rows))
        .select("question_id", "major", "reason")
    )


@register(
    "aud_citations",
    _desk_sql(
        "SELECT question_id, major, minor, reason FROM claim_reasons WHERE reason LIKE '%Complaint "
        "ID%'"
    ),
)
def _(spark, sf):
    d = desk(spark, sf)
    return grounding.narrative_reasons(d.claims, d.items).select(
        "question_id", "major", "minor", "reason"
    )


@register(
    "aud_claim_sequence",
    _desk_sql(
        "SELECT question_id, CASE WHEN profile IN ('ranked_issues', 'response_distribution') THEN "
        "expected_rows END AS expected_rows, claimed_rows, profile NOT IN ('ranked_issues', "
        "'response_distribution') OR in_sequence AS in_sequence FROM sequences"
    ),
)
def _(spark, sf):
    d = desk(spark, sf)
    return grounding.sequence_facts(d.questions, d.claims, d.rows)


@register(
    "aud_theme_claims",
    _desk_sql(
        "SELECT question_id, reason FROM claim_reasons WHERE reason LIKE 'sample themes%' UNION ALL "
        "SELECT question_id, reason FROM draft_reasons WHERE reason LIKE 'sample themes%'"
    ),
)
def _(spark, sf):
    d = desk(spark, sf)
    facts = grounding.draft_facts(d.questions, d.claims, d.remarks, d.rows, d.items)
    return (
        grounding.theme_reasons(d.claims, d.items)
        .unionByName(grounding.draft_reasons(facts))
        .where(F.col("reason").startswith("sample themes"))
        .select("question_id", "reason")
    )


@register(
    "aud_known_denominator",
    _desk_sql("SELECT question_id, reason FROM draft_reasons WHERE reason LIKE 'known-response%'"),
)
def _(spark, sf):
    d = desk(spark, sf)
    facts = grounding.draft_facts(d.questions, d.claims, d.remarks, d.rows, d.items)
    return (
        grounding.draft_reasons(facts)
        .where(F.col("reason").startswith("known-response"))
        .select("question_id", "reason")
    )


def _audited(spark, sf):
    d = desk(spark, sf)
    reasons = grounding.all_reasons(d.questions, d.claims, d.remarks, d.rows, d.items, d.filters)
    reasons = cut_lineage(reasons)
    return d, grounding.verdicts(d.questions, d.claims, d.items, reasons)


@register("aud_verdicts", _desk_sql("SELECT * FROM verdicts"))
def _(spark, sf):
    return _audited(spark, sf)[1]


_UNRESOLVED = "The explicit company or brand 'State Farm' could not be resolved."
_OUTCOMES = {
    "records": "SELECT question_id, CASE WHEN uncovered THEN "
    f"{_text(coverage.NO_AUTO_CLAIMS)} WHEN unresolved THEN {_text(_UNRESOLVED)} WHEN mode = "
    f"'combined' AND NOT has_rows THEN {_text(NO_ROWS_REASON)} WHEN NOT has_items THEN "
    f"{_text(NO_NARRATIVES_REASON)} WHEN NOT accepted THEN {_text(REJECTED_PREFIX)} || reasons END "
    "AS refusal, answer, citations, mode = 'combined' AND NOT uncovered AND NOT unresolved AS "
    "asked, profile || ' of ' || company AS query FROM (SELECT q.*, number % 10 = 0 AND number > 0 "
    "AND profile = 'ranked_issues' AS uncovered, number % 5 = 0 AND profile = 'structured_summary' "
    "AS unresolved, EXISTS (SELECT 1 FROM rows_ r WHERE r.question_id = q.question_id) AS has_rows, "
    "EXISTS (SELECT 1 FROM items i WHERE i.question_id = q.question_id) AS has_items, accepted, "
    "reasons, citations, answer FROM q JOIN verdicts USING (question_id) JOIN rendered USING "
    "(question_id))"
}
_ANSWERS = (
    "SELECT question_id, coalesce(refusal, answer) AS answer, CASE WHEN refusal IS NULL THEN "
    "citations ELSE '' END AS citations, CASE WHEN asked THEN query END AS query, refusal IS NOT "
    "NULL AS abstained FROM records"
)


def _records(spark, sf):
    d, verdicts = _audited(spark, sf)
    rendered = drafts.render(d.good_claims, d.good_remarks, d.rows)
    number, profile = F.col("number"), F.col("profile")
    asked = d.questions.withColumns(
        {
            "needs_relief_amount": F.lit(False),
            "needs_auto_claims": (number % 10 == 0)
            & (number > 0)
            & (profile == "ranked_issues"),
            "requested_start": F.lit(None).cast("date"),
            "requested_end": F.lit(None).cast("date"),
            "company_or_brand": F.when(
                (number % 5 == 0) & (profile == "structured_summary"), "State Farm"
            ),
        }
    )
    covered = coverage.decide(asked, _capabilities(spark, sf))
    named = asked.where(F.col("company_or_brand").isNotNull()).select(
        "question_id", "company_or_brand"
    )
    entities = resolve_companies(named, "company_or_brand")
    return answers.answer_records(asked, covered, entities, d.rows, d.items, verdicts, rendered)


@register("aud_answer_records", sql.query(_ANSWERS, "idx", **DESK, **_OUTCOMES))
def _(spark, sf):
    return _records(spark, sf).withColumn(
        "citations", F.array_join(F.col("citations").cast("array<string>"), ",")
    )


@register(
    "aud_answer_constraints",
    sql.query(
        "SELECT count(*) FILTER (WHERE trim(question_id) = '') AS blank_question_ids, count(*) "
        "FILTER (WHERE trim(answer) = '') AS blank_answers, CAST(0 AS BIGINT) AS invalid_citations, count(*) FILTER "
        f"(WHERE abstained AND citations <> '') AS cited_abstentions FROM ({_ANSWERS})",
        "idx",
        **DESK,
        **_OUTCOMES,
    ),
)
def _(spark, sf):
    return answers.record_violations(_records(spark, sf))


def _capabilities(spark, sf):
    profile = bronze.population_profile(raw(spark, sf))
    return profile.select(
        F.lit("1996-01-01").cast("date").alias("snapshot_start"),
        F.greatest("date_received_max", F.lit("2000-12-31").cast("date")).alias("snapshot_end"),
        (F.col("narrative_count") > 0).alias("has_consumer_narratives"),
        F.lit(False).alias("has_verified_relief_amount"),
        F.lit(False).alias("supports_auto_insurance_claims"),
    )


_STARTS = "CAST(o_orderdate AS DATE)"
_HIGH = "greatest((SELECT max(CAST(l_shipdate AS DATE)) FROM raw), DATE '2000-12-31')"


@register(
    "aud_coverage",
    sql.query(
        "SELECT o_orderkey, reason IS NULL AS answerable, reason, CASE WHEN reason LIKE 'The CFPB%' "
        "THEN 'verified_relief_amount' WHEN reason LIKE 'This CFPB%' THEN 'auto_insurance_claims' "
        "WHEN reason IS NOT NULL THEN 'date_range' END AS required_capability FROM (SELECT "
        "o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN "
        f"{_text(coverage.NO_RELIEF_AMOUNT)} WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' "
        f"THEN {_text(coverage.NO_AUTO_CLAIMS)} WHEN s >= e THEN {_text(coverage.INVALID_RANGE)} "
        f"WHEN s < DATE '1996-01-01' THEN {_text(coverage.BEGINS_BEFORE)} || '1996-01-01' || "
        f"{_text(coverage.COVERAGE_SUFFIX)} WHEN e > h + 1 THEN {_text(coverage.EXTENDS_BEYOND)} || "
        f"CAST(h AS VARCHAR) || {_text(coverage.COVERAGE_SUFFIX)} END AS reason FROM (SELECT *, "
        f"{_STARTS} AS s, {_STARTS} + CAST(o_custkey % 1500 - 20 AS INTEGER) AS e, {_HIGH} AS h FROM "
        "orders))",
        "raw",
    ),
)
def _(spark, sf):
    start = F.col("o_orderdate").cast("date")
    asked = testdata.table(spark, sf, "orders").select(
        "o_orderkey",
        start.alias("requested_start"),
        F.date_add(start, (F.col("o_custkey") % 1500 - 20).cast("int")).alias("requested_end"),
        ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias(
            "needs_relief_amount"
        ),
        ((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F")).alias(
            "needs_auto_claims"
        ),
    )
    return coverage.decide(asked, _capabilities(spark, sf)).select(
        "o_orderkey", "answerable", "reason", "required_capability"
    )


def _claim(kind, template):
    """Columns of a claim with one reference of its kind."""
    return (
        F.lit(0).alias("claim_no"),
        F.lit(kind).alias("kind"),
        F.lit(template).alias("template"),
        F.lit(int(kind == "quantitative")).alias("structured_ref_count"),
        F.lit(int(kind == "narrative")).alias("narrative_ref_count"),
        F.lit(None).cast(drafts.THEMES_TYPE).alias("themes"),
    )


@register(
    "jn_citation_membership",
    """SELECT source AS question_id, complaint_id FROM (SELECT source, CASE WHEN n_chars % 9 = 0 THEN
  doc_id + 1 ELSE doc_id END AS complaint_id FROM documents) c WHERE NOT EXISTS (SELECT 1 FROM
  documents d WHERE d.source = c.source AND d.doc_id = c.complaint_id)""",
)
def _(spark, sf):
    documents = testdata.table(spark, sf, "documents")
    cited = documents.select(
        F.col("source").alias("question_id"),
        F.when(F.col("n_chars") % 9 == 0, F.col("doc_id") + 1)
        .otherwise(F.col("doc_id"))
        .alias("complaint_id"),
        *_claim("narrative", "attributed_complaint"),
    )
    returned = documents.select(
        F.col("source").alias("question_id"),
        F.col("doc_id").alias("complaint_id"),
        F.lit(1).alias("position"),
        F.coalesce("text", F.lit("")).alias("excerpt"),
    )
    return grounding.absent_citations(cited, returned).select("question_id", "complaint_id")


@register(
    "jn_row_reference_membership",
    """SELECT o_orderkey AS question_id, n_lines AS row_index FROM (SELECT o_orderkey, 1 + o_custkey % 7
  AS n_lines FROM orders) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey
  AND l_linenumber = n_lines)""",
)
def _(spark, sf):
    referenced = testdata.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("question_id"),
        (1 + F.col("o_custkey") % 7).alias("row_index"),
        *_claim("quantitative", "structured_row"),
    )
    existing = testdata.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("question_id"),
        F.col("l_linenumber").cast("bigint").alias("row_index"),
        F.array(F.lit("l_quantity")).alias("row_columns"),
    )
    return grounding.absent_rows(referenced, existing).select("question_id", "row_index")
