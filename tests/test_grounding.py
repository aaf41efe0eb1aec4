"""Drafts and the audit: one accepted example and everything that must reject it.

The audit is a batch job, so all examples are audited together, one question each.
"""

from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from docket_spark.constants import AUDITED_FIELDS, TEMPLATE_COLUMNS, THEME_LIMITATIONS
from docket_spark.plans import answers, drafts, evidence, grounding
from docket_spark.plans.analysis import Filters, Request, run

ITEM = {
    "company": "Acme", "brand_name": "Acme Pay", "product": "Payments", "sub_product": "Wallet",
    "issue": "Frozen", "sub_issue": "Access", "state": "CA", "timely_response": "false",
    "company_response": "Closed with explanation", "date_received": "2025-01-15",
}
WANTED = {
    **{name: ITEM[name] for name in AUDITED_FIELDS},
    "timely_response": False, "start": date(2025, 1, 1), "end": date(2025, 2, 1),
}
ITEM_SCHEMA = (
    "question_id string, position int, complaint_id string, excerpt string, truncated boolean, "
    + ", ".join(f"{name} string" for name in evidence.METADATA)
)
FILTER_SCHEMA = (
    "question_id string, "
    + ", ".join(f"want_{name} string" for name in AUDITED_FIELDS)
    + ", want_timely_response boolean, want_start date, want_end date"
)
CLAIM_SCHEMA = (
    "question_id string, claim_no bigint, kind string, template string, structured_ref_count int, "
    "narrative_ref_count int, row_index int, columns array<string>, complaint_id string, "
    f"quote string, themes {drafts.THEMES_TYPE}"
)
ROW_SCHEMA = "question_id string, row_index int, row_columns array<string>, row_type string"
REMARK_SCHEMA = "question_id string, interpretations array<string>, limitations array<string>"
QUESTION_SCHEMA = (
    "question_id string, mode string, profile string, has_structured boolean, has_retrieval boolean"
)
# Claims and items without the question id, which the examples add.
STRUCTURED = (0, "quantitative", "structured_row", 1, 0, 0, ["company"], None, None, None)
QUOTED = (1, "narrative", "attributed_complaint", 0, 1, None, None, "42", "returned excerpt", None)
ROW = (0, ["company", "complaint_count"], None)
CASES = {}


def item(position=1, complaint_id="42", excerpt="exact  returned excerpt", **changes):
    values = {**ITEM, **changes}
    return (position, complaint_id, excerpt, False, *[values[n] for n in evidence.METADATA])


def case(name, expected, **parts):
    """``expected`` is the exact reason text, empty for an accepted draft."""
    parts.setdefault("items", [item()])
    parts.setdefault("claims", [STRUCTURED, QUOTED])
    parts.setdefault("rows", [ROW])
    parts.setdefault("remarks", ([], []))
    parts.setdefault("filters", {})
    parts.setdefault("question", ("combined", "structured_summary", True, True))
    CASES[name] = (expected, parts)


def changed(claim, **changes):
    names = ("claim_no", "kind", "template", "n_rows", "n_cited", "row_index", "columns", "complaint_id", "quote", "themes")
    return tuple(changes.get(name, value) for name, value in zip(names, claim))


case("accepted", "")
case("folded", "", items=[item(company="  aCME ", timely_response=" False ")])
for field, value, reason in (
    ("company", "Other", "mismatches filter company"),
    ("brand_name", "Other", "mismatches filter brand_name"),
    ("product", "  ", "is missing metadata product"),
    ("company_response", None, "is missing metadata company_response"),
    ("timely_response", "true", "mismatches filter timely_response"),
    ("timely_response", "no", "has invalid timely_response metadata"),
    ("date_received", "2025-02-01", "is outside retrieval end"),
    ("date_received", "2024-12-31", "predates retrieval start"),
    ("date_received", "soon", "has invalid date_received metadata"),
):
    case(f"{field}={value}", f"Complaint ID '42' {reason}", items=[item(**{field: value})])
NO_CITATION = "narrative answer has no accepted citations"
case("kind", f"unsupported claim kind: opinion; {NO_CITATION}", claims=[changed(QUOTED, kind="opinion", template="x")])
case("template", "claim kind 'quantitative' does not allow template 'sample_complaint'", claims=[changed(STRUCTURED, template="sample_complaint"), QUOTED])
case("two rows", "quantitative claim requires exactly one structured reference", claims=[changed(STRUCTURED, n_rows=2), QUOTED])
case("absent row", "structured row reference does not exist", claims=[changed(STRUCTURED, row_index=1), QUOTED])
case("no column", "structured reference requires at least one column", claims=[changed(STRUCTURED, columns=[]), QUOTED])
case("absent column", "structured column reference does not exist", claims=[changed(STRUCTURED, columns=["share"]), QUOTED])
case("absent id", f"Complaint ID '43' is not in evidence; {NO_CITATION}", claims=[STRUCTURED, changed(QUOTED, complaint_id="43")])
for quote in ("invented", ""):
    case(f"quote {quote}", "quote for Complaint ID '42' is not in excerpt", claims=[STRUCTURED, changed(QUOTED, quote=quote)])
case("cited twice", "Complaint ID '42' is duplicated", claims=[STRUCTURED, QUOTED, changed(QUOTED, claim_no=2)])
case("limitation", "limitation claim must not contain evidence references", claims=[STRUCTURED, QUOTED, (2, "limitation", "limitation", 0, 0, None, None, None, None, [("a", None, 2)])])
case("uncited", NO_CITATION, claims=[STRUCTURED])
case("ids", "Complaint ID '42' is duplicated in evidence; Complaint ID '042' is not canonical decimal", items=[item(), item(2), item(3), item(4, "042")])
case("missing", f"required structured evidence is missing; required narrative evidence is missing; Complaint ID '42' mismatches filter company; {NO_CITATION}", question=("combined", "structured_summary", False, False), items=[item(company="x")], claims=[], rows=[])
case(
    "four citations",
    "narrative examples exceed the maximum of three citations",
    items=[item(i, str(i)) for i in range(1, 5)],
    claims=[STRUCTURED, *[changed(QUOTED, claim_no=i, complaint_id=str(i)) for i in range(1, 5)]],
)
RANKED = list(TEMPLATE_COLUMNS["ranked_issue_row"])


def ranked_claims(order):
    return [(n, "quantitative", "ranked_issue_row", 1, 0, i, RANKED, None, None, None) for n, i in enumerate(order)]


RANKED_ROWS = [(i, RANKED, None) for i in range(7)]
for order in ([0, 1, 2, 3, 4], [0, 1, 2, 3], [1, 0, 2, 3, 4], [0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 3], [0, 1, 2, 4, 3], []):
    case(
        f"ranked {order}",
        "" if order == [0, 1, 2, 3, 4] else grounding.SEQUENCE_REASONS["ranked_issues"],
        rows=RANKED_ROWS,
        claims=ranked_claims(order),
        question=("structured", "ranked_issues", True, True),
    )
case("reversed columns", "ranked_issue_row requires exact ordered structured columns", rows=RANKED_ROWS[:1], claims=[changed(ranked_claims([0])[0], columns=RANKED[::-1])], question=("structured", "ranked_issues", True, True))
KNOWN = [(0, ["company", "timely_response_known_count"], None)]
case("undisclosed", "known-response denominator interpretation is missing", rows=KNOWN)
case("disclosed", "", rows=KNOWN, remarks=(["Unknown values are left out."], []))
CHANGE = list(TEMPLATE_COLUMNS["comparison_total"])


def change_claims(total, driver):
    return [(i, "quantitative", "issue_driver" if i else "comparison_total", 1, 0, i, CHANGE, None, None, None) for i in (0, 1)]


case("row types", "comparison total must reference the total row; issue driver must reference a driver row", rows=[(0, CHANGE, "driver"), (1, CHANGE, "total")], claims=change_claims(0, 1), question=("structured", "trend_drivers", True, True))
case("changes", "", rows=[(0, CHANGE, "total"), (1, CHANGE, "driver")], claims=change_claims(0, 1), question=("structured", "trend_drivers", True, True))
case("no changes", grounding.SEQUENCE_REASONS["trend_drivers"], rows=[], claims=[], question=("structured", "trend_drivers", True, True))
LABELLED = [item(i, str(i), f"text {i}", issue=a, sub_issue=b) for i, (a, b) in enumerate(
    [("Account access", "Frozen account")] * 3 + [("Fees", "Unexpected fee")] * 2, start=1)]
THEMES = [("Account access", "Frozen account", 3), ("Fees", "Unexpected fee", 2)]


def sampled(themes, *more):
    theme = (0, "sample_theme", "retrieved_sample_themes", 0, 0, None, None, None, None, themes)
    example = (9, "narrative", "sample_complaint", 0, 1, None, None, "1", "text 1", None)
    return [theme, example, *more]


def sample_case(name, expected, **parts):
    parts.setdefault("items", LABELLED)
    case(name, expected, filters=None, rows=[], question=("narrative", "sample_themes", False, True), **parts)


sample_case("themes", "", claims=sampled(THEMES), remarks=([], list(THEME_LIMITATIONS)))
sample_case("miscounted", "sample themes do not match repeated retrieved metadata", claims=sampled([("Account access", "Frozen account", 99)]))
sample_case("four themes", "sample theme requires between one and three repeated labels", claims=sampled(THEMES * 2))
sample_case("no themes", "sample themes require exactly one repeated-label summary", claims=sampled(THEMES)[1:])
sample_case("opinions", "sample themes do not allow free-form interpretations; sample themes require allowlisted limitations", claims=sampled(THEMES), remarks=(["I think"], ["Other."]))
sample_case("plain example", "sample theme narratives require sample_complaint templates", claims=sampled(THEMES, changed(QUOTED, claim_no=10, complaint_id="2", quote="text 2")))
sample_case("unrepeated", "sample themes do not match repeated retrieved metadata; sample theme summary requires repeated retrieved labels", items=LABELLED[:1], claims=sampled(THEMES))


@pytest.fixture(scope="module")
def audited(spark):
    def frame(schema, pick):
        return spark.createDataFrame([row for name, (_, parts) in CASES.items() for row in pick(name, parts)], schema)

    def wanted(name, parts):
        want = dict.fromkeys(WANTED) if parts["filters"] is None else WANTED
        return [(name, *[want[n] for n in AUDITED_FIELDS], want["timely_response"], want["start"], want["end"])]

    questions = frame(QUESTION_SCHEMA, lambda name, parts: [(name, *parts["question"])])
    claims = frame(CLAIM_SCHEMA, lambda name, parts: [(name, *claim) for claim in parts["claims"]])
    remarks = frame(REMARK_SCHEMA, lambda name, parts: [(name, *parts["remarks"])])
    table = frame(ROW_SCHEMA, lambda name, parts: [(name, *row) for row in parts["rows"]])
    items = frame(ITEM_SCHEMA, lambda name, parts: [(name, *row) for row in parts["items"]])
    reasons = grounding.all_reasons(questions, claims, remarks, table, items, frame(FILTER_SCHEMA, wanted))
    return {row["question_id"]: row for row in grounding.verdicts(questions, claims, items, reasons).collect()}


@pytest.mark.parametrize("name", CASES)
def test_verdicts(audited, name):
    expected, verdict = CASES[name][0], audited[name]
    assert verdict["reasons"] == expected
    assert verdict["accepted"] == (expected == "")
    assert verdict["reason_count"] == (expected.count("; ") + 1 if expected else 0)
    assert verdict["claim_count"] == len(CASES[name][1]["claims"])
    if expected:
        assert verdict["citations"] == ""


def test_accepted_citations_and_template_hash(audited):
    import hashlib
    import json

    payload = json.dumps([(c[1], c[2]) for c in (STRUCTURED, QUOTED)], separators=(",", ":"))
    assert audited["accepted"]["citations"] == "42"
    assert audited["accepted"]["template_hash"] == hashlib.sha256(payload.encode()).hexdigest()


def change_rows(spark, question, request):
    from fixtures import gold_tables

    result = run(request, gold_tables(spark))
    order = [(F.col("row_type") == "driver").asc(), F.abs("absolute_change").desc(), F.col("issue").asc()]
    return evidence.number_rows(result, question, order)


def test_drafts_pass_their_own_audit(spark):
    ranked = spark.createDataFrame(
        [("ranked_issues", i, RANKED, f"issue {i}", 10 - i, 40, (10 - i) / 40) for i in range(7)],
        "question_id string, row_index int, row_columns array<string>, issue string, complaint_count bigint, total_complaints bigint, share double",
    )
    years = Request("period_comparison_with_issue_drivers", filters=Filters(company="Acme"), baseline_start=date(2024, 1, 1), comparison_start=date(2025, 1, 1))
    quarters = Request("quarter_comparison_with_issue_drivers", baseline_start=date(2025, 4, 1), comparison_start=date(2025, 7, 1))
    table = evidence.stack_rows([ranked, change_rows(spark, "trend_drivers", years), change_rows(spark, "quarter_drivers", quarters)])
    names = ["sample_themes", "ranked_issues", "trend_drivers", "quarter_drivers"]
    questions = spark.createDataFrame([(n, "narrative" if n == names[0] else "combined", n, n != names[0], True) for n in names], QUESTION_SCHEMA)
    items = spark.createDataFrame([(n, *row) for n in names for row in (LABELLED if n == names[0] else LABELLED[:1])], ITEM_SCHEMA)
    claims = drafts.draft_claims(questions, table, items)
    remarks = drafts.draft_remarks(questions, table, items)
    filters = spark.createDataFrame([(n, *[None] * 11) for n in names], FILTER_SCHEMA)
    reasons = grounding.all_reasons(questions, claims, remarks, table, items, filters)
    verdicts = {r["question_id"]: r for r in grounding.verdicts(questions, claims, items, reasons).collect()}
    assert {n: v["reasons"] for n, v in verdicts.items()} == dict.fromkeys(names, "")
    assert verdicts["sample_themes"]["citations"] == "1,2,3" and verdicts["ranked_issues"]["claim_count"] == 6
    text = {r["question_id"]: r["answer"] for r in drafts.render(claims, remarks, table).collect()}
    assert text["sample_themes"] == (
        "Among the retrieved examples, repeated issue/sub-issue labels were: Account access / Frozen "
        "account (3); Fees / Unexpected fee (2). Among the retrieved examples, Complaint 1 reported: "
        "“text 1” Among the retrieved examples, Complaint 2 reported: “text 2” Among the retrieved "
        "examples, Complaint 3 reported: “text 3” Limitations: These are relevance-ranked retrieved "
        "examples, not population prevalence estimates."
    )
    assert text["ranked_issues"].startswith("issue 0: 10 complaints (25% of 40). issue 1: 9 complaints (22.5% of 40).")
    assert "issue 5" not in text["ranked_issues"] and text["ranked_issues"].endswith("Complaint 1 reported: “text 1”")
    assert text["trend_drivers"].startswith(
        "Complaints were up: 14 in the baseline year versus 18 in the comparison year, a change of 4. "
        "Driver Access: change 6 (10 to 16). Driver Fees: change -2 (4 to 2)."
    )
    assert text["quarter_drivers"].startswith("Bravo: Complaints were up: 3 in the baseline period versus 100")


def test_fingerprint_depends_on_content_and_order_only(spark):
    items = spark.createDataFrame([("q", *row) for row in LABELLED], ITEM_SCHEMA)
    one = rows(evidence.fingerprint(items, ["position"]))
    assert one == rows(evidence.fingerprint(items.repartition(4), ["position"]))
    changed = items.withColumn("excerpt", F.upper("excerpt"))
    assert one != rows(evidence.fingerprint(changed, ["position"]))


def test_outcomes_and_constraints(spark):
    make = spark.createDataFrame
    names = ["ok", "uncovered", "unknown", "norows", "noitems", "rejected"]
    questions = make([(n, "combined", f"query {n}", "Nobody" if n == "unknown" else None) for n in names], "question_id string, mode string, query string, company_or_brand string")
    coverage = make([(n, n != "uncovered", "outside" if n == "uncovered" else None) for n in names], "question_id string, answerable boolean, reason string")
    entities = make([("unknown", "unresolved")], "question_id string, status string")
    has = lambda absent: make([(n,) for n in names if n != absent], "question_id string")
    verdicts = make([(n, n != "rejected", "bad" if n == "rejected" else "", "3,12" if n != "rejected" else "") for n in names], "question_id string, accepted boolean, reasons string, citations string")
    rendered = make([(n, f"text {n}") for n in names], "question_id string, answer string")
    records = answers.answer_records(questions, coverage, entities, has("norows"), has("noitems"), verdicts, rendered)
    by_id = {r["question_id"]: r for r in records.collect()}
    assert by_id["ok"].asDict() == {"question_id": "ok", "answer": "text ok", "citations": [3, 12], "query": "query ok", "abstained": False}
    assert {n: r["answer"] for n, r in by_id.items() if r["abstained"]} == {
        "uncovered": "outside",
        "unknown": "The explicit company or brand 'Nobody' could not be resolved.",
        "norows": "The structured query returned no rows for the requested constraints.",
        "noitems": "No narratives matched the requested retrieval constraints.",
        "rejected": "The synthesized answer failed deterministic grounding validation: bad",
    }
    assert [n for n in names if by_id[n]["query"] is None] == ["uncovered", "unknown"]
    assert rows(answers.record_violations(records)) == [(0, 0, 0, 0)]
    broken = make([(" ", "", [1], True), ("x", "y", [None], False)], "question_id string, answer string, citations array<bigint>, abstained boolean")
    assert rows(answers.record_violations(broken)) == [(1, 1, 1, 1)]


def test_further_causes_of_abstention(spark):
    names = ["conflict", "failed", "binding", "ignored", "fine"]
    modes = {"ignored": "structured"}
    questions = spark.createDataFrame(
        [(q, modes.get(q, "combined"), "q()", "Block" if q == "conflict" else None) for q in names],
        "question_id string, mode string, query string, company_or_brand string",
    )
    coverage = spark.createDataFrame([(q, True, None) for q in names], "question_id string, answerable boolean, reason string")
    entities = spark.createDataFrame([("conflict", "curated_alias", "company conflict")], "question_id string, status string, conflict string")
    present = spark.createDataFrame([(q,) for q in names], "question_id string")
    items = present.where("question_id not in ('failed', 'binding')")
    verdicts = spark.createDataFrame([(q, True, None, "1,2") for q in names], "question_id string, accepted boolean, reasons string, citations string")
    rendered = present.withColumn("answer", F.lit("text"))
    outcomes = spark.createDataFrame(
        [("failed", "index_error", "no index"), ("binding", "configuration_error", "no such row"),
         ("ignored", "index_error", "no index"), ("fine", "ok", None)],
        "question_id string, status string, error string",
    )
    records = answers.answer_records(questions, coverage, entities, present, items, verdicts, rendered, outcomes)
    found = {r["question_id"]: (r["answer"], r["citations"], r["query"], r["abstained"]) for r in records.collect()}
    assert found == {
        "conflict": ("The question contradicts the company it names: company conflict.", [], None, True),
        "failed": ("Narratives could not be searched: no index.", [], "q()", True),
        "binding": ("Narratives could not be searched: no such row.", [], "q()", True),
        "ignored": ("text", [1, 2], "q()", False),
        "fine": ("text", [1, 2], "q()", False),
    }


def test_references_without_a_counterpart(spark):
    claims = spark.createDataFrame(
        [
            ("a", 0, "quantitative", "structured_row", 1, 0, 0, ["n"], None, None, None),
            ("a", 1, "quantitative", "structured_row", 1, 0, 7, ["n"], None, None, None),
            ("b", 0, "quantitative", "structured_row", 1, 0, 0, ["n"], None, None, None),
            ("a", 2, "quantitative", "structured_row", 2, 0, 8, ["n"], None, None, None),
            ("a", 3, "narrative", "attributed_complaint", 0, 1, None, None, "42", "q", None),
            ("a", 4, "narrative", "attributed_complaint", 0, 1, None, None, "43", "q", None),
            ("b", 5, "narrative", "attributed_complaint", 0, 1, None, None, "42", "q", None),
            ("a", 6, "narrative", "unknown", 0, 1, None, None, "44", "q", None),
            ("a", 7, "narrative", "attributed_complaint", 0, 1, None, None, None, "q", None),
        ],
        CLAIM_SCHEMA,
    )
    known = spark.createDataFrame([("a", 0, ["n"], None)], ROW_SCHEMA)
    items = spark.createDataFrame([("a", *item())], ITEM_SCHEMA)
    assert {tuple(r) for r in grounding.absent_rows(claims, known).collect()} == {("a", 1, 7), ("b", 0, 0)}
    assert {tuple(r) for r in grounding.absent_citations(claims, items).collect()} == {
        ("a", 4, "43"), ("b", 5, "42"), ("a", 7, None),
    }
