"""Building blocks of the oracle SQL: common table expressions over the test tables."""

from __future__ import annotations

from docket_spark.constants import COMPANY_REGISTRY, METRIC_TABLES
from docket_spark.plans.companies import registry_entries

_DAY = "CAST(CAST({0} AS DATE) AS VARCHAR)"
SHIP = _DAY.format("l_shipdate")
ORDERED = _DAY.format("o_orderdate")
NUMBER = "CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)"
ROW_ORDER = (
    "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, "
    "l_returnflag, l_linestatus"
)
TEXT_COLUMNS = (
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

RAW = f"""
SELECT CASE WHEN l_returnflag = 'R' THEN {SHIP} || 'T09:30:00Z' ELSE {SHIP} END AS date_received,
  CASE WHEN o_orderstatus = 'O' THEN ' ' || p_type || '  ' ELSE p_type END AS product,
  'SIZE ' || CAST(p_size AS VARCHAR) AS sub_product, p_brand AS issue, p_name AS sub_issue,
  'line ' || {NUMBER} AS consumer_complaint_narrative,
  CAST(NULL AS VARCHAR) AS company_public_response, s_name AS company, n_name AS state,
  CAST(NULL AS VARCHAR) AS zip_code,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '  ' ELSE c_mktsegment END AS tags,
  o_orderpriority AS submitted_via, {ORDERED} AS date_sent_to_company,
  o_orderstatus AS company_response_to_consumer,
  CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'R' THEN 'NO' END AS timely_response,
  CASE WHEN l_linestatus = 'F' THEN ' ' || {NUMBER} || ' ' ELSE {NUMBER} END AS complaint_id,
  {ROW_ORDER}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey"""

DEFECTS = """
SELECT * REPLACE (
  CASE l_quantity WHEN 50 THEN 'not-date' WHEN 49 THEN '1998-07' ELSE date_received END
    AS date_received,
  CASE WHEN l_quantity = 48 THEN 'maybe' ELSE timely_response END AS timely_response,
  CASE WHEN l_quantity = 47 THEN '  ' ELSE complaint_id END AS complaint_id,
  CASE WHEN l_tax = 0 THEN ' ' ELSE consumer_complaint_narrative END
    AS consumer_complaint_narrative)
FROM raw"""

_SUPPLIER = "CAST(substr(company, instr(company, '#') + 1) AS BIGINT) % 10"
RENAMED = f"""
SELECT * REPLACE (CASE {_SUPPLIER} WHEN 0 THEN 'BLOCK, INC.' WHEN 1 THEN 'cash app'
  WHEN 2 THEN 'Early Warning Services, LLC' WHEN 3 THEN 'Mohela' ELSE company END AS company)
FROM raw"""

KEY = "nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), '')"


def cleaned(source: str = "raw") -> str:
    columns = ", ".join(f"nullif(trim({name}), '') AS {name}" for name in TEXT_COLUMNS)
    return f"SELECT {columns}, {ROW_ORDER} FROM {source}"


BRANDS = " ".join(
    f"WHEN '{key}' THEN '{brand}'" for key, (_, brand, _) in registry_entries(COMPANY_REGISTRY).items()
)


def silver(order: str = ROW_ORDER) -> str:
    return f"""
SELECT complaint_id, TRY_CAST(date_received AS DATE) AS date_received, product, sub_product, issue,
  sub_issue, consumer_complaint_narrative, company_public_response, company,
  {KEY.format('company')} AS company_key,
  CASE {KEY.format('company')} {BRANDS} END AS brand_name,
  state, zip_code, tags, submitted_via, TRY_CAST(date_sent_to_company AS DATE)
    AS date_sent_to_company, company_response_to_consumer,
  CASE lower(timely_response) WHEN 'yes' THEN true WHEN 'no' THEN false END AS timely_response
FROM (SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY {order}) AS rn FROM cleaned)
WHERE rn = 1"""


MEASURES = """count(*) AS complaint_count,
  count(*) FILTER (WHERE timely_response) AS timely_response_count,
  count(timely_response) AS timely_response_known_count,
  round(count(*) FILTER (WHERE timely_response) / nullif(count(timely_response), 0), 6)
    AS timely_response_rate"""
DATED = """SELECT *, CAST(date_trunc('month', date_received) AS DATE) AS complaint_month
FROM silver WHERE date_received IS NOT NULL"""


def metrics(table: str) -> str:
    dims = ", ".join(METRIC_TABLES[table])
    return f"SELECT {dims}, {MEASURES} FROM dated GROUP BY {dims}"


NARRATIVE_RAW = f"""
SELECT {ORDERED} AS date_received, c_mktsegment AS product, CAST(NULL AS VARCHAR) AS sub_product,
  lang AS issue, source AS sub_issue, text AS consumer_complaint_narrative,
  CAST(NULL AS VARCHAR) AS company_public_response, n_name AS company, r_name AS state,
  CAST(NULL AS VARCHAR) AS zip_code, CAST(NULL AS VARCHAR) AS tags,
  o_orderpriority AS submitted_via, {ORDERED} AS date_sent_to_company,
  o_orderstatus AS company_response_to_consumer,
  CASE quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS timely_response,
  CAST(documents.doc_id AS VARCHAR) AS complaint_id, n_nationkey
FROM documents LEFT JOIN orders ON doc_id = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN labels ON labels.doc_id = documents.doc_id"""

# Document texts hold no surrounding spaces and ids are unique, so the narrative silver needs no
# deduplication; a separate check compares the counts.
NARRATIVE = f"""
SELECT complaint_id, TRY_CAST(date_received AS DATE) AS date_received, product, sub_product, issue,
  sub_issue, nullif(trim(consumer_complaint_narrative), '') AS consumer_complaint_narrative,
  company, {KEY.format('company')} AS company_key,
  CASE {KEY.format('company')} {BRANDS} END AS brand_name, state, company_response_to_consumer,
  CASE timely_response WHEN 'Yes' THEN true WHEN 'No' THEN false END AS timely_response, n_nationkey
FROM narrative_raw"""

INDEX = """
SELECT complaint_id, substr(consumer_complaint_narrative, 1, 6000) AS excerpt, product, sub_product,
  issue, sub_issue, company, company_key, brand_name, date_received, state, timely_response,
  company_response_to_consumer AS company_response,
  length(consumer_complaint_narrative) > 6000 AS narrative_truncated, embedding
FROM narrative JOIN embeddings
  ON vec_id = CAST(complaint_id AS BIGINT) % (SELECT count(*) FROM embeddings)
WHERE length(trim(consumer_complaint_narrative)) > 0"""

BLOCKS = {
    "raw": RAW,
    "defects": DEFECTS,
    "renamed": RENAMED,
    "cleaned": cleaned(),
    "silver": silver(),
    "dated": DATED,
    "narrative_raw": NARRATIVE_RAW,
    "narrative": NARRATIVE,
    "idx": INDEX,
    **{name: metrics(name) for name in METRIC_TABLES},
}
_NEEDS = {
    "defects": ["raw"],
    "renamed": ["raw"],
    "cleaned": ["raw"],
    "silver": ["cleaned"],
    "dated": ["silver"],
    "narrative": ["narrative_raw"],
    "idx": ["narrative"],
    **{name: ["dated"] for name in METRIC_TABLES},
}


def query(body: str, *needs: str, **blocks: str) -> str:
    """``body`` after a WITH clause of the named blocks, their prerequisites and own blocks.

    An own block replaces a shared one of the same name.
    """
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        for needed in _NEEDS.get(name, []):
            add(needed)
        done[name] = blocks.get(name, BLOCKS.get(name, ""))

    for name in needs:
        add(name)
    for name, text in blocks.items():
        done.setdefault(name, text)
    listed = ",\n".join(f"{name} AS ({text})" for name, text in done.items())
    return f"WITH {listed}\n{body}" if listed else body


def distance(left: str, right: str) -> str:
    return (
        f"list_sum([pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2) "
        f"FOR p IN list_zip({left}, {right})])"
    )


def collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '[\\s\\x1c-\\x1f\\x85\\p{{Z}}\\x0b]+', ' ', 'g'))"


def bounded_quote(text: str) -> str:
    """Quote of already collapsed text."""
    window = f"substr({text}, 1, 281)"
    stop = (
        f"CASE WHEN instr(reverse({window}), '.') > 0 "
        f"THEN length({window}) + 1 - instr(reverse({window}), '.') ELSE 0 END"
    )
    return (
        f"CASE WHEN length({text}) <= 280 THEN {text} ELSE rtrim(substr({text}, 1, "
        f"CASE WHEN {stop} >= 41 THEN {stop} ELSE 280 END)) END"
    )
