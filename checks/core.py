"""Sources, cleaning, filters, monthly metrics, windows and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql
from checks.registry import gold, index, narratives, raw, register, rounded, silver
from docket_spark.constants import METRIC_TABLES
from docket_spark.functions.dates import date_ordinal, month_of, parse_date
from docket_spark.functions.text import company_key, document_id, yes_no
from docket_spark.operators.profiling import content_fingerprint, null_profile
from docket_spark.operators.ranking import stratified_sample
from docket_spark.plans import bronze, retrieval
from docket_spark.plans import gold as gold_plan
from docket_spark.plans import silver as silver_plan
from docket_spark.plans.companies import brand_of
from docket_spark.sources import testdata
from docket_spark.sources.complaints import ROW_ORDER, file_digests

POPULATION = testdata.POPULATION


@register("src_raw_snapshot", sql.query(f"SELECT {', '.join(sql.TEXT_COLUMNS)} FROM raw", "raw"))
def _(spark, sf):
    return raw(spark, sf).drop(ROW_ORDER)


@register("src_file_digests")
def _(spark, sf):
    return file_digests(spark, sf, "*.parquet")


_TOLD = "concat_ws(',', " + ", ".join(
    f"coalesce(length({c}) || ':' || {c}, 'N')" for c in sorted(sql.TEXT_COLUMNS)
) + ")"


@register(
    "src_content_fingerprint",
    sql.query(
        "SELECT count(*) AS row_count, bit_xor(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS xor_hash, "
        "CAST(sum(CAST('0x' || substr(h, 17, 15) AS BIGINT) % 1000000007) AS BIGINT) AS sum_hash FROM "
        f"(SELECT md5({_TOLD}) AS h FROM raw)",
        "raw",
    ),
)
def _(spark, sf):
    return content_fingerprint(raw(spark, sf).drop(ROW_ORDER))


_TIDY = ("product", "tags", "complaint_id", "consumer_complaint_narrative", "timely_response")


@register(
    "prj_text_normalise",
    sql.query(f"SELECT {', '.join(_TIDY)} FROM c", "defects", c=sql.cleaned("defects")),
)
def _(spark, sf):
    return silver_plan.clean(testdata.with_defects(raw(spark, sf))).select(*_TIDY)


_SPELLINGS = (
    ("1", "{0}"),
    ("2", "{0} 08:15:00"),
    ("3", "{0}T23:59:59.5+02:00"),
    ("4", "{0}Z"),
    ("5", "{1}"),
    ("6", "{2}"),
)


def _spelled(day, month, year, concat, case):
    return case(
        [
            day,
            concat(day, " 08:15:00"),
            concat(day, "T23:59:59.5+02:00"),
            concat(day, "x"),
            month,
            year,
        ],
        concat("on ", day),
    )


_SQL_SPELLED = _spelled(
    sql.SHIP,
    f"substr({sql.SHIP}, 1, 7)",
    f"substr({sql.SHIP}, 1, 4)",
    lambda a, b: " || ".join(p if p.startswith("CAST") else f"'{p}'" for p in (a, b)),
    lambda options, other: "CASE l_linenumber "
    + " ".join(f"WHEN {i + 1} THEN {o}" for i, o in enumerate(options))
    + f" ELSE {other} END",
)


@register(
    "prj_safe_dates",
    f"SELECT l_orderkey, l_linenumber, spelled, TRY_CAST(spelled AS DATE) AS parsed "
    f"FROM (SELECT *, {_SQL_SPELLED} AS spelled FROM lineitem)",
)
def _(spark, sf):
    lines = testdata.table(spark, sf, "lineitem")
    day = F.col("l_shipdate").cast("date").cast("string")

    def case(options, other):
        number = F.col("l_linenumber")
        return F.coalesce(*[F.when(number == i + 1, o) for i, o in enumerate(options)], other)

    def concat(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    spelled = _spelled(day, F.substring(day, 1, 7), F.substring(day, 1, 4), concat, case)
    return lines.select("l_orderkey", "l_linenumber", spelled.alias("spelled")).withColumn(
        "parsed", parse_date(F.col("spelled"))
    )


@register(
    "prj_tri_state",
    sql.query(
        "SELECT complaint_id, timely_response AS source_flag, CASE lower(timely_response) "
        "WHEN 'yes' THEN true WHEN 'no' THEN false END AS timely_response FROM cleaned",
        "cleaned",
    ),
)
def _(spark, sf):
    cleaned = silver_plan.clean(raw(spark, sf))
    return cleaned.select(
        "complaint_id",
        F.col("timely_response").alias("source_flag"),
        yes_no(F.col("timely_response")).alias("timely_response"),
    )


_KEYED = sql.KEY.format("company")


@register(
    "prj_company_key",
    sql.query(f"SELECT complaint_id, company, {_KEYED} AS company_key FROM renamed", "renamed"),
)
def _(spark, sf):
    rows = testdata.with_registry_names(raw(spark, sf))
    return rows.select("complaint_id", "company", company_key(F.col("company")).alias("company_key"))


@register(
    "prj_brand_mapping",
    sql.query(
        f"SELECT company, CASE {_KEYED} {sql.BRANDS} END AS brand_name, count(*) AS row_count "
        "FROM renamed GROUP BY ALL",
        "renamed",
    ),
)
def _(spark, sf):
    rows = testdata.with_registry_names(raw(spark, sf))
    brand = brand_of(company_key(F.col("company")))
    return rows.groupBy("company", brand.alias("brand_name")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


@register(
    "prj_month_bucket",
    sql.query("SELECT complaint_id, date_received, complaint_month FROM dated", "dated"),
)
def _(spark, sf):
    return silver(spark, sf).select(
        "complaint_id", "date_received", month_of(F.col("date_received")).alias("complaint_month")
    )


@register(
    "prj_unknown_label",
    """SELECT coalesce(issue, 'Unknown') AS issue_label, complaint_count FROM (
  SELECT CASE WHEN p_size < 5 THEN NULL WHEN p_size = 5 THEN 'Unknown' ELSE p_brand END AS issue,
    count(*) AS complaint_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)""",
)
def _(spark, sf):
    lines = testdata.table(spark, sf, "lineitem").join(
        testdata.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    issue = F.when(F.col("p_size") < 5, F.lit(None)).when(
        F.col("p_size") == 5, "Unknown"
    ).otherwise(F.col("p_brand"))
    counted = lines.groupBy(issue.alias("issue")).agg(F.count(F.lit(1)).alias("complaint_count"))
    return counted.select(
        F.coalesce("issue", F.lit("Unknown")).alias("issue_label"), "complaint_count"
    )


def _line(label, column):
    return f"'{label}: ' || coalesce({column}, 'Unknown')"


DOCUMENT = " || chr(10) || ".join(
    [
        "'Complaint ID: ' || complaint_id",
        _line("Company", "company"),
        _line("Product", "product"),
        _line("Sub-product", "sub_product"),
        _line("Issue", "issue"),
        _line("Sub-issue", "sub_issue"),
        "'Consumer narrative:' || chr(10) || substr(consumer_complaint_narrative, 1, 6000)",
    ]
)
ELIGIBLE = "length(trim(consumer_complaint_narrative)) > 0"


@register(
    "prj_document_text",
    sql.query(
        f"SELECT complaint_id, {DOCUMENT} AS document FROM narrative WHERE {ELIGIBLE}",
        "narrative",
    ),
)
def _(spark, sf):
    return retrieval.index_rows(narratives(spark, sf)).select("complaint_id", "document")


_META = ("product", "sub_product", "issue", "sub_issue", "company", "company_key", "brand_name")


@register(
    "prj_index_metadata",
    sql.query(
        "SELECT complaint_id, "
        + ", ".join(f"coalesce({name}, '') AS {name}" for name in (*_META, "state"))
        + ", coalesce(CAST(date_received AS VARCHAR), '') AS date_received, "
        "coalesce(CAST(timely_response AS VARCHAR), '') AS timely_response, "
        "coalesce(company_response_to_consumer, '') AS company_response, "
        "CAST(length(consumer_complaint_narrative) > 6000 AS VARCHAR) AS narrative_truncated, "
        "CAST(date_diff('day', DATE '0001-01-01', date_received) + 1 AS VARCHAR) "
        f"AS date_received_ordinal FROM narrative WHERE {ELIGIBLE}",
        "narrative",
    ),
)
def _(spark, sf):
    rows = retrieval.index_rows(narratives(spark, sf)).select(
        retrieval.metadata_map().alias("metadata")
    )
    names = ("complaint_id", *retrieval.METADATA_COLUMNS, "narrative_truncated", "date_received_ordinal")
    return rows.select(*[F.col("metadata")[name].alias(name) for name in names])


@register(
    "prj_date_ordinal",
    sql.query(
        "SELECT date_received, CAST(date_diff('day', DATE '0001-01-01', date_received) + 1 AS "
        "BIGINT) AS ordinal, count(*) AS row_count FROM silver GROUP BY ALL",
        "silver",
    ),
)
def _(spark, sf):
    ordinal = date_ordinal(F.col("date_received")).cast("bigint")
    return silver(spark, sf).groupBy("date_received", ordinal.alias("ordinal")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


@register(
    "prj_document_id",
    sql.query("SELECT complaint_id, sha256(complaint_id) AS doc_id FROM silver", "silver"),
)
def _(spark, sf):
    return silver(spark, sf).select(
        "complaint_id", document_id(F.col("complaint_id")).alias("doc_id")
    )


@register(
    "prj_excerpt",
    sql.query(
        "SELECT complaint_id, substr(document, instr(document, 'Consumer narrative:' || chr(10)) "
        "+ 20) AS excerpt, truncated FROM (SELECT complaint_id, "
        f"{DOCUMENT} AS document, length(consumer_complaint_narrative) > 6000 AS truncated "
        f"FROM narrative WHERE {ELIGIBLE})",
        "narrative",
    ),
)
def _(spark, sf):
    return retrieval.index_rows(narratives(spark, sf)).select(
        "complaint_id",
        retrieval.excerpt_of_document(F.col("document")).alias("excerpt"),
        F.col("narrative_truncated").alias("truncated"),
    )


@register(
    "flt_eligible_narratives",
    """SELECT lang, count(*) AS eligible FROM (SELECT lang, CASE WHEN source = 'src7' THEN '   '
  WHEN source = 'src8' THEN NULL ELSE text END AS narrative FROM documents)
WHERE length(trim(narrative)) > 0 GROUP BY lang""",
)
def _(spark, sf):
    text = (
        F.when(F.col("source") == "src7", "   ")
        .when(F.col("source") == "src8", F.lit(None))
        .otherwise(F.col("text"))
    )
    documents = testdata.table(spark, sf, "documents").select(
        "lang", text.alias("consumer_complaint_narrative")
    )
    return retrieval.eligible(documents).groupBy("lang").agg(
        F.count(F.lit(1)).alias("eligible")
    )


_OUTSIDE = (
    f"(d IS NULL OR d < DATE '{POPULATION[0]}' OR d > DATE '{POPULATION[1]}')"
)
_DIRTY = (
    "SELECT complaint_id, TRY_CAST(nullif(trim(date_received), '') AS DATE) AS d, "
    "nullif(trim(consumer_complaint_narrative), '') AS narrative FROM defects"
)


@register(
    "flt_population_violations",
    sql.query(
        f"SELECT count(*) FILTER (WHERE {_OUTSIDE}) AS out_of_range, "
        "count(*) FILTER (WHERE narrative IS NULL) AS blank_narrative FROM dirty",
        "defects",
        dirty=_DIRTY,
    ),
)
def _(spark, sf):
    rows = testdata.with_defects(raw(spark, sf))
    return bronze.population_profile(rows, *POPULATION).select(
        F.col("date_received_out_of_range_or_invalid_count").alias("out_of_range"),
        F.col("blank_narrative_count").alias("blank_narrative"),
    )


@register(
    "flt_invalid_records",
    sql.query(
        "SELECT count(*) AS invalid_rows FROM c WHERE complaint_id IS NULL "
        "OR (date_received IS NOT NULL AND TRY_CAST(date_received AS DATE) IS NULL) "
        "OR (date_sent_to_company IS NOT NULL AND TRY_CAST(date_sent_to_company AS DATE) IS NULL) "
        "OR (timely_response IS NOT NULL AND lower(timely_response) NOT IN ('yes', 'no'))",
        "defects",
        c=sql.cleaned("defects"),
    ),
)
def _(spark, sf):
    return silver_plan.count_invalid(silver_plan.clean(testdata.with_defects(raw(spark, sf))))


@register(
    "flt_dated_rows",
    sql.query(
        "SELECT CAST(date_trunc('month', d) AS DATE) AS complaint_month, count(*) AS row_count "
        "FROM dirty WHERE d IS NOT NULL GROUP BY 1",
        "defects",
        dirty=_DIRTY,
    ),
)
def _(spark, sf):
    rows = silver_plan.typed(silver_plan.clean(testdata.with_defects(raw(spark, sf))))
    return gold_plan.dated(rows).groupBy("complaint_month").agg(
        F.count(F.lit(1)).alias("row_count")
    )


@register(
    "agg_metric_bundle",
    sql.query(f"SELECT state, {sql.MEASURES} FROM silver GROUP BY state", "silver"),
)
def _(spark, sf):
    from docket_spark.functions.metrics import complaint_measures, timely_rate

    return rounded(
        silver(spark, sf)
        .groupBy("state")
        .agg(*complaint_measures(F.col("timely_response")))
        .withColumn("timely_response_rate", timely_rate()),
        "timely_response_rate",
    )


def _metric_query(name):
    def build(spark, sf):
        return rounded(gold(spark, sf)[name], "timely_response_rate")

    return build


for _name in METRIC_TABLES:
    register(f"agg_{_name}", sql.query(f"SELECT * FROM {_name}", _name))(_metric_query(_name))


@register(
    "agg_all_metric_tables",
    sql.query(
        " UNION ALL BY NAME ".join(
            f"SELECT '{name}' AS table_name, * EXCLUDE (timely_response_rate) FROM {name}"
            for name in METRIC_TABLES
        ),
        *METRIC_TABLES,
    ),
)
def _(spark, sf):
    return gold_plan.all_metrics(silver(spark, sf, gold_plan.needed_columns(METRIC_TABLES)))


@register(
    "agg_gold_reconciliation",
    sql.query(
        " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, CAST(sum(complaint_count) AS BIGINT) AS metric_total, "
            "sum(complaint_count) = (SELECT count(*) FROM dated) AS matches_dated_silver_rows "
            f"FROM {name}"
            for name in METRIC_TABLES
        ),
        *METRIC_TABLES,
    ),
)
def _(spark, sf):
    return gold_plan.reconciliation(silver(spark, sf, gold_plan.needed_columns(METRIC_TABLES)))


@register(
    "agg_bronze_profile",
    sql.query(
        "SELECT count(*) AS row_count, count(DISTINCT complaint_id) AS "
        "distinct_complaint_id_count, count(narrative) AS narrative_count, "
        "min(d) AS date_received_min, max(d) AS date_received_max, "
        f"count(*) FILTER (WHERE NOT {_OUTSIDE}) AS date_received_in_range_count, "
        f"count(*) FILTER (WHERE {_OUTSIDE}) AS date_received_out_of_range_or_invalid_count, "
        "count(*) FILTER (WHERE narrative IS NULL) AS blank_narrative_count FROM dirty",
        "defects",
        dirty=_DIRTY,
    ),
)
def _(spark, sf):
    return bronze.population_profile(testdata.with_defects(raw(spark, sf)), *POPULATION)


@register(
    "agg_null_profile",
    sql.query(
        " UNION ALL ".join(
            f"SELECT * FROM (SELECT '{name}' AS column_name, count(*) FILTER (WHERE {name} IS NULL) "
            "AS null_count FROM silver) WHERE null_count > 0"
            for name in silver_plan.SILVER_COLUMNS
        ),
        "silver",
    ),
)
def _(spark, sf):
    return null_profile(silver(spark, sf))


@register(
    "agg_brand_counts",
    sql.query(
        "SELECT brand_name, count(*) AS complaint_count FROM silver "
        "WHERE brand_name IS NOT NULL GROUP BY brand_name",
        "renamed",
        "silver",
        cleaned=sql.cleaned("renamed"),
    ),
)
def _(spark, sf):
    return silver_plan.brand_counts(
        silver_plan.silver_table(testdata.with_registry_names(raw(spark, sf)))
    )


@register(
    "agg_duplicate_accounting",
    sql.query(
        "SELECT s AS source_rows, k AS silver_rows, s - k AS duplicate_rows_skipped FROM "
        "(SELECT (SELECT count(*) FROM raw) AS s, (SELECT count(*) FROM silver) AS k)",
        "silver",
    ),
)
def _(spark, sf):
    return silver_plan.duplicate_accounting(raw(spark, sf), silver(spark, sf))


@register(
    "agg_index_reconciliation",
    sql.query(
        "SELECT eligible_silver_narratives, documents_indexed, documents_indexed AS "
        "collection_count, truncated_narrative_count, documents_indexed = "
        "eligible_silver_narratives AS reconciles_to_eligible_silver FROM (SELECT (SELECT count(*) "
        f"FROM narrative WHERE {ELIGIBLE}) AS eligible_silver_narratives, count(*) AS "
        "documents_indexed, count(*) FILTER (WHERE narrative_truncated) AS "
        "truncated_narrative_count FROM idx)",
        "idx",
    ),
)
def _(spark, sf):
    return retrieval.index_reconciliation(narratives(spark, sf), index(spark, sf))


@register(
    "win_first_per_complaint",
    sql.query(
        f"SELECT {', '.join(silver_plan.SILVER_COLUMNS)} FROM silver",
        "silver",
    ),
)
def _(spark, sf):
    return silver(spark, sf)


@register(
    "win_kept_rows",
    sql.query(
        f"SELECT {', '.join(silver_plan.SILVER_COLUMNS)} FROM silver",
        "silver",
    ),
)
def _(spark, sf):
    return silver_plan.typed(silver_plan.kept_rows(silver_plan.clean(raw(spark, sf))))


@register(
    "srt_index_order_limit",
    sql.query(
        f"SELECT complaint_id FROM narrative WHERE {ELIGIBLE} ORDER BY complaint_id LIMIT 25",
        "narrative",
    ),
)
def _(spark, sf):
    return retrieval.ordered_prefix(narratives(spark, sf), 25).select("complaint_id")


@register(
    "ret_stratified_sample",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source "
    "ORDER BY md5(CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) AS rn FROM documents) "
    "WHERE rn <= 15",
)
def _(spark, sf):
    documents = testdata.table(spark, sf, "documents").select(
        "source", "doc_id", F.col("doc_id").cast("string").alias("key")
    )
    return stratified_sample(documents, ["source"], "key", 15).select("source", "doc_id")


@register(
    "fn_calendar_months",
    """SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS complaint_month,
  CAST(date_trunc('month', o_orderdate) + INTERVAL 3 MONTH AS DATE) AS quarter_later,
  CAST(date_trunc('month', o_orderdate) - INTERVAL 12 MONTH AS DATE) AS year_earlier FROM orders""",
)
def _(spark, sf):
    month = month_of(F.col("o_orderdate").cast("date"))
    return (
        testdata.table(spark, sf, "orders")
        .select(month.alias("complaint_month"))
        .distinct()
        .withColumns(
            {
                "quarter_later": F.add_months("complaint_month", 3),
                "year_earlier": F.add_months("complaint_month", -12),
            }
        )
    )
