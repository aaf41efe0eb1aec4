"""Typed analytical requests and the joins and orderings they are made of."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checks import sql
from checks.registry import gold, register, rounded, silver
from docket_spark.functions.answers import display_findings
from docket_spark.functions.dates import add_months
from docket_spark.functions.metrics import metric_rollup, relative_change, sum_between
from docket_spark.operators.totals import with_share
from docket_spark.plans.analysis import Filters, Request, run, run_batch

QUARTERS = {"baseline_start": date(1997, 4, 1), "comparison_start": date(1997, 7, 1)}
YEARS = {"baseline_start": date(1997, 1, 1), "comparison_start": date(1998, 1, 1)}
RATE = (
    "round(sum(timely_response_count) / nullif(sum(timely_response_known_count), 0), 6)"
)
COUNT = "CAST(sum(complaint_count) AS BIGINT)"
TEXT_NULL = "CAST(NULL AS VARCHAR)"


def _request_query(request, *round_columns):
    def build(spark, sf):
        return rounded(run(request, gold(spark, sf)), *round_columns)

    return build


def _add(name, request, oracle, *round_columns):
    register(name, oracle)(_request_query(request, *round_columns))


_add(
    "analysis_aggregate",
    Request(
        "aggregate",
        metric="timely_response_rate",
        dimensions=("company",),
        order_by="timely_response_rate",
        direction="asc",
        limit=20,
    ),
    sql.query(
        f"SELECT company, {RATE} AS timely_response_rate FROM company_month_metrics "
        "GROUP BY company ORDER BY sum(timely_response_count) / "
        "nullif(sum(timely_response_known_count), 0) ASC NULLS LAST, company LIMIT 20",
        "company_month_metrics",
    ),
    "timely_response_rate",
)
_add(
    "analysis_trend",
    Request(
        "trend",
        dimensions=("product", "complaint_month"),
        filters=Filters(start_date=date(1996, 1, 15), end_date=date(1998, 3, 15)),
        limit=100,
    ),
    sql.query(
        f"SELECT product, complaint_month, {COUNT} AS complaint_count FROM product_month_metrics "
        "WHERE complaint_month >= DATE '1996-01-15' AND complaint_month < DATE '1998-03-15' "
        "GROUP BY ALL ORDER BY complaint_month, product LIMIT 100",
        "product_month_metrics",
    ),
)
_add(
    "analysis_trend_default_limit",
    Request("trend", dimensions=("complaint_month",)),
    sql.query(
        f"SELECT complaint_month, {COUNT} AS complaint_count FROM company_month_metrics "
        "GROUP BY ALL ORDER BY complaint_month LIMIT 10",
        "company_month_metrics",
    ),
)


def _window_counts(key, table, first, middle, last, where="true"):
    window = "coalesce(sum(complaint_count) FILTER (WHERE complaint_month >= {} AND complaint_month < {}), 0)"
    a, b, c = (f"DATE '{d}'" for d in (first, middle, last))
    return (
        f"SELECT {key}, CAST({window.format(a, b)} AS BIGINT) AS baseline_complaints, "
        f"CAST({window.format(b, c)} AS BIGINT) AS comparison_complaints FROM {table} "
        f"WHERE complaint_month >= {a} AND complaint_month < {c} AND {where} GROUP BY {key}"
    )


_BY_QUARTER = _window_counts(
    "company", "company_month_metrics", "1997-04-01", "1997-07-01", "1997-10-01"
)
_add(
    "analysis_quarter_comparison",
    Request("quarter_comparison", limit=25, **QUARTERS),
    sql.query(
        "SELECT *, comparison_complaints - baseline_complaints AS absolute_increase FROM q "
        "ORDER BY absolute_increase DESC, company LIMIT 25",
        "company_month_metrics",
        q=_BY_QUARTER,
    ),
)


def _shares(label, alias, table, where):
    return (
        f"SELECT {label} AS {alias}, {COUNT} AS complaint_count, CAST(sum(sum(complaint_count)) "
        f"OVER () AS BIGINT) AS total_complaints, round(sum(complaint_count) / "
        f"sum(sum(complaint_count)) OVER (), 6) AS share FROM {table} WHERE {where} GROUP BY {label}"
    )


_add(
    "analysis_response_distribution",
    Request("response_distribution", filters=Filters(company="Supplier#000000049"), limit=1),
    sql.query(
        _shares(
            "company_response_to_consumer",
            "company_response_to_consumer",
            "company_response_month_metrics",
            "company = 'Supplier#000000049'",
        ),
        "company_response_month_metrics",
    ),
    "share",
)
_COHORT = (
    "SELECT company, CAST(sum(complaint_count) AS BIGINT) AS complaint_count, "
    "CAST(sum(timely_response_count) AS BIGINT) AS timely_response_count, "
    "CAST(sum(timely_response_known_count) AS BIGINT) AS timely_response_known_count, "
    "sum(timely_response_count) / nullif(sum(timely_response_known_count), 0) AS rate "
    "FROM company_month_metrics GROUP BY company ORDER BY sum(complaint_count) DESC, company "
    "LIMIT 10"
)
_add(
    "analysis_top_volume_timely_response",
    Request("top_volume_timely_response"),
    sql.query(
        "SELECT * EXCLUDE (rate), round(rate, 6) AS timely_response_rate FROM cohort "
        "ORDER BY rate NULLS LAST, company LIMIT 1",
        "company_month_metrics",
        cohort=_COHORT,
    ),
    "timely_response_rate",
)
_add(
    "analysis_common_issues",
    Request("common_issues", filters=Filters(product="ECONOMY", state="NATION_3"), limit=7),
    sql.query(
        "SELECT * FROM ("
        + _shares(
            "issue",
            "issue",
            "company_product_state_issue_month_metrics",
            "product = 'ECONOMY' AND state = 'NATION_3'",
        )
        + ") ORDER BY complaint_count DESC, issue LIMIT 7",
        "company_product_state_issue_month_metrics",
    ),
    "share",
)
_add(
    "analysis_common_sub_issues",
    Request("common_sub_issues", filters=Filters(product="STANDARD", issue="Brand#7"), limit=8),
    sql.query(
        "SELECT * FROM ("
        + _shares(
            "sub_issue",
            "issue",
            "product_issue_sub_issue_month_metrics",
            "product = 'STANDARD' AND issue = 'Brand#7'",
        )
        + ") ORDER BY complaint_count DESC, issue LIMIT 8",
        "product_issue_sub_issue_month_metrics",
    ),
    "share",
)
_CHANGE = (
    "comparison_complaints - baseline_complaints AS absolute_change, round((comparison_complaints "
    "- baseline_complaints) / nullif(baseline_complaints, 0), 6) AS percentage_change"
)


def _period(where):
    return {
        "q": _window_counts(
            "issue",
            "company_product_state_issue_month_metrics",
            "1997-01-01",
            "1998-01-01",
            "1999-01-01",
            where,
        ),
        "drivers": "SELECT 'driver' AS row_type, coalesce(issue, 'Unknown') AS issue, "
        f"baseline_complaints, comparison_complaints, {_CHANGE} FROM q",
        "total": f"SELECT 'total' AS row_type, {TEXT_NULL} AS issue, baseline_complaints, "
        f"comparison_complaints, {_CHANGE} FROM (SELECT CAST(sum(baseline_complaints) AS BIGINT) "
        "AS baseline_complaints, CAST(sum(comparison_complaints) AS BIGINT) AS "
        "comparison_complaints FROM q)",
    }


_STACKED = (
    "SELECT * FROM total UNION ALL SELECT * FROM (SELECT * FROM drivers ORDER BY "
    "abs(absolute_change) DESC, issue LIMIT {})"
)
_add(
    "analysis_period_comparison_with_issue_drivers",
    Request(
        "period_comparison_with_issue_drivers",
        filters=Filters(product="ECONOMY", start_date=date(1998, 6, 1)),
        limit=6,
        **YEARS,
    ),
    sql.query(
        _STACKED.format(6),
        "company_product_state_issue_month_metrics",
        **_period("product = 'ECONOMY'"),
    ),
    "percentage_change",
)
_add(
    "analysis_period_comparison_empty_slice",
    Request(
        "period_comparison_with_issue_drivers", filters=Filters(product="ABSENT"), **YEARS
    ),
    sql.query(
        _STACKED.format(10),
        "company_product_state_issue_month_metrics",
        **_period("product = 'ABSENT'"),
    ),
    "percentage_change",
)
_WINNER = {
    "q": _BY_QUARTER,
    "winner": "SELECT * FROM q ORDER BY comparison_complaints - baseline_complaints DESC, company "
    "LIMIT 1",
    "i": _window_counts(
        "issue",
        "company_product_state_issue_month_metrics",
        "1997-04-01",
        "1997-07-01",
        "1997-10-01",
        "company = (SELECT company FROM winner)",
    ),
    "drivers": "SELECT 'driver' AS row_type, (SELECT company FROM winner) AS winner_company, "
    f"coalesce(issue, 'Unknown') AS issue, baseline_complaints, comparison_complaints, {_CHANGE} "
    "FROM i WHERE comparison_complaints > baseline_complaints",
    "total": f"SELECT 'total' AS row_type, company AS winner_company, {TEXT_NULL} AS issue, "
    f"baseline_complaints, comparison_complaints, {_CHANGE} FROM winner",
}
_BOTH = ("company_month_metrics", "company_product_state_issue_month_metrics")
_add(
    "analysis_quarter_comparison_with_issue_drivers",
    Request("quarter_comparison_with_issue_drivers", limit=5, **QUARTERS),
    sql.query(_STACKED.format(5), *_BOTH, **_WINNER),
    "percentage_change",
)


_BATCH = [
    ("largest", Request("aggregate", dimensions=("company",), limit=5)),
    ("months", Request("trend", dimensions=("complaint_month",), limit=6)),
    ("answers", Request("response_distribution")),
]


@register(
    "analysis_request_batch",
    sql.query(
        "SELECT 'largest' AS request_id, * FROM (SELECT company, CAST(sum(complaint_count) AS "
        "BIGINT) AS complaint_count FROM company_month_metrics GROUP BY company ORDER BY 2 DESC, "
        "company LIMIT 5) UNION ALL BY NAME SELECT 'months' AS request_id, * FROM (SELECT "
        f"complaint_month, {COUNT} AS complaint_count FROM company_month_metrics GROUP BY ALL "
        "ORDER BY complaint_month LIMIT 6) UNION ALL BY NAME SELECT 'answers' AS request_id, * FROM "
        "("
        + _shares(
            "company_response_to_consumer",
            "company_response_to_consumer",
            "company_response_month_metrics",
            "true",
        )
        + ")",
        "company_month_metrics",
        "company_response_month_metrics",
    ),
)
def _(spark, sf):
    return rounded(run_batch(_BATCH, gold(spark, sf)), "share")


@register(
    "analysis_display_findings",
    sql.query(
        "SELECT issue AS label, floor(share * 1000 + 0.5) / 10 AS value FROM (SELECT issue, "
        "sum(complaint_count) AS n, sum(complaint_count) / sum(sum(complaint_count)) OVER () AS "
        "share FROM company_issue_month_metrics GROUP BY issue) ORDER BY n DESC, issue LIMIT 5",
        "company_issue_month_metrics",
    ),
)
def _(spark, sf):
    ranked = run(Request("common_issues", limit=50), gold(spark, sf))
    return display_findings(ranked, F.col("complaint_count").desc(), F.col("issue").asc())


@register(
    "flt_hard_filters",
    sql.query(
        f"SELECT company, state, {COUNT} AS complaint_count FROM "
        "company_product_state_issue_month_metrics WHERE product = 'PROMO' AND issue = 'Brand#3' "
        "AND company = 'Supplier#000000007' GROUP BY ALL",
        "company_product_state_issue_month_metrics",
    ),
)
def _(spark, sf):
    filters = Filters(product="PROMO", issue="Brand#3", company="Supplier#000000007")
    table = "company_product_state_issue_month_metrics"
    return (
        gold(spark, sf)[table]
        .where(filters.predicate(table))
        .groupBy("company", "state")
        .agg(metric_rollup("complaint_count").alias("complaint_count"))
    )


@register(
    "flt_month_range",
    sql.query(
        f"SELECT complaint_month, {COUNT} AS complaint_count FROM product_month_metrics WHERE "
        "complaint_month >= DATE '1996-02-15' AND complaint_month < DATE '1996-08-15' GROUP BY ALL",
        "product_month_metrics",
    ),
)
def _(spark, sf):
    filters = Filters(start_date=date(1996, 2, 15), end_date=date(1996, 8, 15))
    return (
        gold(spark, sf)["product_month_metrics"]
        .where(filters.predicate("product_month_metrics"))
        .groupBy("complaint_month")
        .agg(metric_rollup("complaint_count").alias("complaint_count"))
    )


@register(
    "jn_grand_total",
    sql.query(
        _shares("state", "state", "company_product_state_issue_month_metrics", "true"),
        "company_product_state_issue_month_metrics",
    ),
)
def _(spark, sf):
    counts = silver(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("complaint_count"))
    return rounded(with_share(counts), "share")


def _winner(spark, sf):
    counts = silver(spark, sf).groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("company").asc()).limit(1)


_SILVER_WINNER = (
    "SELECT company FROM silver GROUP BY company ORDER BY count(*) DESC, company LIMIT 1"
)


@register(
    "jn_winner_detail",
    sql.query(
        f"SELECT complaint_id, company, issue FROM silver WHERE company = ({_SILVER_WINNER})",
        "silver",
    ),
)
def _(spark, sf):
    name = _winner(spark, sf).select("company").scalar()
    return silver(spark, sf).where(F.col("company") == name).select(
        "complaint_id", "company", "issue"
    )


@register(
    "jn_winner_column",
    sql.query(
        f"SELECT issue, count(*) AS complaint_count, ({_SILVER_WINNER}) AS winner_company "
        "FROM silver GROUP BY issue",
        "silver",
    ),
)
def _(spark, sf):
    counts = silver(spark, sf).groupBy("issue").agg(F.count(F.lit(1)).alias("complaint_count"))
    return counts.withColumn("winner_company", _winner(spark, sf).select("company").scalar())


@register(
    "agg_metric_rollup",
    sql.query(
        f"SELECT product, {COUNT} AS complaint_count, {RATE} AS timely_response_rate FROM "
        "company_product_month_metrics GROUP BY product",
        "company_product_month_metrics",
    ),
)
def _(spark, sf):
    table = gold(spark, sf)["company_product_month_metrics"]
    return rounded(
        table.groupBy("product").agg(
            metric_rollup("complaint_count").alias("complaint_count"),
            metric_rollup("timely_response_rate").alias("timely_response_rate"),
        ),
        "timely_response_rate",
    )


@register(
    "agg_two_window_sums", sql.query("SELECT * FROM q", "company_month_metrics", q=_BY_QUARTER)
)
def _(spark, sf):
    month, count = F.col("complaint_month"), F.col("complaint_count")
    first, middle, last = date(1997, 4, 1), date(1997, 7, 1), date(1997, 10, 1)
    return (
        gold(spark, sf)["company_month_metrics"]
        .where((month >= F.lit(first)) & (month < F.lit(last)))
        .groupBy("company")
        .agg(
            sum_between(count, month, first, middle).alias("baseline_complaints"),
            sum_between(count, month, middle, last).alias("comparison_complaints"),
        )
    )


@register(
    "agg_share_of_total",
    sql.query(
        _shares("issue", "issue", "company_issue_month_metrics", "company = 'Supplier#000000011'"),
        "company_issue_month_metrics",
    ),
)
def _(spark, sf):
    counts = (
        gold(spark, sf)["company_issue_month_metrics"]
        .where(F.col("company") == "Supplier#000000011")
        .groupBy("issue")
        .agg(metric_rollup("complaint_count").alias("complaint_count"))
    )
    return rounded(with_share(counts), "share")


@register(
    "agg_period_change",
    sql.query(
        f"SELECT company, {_CHANGE} FROM q", "company_month_metrics", q=_BY_QUARTER
    ),
)
def _(spark, sf):
    month, count = F.col("complaint_month"), F.col("complaint_count")
    middle = QUARTERS["comparison_start"]
    first, last = QUARTERS["baseline_start"], add_months(middle, 3)
    counts = (
        gold(spark, sf)["company_month_metrics"]
        .where((month >= F.lit(first)) & (month < F.lit(last)))
        .groupBy("company")
        .agg(
            sum_between(count, month, first, middle).alias("baseline_complaints"),
            sum_between(count, month, middle, last).alias("comparison_complaints"),
        )
    )
    change = F.col("comparison_complaints") - F.col("baseline_complaints")
    return rounded(
        counts.select(
            "company",
            change.alias("absolute_change"),
            relative_change(F.col("baseline_complaints"), change).alias("percentage_change"),
        ),
        "percentage_change",
    )


@register(
    "srt_topk_total_order",
    sql.query(
        "SELECT company, product, n AS complaint_count FROM (SELECT company, product, "
        "CAST(sum(complaint_count) AS BIGINT) AS n FROM company_product_month_metrics GROUP BY ALL) "
        "ORDER BY n DESC, company, product LIMIT 50",
        "company_product_month_metrics",
    ),
)
def _(spark, sf):
    request = Request("aggregate", dimensions=("company", "product"), limit=50)
    return run(request, gold(spark, sf))


@register(
    "srt_cohort_rerank",
    sql.query(
        "SELECT * EXCLUDE (rate), round(rate, 6) AS timely_response_rate FROM cohort WHERE "
        "complaint_count > 0 ORDER BY rate NULLS LAST, company LIMIT 1",
        "company_month_metrics",
        cohort=_COHORT.replace("LIMIT 10", "LIMIT 40").replace(
            "GROUP BY company", "WHERE complaint_month >= DATE '1997-01-01' GROUP BY company"
        ),
    ),
)
def _(spark, sf):
    request = Request(
        "top_volume_timely_response",
        cohort_size=40,
        filters=Filters(start_date=date(1997, 1, 1)),
    )
    return rounded(run(request, gold(spark, sf)), "timely_response_rate")


@register(
    "srt_rate_nulls_last",
    sql.query(
        "SELECT company, product, timely_response_rate FROM (SELECT company, product, "
        f"{RATE} AS timely_response_rate, sum(timely_response_count) / "
        "nullif(sum(timely_response_known_count), 0) AS rate FROM company_product_month_metrics "
        "WHERE complaint_month < DATE '1995-03-01' GROUP BY ALL) ORDER BY rate DESC NULLS LAST, "
        "company, product LIMIT 400",
        "company_product_month_metrics",
    ),
)
def _(spark, sf):
    request = Request(
        "aggregate",
        metric="timely_response_rate",
        order_by="timely_response_rate",
        dimensions=("company", "product"),
        filters=Filters(end_date=date(1995, 3, 1)),
        limit=400,
    )
    return rounded(run(request, gold(spark, sf)), "timely_response_rate")


@register(
    "set_total_union_drivers",
    sql.query(
        "SELECT row_number() OVER (ORDER BY row_type = 'driver', abs(absolute_change) DESC, issue) "
        "AS place, row_type, issue, absolute_change FROM (" + _STACKED.format(12) + ")",
        "company_product_state_issue_month_metrics",
        **_period("true"),
    ),
)
def _(spark, sf):
    request = Request("period_comparison_with_issue_drivers", limit=12, **YEARS)
    # The total and at most twelve drivers: numbering them by the operation's own order is bounded.
    order = Window.orderBy(
        F.col("row_type") == "driver", F.abs("absolute_change").desc(), F.col("issue")
    )
    rows = run(request, gold(spark, sf)).withColumn("place", F.row_number().over(order).cast("long"))
    return rows.select("place", "row_type", "issue", "absolute_change")
