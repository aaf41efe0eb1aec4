"""Headline timings: build the tables once, then run every analytical request on them.

Prints one JSON line. BENCH_SF_DIR names the input tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import date

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docket_spark.functions.embedding import hashed_terms
from docket_spark.operators.blocks import nearest_batch
from docket_spark.plans import analysis, bronze, gold, retrieval, silver
from docket_spark.plans.analysis import Filters, Request
from docket_spark.plans.publish import current_folder
from docket_spark.session import build_session
from docket_spark.sources import testdata
from docket_spark.sources.complaints import ROW_ORDER

QUARTERS = {"baseline_start": date(1997, 4, 1), "comparison_start": date(1997, 7, 1)}
YEARS = {"baseline_start": date(1997, 1, 1), "comparison_start": date(1998, 1, 1)}
REQUESTS = {
    "aggregate": Request("aggregate", dimensions=("company",)),
    "aggregate_rate": Request(
        "aggregate",
        metric="timely_response_rate",
        dimensions=("company", "product"),
        order_by="timely_response_rate",
    ),
    "trend": Request("trend", dimensions=("product", "complaint_month"), limit=100),
    "quarter_comparison": Request("quarter_comparison", **QUARTERS),
    "response_distribution": Request(
        "response_distribution", filters=Filters(company="Supplier#000000049")
    ),
    "top_volume_timely_response": Request("top_volume_timely_response"),
    "common_issues": Request("common_issues", filters=Filters(product="ECONOMY")),
    "common_sub_issues": Request("common_sub_issues", filters=Filters(product="ECONOMY")),
    "period_comparison_with_issue_drivers": Request(
        "period_comparison_with_issue_drivers", filters=Filters(product="ECONOMY"), **YEARS
    ),
    "quarter_comparison_with_issue_drivers": Request(
        "quarter_comparison_with_issue_drivers", **QUARTERS
    ),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    started = time.perf_counter()
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="docket-bench-")
    timings: dict[str, float] = {}

    def timed(name, action):
        begin = time.perf_counter()
        result = action()
        timings[name] = round(time.perf_counter() - begin, 3)
        return result

    # Not part of the timings: the raw snapshots the jobs start from.
    lines, texts = f"{root}/raw-lines", f"{root}/raw-texts"
    raw = testdata.raw_complaints(spark, sf_dir)
    raw.repartition(int(cpus)).write.parquet(lines)
    testdata.narrative_complaints(spark, sf_dir).drop(ROW_ORDER).repartition(int(cpus)).write.parquet(
        texts
    )
    setup = time.perf_counter() - started

    timed(
        "land_bronze",
        lambda: bronze.create_bronze(
            spark, lines, f"{root}/bronze", allow_population_violations=True
        ),
    )
    timed("rebuild_silver", lambda: silver.rebuild_silver(spark, f"{root}/bronze", f"{root}/silver"))
    timed("rebuild_gold", lambda: gold.rebuild_gold(spark, f"{root}/silver", f"{root}/gold"))
    tables = gold.read_metric_tables(spark, current_folder(spark, f"{root}/gold"))
    for name, request in REQUESTS.items():
        timed(name, lambda request=request: analysis.run(request, tables).collect())
    timed(
        "request_batch",
        lambda: analysis.run_batch(list(REQUESTS.items()), tables).collect(),
    )

    timed(
        "land_narratives",
        lambda: bronze.create_bronze(
            spark, texts, f"{root}/texts-bronze", allow_population_violations=True
        ),
    )
    timed(
        "silver_narratives",
        lambda: silver.rebuild_silver(spark, f"{root}/texts-bronze", f"{root}/texts-silver"),
    )
    timed(
        "build_index",
        lambda: retrieval.build_index(
            spark, f"{root}/texts-silver", f"{root}/index", hashed_terms(64)
        ),
    )
    index = retrieval.read_index(spark, current_folder(spark, f"{root}/index"))
    vector = hashed_terms(64)(["late fee dispute"])[0].tolist()
    timed(
        "retrieve_diverse",
        lambda: retrieval.retrieve_diverse(
            index, vector, retrieval.NarrativeFilters(product="BUILDING")
        ).collect(),
    )
    # Every hundredth narrative is a request, so their number grows with the tables.
    asked = index.where("CAST(complaint_id AS BIGINT) % 100 = 0").select(
        index.complaint_id.alias("question_id"), index.embedding.alias("query_vector"), "product"
    )
    timed(
        "retrieve_batch",
        lambda: nearest_batch(index, asked, 24, filters=("product",)).collect(),
    )
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "setup_seconds": round(setup, 1),
            }
        )
    )


if __name__ == "__main__":
    main()
