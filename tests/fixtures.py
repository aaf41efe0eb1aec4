"""Small hand-made tables shared by the tests."""

from datetime import date

from docket_spark.constants import METRIC_TABLES, SOURCE_COLUMNS

RAW_SCHEMA = ", ".join(f"{name} string" for name in SOURCE_COLUMNS)


def raw_row(**values):
    return tuple(values.get(name) for name in SOURCE_COLUMNS)


SILVER_SOURCE = [
    raw_row(
        date_received="2025-01-02T09:00:00Z",
        product=" Payments ",
        sub_product="",
        issue="Late",
        sub_issue="Fees",
        consumer_complaint_narrative="first",
        company="BLOCK, INC.",
        state="CA",
        date_sent_to_company="2025-01-03",
        company_response_to_consumer="Closed",
        timely_response="Yes",
        complaint_id="100",
    ),
    raw_row(
        date_received="2025-02-03",
        product="Transfer",
        issue="Fraud",
        consumer_complaint_narrative="second",
        company="Early Warning Services, LLC",
        state="TX",
        timely_response="No",
        complaint_id="101",
    ),
    raw_row(
        date_received="2025-12-31",
        product="loses",
        consumer_complaint_narrative="duplicate",
        company="Cash App",
        timely_response="No",
        complaint_id=" 100 ",
    ),
]
INVALID_ROW = raw_row(date_received="not-date", complaint_id="102")


def month_rows(table, *entries):
    """Metric rows from (dimension values..., month, count, timely, known)."""
    width = len(METRIC_TABLES[table])
    result = []
    for entry in entries:
        dims, (count, timely, known) = entry[:width], entry[width:]
        result.append((*dims, count, timely, known, timely / known if known else None))
    return result


def metric_frame(spark, table, entries):
    fields = [
        f"{name} {'date' if name == 'complaint_month' else 'string'}"
        for name in METRIC_TABLES[table]
    ]
    schema = ", ".join(
        [
            *fields,
            "complaint_count bigint",
            "timely_response_count bigint",
            "timely_response_known_count bigint",
            "timely_response_rate double",
        ]
    )
    return spark.createDataFrame(month_rows(table, *entries), schema)


def d(year, month, day=1):
    return date(year, month, day)


def gold_tables(spark, extra_companies=()):
    acme = [10, 5, 5, 30, 20, 10]
    company = [("Acme", d(2025, 4 + i), n, int(n * 0.8), n) for i, n in enumerate(acme)]
    company[0] = ("Acme", d(2025, 4), 10, 9, 10)
    company[1] = ("Acme", d(2025, 5), 5, 5, 5)
    company[2] = ("Acme", d(2025, 6), 5, 5, 5)
    company[3] = ("Acme", d(2025, 7), 30, 24, 30)
    company[4] = ("Acme", d(2025, 8), 20, 18, 20)
    company[5] = ("Acme", d(2025, 9), 10, 8, 10)
    company += [
        ("Bravo", d(2025, 4), 3, 1, 2),
        ("Bravo", d(2025, 7), 100, 90, 100),
        ("Comparison only", d(2025, 7), 50, 50, 50),
        ("Baseline only", d(2025, 4), 60, 30, 60),
        *extra_companies,
    ]
    checking = "Checking or savings account"
    data = {
        "company_month_metrics": company,
        "company_product_month_metrics": [
            ("Acme", checking, d(2025, 1), 8, 4, 8),
            ("Acme", checking, d(2025, 2), 12, 6, 12),
            ("Acme", "Mortgage", d(2025, 1), 4, 4, 4),
        ],
        "product_month_metrics": [
            (checking, d(2025, 1), 8, 4, 8),
            (checking, d(2025, 2), 12, 6, 12),
            ("Mortgage", d(2025, 1), 4, 4, 4),
        ],
        "company_issue_month_metrics": [
            ("Acme", "Account management", d(2025, 1), 10, 0, 0),
        ],
        "product_issue_sub_issue_month_metrics": [
            ("Mortgage", "Escrow", "Fees", d(2025, 1), 4, 4, 4),
        ],
        "company_product_state_issue_month_metrics": [
            ("Block", "Mortgage", "CA", "Escrow", d(2025, 7), 7, 7, 7),
            ("Block", "Mortgage", "CA", "Payment", d(2025, 7), 3, 3, 3),
            ("Acme", checking, "CA", "Access", d(2024, 1), 10, 5, 10),
            ("Acme", checking, "CA", "Access", d(2025, 1), 16, 5, 16),
            ("Acme", checking, "CA", "Fees", d(2024, 1), 4, 4, 4),
            ("Acme", checking, "CA", "Fees", d(2025, 1), 2, 2, 2),
            ("Bravo", checking, "TX", "Access", d(2025, 4), 3, 1, 2),
            ("Bravo", checking, "TX", "Access", d(2025, 7), 60, 50, 60),
            ("Bravo", checking, "TX", None, d(2025, 7), 30, 30, 30),
            ("Bravo", "Mortgage", "TX", "Unknown", d(2025, 8), 10, 10, 10),
        ],
        "company_response_month_metrics": [
            ("Block", "Closed with monetary relief", d(2025, 1), 7, 7, 7),
            ("Block", "Closed with monetary relief", d(2025, 2), 3, 3, 3),
            ("Block", "Closed with explanation", d(2025, 1), 13, 13, 13),
        ],
    }
    return {name: metric_frame(spark, name, entries) for name, entries in data.items()}
