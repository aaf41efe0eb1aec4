"""The driver contract, and a few registered queries against DuckDB at the smallest scale."""

import os
import re

import pytest

import __spark_entry__ as contract
from checks.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
SAMPLE = (
    "win_first_per_complaint",
    "analysis_quarter_comparison_with_issue_drivers",
    "ret_keyed_topk",
    "inc_merge",
)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    # Trained and searched results of the training-data operators have tests of their own.
    own = {n for n in contract.queries() if re.match(r"op[0-9]+_|pipeline$", n)}
    assert set(contract.queries()) - set(contract.oracle_sql()) - own == {"src_file_digests"}


@needs_data
def test_flagship(spark):
    result = contract.entry(spark)
    assert result.columns == [
        "company",
        "complaint_count",
        "timely_response_count",
        "timely_response_known_count",
        "timely_response_rate",
    ]
    assert result.count() == 1


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_sample_against_duckdb(spark, name):
    good, detail = compare(
        spark, oracle_connection(SF), SF, contract.queries()[name], contract.oracle_sql()[name]
    )
    assert good, detail
