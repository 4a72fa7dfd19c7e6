import pytest

import __spark_entry__ as contract
from check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
# Each of these plays a whole run; the table of rounds and the stream stand for the rest.
LOOP_REPORTS = {"decision_log", "curated_rows", "regime_curve", "regime_summary", "result_document"}


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in contract.queries() if n not in LOOP_REPORTS])
def test_query_equals_its_sql(spark, connection, name):
    verdict, rows, _, _ = compare(spark, connection, name, SF_DIR)
    assert verdict in ("equal", "rows only") and rows > 0


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
