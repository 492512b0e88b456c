"""Every query against its SQL oracle, on the driver's tables and on fixtures."""

import pytest

import __spark_entry__ as contract
from tallyshop import catalogue, oracle, read_tables
from tests.compare import assert_same, model_db

QUERIES = catalogue.queries()
SQL = oracle.oracle_sql()

# Checks of the driver's star itself, and checks whose result a fixture gives
# in full columns.
_STAR_ONLY = {name for name in QUERIES if name.startswith("table_")}
_ON_MODEL = sorted(set(QUERIES) - _STAR_ONLY)
_REPORTS = {**catalogue.REPORTS, **catalogue.VARIANTS, **catalogue.OPERATORS}


def _body(name: str) -> str:
    body = {**oracle.REPORT_SQL, **oracle.VARIANT_SQL, **oracle.OPERATOR_SQL}[name]
    return f"WITH {oracle.JOINED} {body}"


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())
    assert len(catalogue.REPORTS) == 65


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_star(spark, star_dir, star_db, name):
    assert_same(QUERIES[name](spark, star_dir), star_db, SQL[name])


@pytest.mark.parametrize("name", _ON_MODEL)
def test_golden(spark, golden_dir, name):
    assert_same(_REPORTS[name](read_tables(spark, golden_dir)), model_db(golden_dir), _body(name))


@pytest.mark.parametrize("name", _ON_MODEL)
def test_empty_tables(spark, empty_dir, name):
    assert_same(_REPORTS[name](read_tables(spark, empty_dir)), model_db(empty_dir), _body(name))


@pytest.mark.parametrize("name", _ON_MODEL)
def test_hot_keys_nulls_and_orphans(spark, skewed_dir, name):
    assert_same(_REPORTS[name](read_tables(spark, skewed_dir)), model_db(skewed_dir), _body(name))


def test_entry(spark, star_dir):
    assert contract.entry(spark).columns == ["order_month", "num_orders", "net_revenue"]
