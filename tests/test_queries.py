"""Registered queries next to their SQL on the smallest driver tables.

``SURVEYSPARK_ALL=1`` runs all of them; by default one of each kind.
"""

import os

import pytest

import __spark_entry__ as contract
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SOME = ("merge_m1_orders_customer", "merge_11_master_wins", "duplicate_keys_lineitem", "historical_weight_float",
        "first_nonblank_job", "rates_by_age_sector_gender", "shares_status_with_totals", "weighted_mean_margins",
        "crosstab_row", "weighted_percentiles_by_group", "oaxaca_pooled", "catalogue_one_pass", "extract_log_rows",
        "quantile_by_dummy", "visits_stacked", "log_commands_read", "ols_many_regressors")
# Queries that SQL cannot express; each has a brute-force test of its own.
WITHOUT_SQL = {"quantile_regression", "wage_quantile_models"}
TEXT = {n for n in contract.queries() if n == "pipeline" or n.startswith("op") and n[2].isdigit()}
NAMES = sorted(set(contract.queries()) - TEXT) if os.environ.get("SURVEYSPARK_ALL") else SOME


@pytest.fixture(scope="module")
def connection():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    verdict, *_ = compare(spark, connection, name, SF)
    assert verdict == "ok" or name in WITHOUT_SQL and verdict.startswith("rows only")


def test_every_other_query_has_sql():
    assert set(contract.queries()) - set(contract.oracle_sql()) - TEXT == WITHOUT_SQL


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 27
