"""A cross-section of the registered queries against their SQL on the smallest tables."""

import pytest
from check_oracle import compare, duck

import __spark_entry__ as E
from hearthline.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = ["join_prev_year", "property_key", "ppd_reject", "join_mutation", "src_jsonstat_nd", "agg_flavour", "win_distinct_on", "link_fuzzy", "index_restate", "val_avm",
         "fc_fit", "point_in_polygon", "map_gate", "cov_register", "dq_min_sample"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    message, ok, _ = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert ok, message


def test_every_query_has_a_statement():
    assert set(registry.queries()) == set(registry.statements()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    assert "growth_1y_pct" in E.entry(spark).columns
