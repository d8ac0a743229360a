"""Every registered query against its SQL, and the shape of the physical plans."""

import re

import pytest

import __spark_entry__ as entry
from check import normal, oracle
from framewise.catalog import ALL

FOLDER = "/root/testdata/sf0.001"
QUERIES = {n: q for n, q in entry.queries().items() if n in ALL}
SQL = {n: q for n, q in entry.oracle_sql().items() if n in ALL}


@pytest.fixture(scope="module")
def duck():
    return oracle(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def plan_of(df):
    """Final physical plan; run the frame first."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def executed(df):
    df.collect()
    return plan_of(df)


STATISTICS = re.compile("rank_sum|holm|variance|pearson|linear|vif|tidy|predict|random")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan
    if name != "predict_grid":  # its one-row fit joins on a constant
        assert "NestedLoop" not in plan
    if not STATISTICS.search(name):  # Python workers only close statistics
        assert "Python" not in plan and "InPandas" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = executed(QUERIES["item_reach"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    assert "l_extendedprice" not in plan


def test_top_lists_are_cut_before_the_shuffle(spark):
    plan = executed(QUERIES["item_distribution_panel"](spark, FOLDER))
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["running_total", "quantiles"])
def test_sliced_operators_scan_once(spark, name):
    plan = executed(QUERIES[name](spark, FOLDER))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("name", ["neighbours", "frame_durations"])
def test_order_without_hot_keys_is_one_window(spark, name):
    plan = executed(QUERIES[name](spark, FOLDER))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["site", "item"] and df.count() == 125
