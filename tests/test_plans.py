"""The registered catalogue: contract, plan shape, and a set of queries against DuckDB."""

import os
import re

import pytest

import __spark_entry__ as entry
from formbook.plans import load
from tools.oracle_check import TABLES, compare

QUERIES, ORACLES = load()

# one or two per family here; tools/oracle_check.py runs them all
CHECKED = [
    "flagship_consensus_bet_ledger", "m6_bet_decision", "p10_attempt_funnel", "w1_prior_rolling", "w5_prior_ema_with_gaps", "w17_forward_min_clip",
    "j5_asof_join", "j6_closing_snapshot", "j14_interval_coverage", "u6_two_sided_pairs", "a10_dispersion", "a23_reliability_quantile_bins", "a35_cluster_bootstrap_roi",
    "m14_count_line_price", "s8_flatten_quote_envelopes", "b6_policy_grid", "t3_current_and_closing_line",
]


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def test_contract():
    assert set(ORACLES) <= set(QUERIES)
    assert entry.FLAGSHIP in QUERIES
    assert len(QUERIES) > 230 and len(ORACLES) > 220


def test_every_oracle_parses_and_binds(duck):
    for name, sql in ORACLES.items():
        duck.execute("EXPLAIN " + sql)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["dimension", "value"] and df.count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_against_duckdb(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert compare(df.columns, got, cols, cur.fetchall()) is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, data):
    text = plan(QUERIES["s17_audited_scan"](spark, data))
    assert "EqualTo(o_orderstatus,F)" in text
    assert re.search(r"ReadSchema: struct<[^>]*o_orderstatus", text) and "o_totalprice" not in text.split("ReadSchema")[1]


def test_one_sort_for_all_rolling_columns(spark, data):
    text = plan(QUERIES["w1_prior_rolling"](spark, data))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1


def test_first_row_per_key_is_cut_before_the_shuffle(spark, data):
    text = plan(QUERIES["w13_one_per_entity_night"](spark, data))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["u6_two_sided_pairs", "a12_leave_one_out", "j4_opponent_row", "j9_tolerant_date_join", "b5_threshold_sweep", "a23_reliability_quantile_bins", "b2_fraction_split_by_row"])
def test_no_cross_joins(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["w1_prior_rolling", "u6_two_sided_pairs", "j6_closing_snapshot", "p10_attempt_funnel", "b6_policy_grid"])
def test_native_operators_stay_in_the_jvm(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "Python" not in text and "ArrowEval" not in text


def test_source_has_no_machine_local_checkpoints():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "formbook")
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f), encoding="utf8").read()
                assert "localCheckpoint" not in text and "crossJoin" not in text
