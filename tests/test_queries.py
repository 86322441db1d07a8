"""Registered queries against their SQL on the smallest tables.

Every one of them; PANELSPARK_QUICK=1 checks one per family.
"""
from __future__ import annotations

import os

import pytest

from oracle_check import compare, connect
from panelspark.plans import REGISTRY

SF = "/root/testdata/sf0.001"
# Where the smallest tables have no result to compare: nothing survives the mining of edges there.
LARGER = "/root/testdata/sf0.01"
ON_LARGER = {"c11_mine_edges", "c12_edge_listing", "c13_local_correlations", "n3_correlation_edges", "n7_arcs", "n9_propagate",
             "n10_collapse_variants", "n11_propagate_per_unit"}
QUICK = ["v1_current_vintage", "v2_best_source", "v5_source_disagreements", "p1_series", "t1_yoy", "t5_trends",
         "a10_headline", "a11_movers", "r1_revisions", "e4_event_study", "e4_point_event_study", "i1_validate",
         "i8_ingestion_summary", "s5_flatten_jsonstat", "d6_rollup", "c6_select_lag", "g2_beta_stats",
         "n4_degree_centrality", "f7_backtest"]
NAMES = QUICK if os.environ.get("PANELSPARK_QUICK") else [n for n, q in REGISTRY.items() if q.sql]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return {sf: connect(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    sf = LARGER if name in ON_LARGER else SF
    assert compare(spark, con[sf], REGISTRY[name], sf) is None


def test_names_follow_the_inventory():
    for name in REGISTRY:
        assert name[0] in "svpiarecgntfd" and name.split("_")[0][1:].isdigit(), name


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
