"""Registered queries against their SQL on the smallest tables.

A selection runs by default; ``ALL_QUERIES=1`` runs every one.
"""

import os

import pytest

from oracle import compare, connect

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "noise_filter", "flow_statistics", "flow_handshake", "macro_vectors", "rule_engine", "block_register", "response_plan", "extended_metrics", "rank_metrics",
    "conformal_verdicts", "stage_report", "label_conflicts", "leak_check", "conversion_report", "node_vectors", "last_neighbors", "snapshot_sizes",
    "evidence_packets", "merkle_proofs", "ledger_branches", "reanchored_states", "forecast_report", "flow_csv_scan", "holdout_modes",
    "shapley_attributions",
]


def _names():
    from flowspark.plans import catalog

    return list(catalog.QUERIES) if os.environ.get("ALL_QUERIES") else CHOSEN


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", _names())
def test_query(spark, duck, name):
    from flowspark.plans import catalog

    assert compare(spark, duck, name, catalog.QUERIES[name], catalog.ORACLE.get(name), SF) is None


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
