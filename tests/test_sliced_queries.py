"""Queries must match their SQL when every ordered operator is forced to split its keys."""

import sys

import pytest

from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["last_neighbors", "snapshot_nodes", "incidents", "inter_arrival", "flow_payload_entropy", "feature_audit", "evidence_digests"])
def test_sliced(spark, monkeypatch, name):
    from flowspark.operators import ordered as module
    from flowspark.plans import catalog

    real = module.ordered
    users = [m for n, m in sys.modules.items() if n.startswith("flowspark") and getattr(m, "ordered", None) is real]
    for user in users:
        monkeypatch.setattr(user, "ordered", lambda df, keys, order, limit=0, largest=None: real(df, keys, order, 150))
    assert compare(spark, connect(SF), name, catalog.QUERIES[name], catalog.ORACLE[name], SF) is None
