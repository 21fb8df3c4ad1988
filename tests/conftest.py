import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from flowspark.session import build_session

    session = build_session("tests", 4, spark__sql__shuffle__partitions="4")
    yield session


PACKET_DEFAULTS = dict(
    src_ip="10.0.0.1", dst_ip="10.0.0.2", src_port=40000, dst_port=80, protocol="tcp", length=60, tcp_flags=None,
    tcp_window=None, ttl=64, payload=b"",
)


@pytest.fixture(scope="session")
def packets(spark):
    """Packet rows from (seconds, overrides) pairs, in arrival order."""
    from flowspark.schemas import PACKET

    def make(*rows):
        full = [dict(PACKET_DEFAULTS, seq=i, ts_us=round(t * 1e6), **over) for i, (t, over) in enumerate(rows)]
        return spark.createDataFrame([tuple(r[c] for c in PACKET.names) for r in full], PACKET)

    return make
