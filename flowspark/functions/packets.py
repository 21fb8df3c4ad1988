"""Column expressions on packet and endpoint fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The bit of each TCP flag.
TCP_FLAGS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32}

# Service names by port.
SERVICES = {
    21: "FTP",
    22: "SSH",
    23: "Telnet",
    25: "SMTP",
    53: "DNS",
    80: "HTTP",
    110: "POP3",
    143: "IMAP",
    443: "HTTPS",
    445: "SMB",
    3389: "RDP",
    3306: "MySQL",
    5432: "PostgreSQL",
    8080: "HTTP-Alt",
    8443: "HTTPS-Alt",
}

# Entropy class floors, and node role ports.
ENTROPY_HIGH, ENTROPY_MEDIUM = 7.2, 5.0
ADMIN_PORTS = [22, 23, 80, 443, 8080]
SERVER_PORTS = [445, 139, 3389, 3306, 5432]


def tcp_flag(flags: Column, name: str) -> Column:
    """Whether a flag bit is set; absent flags count as none."""
    return F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(TCP_FLAGS[name])) != 0


def port_tier(port: Column) -> Column:
    return (
        F.when(port.between(0, 1023), "SYSTEM_WELL_KNOWN")
        .when(port.between(1024, 49151), "REGISTERED_SERVICE")
        .otherwise("DYNAMIC_EPHEMERAL")
    )


def _known_service(port: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in SERVICES.items() for v in pair])
    return F.element_at(table, port.cast("int"))


def service_name(src_port: Column, dst_port: Column) -> Column:
    return F.coalesce(_known_service(dst_port), _known_service(src_port), F.lit("UNKNOWN"))


def port_profile(src_port: Column, dst_port: Column) -> Column:
    """Struct of tiers, service, direction guess and the unexplained-ephemeral flag."""
    service = service_name(src_port, dst_port)
    both_ephemeral = (port_tier(src_port) == "DYNAMIC_EPHEMERAL") & (port_tier(dst_port) == "DYNAMIC_EPHEMERAL")
    return F.struct(
        port_tier(src_port).alias("src_tier"),
        port_tier(dst_port).alias("dst_tier"),
        service.alias("service"),
        (dst_port.isin(*SERVICES) | (dst_port < src_port)).alias("client_to_server"),
        (both_ephemeral & (service == "UNKNOWN")).alias("suspicious_ephemeral"),
    )


@F.pandas_udf(T.DoubleType())
def byte_entropy(payload: pd.Series) -> pd.Series:
    """Shannon entropy of the whole value in bits per byte; 0 when empty."""

    def one(value) -> float:
        if not value:
            return 0.0
        counts = np.bincount(np.frombuffer(value, dtype=np.uint8), minlength=1)
        share = counts[counts > 0] / len(value)
        return float(-(share * np.log2(share)).sum()) + 0.0

    return payload.map(one).astype("float64")


def entropy_class(entropy: Column) -> Column:
    return (
        F.when(entropy >= ENTROPY_HIGH, "HIGH_ENCRYPTED_OR_PACKED")
        .when(entropy >= ENTROPY_MEDIUM, "MEDIUM_STRUCTURED")
        .when(entropy > 0, "LOW_TEXT_OR_SPARSE")
        .otherwise("EMPTY")
    )


def is_internal(ip: Column) -> Column:
    return ip.startswith("10.") | ip.startswith("192.168.")


def node_role(ip: Column, port: Column) -> Column:
    """Struct(role, role_name); the first matching branch wins."""

    def role(number: int, name: Column | str) -> Column:
        return F.struct(F.lit(number).alias("role"), (F.lit(name) if isinstance(name, str) else name).alias("role_name"))

    sensitive = F.lower(ip).contains("calea") | ip.endswith(".250") | (port == 8443)
    admin = port.isin(*ADMIN_PORTS) & (ip.startswith("10.0.") | ip.endswith(".1"))
    text = port.cast("string")
    return (
        F.when(sensitive, role(3, "CALEA-Wiretap-Core"))
        .when(admin, role(2, "Router-Admin-Core"))
        .when(port.isin(*SERVER_PORTS), role(1, F.concat(F.lit("Server-"), text)))
        .when(port >= 1024, role(0, "Client"))
        .otherwise(role(1, F.concat(F.lit("Service-"), text)))
    )
