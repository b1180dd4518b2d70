"""Addresses that the JVM has no functions for."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Blocks of the newer address family in the order in which they are tried.
IPV6_BLOCKS = (
    ("::1/128", "IPv6 loopback address", "Loopback"),
    ("fe80::/10", "IPv6 link-local address space", "Link-local"),
    ("fc00::/7", "IPv6 Unique Local Address (ULA) space", "Private"),
    ("::/128", "IPv6 unspecified address", "Special"),
    ("ff00::/8", "IPv6 multicast address space", "Multicast"),
    ("2001:db8::/32", "IPv6 documentation address space", "Documentation"),
)
_BLOCKS = tuple((ipaddress.IPv6Network(n), reason, kind) for n, reason, kind in IPV6_BLOCKS)


def rate_ipv6(text: str | None) -> tuple[bool, str, str]:
    """routable, reason, kind of an address or of the first one of a block; mapped addresses are told by their kind alone."""
    try:
        ip = ipaddress.ip_network((text or "").strip(), strict=False).network_address
    except ValueError:
        return False, "Invalid IPv6 address format", "Invalid"
    if ip.version == 4:
        return False, "Invalid IPv6 address format", "Invalid"
    for block, reason, kind in _BLOCKS:
        if ip in block:
            return False, reason, kind
    if ip.ipv4_mapped:
        inner = ip.ipv4_mapped
        fine = inner.is_global and not inner.is_multicast
        return fine, f"IPv4-mapped IPv6 with {'routable' if fine else 'non-routable'} IPv4 address", "IPv4-mapped"
    return True, "Globally routable IPv6 address", "Public"


@F.pandas_udf(T.StructType([T.StructField("routable", T.BooleanType()), T.StructField("reason", T.StringType()), T.StructField("kind", T.StringType())]))
def classify_ipv6(ips: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rate_ipv6(x) for x in ips], columns=["routable", "reason", "kind"])


@F.pandas_udf(T.StringType())
def compress_ipv6(ips: pd.Series) -> pd.Series:
    """The shortest form of an address; other strings stay as they are."""

    def one(x: str | None) -> str | None:
        try:
            return ipaddress.IPv6Address(x).compressed
        except ValueError:
            return x

    return ips.map(one)
