"""Address and protocol expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import ICMP_NAMES

_OCTET = r"(0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ipv4_number(c) -> Column:
    """IPv4 text to a BIGINT; anything else is NULL."""
    c = _c(c)
    parts = F.split(c, r"\.")

    def octet(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("bigint")

    number = octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3)
    return F.when(c.rlike(_IPV4), number)


def in_network(c, cidr: str) -> Column:
    """True when the address lies in ``cidr``; a bad address or network gives false."""
    c = _c(c)
    try:
        net = ipaddress.ip_network(cidr, strict=False)
    except ValueError:
        return F.lit(False)
    if net.version == 4:
        lo, hi = int(net.network_address), int(net.broadcast_address)
        return F.coalesce(ipv4_number(c).between(lo, hi), F.lit(False))
    return F.coalesce(_in_ipv6(cidr)(c), F.lit(False))


def _in_ipv6(cidr: str):
    """128-bit arithmetic has no built-in; only an IPv6 network needs this function."""

    @F.pandas_udf("boolean")
    def test(addresses: pd.Series) -> pd.Series:
        net = ipaddress.ip_network(cidr, strict=False)

        def inside(a):
            if not a or ":" not in a:
                return False
            try:
                return ipaddress.ip_address(a) in net
            except ValueError:
                return False

        return addresses.map(inside).astype(bool)

    return test


def proto_flags(c) -> dict[str, Column]:
    p = F.lower(F.trim(F.coalesce(_c(c), F.lit(""))))
    return {
        "proto_tcp": (p == "tcp").cast("double"),
        "proto_udp": (p == "udp").cast("double"),
        "proto_icmp": p.isin(*ICMP_NAMES).cast("double"),
    }
