"""IP address rules (P6, P7, P8) as native column expressions."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ip_scope(ip="src_ip") -> Column:
    """P6: 'private' / 'public' / 'unknown' by the pipeline's octet rule.

    Four dot-separated parts and the first two parse as integers, else
    'unknown'. 10/8, 172.16-31, 192.168, 127/8 are private; everything else
    (parts 3-4 and ranges unchecked) is public.
    """
    parts = F.split(_c(ip), r"\.", -1)
    first = F.try_element_at(parts, F.lit(1)).try_cast("int")
    second = F.try_element_at(parts, F.lit(2)).try_cast("int")
    return (
        F.when(_c(ip).isNull() | (F.size(parts) != 4), "unknown")
        .when(first.isNull() | second.isNull(), "unknown")
        .when(first == 10, "private")
        .when((first == 172) & second.between(16, 31), "private")
        .when((first == 192) & (second == 168), "private")
        .when(first == 127, "private")
        .otherwise("public")
    )


# Strict dotted-quad: four decimal octets 0-255 without leading zeros.
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
IPV4_STRICT = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4_to_long(ip="src_ip") -> Column:
    """Dotted quad to BIGINT (NULL when not a strict IPv4 address)."""
    parts = F.split(_c(ip), r"\.", -1)
    o = [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]
    val = o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3]
    return F.when(_c(ip).rlike(IPV4_STRICT), val)


def _in_net(v: Column, net: str) -> Column:
    n = ipaddress.ip_network(net)
    base = int(n.network_address)
    return (v >= F.lit(base)) & (v < F.lit(base + n.num_addresses))


# IPv4 networks the standard library (Python 3.13 `ipaddress`)
# treats as private, and the two exceptions inside 192.0.0.0/24.
IPV4_PRIVATE_NETS = ("0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.0.170/31 192.0.2.0/24 "
                     "192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 255.255.255.255/32").split()
IPV4_PRIVATE_EXCEPTIONS = "192.0.0.9/32 192.0.0.10/32".split()


def _ipv6_private(ip: Column) -> Column:
    """IPv6 subset: loopback, unspecified, fc00::/7, fe80::/10, 2001:db8::/32."""
    s = F.lower(ip)
    head = F.split(s, ":", -1).getItem(0)
    return (
        s.isin("::1", "::", "0:0:0:0:0:0:0:1", "0:0:0:0:0:0:0:0")
        | s.rlike(r"^f[cd][0-9a-f]{0,2}:")
        | s.rlike(r"^fe[89ab][0-9a-f]:")
        | s.startswith("2001:db8:") | (s == "2001:db8::")
    ) & s.rlike(r"^[0-9a-f:]+$") & (F.length(head) <= 4)


def is_private_ip(ip="ip_address") -> Column:
    """Standards-based private test; invalid text counts as not private."""
    v = ipv4_to_long(ip)
    inside = reduce(lambda x, y: x | y, [_in_net(v, n) for n in IPV4_PRIVATE_NETS])
    for net in IPV4_PRIVATE_EXCEPTIONS:
        inside = inside & ~_in_net(v, net)
    v6 = _c(ip).contains(":") & _ipv6_private(_c(ip))
    return F.coalesce(F.when(v.isNotNull(), inside).otherwise(v6), F.lit(False))


def asn_number(as_text="as_text") -> Column:
    """P8: 'AS123 Org Name' -> 'AS123' (first word), default 'unknown'."""
    parts = F.split(_c(as_text), " ", 2)
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("unknown"))


def asn_org(as_text="as_text") -> Column:
    """P8: 'AS123 Org Name' -> 'Org Name' (rest after the first space)."""
    parts = F.split(_c(as_text), " ", 2)
    return F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("unknown"))
