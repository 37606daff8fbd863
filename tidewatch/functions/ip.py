"""Addresses as numbers, bits and classes. Text that is no address gives null, or the class ``unknown``."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_MAPPED = r"^(?i)::ffff:(?=[0-9.]+$)"

#: Networks that are not routed publicly: fixed values of the special-purpose registry.
PRIVATE = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
SHARED = "100.64.0.0/10"
#: The same for IPv6: local, documentation, discard-only, translation of private networks, and the special block of 2001.
PRIVATE_6 = ("::/128", "fc00::/7", "2001:db8::/32", "100::/64", "64:ff9b:1::/48", "2001::/23", "2002::/16", "3fff::/20")
_GROUP = "[0-9a-f]{1,4}"


def unmapped(ip: Column) -> Column:
    """An IPv4 address written as an IPv6 one, in its own form; other text as it is."""
    return F.regexp_replace(ip, _MAPPED, "")


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x written once, however often f names it: expressions of expressions stay small."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def number(ip: Column) -> Column:
    """The address as a number, or null."""
    part = lambda p, i: F.get(p, F.lit(i)).cast("long")
    value = lambda p: part(p, 0) * 16777216 + part(p, 1) * 65536 + part(p, 2) * 256 + part(p, 3)
    return _once(unmapped(ip), lambda a: F.when(a.rlike(IPV4), _once(F.split(a, r"\."), value)))


def text(n: Column) -> Column:
    """The address of a number."""
    return F.concat_ws(".", *((F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)))


def bounds(cidr: str) -> tuple[int, int]:
    """First and last number of a network given on the driver; a bare address is a network of one."""
    base, _, length = cidr.partition("/")
    size = 1 << (32 - int(length or 32))
    n = 0
    for part in base.split("."):
        n = n * 256 + int(part)
    return n // size * size, n // size * size + size - 1


def within(n: Column, *cidrs: str) -> Column:
    """Whether a number lies in one of the networks; false for null."""

    def test(x: Column) -> Column:
        hit = F.lit(False)
        for cidr in cidrs:
            hit = hit | x.between(*bounds(cidr))
        return F.coalesce(hit, F.lit(False))

    return _once(n, test)


def _groups(text: Column) -> Column:
    """The groups of one side of an IPv6 address as digits, four each."""
    return F.when(text == "", "").otherwise(F.array_join(F.transform(F.split(text, ":"), lambda g: F.lpad(g, 4, "0")), ""))


def digits_6(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, without its zone, or null. An IPv4 address inside one has its digits."""
    plain = F.lower(F.regexp_replace(ip, "%.*$", ""))
    inner = F.regexp_extract(plain, r":([0-9.]+)$", 1)
    pair = lambda n: F.concat_ws(":", F.lower(F.hex(F.shiftright(n, 16))), F.lower(F.hex(n % 65536)))
    whole = _once(F.struct(plain.alias("t"), inner.alias("v")), lambda x: F.when(x["v"].rlike(IPV4), F.concat(F.substr(x["t"], F.lit(1), F.length(x["t"]) - F.length(x["v"])), pair(number(x["v"])))).otherwise(x["t"]))

    def of(t: Column) -> Column:
        full = t.rlike(rf"^{_GROUP}(?::{_GROUP}){{7}}$")
        short = t.rlike(rf"^(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?$")
        sides = F.split(t, "::")
        left, right = _groups(F.get(sides, F.lit(0))), _groups(F.get(sides, F.lit(1)))
        fill = F.lit(32) - F.length(left) - F.length(right)
        return F.when(full, _groups(t)).when(short & (fill >= 4), F.concat(left, F.repeat(F.lit("0"), fill), right))

    return _once(whole, of)


def bits(ip: Column) -> Column:
    """4 or 6 and the bits of an address, as text: addresses of one network begin alike. Null for what is no address."""
    six = lambda h: F.concat(F.lit("6"), F.array_join(F.transform(F.split(h, ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), ""))
    four = lambda n: F.concat(F.lit("4"), F.lpad(F.bin(n), 32, "0"))
    return _once(unmapped(ip), lambda a: F.coalesce(_once(number(a), four), _once(digits_6(a), lambda h: F.when(h.isNotNull(), six(h)))))


def network_bits(cidr: Column) -> Column:
    """The bits that the addresses of a network begin with; a bare address is a network of one."""
    base, length = F.split(cidr, "/")[0], F.get(F.split(cidr, "/"), F.lit(1)).try_cast("int")
    return _once(bits(base), lambda b: F.substr(b, F.lit(1), 1 + F.coalesce(length, F.length(b) - 1)))


def _bits_of(cidr: str) -> str:
    net = ipaddress.ip_network(cidr)
    return str(net.version) + f"{int(net.network_address):0{net.max_prefixlen}b}"[: net.prefixlen]


def _class_6(ip: Column) -> Column:
    def of(b: Column) -> Column:
        private = F.lit(False)
        for cidr in PRIVATE_6:
            private = private | b.startswith(_bits_of(cidr))
        kind = F.when(b == _bits_of("::1/128"), "loopback").when(b.startswith(_bits_of("fe80::/10")), "link_local").when(b.startswith(_bits_of("ff00::/8")), "multicast").when(private, "private")
        return F.when(b.isNull(), "unknown").otherwise(F.coalesce(kind, F.lit("public")))

    return _once(bits(ip), of)


def classify(ip: Column) -> Column:
    """loopback, link_local, multicast, private, public or unknown, tested in this order."""
    four = lambda n: (
        F.when(within(n, "127.0.0.0/8"), "loopback")
        .when(within(n, "169.254.0.0/16"), "link_local")
        .when(within(n, "224.0.0.0/4"), "multicast")
        .when(within(n, *PRIVATE), "private")
        .otherwise("public")
    )
    return F.coalesce(_once(number(ip), lambda n: F.when(n.isNotNull(), four(n))), F.when(F.contains(ip, F.lit(":")), _class_6(ip)), F.lit("unknown"))


def is_global(ip: Column) -> Column:
    """Public, and not of the range that carriers share among customers."""
    return (classify(ip) == "public") & ~within(number(ip), SHARED)


def is_multicast_or_broadcast(ip: Column) -> Column:
    return F.coalesce(ip.endswith(".255") | within(number(ip), "224.0.0.0/4"), F.lit(False))


def network_key(n: Column, length: Column) -> Column:
    """What addresses of one network of this length share."""
    return F.call_function("shiftright", n, (32 - length).cast("int"))


def from_arpa(name: Column) -> Column:
    """The address that a reverse-lookup name stands for, or null."""
    m = F.regexp_extract(F.lower(name), r"^((?:[0-9]{1,3}\.){4})in-addr\.arpa\.?$", 1)
    turned = F.concat_ws(".", F.reverse(F.slice(F.split(m, r"\."), 1, 4)))
    return F.when(turned.rlike(IPV4), turned)


def direction(src: Column, dst: Column, local: list[str]) -> Column:
    """outbound, inbound, local or transit, seen from a list of own addresses."""
    s, d = src.isin(local), dst.isin(local)
    return F.when(s & d, "local").when(s, "outbound").when(d, "inbound").otherwise("transit")


def remote(src: Column, dst: Column, local: list[str]) -> Column:
    """The address at the other end, or null where there is none."""
    way = direction(src, dst, local)
    return F.when(way == "outbound", dst).when(way == "inbound", src)
