"""Addresses that a service must not be made to call, told from host and port alone (no name lookup)."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

# Networks and host endings that are private.
NETWORKS_V4 = ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "0.0.0.0/8", "192.0.0.0/24", "198.18.0.0/15")
NETWORKS_V6 = ("::1/128", "fc00::/7", "fe80::/10", "::/128", "::ffff:127.0.0.0/104")
SUFFIXES = (".localhost", ".local", ".internal", ".localdomain", ".home.arpa", ".intranet", ".corp", ".lan")


def ipv4_number(host: Column) -> Column:
    """The address as a number; null for anything else."""
    parts = F.split(host, r"\.")
    ok = host.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & F.forall(parts, lambda p: p.try_cast("int") <= 255)
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.try_cast("long")))


def _words(part: Column) -> Column:
    """The 16-bit words of one side of a double colon: hex words, of which the last may be an IPv4 address. A word that is none is null."""
    pieces = F.filter(F.split(part, ":"), lambda x: F.length(part) > 0)

    def word(x: Column) -> Column:
        v4 = ipv4_number(x)
        hex_ = F.when(x.rlike("^[0-9a-f]{1,4}$"), F.conv(x, 16, 10).cast("long"))
        return F.when(F.contains(x, F.lit(".")), F.array(F.shiftright(v4, 16), v4.bitwiseAND(F.lit(65535)))).otherwise(F.array(hex_))

    return F.flatten(F.transform(pieces, word))


def ipv6_halves(host: Column) -> Column:
    """Struct (high, low) of the address as two 64-bit halves; null for anything else.

    Takes full, compressed and mixed forms, in brackets or not, with or without a zone;
    a double colon stands for one zero word or more, and there is one at most.
    """
    h = F.regexp_replace(F.lower(F.trim(host)), r"^\[|\]$", "")
    h = F.regexp_replace(h, r"%[^%]+$", "")
    sides = F.split(h, "::")
    left, right = _words(F.get(sides, F.lit(0))), _words(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    given = F.size(left) + F.size(right)
    short = F.size(sides) == 2
    zeros = F.when(short & (given <= 7), F.array_repeat(F.lit(0).cast("long"), 8 - given)).when(~short & (given == 8), F.array().cast("array<bigint>"))
    words = F.concat(left, zeros, right)
    # an IPv4 part ends the address, and there are two sides at most
    ok = F.contains(h, F.lit(":")) & (F.size(sides) <= 2) & ~h.rlike(r"\.[^:]*:") & F.forall(words, lambda x: x.isNotNull())
    half = lambda at: F.aggregate(F.slice(words, at, 4), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 16).bitwiseOR(x))
    return F.when(ok & (F.size(words) == 8), F.struct(half(1).alias("high"), half(5).alias("low")))


def _network(text: str) -> ipaddress.IPv4Network | ipaddress.IPv6Network:
    return ipaddress.ip_network(text)


def in_networks_v4(number: Column, networks: tuple[str, ...]) -> Column:
    """Whether an address as a number lies in one of the networks."""
    found = F.lit(False)
    for n in map(_network, networks):
        found = found | number.between(int(n[0]), int(n[-1]))
    return F.coalesce(found, F.lit(False))


def in_networks_v6(halves: Column, networks: tuple[str, ...]) -> Column:
    """Whether an address as two halves has one of the networks' prefixes: its bits are compared under the mask, the high half's first."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = F.lit(False)
    for n in map(_network, networks):
        bits, mask = int(n.network_address), int(n.netmask)
        parts = [(halves[name], (mask >> by) & (1 << 64) - 1, (bits >> by) & (1 << 64) - 1) for name, by in (("high", 64), ("low", 0))]
        same = [half.bitwiseAND(F.lit(signed(m))) == F.lit(signed(b)) for half, m, b in parts if m]
        found = found | (same[0] if len(same) == 1 else same[0] & same[1])
    return F.coalesce(found, F.lit(False))


def is_private(host: Column, v4: tuple[str, ...] = NETWORKS_V4, v6: tuple[str, ...] = NETWORKS_V6) -> Column:
    """An address in one of the private networks, in any of its spellings, or an internal name. A null host is none."""
    h = F.regexp_replace(F.lower(F.trim(host)), r"^\[|\]$|\.+$", "")
    named = h == "localhost"
    for s in SUFFIXES:
        named = named | h.endswith(s)
    # the address is told once, where it has a colon
    halves = F.when(F.contains(h, F.lit(":")), ipv6_halves(h))
    v6_private = F.get(F.transform(F.array(halves), lambda a: in_networks_v6(a, v6)), F.lit(0))
    return in_networks_v4(ipv4_number(h), v4) | F.coalesce(named | v6_private, F.lit(False))


def server_address_problem(host: Column, port: Column) -> Column:
    """private, port, or null when the address may be registered."""
    return F.when(is_private(host), "private").when(~port.between(1, 65535), "port")


def callback_problem(url: Column) -> Column:
    """scheme, host, private, or null when the url may be called."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.regexp_extract(url, r"^[^:]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1)
    return F.when(url.isNull() | ~scheme.isin("http", "https"), "scheme").when(host == "", "host").when(is_private(host), "private")
