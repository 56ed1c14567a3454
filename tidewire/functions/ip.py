"""IP addresses as native Spark expressions.

Addresses stay text.  ``ip_hex`` gives a sortable 32 digit form in which IPv4
is ``::ffff:a.b.c.d``, so equal spellings compare equal and a network is a
range of that form.  No Python runs per row: everything here is a Column.

Membership tests against a *literal* CIDR list compile to octet comparisons on
the dotted text, which is much cheaper than building the hex form for each
row.  Joins against a *table* of networks use ``network_key``: an address is
looked up once per prefix length in use, so the join is an equi-join and never
a nested loop.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
V4_PATTERN = rf"^{_DOTTED}$"
_V4_UNICAST = rf"^(?!127\.|0\.0\.0\.0$|22[4-9]\.|23[0-9]\.){_DOTTED}$"
_G = "[0-9a-f]{1,4}"
_V6_SHAPE = rf"^(?:(?:{_G}:){{7}}{_G}|(?:{_G}(?::{_G})*)?::(?:{_G}(?::{_G})*)?)$"

V4_PREFIX = "0" * 20 + "ffff"


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def _any(conditions: Iterable[Column]) -> Column:
    conditions = list(conditions)
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _v4_digits(dotted: Column) -> Column:
    octets = F.split(dotted, r"\.")
    two = F.transform(octets, lambda o: F.lpad(F.hex(o.try_cast("long")), 2, "0"))
    return F.lower(F.array_join(two, ""))


def _v6_hex(text: Column) -> Column:
    """Kept small on purpose: this expression is part of every address test."""

    def undotted(low: Column) -> Column:
        """``::ffff:1.2.3.4`` to ``::ffff:0102:0304``."""
        tail = F.substring_index(low, ":", -1)
        return F.when(
            tail.rlike(V4_PATTERN),
            F.concat(
                low.substr(F.lit(1), F.length(low) - F.length(tail)),
                F.regexp_replace(_v4_digits(tail), "^(.{4})", "$1:"),
            ),
        )

    def digits(t: Column) -> Column:
        count = F.regexp_count(t, F.lit("[0-9a-f]+"))
        gap = F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.lit(8) - count))
        groups = F.split(F.replace(t, F.lit("::"), gap), ":")
        padded = F.transform(groups, lambda g: F.when(g != "", F.lpad(g, 4, "0")))
        # a double colon stands for at least one group
        usable = t.rlike(_V6_SHAPE) & ((count < 8) | ~t.contains("::"))
        return F.when(usable, F.array_join(padded, ""))

    low = F.lower(text)
    plain = F.when(text.contains("."), _bind(low, undotted)).otherwise(low)
    return _bind(plain, digits)


def ip_hex(c: Column | str) -> Column:
    """32 lower-case hex digits of an IPv4/IPv6 address, null when it is not one."""
    c = _as_col(c)
    return F.when(
        c.rlike(V4_PATTERN), F.concat(F.lit(V4_PREFIX), _v4_digits(c))
    ).when(c.contains(":"), _v6_hex(c))


def is_ip(c: Column | str) -> Column:
    c = _as_col(c)
    return F.coalesce(
        F.when(c.contains(":"), _v6_hex(c).isNotNull()).otherwise(c.rlike(V4_PATTERN)), F.lit(False)
    )


# --- literal network lists ---------------------------------------------------


def parse_cidr(text: str) -> ipaddress.IPv4Network | ipaddress.IPv6Network | None:
    """A network from configuration text; None when it is not one."""
    try:
        if "/" not in text:
            return None
        net = ipaddress.ip_network(text.strip(), strict=False)
    except ValueError:
        return None
    if net.version == 6 and net.prefixlen >= 96 and net.network_address.ipv4_mapped:
        return ipaddress.ip_network(
            f"{net.network_address.ipv4_mapped}/{net.prefixlen - 96}", strict=False
        )
    return net


def address_hex(text: str) -> str | None:
    """Driver-side twin of ``ip_hex`` for literals."""
    try:
        addr = ipaddress.ip_address(text)
    except ValueError:
        return None
    if "%" in text:
        return None
    return V4_PREFIX + f"{int(addr):08x}" if addr.version == 4 else f"{int(addr):032x}"


def _v4_member(c: Column, net: ipaddress.IPv4Network) -> Column:
    octets = str(net.network_address).split(".")
    whole, rest = divmod(net.prefixlen, 8)
    if whole == 4:
        return c == ".".join(octets)
    head = ".".join(octets[:whole]) + "." if whole else ""
    condition = c.startswith(head) if head else F.lit(True)
    if rest:
        low = int(octets[whole])
        high = low + (1 << (8 - rest)) - 1
        octet = F.get(F.split(c, r"\."), F.lit(whole)).try_cast("int")
        condition = condition & octet.between(low, high)
    return condition


def _v6_member(h: Column, net: ipaddress.IPv6Network) -> Column:
    low = f"{int(net.network_address):032x}"
    high = f"{int(net.broadcast_address):032x}"
    inside = h.between(low, high)
    # an IPv4 address is never inside an IPv6 network
    return inside & ~h.startswith(V4_PREFIX)


def _mapped_member(h: Column, net: ipaddress.IPv4Network) -> Column:
    return h.between(
        V4_PREFIX + f"{int(net.network_address):08x}", V4_PREFIX + f"{int(net.broadcast_address):08x}"
    )


def in_cidr(c: Column | str, cidrs: str | Sequence[str]) -> Column:
    """True when the address lies in any of the networks; invalid text is false."""
    texts = [cidrs] if isinstance(cidrs, str) else list(cidrs)
    nets = [n for n in map(parse_cidr, texts) if n is not None]
    return _member(_as_col(c), nets, unicast=False) if nets else F.lit(False)


def _member(c: Column, nets: list, unicast: bool) -> Column:
    v4 = [n for n in nets if n.version == 4]
    v6 = [n for n in nets if n.version == 6]
    dotted = _any([_v4_member(c, n) for n in v4]) & c.rlike(_V4_UNICAST if unicast else V4_PATTERN)

    def colon(h: Column) -> Column:
        inside = _any([_mapped_member(h, n) for n in v4] + [_v6_member(h, n) for n in v6])
        return inside & _v6_unicast(h) if unicast else inside

    return F.coalesce(
        F.when(c.contains(":"), _bind(_v6_hex(c), colon)).otherwise(dotted), F.lit(False)
    )


def _v6_unicast(h: Column) -> Column:
    mapped = h.startswith(V4_PREFIX)
    special4 = (
        h.startswith(V4_PREFIX + "7f")
        | h.startswith(V4_PREFIX + "e")
        | (h == V4_PREFIX + "0" * 8)
    )
    special6 = h.isin("0" * 32, "0" * 31 + "1") | h.startswith("ff")
    return h.isNotNull() & F.when(mapped, ~special4).otherwise(~special6)


def is_unicast(c: Column | str) -> Column:
    """A valid address that is not unspecified, loopback or multicast."""
    c = _as_col(c)
    return F.coalesce(
        F.when(c.contains(":"), _bind(_v6_hex(c), _v6_unicast)).otherwise(c.rlike(_V4_UNICAST)),
        F.lit(False),
    )


def _touches_special(net: ipaddress.IPv4Network | ipaddress.IPv6Network) -> bool:
    if net.version == 6:
        return True
    return any(
        net.overlaps(ipaddress.ip_network(s)) for s in ("127.0.0.0/8", "224.0.0.0/4", "0.0.0.0/32")
    )


def is_local(c: Column | str, cidrs: Sequence[str]) -> Column:
    """A unicast address in a local network."""
    c = _as_col(c)
    nets = [n for n in map(parse_cidr, cidrs) if n is not None]
    if not nets:
        return F.lit(False)
    special = any(_touches_special(n) for n in nets)
    return _member(c, nets, unicast=special)


# --- labels --------------------------------------------------------------------


def subnet24(c: Column | str) -> Column:
    """``a.b.c.0/24``; text with fewer than three dotted parts is Unknown."""
    c = F.coalesce(_as_col(c), F.lit(""))
    return F.when(F.size(F.split(c, r"\.")) < 3, F.lit("Unknown")).otherwise(
        F.concat(F.substring_index(c, ".", 3), F.lit(".0/24"))
    )


def subnet_vlan(c: Column | str, cidrs: Sequence[str]) -> Column:
    """First local network that holds the address, else its /24, else Unknown."""
    c = _as_col(c)
    known = [F.when(in_cidr(c, cidr), F.lit(cidr)) for cidr in cidrs]
    dotted = F.when(
        F.size(F.split(c, r"\.")) == 4, F.concat(F.substring_index(c, ".", 3), F.lit(".0/24"))
    )
    return F.coalesce(*known, dotted, F.lit("Unknown"))


# --- networks held in a table ----------------------------------------------------


def _masked(h: Column, bits: Column) -> Column:
    """The whole digits of the prefix, then the leading bits of the digit it cuts."""
    whole = (bits / 4).cast("int")
    cut = F.conv(F.concat(h, F.lit("0")).substr(whole + 1, F.lit(1)), 16, 10).try_cast("int")
    lead = F.call_function("shiftright", cut, F.lit(4) - bits % 4)
    return F.concat_ws(".", h.substr(F.lit(1), whole), lead.cast("string"))


def cidr_bits(cidr: Column) -> Column:
    """Prefix length over the 128 bit form, null when the text is not a network."""
    address = F.substring_index(cidr, "/", 1)
    length = F.when(
        cidr.rlike(r"^[^/]+/(?:0|[1-9][0-9]{0,2})$"), F.substring_index(cidr, "/", -1).try_cast("int")
    )
    return F.when(address.rlike(V4_PATTERN) & (length <= 32), length + 96).when(
        address.contains(":") & (length <= 128) & _v6_hex(address).isNotNull(), length
    )


def _family(h: Column) -> Column:
    return F.when(h.startswith(V4_PREFIX), F.lit("4")).otherwise(F.lit("6"))


def network_key(h: Column, bits: Column) -> Column:
    """Join key of a network, or of an address seen at a given prefix length."""
    return F.concat_ws("/", _family(h), bits.cast("string"), _masked(h, bits))


def cidr_key(cidr: Column) -> Column:
    """``network_key`` of CIDR text, null when it is not a network."""
    bits = cidr_bits(cidr)
    return F.when(
        bits.isNotNull(), network_key(ip_hex(F.substring_index(cidr, "/", 1)), bits)
    )
