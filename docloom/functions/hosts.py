"""Hosts of URLs in the one form that the public URL standard gives them, as column expressions.

Numbers in three bases, short and whole addresses of version 4, compressed addresses of version 6 and names beyond ASCII
come out as one spelling each; what is no host is null. Names are mapped by IDNA 2003, which writes a sharp s as ss.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is named, so that it stands in the plan once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hex(text: Column) -> Column:
    """Up to eight hexadecimal digits as a number."""
    return F.conv(text, 16, 10).cast("long")


def _number(part: Column) -> Column:
    """A part of a version 4 address: 0x is hexadecimal, a leading 0 octal; null for others and beyond 32 bits."""
    digits = F.regexp_replace(F.regexp_replace(part, "^0x", ""), "^0+(?=.)", "")
    value = lambda digits: (
        F.when(part.rlike("^0x[0-9a-f]*$"), F.when(F.length(digits) <= 8, F.when(digits == "", F.lit(0)).otherwise(_hex(digits))))
        .when(part.rlike("^0[0-7]+$"), F.when(F.length(digits) <= 11, F.conv(digits, 8, 10).cast("long")))
        .when(part.rlike("^(0|[1-9][0-9]*)$"), F.when(F.length(digits) <= 10, digits.try_cast("long")))
    )
    return let(let(digits, value), lambda v: F.when(v < 1 << 32, v))


def _labels(host: Column) -> Column:
    return let(F.split(host, r"\."), lambda labels: F.when((F.size(labels) > 1) & (F.element_at(labels, -1) == ""), F.slice(labels, 1, F.size(labels) - 1)).otherwise(labels))


def ends_in_number(host: Column) -> Column:
    """Whether a host is to be read as a version 4 address, well-formed or not."""
    return F.element_at(_labels(host), -1).rlike("^([0-9]+|0x[0-9a-f]*)$")


def ipv4(host: Column) -> Column:
    """A version 4 address of one to four parts as a number; null if it is none."""
    return let(F.transform(_labels(host), _number), _combined)


def _combined(parts: Column) -> Column:
    n, last = F.size(parts), F.element_at(parts, -1)
    weights = F.array(*[F.lit(1 << s).cast("long") for s in (24, 16, 8, 0)])
    head = F.zip_with(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), F.slice(weights, 1, F.greatest(F.least(n, F.lit(4)) - 1, F.lit(0))), lambda a, b: F.when(a <= 255, a * b))
    room = F.element_at(F.array(*[F.lit(1 << s).cast("long") for s in (32, 24, 16, 8)]), F.least(n, F.lit(4)))
    total = F.aggregate(head, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.when((n <= 4) & (last < room), total + last)


def ipv4_text(value: Column) -> Column:
    return let(value, lambda v: F.concat(*[x for s in (24, 16, 8, 0) for x in (F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string"), F.lit("." if s else ""))]))


_TAIL = r"^(.*:)([0-9]{1,3}(?:\.[0-9]{1,3}){3})$"


def _without_tail(text: Column) -> Column:
    """An address of version 6 whose dotted end is written as two groups; null if the end is no address."""
    four = F.transform(F.split(F.regexp_extract(text, _TAIL, 2), r"\."), lambda x: F.when(x.rlike("^(0|[1-9][0-9]{0,2})$"), x.try_cast("int")))
    pair = lambda f, i: F.lower(F.hex((F.get(f, F.lit(i)) * 256 + F.get(f, F.lit(i + 1))).cast("long")))
    made = lambda f: F.when(F.forall(f, lambda x: F.coalesce(x <= 255, F.lit(False))), F.concat(F.regexp_extract(text, _TAIL, 1), pair(f, 0), F.lit(":"), pair(f, 2)))
    return F.when(text.rlike(_TAIL), let(four, made)).otherwise(text)


def _filled(halves: Column) -> Column:
    """Eight groups of what stands before and after ::, if it does."""
    groups = lambda i: let(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":")))
    both = lambda left: let(groups(1), lambda right: F.when(F.size(left) + F.size(right) <= 7, F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)))
    return let(groups(0), lambda left: F.when(F.size(halves) == 1, left).when(F.size(halves) == 2, both(left)))


def ipv6(text: Column) -> Column:
    """The eight groups of a version 6 address (without brackets); null if it is none."""
    good = lambda full: F.when((F.size(full) == 8) & F.forall(full, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.transform(full, _hex))
    return let(text, lambda t: let(F.split(_without_tail(t), "::"), lambda halves: let(_filled(halves), good)))


def ipv6_text(groups: Column) -> Column:
    """Groups without leading zeros, the first of the longest runs of two or more zeros as ::."""

    def short(text: Column) -> Column:
        out = text
        for k in range(2, 9):  # longer runs come later and win
            run = rf"^((?:.*?:)??)0(?::0){{{k - 1}}}((?::.*)?)$"
            left, right = F.regexp_extract(text, run, 1), F.regexp_extract(text, run, 2)
            out = F.when(text.rlike(run), F.concat(F.when(left == "", ":").otherwise(left), F.when(right == "", ":").otherwise(right))).otherwise(out)
        return out

    return let(F.array_join(F.transform(groups, lambda x: F.lower(F.hex(x))), ":"), lambda text: F.when(groups.isNotNull(), short(text)))


def canonical(raw: Column) -> Column:
    """A URL's host as the standard spells it; null if it can't be one."""

    def decoded(low: Column) -> Column:
        return F.when(low.contains("%"), F.try_url_decode(F.replace(low, F.lit("+"), F.lit("%2b")))).otherwise(low)

    def mapped(plain: Column) -> Column:
        return F.lower(F.when(plain.rlike(r"[^\x00-\x7f]"), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), plain)).otherwise(plain))

    def named(name: Column) -> Column:
        return F.when((name != "") & ~name.rlike(_FORBIDDEN), F.when(ends_in_number(name), ipv4_text(ipv4(name))).otherwise(name))

    def whole(low: Column) -> Column:
        inner = let(ipv6(F.regexp_extract(low, r"^\[([^\[\]]*)\]$", 1)), lambda groups: F.concat(F.lit("["), ipv6_text(groups), F.lit("]")))
        return F.when(low.startswith("["), inner).otherwise(let(let(decoded(low), mapped), named))

    return let(F.lower(raw), whole)


def is_public(host: Column) -> Column:
    """Whether a canonical host is a name but localhost, or an address outside the loopback, unspecified, private and
    link-local ranges. Version 4 addresses within version 6 ones (mapped and compatible) are judged as themselves."""

    def judged(v4: Column, inner: Column, host: Column) -> Column:
        first, two, group = F.shiftright(v4, 24), F.shiftright(v4, 16), F.get(inner, F.lit(0))
        local4 = first.isin(0, 10, 127) | two.between(0xAC10, 0xAC1F) | two.isin(0xC0A8, 0xA9FE)
        local6 = group.between(0xFE80, 0xFEBF) | group.between(0xFC00, 0xFDFF)
        name = F.regexp_replace(host, r"\.$", "")
        return F.when(v4.isNotNull(), local4).when(inner.isNotNull(), local6).otherwise((name == "localhost") | name.endswith(".localhost"))

    def of(host: Column, inner: Column) -> Column:
        inside = F.forall(F.slice(inner, 1, 5), lambda x: x == 0) & F.get(inner, F.lit(5)).isin(0, 0xFFFF)
        v4 = F.when(host.startswith("["), F.when(inside, F.get(inner, F.lit(6)) * 65536 + F.get(inner, F.lit(7)))).when(ends_in_number(host), ipv4(host))
        return let(v4, lambda v: judged(v, inner, host))

    local = let(host, lambda h: let(ipv6(F.regexp_extract(h, r"^\[(.*)\]$", 1)), lambda inner: of(h, inner)))
    return F.coalesce(~local, F.lit(False))
