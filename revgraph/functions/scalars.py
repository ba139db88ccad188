"""Scalar expressions: formatting, keys, edge-type and revision arithmetic. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revgraph.model import EDGE_TYPES, REVISION


def camel_to_snake(s: Column) -> Column:
    """fooBarBaz to FOO_BAR_BAZ."""
    return F.upper(F.regexp_replace(s, r"(?<!^)(\p{Lu})", "_$1"))


def si_bytes(n: Column) -> Column:
    """Bytes with an SI prefix: 999 B, 1.5 kB, 2.0 GB. Thousands are cut off before the last division."""
    n = n.cast("long")
    cases = F.when((n > -1000) & (n < 1000), F.concat(n.cast("string"), F.lit(" B")))
    for prefix, divisor in zip("kMGTP", (1, 10**3, 10**6, 10**9, 10**12), strict=True):
        cut = (n - n % divisor) / divisor
        cases = cases.when((cut > -999_950) & (cut < 999_950), F.format_string(f"%.1f {prefix}B", cut / F.lit(1000.0)))
    return cases.otherwise(F.format_string("%.1f EB", (n - n % 10**15) / F.lit(10**15) / F.lit(1000.0)))


def duration(nanos: Column) -> Column:
    """Nanoseconds as `1d 2h 3m`, `1h 2m 3s` or `1m 2s 3.5ms`; days wrap at 24 as they do in the format's definition."""
    s = F.floor(nanos / F.lit(10**9)).cast("long")
    day, hour, minute, sec = F.floor(s / 86400) % 24, F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60
    ms = (nanos / F.lit(10.0**6)) % 1000
    return F.when(day > 0, F.format_string("%dd %dh %dm", day, hour, minute)).when(hour > 0, F.format_string("%dh %dm %ds", hour, minute, sec)).otherwise(F.format_string("%dm %ds %fms", minute, sec, ms))


def grouped(n: Column) -> Column:
    """Whole numbers with thousands separators."""
    return F.format_number(n.cast("long"), 0)


def child_name(name: Column) -> Column:
    """Index key of a child's name."""
    return F.substring(name, 1, 200)


def java_hash(s: Column) -> Column:
    """The 32-bit polynomial hash (factor 31) of a string of characters of the basic plane."""
    codes = F.transform(F.split(s, ""), lambda c: F.when(c == "", 0).otherwise(F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10)).cast("long"))
    h = F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(0).cast("long"), lambda h, x: (h * 31 + x).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h >= 2**31, h - 2**32).otherwise(h)


def source_local_key(name: Column) -> Column:
    return java_hash(F.lower(name)).cast("string")


def _mapped(x: Column, pairs: dict[str, str]) -> Column:
    out = None
    for a, b in pairs.items():
        out = (out.when if out is not None else F.when)(x == a, F.lit(b))
    return out


def stored_type(literal: Column) -> Column:
    """File literal of an edge type to its stored name; null if unknown."""
    return _mapped(literal, {b: a for a, b in EDGE_TYPES.items()})


def file_literal(stored: Column) -> Column:
    return _mapped(stored, EDGE_TYPES)


def attribute_key(key: Column) -> Column:
    """The key `label` in any case is reserved and gets a leading underscore."""
    return F.when(F.lower(key) == "label", F.concat(F.lit("_"), key)).otherwise(key)


def is_major(r: Column) -> Column:
    return F.floor(r) == r


def max_minor(r: Column) -> Column:
    """The last minor revision of a major one: floor + 0.999999."""
    return (F.floor(r) + F.lit("0.999999").cast(REVISION)).cast(REVISION)


def revision_label(r: Column) -> Column:
    """`3` for a major revision, `3.12` for 3.000012."""
    major = F.floor(r).cast("long").cast("string")
    minor = F.round((r - F.floor(r)) * 1_000_000).cast("long").cast("string")
    return F.when(is_major(r), major).otherwise(F.concat(major, F.lit("."), minor))


def content_id(*parts: Column) -> Column:
    """Deterministic identity of an object from its natural key."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def display_name(kind: Column, name: Column, number: Column | None = None) -> Column:
    """A vertex's name by kind; revisions show their number with six decimals."""
    if number is None:
        return name
    return F.when(kind == "RevisionNode", F.concat(F.lit("revision["), number.cast("decimal(16,6)").cast("string"), F.lit("]"))).otherwise(name)


def display_type(kind: Column, type_: Column) -> Column:
    """A vertex's type by kind; roots and source nodes show their kind, attributes their key."""
    return F.when(kind.isin("SuperRoot", "RevisionRoot", "SourceRoot", "SourceNode", "RevisionNode"), kind).otherwise(type_)
