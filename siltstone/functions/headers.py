"""Header multimaps, map<string, array<string>>, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header names that the operators treat specially.
HOP_BY_HOP = ("Connection", "Keep-Alive", "Proxy-Connection", "Upgrade", "Transfer-Encoding")
HOP_BY_HOP_LONG = ("Connection", "Keep-Alive", "Proxy-Connection", "Proxy-Authenticate", "Proxy-Authorization", "Te", "Trailers", "Transfer-Encoding", "Upgrade")
SENSITIVE = ("authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "x-csrf-token", "x-forwarded-for", "x-real-ip")
LOOKUP_SKIPS = ("host", "content-length")


def canonical(name: Column) -> Column:
    """Words between hyphens start with a capital."""
    return F.array_join(F.transform(F.split(name, "-"), F.initcap), "-")


def header(headers: Column, name: str | Column) -> Column:
    """FLT-06: the first value of a header; a missing header and an empty one are both empty."""
    key = F.lit(name) if isinstance(name, str) else name
    return F.coalesce(F.get(F.try_element_at(headers, key), F.lit(0)), F.lit(""))


def excluded(name: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """FLT-07, FLT-08: a pattern with stars matches names that contain the rest of it, another one only itself."""
    out = F.lit(False)
    for p in patterns:
        left, right = (F.lower(name), p.lower()) if ignore_case else (name, p)
        out = out | (F.contains(left, F.lit(right.replace("*", ""))) if "*" in p else left == right)
    return out


def is_sensitive(name: Column) -> Column:
    """FLT-09."""
    return F.lower(name).isin(*SENSITIVE)


def size_of(headers: Column) -> Column:
    """AGG-01, FLT-02: bytes of all values, and of each name once."""
    one = lambda e: F.octet_length(e["key"]) + F.aggregate(e["value"], F.lit(0), lambda s, v: s + F.octet_length(v))
    return F.aggregate(F.map_entries(headers), F.lit(0).cast("long"), lambda s, e: s + one(e))


def without(headers: Column, names: tuple[str, ...], ignore_case: bool = False) -> Column:
    keep = (lambda k, _: ~F.lower(k).isin(*[n.lower() for n in names])) if ignore_case else (lambda k, _: ~k.isin(*names))
    return F.map_filter(headers, keep)


def filtered(headers: Column, exclude: list[str], override: dict[str, str], host: Column | None = None, ignore_case: bool = False, hop_by_hop: tuple[str, ...] = HOP_BY_HOP) -> Column:
    """HDR-01: copied without the excluded ones, then overridden, then without the hop-by-hop ones, then with the host.

    Overrides may bring back an excluded header and may be removed as hop-by-hop.  Overridden names are dropped first, since a map with a repeated key is an error.
    """
    kept = F.map_filter(headers, lambda k, _: ~excluded(k, exclude, ignore_case) & ~k.isin(*override)) if override else F.map_filter(headers, lambda k, _: ~excluded(k, exclude, ignore_case))
    if override:
        kept = F.map_concat(kept, F.create_map(*[x for k, v in override.items() for x in (F.lit(k), F.array(F.lit(v)))]))
    kept = without(kept, hop_by_hop)
    if host is not None:
        kept = F.map_concat(F.map_filter(kept, lambda k, _: k != "Host"), F.create_map(F.lit("Host"), F.array(host)))
    return kept


def without_connection_tokens(headers: Column) -> Column:
    """HDR-03 in its corrected mode: the headers that Connection names go as well, then the nine hop-by-hop ones."""
    named = F.transform(F.flatten(F.transform(F.coalesce(F.try_element_at(headers, F.lit("Connection")), F.array().cast("array<string>")), lambda v: F.split(v, ","))), lambda t: F.lower(F.trim(t)))
    return without(F.map_filter(headers, lambda k, _: ~F.array_contains(named, F.lower(k))), HOP_BY_HOP_LONG)


def lookup_headers(headers: Column) -> Column:
    """HDR-05."""
    return without(headers, LOOKUP_SKIPS, ignore_case=True)


def merged(into: Column, more: Column) -> Column:
    """HDR-06: values are appended to those of the same name."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(into, more, lambda _, a, b: F.concat(F.coalesce(a, none), F.coalesce(b, none)))
