"""Paths and URLs as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PROXY_PREFIX = "/proxy"
LEGACY_PREFIX_LENGTH = 13


def strip_proxy_prefix(path: Column) -> Column:
    """URL-01: without one leading "/proxy", taken as a string prefix."""
    return F.when(F.startswith(path, F.lit(PROXY_PREFIX)), F.substring(path, len(PROXY_PREFIX) + 1, 2**31 - 1)).otherwise(path)


def rooted(path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def clean_url_path(path: Column) -> Column:
    """URL-02: rooted, without repeated slashes and without one trailing slash; empty becomes "/"."""
    single = F.regexp_replace(F.concat(F.lit("/"), path), "/{2,}", "/")
    return F.when(single == "/", single).otherwise(F.regexp_replace(single, "/$", ""))


def join_base(base: Column, path: Column) -> Column:
    """URL-03: base without its trailing slashes, then the rooted path; an empty base gives the path as it is."""
    return F.when(base == "", path).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), rooted(path)))


def append_query(url: Column, query: Column) -> Column:
    """URL-05: a non-empty raw query follows a question mark."""
    return F.when(F.coalesce(query, F.lit("")) == "", url).otherwise(F.concat(url, F.lit("?"), query))


def join_once(base: Column, path: Column) -> Column:
    """URL-06: plain concatenation, with a slash only where neither side has one."""
    bare = ~F.endswith(base, F.lit("/")) & ~F.startswith(path, F.lit("/"))
    return F.when(bare, F.concat(base, F.lit("/"), path)).otherwise(F.concat(base, path))


def drop_legacy_prefix(path: Column) -> Column:
    """URL-07: a path of more than 13 bytes loses its first 13, whatever they are; both counted in bytes."""
    rest = F.substring(F.encode(path, "UTF-8"), LEGACY_PREFIX_LENGTH + 1, 2**31 - 1).cast("string")
    return F.when(F.octet_length(path) > LEGACY_PREFIX_LENGTH, rest).otherwise(path)


def with_port(base: Column, port: Column) -> Column:
    """URL-08."""
    return F.concat(base, F.lit(":"), port.cast("string"))


def trim_one_slash(url: Column) -> Column:
    """STR-07."""
    return F.regexp_replace(url, "/$", "")


def is_absolute(path: Column) -> Column:
    return F.startswith(path, F.lit("/"))


def segments(path: Column) -> Column:
    """The segments of the lexically cleaned path: none for "." and "/"."""
    rooted = is_absolute(path)

    def step(kept: Column, part: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        up = F.when((F.size(kept) > 0) & (last != ".."), F.slice(kept, 1, F.size(kept) - 1)).when(rooted, kept).otherwise(F.array_append(kept, F.lit("..")))
        return F.when((part == "") | (part == "."), kept).when(part == "..", up).otherwise(F.array_append(kept, part))

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def to_unix_path(path: Column, windows: bool = False) -> Column:
    """STR-03: lexical cleaning; windows: backslashes are separators too."""
    path = F.replace(path, F.lit("\\"), F.lit("/")) if windows else path
    inner = F.array_join(segments(path), "/")
    return F.when(is_absolute(path), F.concat(F.lit("/"), inner)).when(inner == "", F.lit(".")).otherwise(inner)


def path_equal(a: Column, b: Column, windows: bool = False) -> Column:
    """FLT-12: equality up to the separators of the system."""
    return F.replace(a, F.lit("\\"), F.lit("/")) == F.replace(b, F.lit("\\"), F.lit("/")) if windows else a == b


def is_child(parent: Column, path: Column) -> Column:
    """FLT-13: strictly below parent; both rooted or both not.  A first step that starts with two dots never counts."""
    above, below = segments(parent), segments(path)
    step = F.get(below, F.size(above))
    inside = (F.size(below) > F.size(above)) & (F.slice(below, 1, F.size(above)) == above)
    return (is_absolute(parent) == is_absolute(path)) & inside & ~F.startswith(step, F.lit(".."))


def is_hidden(path: Column) -> Column:
    """FLT-14: a component that starts with a dot; "." and ".." themselves are not hidden."""
    return ~to_unix_path(path).isin(".", "..") & F.exists(segments(path), lambda s: F.startswith(s, F.lit(".")))


#: What a path may hold besides letters, digits and - . _ ; everything else is percent-encoded.
PATH_SAFE = "/$&,:;=@~"


def encoded_path(path: Column) -> Column:
    """Percent-encoded UTF-8, as the path of a URL is written."""
    out = F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for c in PATH_SAFE + "+":
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def decoded_path(path: Column) -> Column:
    """The path that a URL's percent-encoding stands for; null where an escape is broken.  A plus stays a plus."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def full_path_url(target: Column, path: Column) -> Column:
    """URL-04: the target's path, then the rooted request path, cleaned and percent-encoded; the target's query and fragment are dropped.

    path is a decoded one, as the request's path column holds it; a target with a broken escape gives null.
    """
    origin = F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    own = decoded_path(F.regexp_extract(target, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1))
    return F.concat(origin, encoded_path(to_unix_path(F.concat(own, rooted(path)))))


def first_rule(path: Column, rules: list[tuple[str, str]]) -> Column:
    """JON-03: the first rule in list order whose source is a prefix replaces it; no rule leaves the path."""
    chain = [(F.startswith(path, F.lit(a)), F.concat(F.lit(b), F.substring(path, len(a) + 1, 2**31 - 1))) for a, b in rules]
    if not chain:
        return path
    return reduce(lambda c, w: c.when(*w), chain[1:], F.when(*chain[0])).otherwise(path)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, raw query) of an absolute URL; empty strings where it has none."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k), F.lit(""))
    return part(1), part(2), part(3)
