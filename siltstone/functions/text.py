"""Lines, blanks, base64, lists and ordered sets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BASE64 = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def split_lines(text: Column) -> Column:
    """STR-01: none for the empty text; a trailing newline gives one more empty line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def join_lines(lines: Column) -> Column:
    """STR-02."""
    return F.array_join(lines, "\n")


def count_lines(text: Column) -> Column:
    """STR-04: newlines, and one more for an unfinished last line."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (breaks + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def line_slice(text: Column, start: int = 1, end: int = 100) -> Column:
    """TOP-02: lines start..end, counted from 1; end -1 is the last one."""
    lines = split_lines(text)
    count = F.size(lines) if end < 0 else F.lit(max(end - start + 1, 0))
    return F.array_join(F.slice(lines, max(start, 1), count), "\n")


def is_blank(text: Column) -> Column:
    """FLT-11: nothing but Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "") == ""


def decode_base64(text: Column) -> Column:
    """STR-05: strict alphabet and padding; what isn't base64 comes back as it is.  Line breaks inside are skipped."""
    bare = F.regexp_replace(text, r"[\r\n]", "")
    return F.when(bare.rlike(_BASE64), F.coalesce(F.try_to_binary(bare, F.lit("base64")).cast("string"), text)).otherwise(text)


def truncate_error(text: Column, limit: int = 200) -> Column:
    """ERR-11: a null is empty; beyond limit bytes cut there, or before the character that the limit would split, with dots."""
    n = F.length(F.substring(F.encode(text, "UTF-8"), 1, limit).cast("string"))  # a split last character counts as one
    head = F.left(text, n)
    head = F.when(F.octet_length(head) > limit, F.left(text, n - 1)).otherwise(head)
    return F.coalesce(F.when(F.octet_length(text) > limit, F.concat(head, F.lit("..."))).otherwise(text), F.lit(""))


def join_numbers(numbers: Column) -> Column:
    """ARR-01."""
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",")


def distinct_in_order(items: Column) -> Column:
    """SET-01: the first of equal items stays."""
    return F.array_distinct(items)


def timestamp_of(item: Column) -> Column:
    """SRT-01: a sign and digits as a long, beyond its range the nearest one; anything else, blanks around it too, is 0."""
    beyond = F.when(F.startswith(item, F.lit("-")), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return F.when(item.rlike(r"^[+-]?[0-9]+\z"), F.coalesce(item.try_cast("long"), beyond)).otherwise(F.lit(0).cast("long"))


def ordered_timestamps(items: Column) -> Column:
    """SRT-01: the distinct numbers of one row's array in order."""
    return F.array_sort(F.array_distinct(F.transform(items, timestamp_of)))


def ordered_timestamps_by(rows: DataFrame, key: str, item: str, out: str = "at") -> DataFrame:
    """SRT-01 over rows: (key, out), the distinct numbers of each key, sorted by ranges, so no key's set is gathered."""
    return rows.select(key, timestamp_of(F.col(item)).alias(out)).distinct().orderBy(key, out)


def map_values_sorted(m: Column) -> Column:
    """MAP-01, in a defined order."""
    return F.array_sort(F.map_values(m))
