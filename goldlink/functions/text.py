"""String helpers whose semantics are those of Unicode-aware text processing, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def title_case(c: Column) -> Column:
    """Capital after every character that is no letter, lower case elsewhere (``initcap`` only looks at blanks)."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small literal table, null where the key is absent."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def split_filled(c: Column, pattern: str) -> Column:
    """Split, strip each part, drop what is blank; null input gives an empty array."""
    parts = F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def capture(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is no match."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def find_all(c: Column, pattern: str) -> Column:
    """Distinct matches in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    Column expressions are trees: a value that is used many times, level over level, otherwise makes plans grow exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
