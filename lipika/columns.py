"""Small helpers for writing native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often body uses it.

    Catalyst inlines a projected expression into a lambda, where it would be evaluated
    for each element; a lambda variable is bound to the value itself.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str) -> Column:
    """All whole matches of a Java pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def free_name(df: DataFrame, wanted: str, taken: Iterable[str] = ()) -> str:
    """A column name like ``wanted`` that the frame does not have (names compare without case)."""
    used = {c.lower() for c in df.columns} | {c.lower() for c in taken}
    name, n = wanted, 0
    while name.lower() in used:
        n += 1
        name = f"{wanted}_{n}"
    return name
