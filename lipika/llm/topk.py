"""The most frequent rows of a count table, without every task sending its own top to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_frequent(counts: DataFrame, k: int, tie: str, n: str = "n") -> DataFrame:
    """The ``k`` rows of largest ``n``, ties by ``tie``.

    Rows are first counted by level of ``n`` (eight to each doubling, so at most some
    hundreds of levels reach the driver), and only those of the levels that can hold the
    first ``k`` are sorted. ``counts`` is read twice, so it should be a written table.
    """
    level = F.floor(F.log2(F.col(n)) * 8).cast("int")
    held, edge = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        held, edge = held + r["count"], r["level"]
        if held >= k:
            break
    rows = counts if edge is None else counts.filter(level >= edge)
    return rows.orderBy(F.desc(n), tie).limit(k)
