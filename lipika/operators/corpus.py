"""Corpora: slices by order, held-out lines, weighted mixing, configured sources, experiment grids.

Places in an order are counted without one task that sorts everything: cut points are taken
once from a sample of the order's columns, every row's range follows from them by
comparison, each range is ranked alone, and the ranges' counts (one row each) give the offsets.
As ranges are a function of the row, they are the same however often the rows are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lipika.columns import free_name
from lipika.errors import ConfigError, EmptyCorpusError, require
from lipika.functions.text import is_blank, split_lines

#: What the configured sources stand for here: a filter on the table's ``source`` column.
TOTAL_LINES = 1_500_000


#: Rows in a range, and the most ranges.
RANGE_ROWS, RANGES = 100_000, 16_384


def cut_points(df: DataFrame, order: list[str], rows: int = RANGE_ROWS, most: int = RANGES) -> list[tuple]:
    """Keys that part the order into ranges of about ``rows`` rows, at most ``most``; from 16 sampled keys a range (64 where there are few ranges)."""
    keys = df.select(*order)
    n = keys.count()
    ranges = min(most, max(1, n // rows))
    if ranges == 1:
        return []
    each = 64 if ranges <= 1024 else 16
    found = [tuple(r) for r in keys.sample(min(1.0, each * ranges / n), seed=7).orderBy(*order).collect()]
    chosen = [found[len(found) * k // ranges] for k in range(1, ranges)] if found else []
    return [c for k, c in enumerate(chosen) if not k or c != chosen[k - 1]]


def range_of(df: DataFrame, order: list[str], cuts: list[tuple]) -> Column:
    """How many of the cut points a row's key is not below, by binary search."""
    if not cuts:
        return F.lit(0)
    kinds = [df.schema[c].dataType for c in order]
    row = lambda values: F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(values, kinds, order)))
    table, key = F.array(*map(row, cuts)), F.struct(*order)

    def step(found: Column, width: Column) -> Column:
        at = found + width
        return F.when((at <= len(cuts)) & (F.get(table, at - 1) <= key), at).otherwise(found)

    widths = F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)))
    return F.aggregate(widths, F.lit(0), step)


def placed(df: DataFrame, order: list[str], name: str = "place", within: list[str] | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """The frame with ``name``: the row's place from 0 in the order (nulls first), in all or within groups. Ties have places of their own, in any order."""
    within = within or []
    part = free_name(df, "range")
    dealt = df.withColumn(part, range_of(df, order, cut_points(df, order, rows)))
    sizes = dealt.groupBy(*within, part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    keys = {c: free_name(df, f"{c}_of_base", [part]) for c in [*within, part]}
    base = free_name(df, "base", [part, *keys.values()])
    bases = sizes.select(*(F.col(c).alias(k) for c, k in keys.items()), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    rank = F.row_number().over(Window.partitionBy(*within, part).orderBy(*order)) - 1
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return dealt.withColumn(name, rank).join(bases, on).withColumn(name, F.col(name) + F.col(base)).drop(part, base, *keys.values())


def offset_limit(df: DataFrame, offset: int, limit: int | None, order: list[str], within: list[str] | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """Rows from ``offset`` on, at most ``limit``, in the order; in all or in each group.

    Without groups only the ranges that hold a wanted place are ranked; the rest is not shuffled.
    """
    require(offset >= 0, f"offset must be >= 0, got {offset}")
    require(limit is None or limit >= 1, f"limit must be >= 1, got {limit}")
    name = free_name(df, "place")
    wanted = lambda at: (at >= offset) & (at < offset + limit) if limit is not None else at >= offset
    if within:
        return placed(df, order, name, within, rows).filter(wanted(F.col(name))).drop(name)
    part = free_name(df, "range", [name])
    dealt = df.withColumn(part, range_of(df, order, cut_points(df, order, rows)))
    bases, at = {}, 0
    for r in dealt.groupBy(part).count().orderBy(part).collect():  # at most RANGES rows
        if at + r["count"] > offset and (limit is None or at < offset + limit):
            bases[r[part]] = at
        at += r["count"]
    if not bases:
        return df.filter(F.lit(False))
    base = F.create_map(*(F.lit(x) for kv in bases.items() for x in kv))[F.col(part)]
    rank = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    near = dealt.filter(F.col(part).isin(list(bases))).withColumn(name, rank + base)
    return near.filter(wanted(F.col(name))).drop(name, part)


def lines_of(docs: DataFrame, text: str = "text", sentences: bool = False) -> DataFrame:
    """A row for each line that is not blank, with ``line_no`` and ``line``; other columns but the text stay."""
    parts = split_lines(F.col(text)) if sentences else F.split(text, "\n")
    rows = docs.select(*(c for c in docs.columns if c != text), F.posexplode(parts).alias("line_no", "line"))
    return rows.filter(~is_blank(F.col("line")))


def held_out(docs: DataFrame, skip: int, limit: int, order: list[str], text: str = "text") -> DataFrame:
    """Lines of the documents after the first ``skip``; it ends after the document in which ``limit`` lines are reached."""
    n = F.size(F.filter(F.split(text, "\n"), lambda x: ~is_blank(x)))
    rest = offset_limit(docs, skip, None, order)
    # every document with a line gives one at least, so no more than limit of those can be wanted
    after = rest.select(*order, text, n.alias("n_lines")).filter("n_lines > 0").orderBy(*order).limit(limit)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    wanted = after.withColumn("before", F.coalesce(F.sum("n_lines").over(before), F.lit(0))).filter(F.col("before") < limit)
    return lines_of(wanted.drop("before", "n_lines"), text)


def register_slices(docs: DataFrame, budgets: dict[str, int], limit: int, order: list[str], register: str = "source") -> DataFrame:
    """``part`` (train or held_out) of each register's documents: the first ``budgets[register]``, then the next ``limit``; no document is in both."""
    require(bool(budgets), "no registers given")
    require(limit >= 1, f"limit must be >= 1, got {limit}")
    place = free_name(docs, "place")
    table = F.create_map(*(F.lit(x) for kv in budgets.items() for x in kv))[F.col(register)]
    rows = placed(docs.filter(F.col(register).isin(list(budgets))), order, place, within=[register])
    part = F.when(F.col(place) < table, F.lit("train")).when(F.col(place) < table + limit, F.lit("held_out"))
    return rows.withColumn("part", part).drop(place).filter(F.col("part").isNotNull())


def versioned(docs: DataFrame, version: str, register: str = "source") -> DataFrame:
    """A data set's description: documents, words' bytes and a checksum of each register under a version; the checksum does not depend on the rows' order."""
    row = F.xxhash64(*docs.columns)
    sums = docs.groupBy(register).agg(F.count("*").alias("n_docs"), F.bit_xor(row).alias("xor"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("sum"))
    return sums.select(F.lit(version).alias("version"), register, "n_docs", F.concat_ws("-", F.hex("xor"), F.hex("sum")).alias("checksum"))


def targets(weights: dict[str, float], total: int) -> dict[str, int]:
    """Rows wanted of each source: its share, rounded half to even, one at least."""
    require(bool(weights), "no weights given")
    require(total >= 1, f"the total must be >= 1, got {total}")
    whole = sum(weights.values())
    require(whole > 0, "weights must sum to a positive number")
    return {k: max(1, round(total * w / whole)) for k, w in weights.items()}


def weighted_mix(lines: DataFrame, weights: dict[str, float], total: int, order: list[str], source: str = "source") -> DataFrame:
    """``place`` from 0 and the rows of each source, repeated from its start until its share is filled.

    A source's row k goes to the places k, k + n, ... below its target, so rows are repeated by
    one ``explode`` and no row is looked for.
    """
    wanted = targets(weights, total)
    rows = lines.filter(F.col(source).isin(list(wanted)))
    counts = {r[source]: r["n"] for r in rows.groupBy(source).agg(F.count("*").alias("n")).collect()}  # one row a source
    for name in wanted:
        if not counts.get(name):
            raise ConfigError(f"source {name!r} has a weight but no text")
    ranked = placed(rows, order, "k", within=[source])
    table = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col(source)]
    kept = ranked.withColumn("target", table(wanted)).withColumn("n", table(counts)).filter("k < target")
    return kept.withColumn("place", F.explode(F.sequence(F.col("k").cast("long"), F.col("target").cast("long") - 1, F.col("n").cast("long")))).drop("k", "target", "n")


def configured(config: dict, sources: dict[str, DataFrame], unavailable: tuple[str, ...] = (), order: list[str] | None = None) -> DataFrame:
    """The mix that a configuration's ``corpus_sources`` and ``total_lines`` describe; unknown names are an error."""
    weights = config.get("corpus_sources")
    require(bool(weights), "the configuration has no corpus_sources")
    unknown = sorted(set(weights) - set(sources) - set(unavailable))
    require(not unknown, f"unknown corpus sources: {unknown}")
    used = {k: v for k, v in weights.items() if k in sources}
    require(bool(used), "no usable corpus source is left")
    rows = reduce(DataFrame.unionByName, (sources[k].withColumn("source", F.lit(k)) for k in used))
    return weighted_mix(rows, used, config.get("total_lines", TOTAL_LINES), order or ["doc_id", "line_no"])


def require_text(df: DataFrame, what: str = "corpus") -> DataFrame:
    """The frame, if it has a row."""
    if df.limit(1).count() == 0:
        raise EmptyCorpusError(f"{what} has no usable text")
    return df


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """All combinations of an experiment's settings, one row each."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        column: Column = F.explode(F.array(*(F.lit(v).cast("long") if isinstance(v, int) else F.lit(v) for v in values)))
        out = out.select("*", column.alias(name))
    return out
