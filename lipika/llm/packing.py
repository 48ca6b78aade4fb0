"""Packing documents into fixed windows by non-negative least squares.

A document of T tokens gives T // window whole windows and one remainder. Remainders are
counted by length: a histogram of at most ``window`` numbers, whatever the corpus. Shallow
combinations (pairs, and triples over a grid) of lengths that fill a window exactly are
enumerated, their repeat counts are solved for by non-negative least squares against the
histogram and rounded down to what is there, then topped up greedily. What remains is laid
end to end and cut at the windows' edges, so only the very last sequence has padding.

The plan is arithmetic over (length, rank): the rank of a document among those with its
remainder gives its sequence and offset. Ranks are taken within (length, salt) groups whose
number grows with the corpus; the salt is taken from the row's number in the written table, so
neither a length nor an id that a third of all rows share lands in one group.

Defined results: a null text is empty (with an end id it is one token). A document without
tokens gives no piece. Ties and repeated rows are packed row by row. Which of the documents
with one remainder takes which place follows the rows' order in the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lipika.llm.flat import tidy
from lipika.llm.tokens import id_type, token_table
from lipika.session import written

#: Whole windows of document g start at sequence ``first_whole + g * 2 ** WHOLE_BITS``.
WHOLE_BITS = 21


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Rows of three lengths that sum to the window; 0 pads a pair. Only lengths that occur."""
    lengths = np.flatnonzero(present)
    lengths = lengths[lengths > 0]
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    a = lengths[lengths <= window // 2]
    pairs = a[there[window - a]]
    rows = [np.stack([np.zeros_like(pairs), pairs, window - pairs], 1)]
    grid = lengths[(lengths % max(1, window // 64) == 0) & (lengths <= window // 3)]
    for first in grid:
        b = lengths[(lengths >= first) & (2 * lengths <= window - first)]
        b = b[there[window - first - b]]
        rows.append(np.stack([np.full_like(b, first), b, window - first - b], 1))
    return np.concatenate(rows)


def solve(columns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring A x near the histogram in least squares (multiplicative updates, which stay non-negative)."""
    target = histogram.astype(float).copy()
    target[0] = 0
    weight = (columns > 0).astype(float)
    x = np.full(len(columns), max(1.0, target.sum() / max(1, 3 * len(columns))))
    top = (target[columns] * weight).sum(1)
    for _ in range(rounds):
        made = np.bincount(columns.ravel(), (x[:, None] * weight).ravel(), minlength=len(target))
        x *= top / np.maximum((made[columns] * weight).sum(1), 1e-9)
    return x


@dataclass
class Plan:
    """Where the remainder of (length, rank) goes."""

    window: int
    histogram: np.ndarray
    ranges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    used: np.ndarray = None
    n_combined: int = 0
    rest_base: np.ndarray = None
    n_rest: int = 0
    doc_base: np.ndarray = None

    @property
    def first_whole(self) -> int:
        return self.n_combined + self.n_rest

    def remainder(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of each piece of a remainder."""
        if rank < self.used[length]:
            starts, sequences, offsets = self.ranges[length]
            k = int(np.searchsorted(starts, rank, "right")) - 1
            return [(int(sequences[k] + rank - starts[k]), int(offsets[k]), length)]
        at = int(self.rest_base[length]) + (rank - int(self.used[length])) * length
        first = min(length, self.window - at % self.window)
        out = [(self.n_combined + at // self.window, at % self.window, first)]
        return out + ([(self.n_combined + at // self.window + 1, 0, length - first)] if first < length else [])

    def whole(self, length: int, rank: int, k: int) -> int:
        """Sequence of a document's k-th whole window."""
        return self.first_whole + ((int(self.doc_base[length]) + rank) << WHOLE_BITS) + k


def plan(histogram: np.ndarray, window: int) -> Plan:
    """``histogram[r]``: documents whose token count leaves r (0 included)."""
    out = Plan(window, histogram)
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    columns = combinations(window, left > 0)
    counts = np.zeros(len(columns), np.int64)
    if len(columns):
        x = solve(columns, histogram)
        order = np.argsort(-x, kind="stable")
        for most in (np.floor(x + 1e-6).astype(np.int64), np.full(len(x), np.iinfo(np.int64).max)):
            for k in order.tolist():  # first what was solved for, then greedily what still fits
                parts, times = np.unique(columns[k][columns[k] > 0], return_counts=True)
                n = min(int(most[k]), int((left[parts] // times).min()))
                if n > 0:
                    counts[k] += n
                    left[parts] -= n * times
    rows: dict[int, list[tuple[int, int, int]]] = {}
    filled = np.zeros(window, np.int64)
    for k in np.flatnonzero(counts).tolist():
        offset = 0
        for length in columns[k][columns[k] > 0].tolist():
            rows.setdefault(length, []).append((int(filled[length]), out.n_combined, offset))
            filled[length] += counts[k]
            offset += length
        out.n_combined += int(counts[k])
    out.ranges = {length: tuple(np.array(c, np.int64) for c in zip(*r)) for length, r in rows.items()}
    out.used = filled
    tokens = (histogram - filled) * np.arange(window)
    tokens[0] = 0
    out.rest_base = np.concatenate([[0], np.cumsum(tokens)[:-1]])
    out.n_rest = int(-(-int(tokens.sum()) // window))
    out.doc_base = np.concatenate([[0], np.cumsum(histogram)[:-1]])
    return out


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int | None = 0, id_col: str = "doc_id", text: str = "text", rows_per_salt: int = 10_000, with_ids: bool = True) -> DataFrame:
    """One row for each piece: ``id_col``, ``start``, ``length``, ``ids`` (binary; null without ``with_ids``), ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``."""
    table = written(token_table(docs, path, end_id, id_col, text).withColumn("row", F.monotonically_increasing_id()), "tokens")
    left = F.pmod("n", F.lit(window)).cast("int").alias("left")
    counted = table.groupBy(left).count().collect()  # at most ``window`` rows
    histogram = np.zeros(window, np.int64)
    for r in counted:
        histogram[r["left"]] = r["count"]
    made = plan(histogram, window)
    salts = max(64, int(histogram.sum()) // rows_per_salt)
    salted = table.select("*", left, F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"))
    sizes = salted.groupBy("left", "salt").count()
    before = Window.partitionBy("left").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("left", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("left", "salt").orderBy("row")
    ranked = salted.join(bases, ["left", "salt"]).select("id", "ids", (F.col("base") + F.row_number().over(order) - 1).alias("rank"))
    kind = id_type(Tokenizer.from_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, raw, rank in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, kind).astype("<u4")
                n = len(ids)
                pieces = [(made.whole(n % window, rank, k), 0, window) for k in range(n // window)]
                pieces += made.remainder(n % window, rank) if n % window else []
                start = 0
                for sequence, offset, length in pieces:
                    piece = ids[start : start + length].tobytes()
                    for column, value in zip(out, (key, start, length, piece if with_ids else None, zlib.crc32(piece), n, sequence, offset)):
                        column.append(value)
                    start += length
            longs = pa.int64()
            kinds = [batch.column(0).type, longs, longs, pa.binary(), longs, longs, longs, longs]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    id_name = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_name}, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
