"""Bit fingerprints on a ring of segments: SimHash, chain keys, the pigeonring filter and the full Hamming distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 1 << 15
_MIX = 0x9E3779B97F4A7C15


def _widened(h: np.ndarray, width: int) -> np.ndarray:
    """``width`` independent 64-bit words from each hash; the first is the hash itself."""
    out = np.empty((len(h), width), "<u8")
    out[:, 0] = h
    for k in range(1, width):
        x = h + np.uint64(_MIX * k & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def simhash(h: np.ndarray, width: int = 1) -> np.ndarray:
    """``width`` words of 64 bits; a bit is set if it is set in over half of the hashes."""
    ones = np.zeros(64 * width, np.int64)
    for at in range(0, len(h), CHUNK):
        wide = _widened(h[at : at + CHUNK], width)
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(wide), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<i8")


def segment_masks(width: int, per_word: int) -> list[tuple[int, int]]:
    """(word, mask) of each segment of the ring: ``per_word`` nearly equal ones in each word."""
    cuts = [-(-64 * k // per_word) for k in range(per_word + 1)]
    return [(w, sum(1 << b for b in range(a, z))) for w in range(width) for a, z in zip(cuts, cuts[1:])]


def as_long(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")


def chain_keys(fp: Column, masks: list[tuple[int, int]], run: int) -> Column:
    """Array of (start, key): the bits of ``run`` consecutive segments from each start."""
    out = []
    for start in range(len(masks)):
        by_word: dict[int, int] = {}
        for k in range(run):
            w, m = masks[(start + k) % len(masks)]
            by_word[w] = by_word.get(w, 0) | m
        bits = [F.get(fp, F.lit(w)).bitwiseAND(as_long(m)) for w, m in by_word.items()]
        key = bits[0] if len(bits) == 1 else F.xxhash64(*bits)
        out.append(F.struct(F.lit(start).alias("start"), key.alias("bits")))
    return F.array(*out)


def within_budgets(a: Column, b: Column, masks: list[tuple[int, int]], tau: int) -> Column:
    """Whether some chain around the whole ring keeps each of its beginnings within the proportional budget."""
    m = len(masks)
    diffs = F.array(*(F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w))).bitwiseAND(as_long(k))) for w, k in masks))

    def viable(d: Column) -> Column:
        def chain(start: Column) -> Column:
            # (cumulative differences, still within budget) over the m segments from start
            def step(acc: Column, offset: Column) -> Column:
                total = acc["sum"] + F.get(d, (start + offset) % m)
                return F.struct(total.alias("sum"), (acc["ok"] & (total * m <= (offset + 1) * tau)).alias("ok"))

            return F.aggregate(F.sequence(F.lit(0), F.lit(m - 1)), F.struct(F.lit(0).alias("sum"), F.lit(True).alias("ok")), step, lambda acc: acc["ok"])

        # few starts of unlike fingerprints are within the budget of their first segment
        return F.exists(F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda s: F.get(d, s) * m <= tau), chain)

    return F.element_at(F.transform(F.array(diffs), viable), 1)


def hamming(a: Column, b: Column, width: int) -> Column:
    total = F.lit(0)
    for w in range(width):
        total = total + F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w))))
    return total
