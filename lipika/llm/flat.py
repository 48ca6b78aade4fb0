"""Many texts as one array of bytes, cut into pieces, hashed and looked up together.

Pieces are known by a 64-bit hash: a polynomial over random 64-bit numbers of their bytes and
their length. Two given pieces share one with a probability of about 2 ** -60.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

#: Bytes that are hashed together, and bytes of texts that are worked on together.
SPAN = 1 << 17
GROUP = 1 << 19
#: Longer pieces are not looked up.
LONGEST = 64
_BASE = 0x9E3779B97F4A7C15 | 5
_BYTES = np.random.default_rng(20240103).integers(0, 1 << 64, 256, np.uint64)
_POWERS: list[np.ndarray] = []
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if not _POWERS:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(SPAN + 1, b, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps))
    return _POWERS


def groups(texts: pa.Array, most: int = GROUP) -> Iterator[pa.Array]:
    """Slices of a string column with at most ``most`` bytes, or one text."""
    texts = pc.fill_null(pc.cast(texts, pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset + 1 : texts.offset + 1 + len(texts)].astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    at, base = 0, int(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]) if len(texts) else 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield texts.slice(at, stop - at)
        at, base = stop, int(ends[stop - 1])


def release() -> None:
    """Give memory that is free back to the machine: a worker lives on, and other stages need it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def trim_jvm(spark: SparkSession) -> str:
    """Have the C library of the driver's JVM give freed native memory back, as jcmd does; what the command says (JVMs without it: nothing)."""
    jvm = spark.sparkContext._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)  # object, operation, no arguments, no signature
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(server, given)
    except Py4JError:
        return ""


def release_driver(spark: SparkSession) -> None:
    """What :func:`release` is to a worker, between the steps of a long stage: the driver's Python, its JVM's heap and native memory.

    The collection of the heap also lets Spark drop broadcasts and shuffle files of frames that are gone.
    """
    gc.collect()
    release()
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that releases what it took when it ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            release()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows``, so that a task holds few texts as Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a zero after each, and the places of these zeros. No text may be null."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data else np.zeros(0, np.uint8)
    ends = edges[1:] - edges[0]
    marks = ends + np.arange(len(ends))
    out = np.empty(len(raw) + len(ends), np.uint8)
    solid = np.ones(len(out), bool)
    solid[marks] = False
    out[solid], out[marks] = raw, 0
    return out, marks


def hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each piece; pieces are in order and do not overlap. Of longer ones than ``SPAN`` only a part is seen."""
    power, inverse = _powers()
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        a = int(starts[k])
        z = max(k + 1, int(np.searchsorted(ends, a + SPAN, "right")))
        b = min(int(ends[z - 1]), a + SPAN)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTES[flat[a:b]] * power[: b - a], out=sums[1:])
        s, e = starts[k:z] - a, np.minimum(ends[k:z] - a, b - a)
        out[k:z] = (sums[e] - sums[s]) * inverse[s]
        k = z
    out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def words(flat: np.ndarray, space: np.ndarray, alone: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of bytes for which the table ``space`` (256 of bool) is false; zero must be a space. Bytes of ``alone`` are words of their own."""
    solid = np.zeros(len(flat) + 2, bool)
    np.logical_not(space[flat], out=solid[1:-1])
    edge = solid[1:] != solid[:-1]
    if not alone:
        at = np.flatnonzero(edge)
        return at[::2], at[1::2]
    mark = np.zeros(len(flat) + 2, bool)
    for b in alone:
        mark[1:-1] |= flat == b
    cut = edge | mark[1:] | mark[:-1]
    return np.flatnonzero(cut & solid[1:]), np.flatnonzero(cut & solid[:-1])


def strings(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = flat.tobytes()
    return [raw[a:z].decode("utf-8", "replace") for a, z in zip(starts.tolist(), ends.tolist())]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def binary(flat: np.ndarray, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary (or string) column of consecutive stretches of an array; ``ends`` counts its items."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends * flat.itemsize
    return pa.Array.from_buffers(kind or pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


class Table:
    """Numbers 0, 1, 2, ... of hashes, at most ``most``, by open addressing."""

    def __init__(self, most: int):
        bits = max(8, (2 * most - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.zeros(1 << bits, np.int32)
        self.keys = np.zeros(most, np.uint64)
        self.most, self.n = most, 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out = np.full(len(wanted), -1, np.int32)
        left, at = np.arange(len(wanted)), (wanted >> self.shift).astype(np.int64)
        while len(left):
            k = self.slots[at] - 1
            there = k >= 0
            left, at, k = left[there], at[there], k[there]
            same = self.keys[k] == wanted[left]
            out[left[same]] = k[same]
            other = ~same
            left, at = left[other], (at[other] + 1) & self.mask
        return out

    def add(self, new: np.ndarray) -> int:
        """Number distinct hashes that are not there, as far as there is room; how many were."""
        new = new[: self.most - self.n]
        slots, mask = self.slots, self.mask
        for k, a in enumerate((new >> self.shift).tolist(), self.n + 1):
            while slots[a]:
                a = (a + 1) & mask
            slots[a] = k
        self.keys[self.n : self.n + len(new)] = new
        self.n += len(new)
        return len(new)


class Lists:
    """Numbered lists of small numbers in one pool."""

    def __init__(self, kind: str):
        self.first, self.count, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, kind)
        self.n = self.used = 0

    def add(self, lists: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        if self.n + len(lists) > len(self.first):
            room = max(2 * len(self.first), self.n + len(lists))
            self.first, self.count = np.resize(self.first, room), np.resize(self.count, room)
        total = int(sizes.sum())
        if self.used + total > len(self.pool):
            self.pool = np.resize(self.pool, max(3 * len(self.pool) // 2, self.used + total))
        self.first[self.n : self.n + len(lists)] = self.used + np.cumsum(sizes) - sizes
        self.count[self.n : self.n + len(lists)] = sizes
        if total:
            self.pool[self.used : self.used + total] = np.concatenate(lists)
        self.n, self.used = self.n + len(lists), self.used + total

    def keep(self, n: int) -> None:
        """Forget all lists from number n on."""
        if n < self.n:
            self.n, self.used = n, int(self.first[n])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All items of the lists one after another, and where each list ends."""
        count = self.count[numbers]
        return self.pool[spread(self.first[numbers], count)], np.cumsum(count)
