"""A binary file of token ids, coded by an adaptive range coder with context mixing.

Ids are cut into blocks of ``BLOCK``, each coded from a fresh model, so any block can be read
alone; its bytes carry a CRC-32. Three orders predict each id, all adaptively: orders 2 and 1
name the id that last followed the same two ids, or one id, in the block, and order 0 names
the id that has lately been most frequent. How sure each order is has an adaptive logit for
its state; the logits are mixed by adding them, and all of them move down the gradient of
the code length after each id. The ids that no order names are coded by the block's
histogram of them (order -1), which is sent with the block. All arithmetic is in integers, so
that every machine decodes alike.

Blocks do not depend on each other, so many are coded in step, one numpy lane each: the
time for a step is shared by thousands of blocks.

File: ``MAGIC``, then blocks, then an index (JSON: documents and blocks, deflated), its
length and CRC. Documents may run over blocks. Memory is bounded by one and a half times ``LANES`` blocks.

Defined results: a null text is empty (one end id). Documents are in ascending order of
ids, null ids first, ties by tokens; repeated rows stay. An empty table gives no file. A
document of any length is one row; ids of documents are integers or strings.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lipika.llm.files import opened, replacing
from lipika.llm.flat import release, tidy
from lipika.llm.tokens import forget, id_type, token_table
from lipika.session import scratch, written

MAGIC = b"LPKRC1\n"
BLOCK = 4096
LANES = 3072
#: Ids in a batch of rows, but for one document.
ROWS_IDS = 1 << 20
SLOTS_1, SLOTS_2 = 1 << 10, 1 << 11
#: Bits of a step of the range coder.
UNITS = 28
_HALF = np.uint64(1 << 32)
_LOW = np.uint64((1 << 32) - 1)
_32 = np.uint64(32)
_UNITS = np.uint64(UNITS)
_ONE = np.uint64(1)
_16 = np.uint64(16)
_FINER = np.uint64(UNITS - 16)
#: Steps that are turned from rows of lanes into rows of steps at once, and what keeps lanes off the same lines of the cache.
_TURN, _PAD = 64, 16
_COUNT = np.uint64(65535)
#: Lanes whose histograms are made together.
_GROUP = 64
#: Logits have 4096 to a unit; the table has 256 to a unit, from -8 to 8.
_CENTRE = 2048


def _shares() -> np.ndarray:
    """Probabilities in 65536ths of logits, away from 0 and 1."""
    x = np.arange(-_CENTRE, _CENTRE) / 256
    return np.clip(np.round(65536 / (1 + 2.0 ** (-x / np.log(2)))), 32, 65536 - 2048).astype(np.int32)


_SHARE = _shares()
#: What the later orders take of the rest, in 32768ths: at most a half and 7 / 16 of the table's, so that something is left.
_SHARE_1, _SHARE_0 = _SHARE >> 1, (_SHARE >> 4) * 7
_TOP_0 = 4096 * 7


class _Predictor:
    """The model of all lanes: what orders 2, 1 and 0 name, and how sure they are."""

    def __init__(self, lanes: int):
        row = np.arange(lanes, dtype=np.int64)  # places are 64-bit, as numpy wants them; all else is 32-bit
        self.row_2, self.row_1, self.row_8, self.row_16 = row * SLOTS_2, row * SLOTS_1, row * 8, row * 16
        # a slot: 0 for none, else (id + 1) * 8 + 1 + successes in a row (to 3); ids are kept as id + 1
        self.two = np.zeros(lanes * SLOTS_2, np.int32)
        self.one = np.zeros(lanes * SLOTS_1, np.int32)
        start = np.array([-8, -2, 0, 1, 2, 0, 0, 0], np.int32) << 12
        centre = np.int32(_CENTRE << 4)  # logits that are looked up have the table's centre in them
        self.logit_2 = np.tile(start + centre, lanes)  # that order 2 is right: by its own state,
        self.logit_21 = np.zeros(lanes * 16, np.int32)  # the state of order 1 and whether both agree,
        self.logit_20 = np.zeros(lanes * 16, np.int32)  # and the state of order 0
        self.logit_1 = np.tile(np.concatenate([start, start - (4 << 12)]) + centre, lanes)  # order 1, if order 2 fails
        self.logit_0 = np.full(lanes * 16, (-3 << 12) + centre, np.int32)  # order 0, if both fail
        self.hash_1 = np.zeros(lanes, np.int32)  # of the id before
        self.hash_2 = np.zeros(lanes, np.int32)  # of the one before that
        self.named_0, self.strength = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.most, self.most_0 = np.full(lanes, 3, np.int32), np.full(lanes, 63, np.int32)  # arrays are sooner compared than numbers

    def predict(self) -> None:
        """Sets ``share_2``, ``share_1``, ``share_0``: parts of 65536 for each order being right before the next; the rest: none is."""
        self.at_2 = self.row_2 + ((self.hash_1 ^ self.hash_2 * 5) & (SLOTS_2 - 1))
        self.at_1 = self.row_1 + (self.hash_1 & (SLOTS_1 - 1))
        slot_2, slot_1 = self.two.take(self.at_2, mode="wrap"), self.one.take(self.at_1, mode="wrap")
        self.named_2, self.named_1 = slot_2 >> 3, slot_1 >> 3
        self.sure_2, self.sure_1 = slot_2 & 7, slot_1 & 7
        same = (self.named_2 == self.named_1).astype(np.int32)
        taken = ((self.named_0 == self.named_2) | (self.named_0 == self.named_1)).astype(np.int32)
        self.state_2 = self.row_8 + self.sure_2
        self.state_1 = self.row_16 + (self.sure_1 + (same << 3))
        self.state_0 = self.row_16 + ((self.strength >> 3) + (taken << 3))
        self.old_2, self.old_21, self.old_20 = self.logit_2.take(self.state_2, mode="wrap"), self.logit_21.take(self.state_1, mode="wrap"), self.logit_20.take(self.state_0, mode="wrap")
        self.old_1, self.old_0 = self.logit_1.take(self.state_1, mode="wrap"), self.logit_0.take(self.state_0, mode="wrap")
        self.share_2 = _SHARE.take(self.old_2 + self.old_21 + self.old_20 >> 4, mode="clip")
        self.part_1 = _SHARE_1.take(self.old_1 >> 4, mode="clip")
        self.part_0 = _SHARE_0.take(self.old_0 >> 4, mode="clip")
        rest = 65536 - self.share_2
        self.share_1 = (rest * self.part_1 >> 15) + 1
        self.share_0 = ((rest - self.share_1) * self.part_0 >> 15) + 1

    def learn(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``ids`` (plus 1) came; gives 1 for each lane where order 2, 2 and 1, or all of them named another, else 0."""
        right_2, right_1, right_0 = ((named == ids).astype(np.int32) for named in (self.named_2, self.named_1, self.named_0))
        step = ((right_2 << 16) - self.share_2) >> 7
        self.logit_2[self.state_2] = self.old_2 + step
        self.logit_21[self.state_1] = self.old_21 + step
        self.logit_20[self.state_0] = self.old_20 + step
        past_2 = right_2 ^ 1
        self.logit_1[self.state_1] = self.old_1 + (((right_1 << 15) - self.part_1) >> 5) * past_2
        past_1 = past_2 & ~right_1
        self.logit_0[self.state_0] = self.old_0 + ((right_0 * _TOP_0 - self.part_0) >> 6) * past_1
        fresh = (ids << 3) + 1
        self.two[self.at_2] = fresh + right_2 * np.minimum(self.sure_2, self.most)
        self.one[self.at_1] = fresh + right_1 * np.minimum(self.sure_1, self.most)
        self.hash_2 = self.hash_1
        self.hash_1 = ids ^ (ids >> 7) * 37
        strength = np.minimum(self.strength + ((right_0 << 4) - 1), self.most_0)
        lost = strength >> 31  # all bits, or none
        self.named_0 = self.named_0 ^ ((self.named_0 ^ ids) & lost)
        self.strength = strength - (lost << 3)  # from -1 to 7
        return past_2, past_1, past_1 & ~right_0


class _Writer:
    """Range encoders of 64 bits, one for each lane; they give out 32 bits at a time.

    The range is at least 2 ** 32 before each step. When it has fallen below, the upper half
    of ``low`` is settled (the range is cut where it would carry into it) and given out.
    """

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.lanes, self.words = [], []  # what was given out, in the order of steps
        self.kind = np.min_scalar_type(lanes)

    def narrow(self, n: int, start: np.ndarray, share: np.ndarray) -> None:
        """Code one choice of each of the first ``n`` lanes, in parts of ``2 ** UNITS``."""
        step = self.range[:n] >> _UNITS
        self.low[:n] += step * start
        self.range[:n] = step * share

    def _give(self, at: np.ndarray, low: np.ndarray) -> None:
        self.lanes.append(at.astype(self.kind))
        self.words.append((low >> _32).astype("<u4"))

    def settle(self, n: int) -> None:
        at = np.flatnonzero(self.range[:n] < _HALF)
        if len(at):
            low, rng = self.low.take(at), self.range.take(at)
            crossing = (low ^ (low + rng - _ONE)) >= _HALF
            rng = np.where(crossing, _HALF - (low & _LOW), rng)
            self._give(at, low)
            self.low[at], self.range[at] = low << _32, rng << _32

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        self._give(every, self.low)
        self._give(every, self.low << _32)
        lanes = np.concatenate(self.lanes)
        words = np.concatenate(self.words)[np.argsort(lanes, kind="stable")].tobytes()
        edges = (np.cumsum(np.bincount(lanes, minlength=len(every))) * 4).tolist()
        return [words[a:z] for a, z in zip([0, *edges], edges)]


class _Reader:
    """The decoders of :class:`_Writer`'s streams."""

    def __init__(self, streams: list[bytes]):
        # a damaged stream may ask for more than its own words
        self.words = np.frombuffer(b"".join(streams) + bytes(16), "<u4")
        sizes = np.array([len(s) // 4 for s in streams], np.int64)
        self.at = np.cumsum(sizes) - sizes
        self.low, self.range = np.zeros(len(streams), np.uint64), np.full(len(streams), (1 << 64) - 1, np.uint64)
        self.code = self.words[self.at].astype(np.uint64) << _32 | self.words[self.at + 1]
        self.at += 2

    def place(self, n: int) -> np.ndarray:
        self.step = self.range[:n] >> _UNITS
        return np.minimum((self.code[:n] - self.low[:n]) // self.step, np.uint64((1 << UNITS) - 1)).view(np.int64)

    def narrow(self, n: int, start: np.ndarray, share: np.ndarray) -> None:
        self.low[:n] += self.step * start.view(np.uint64)
        self.range[:n] = self.step * share.view(np.uint64)

    def settle(self, n: int) -> None:
        at = np.flatnonzero(self.range[:n] < _HALF)
        if len(at):
            low, rng, now = self.low.take(at), self.range.take(at), self.at.take(at)
            crossing = (low ^ (low + rng - _ONE)) >= _HALF
            rng = np.where(crossing, _HALF - (low & _LOW), rng)
            self.code[at] = self.code.take(at) << _32 | self.words.take(now, mode="clip")
            self.at[at] = now + 1
            self.low[at], self.range[at] = low << _32, rng << _32


def _varints(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Seven bits a byte, the low ones first; all but a value's last byte have the top bit. Also where each value ends."""
    values = np.asarray(values, np.int64)
    sizes = np.ones(len(values), np.int64)
    for k in (7, 14, 21, 28):
        sizes += values >= 1 << k
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > k)
        out[ends[at] - sizes[at] + k] = (values[at] >> 7 * k & 127) | (sizes[at] > k + 1) * 128
    return out.tobytes(), ends


def _from_varints(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if len(ends) != n or len(raw) and raw[-1] > 127:
        raise ValueError("damaged block header")
    starts = np.concatenate([[0], ends[:-1] + 1]) if n else np.zeros(0, np.int64)
    sizes = ends - starts + 1
    values = raw[starts].astype(np.int64) & 127
    for k in range(1, int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > k)
        values[at] |= (raw[starts[at] + k].astype(np.int64) & 127) << 7 * k
    return values


def _within(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _live(sizes: np.ndarray, steps: int) -> list[int]:
    """How many of the lanes, longest first, have an id at each step."""
    return np.searchsorted(-sizes, -np.arange(steps), "left").tolist()


def _inverse(totals: np.ndarray) -> np.ndarray:
    """``share * _inverse(total) >> 16`` is a unit of a histogram: its share of ``2 ** UNITS`` by its total, or a little less."""
    return (1 << UNITS) // totals


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block's bytes: lengths, the histogram of what no order named, and the coded ids."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    sizes = np.array([len(blocks[k]) for k in order], np.int64)
    lanes, steps = len(blocks), int(sizes[0]) if blocks else 0
    live = _live(sizes, steps)
    rows = np.zeros((lanes, steps + _PAD), np.int32)
    for k, o in enumerate(order):
        rows[k, : sizes[k]] = blocks[o]
    # first pass: what the model says at each step does not depend on the coder
    starts, shares = np.zeros((steps, lanes), np.uint16), np.zeros((steps, lanes), np.uint16)
    missed = np.zeros((lanes, steps + _PAD), bool)  # whose id no order named
    turned_missed = np.zeros((_TURN, lanes), bool)
    places = []
    kind = np.min_scalar_type(lanes)
    model = _Predictor(lanes)
    for t in range(steps):
        k = t % _TURN
        if k == 0:
            turned = np.add(rows[:, t : t + _TURN].T, 1, order="C")
        model.predict()
        share_2, share_1, share_0 = model.share_2, model.share_1, model.share_0
        past_2, past_1, past_0 = model.learn(turned[k])
        # the choice lies between the orders before that failed and all the others
        start = past_2 * share_2 + past_1 * share_1 + past_0 * share_0
        starts[t] = start
        shares[t] = share_2 + past_2 * share_1 + past_1 * share_0 + past_0 * (65536 - share_2 - share_1 - share_0) - start
        np.not_equal(past_0, 0, out=turned_missed[k])
        places.append(np.flatnonzero(turned_missed[k, : live[t]]).astype(kind))
        if k == _TURN - 1 or t == steps - 1:
            missed[:, t - k : t + 1] = turned_missed[: k + 1].T
    for k, size in enumerate(sizes.tolist()):
        if size < steps:
            missed[k, size:] = False
    del model
    heads, totals = [], []
    for k in range(0, lanes, _GROUP):
        some, of = _histograms(rows[k : k + _GROUP], missed[k : k + _GROUP])
        heads += some
        totals.append(of)
    del missed
    inverse = _inverse(np.maximum(np.concatenate(totals), 1)).astype(np.uint64) if totals else np.zeros(0, np.uint64)
    writer = _Writer(lanes)
    for t in range(steps):
        if t % _TURN == 0:
            turned = rows[:, t : t + _TURN].T.astype(np.uint64, order="C")
        n, at = live[t], places[t].astype(np.int64)
        start, share = starts[t, :n].astype(np.uint64) << _FINER, shares[t, :n].astype(np.uint64)
        unit = share.take(at) * inverse.take(at) >> _16
        share <<= _FINER
        found = turned[t % _TURN].take(at)
        start[at] += (found >> _16) * unit
        share[at] = (found & _COUNT) * unit
        writer.narrow(n, start, share)
        writer.settle(n)
    out: list[bytes] = [b""] * lanes
    for k, (o, body) in enumerate(zip(order, writer.finish())):
        n, packed = heads[k]
        raw = struct.pack("<III", int(sizes[k]), n, len(packed)) + packed + body
        out[o] = raw + struct.pack("<I", zlib.crc32(raw))
    return out


def _histograms(rows: np.ndarray, missed: np.ndarray) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """Order -1: of each lane the number of distinct ids that no order named and their packed histogram; and the lanes' totals.

    In ``rows`` the missed ids give way to where they begin there (times 65536) and their counts.
    """
    totals = np.count_nonzero(missed, axis=1)
    places = np.flatnonzero(missed)
    flat = rows.reshape(-1)  # whole rows: no copy
    begins = np.cumsum(totals) - totals
    bits = int(totals.max(initial=1)).bit_length()
    keys = flat[places].astype(np.int64) << bits | _within(totals)
    for a, n in zip(begins.tolist(), totals.tolist()):
        keys[a : a + n].sort()
    ids = keys >> bits
    some = totals > 0
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    new[begins[some]] = True
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(ids))
    n_kinds = np.searchsorted(first, begins + totals) - np.searchsorted(first, begins)
    base = np.repeat(begins, totals)
    flat[places[base + (keys & (1 << bits) - 1)]] = np.repeat(first << 16 | n, n) - (base << 16)
    # of each lane the gaps between its ids, then their counts less one
    gaps = np.diff(ids[first], prepend=0)
    tops = np.cumsum(n_kinds)
    heads = (tops - n_kinds)[some]
    gaps[heads] = ids[first[heads]]
    values = np.zeros(2 * len(first), np.int64)
    at = np.arange(len(first)) + np.repeat(tops - n_kinds, n_kinds)
    values[at] = gaps
    values[at + np.repeat(n_kinds, n_kinds)] = n - 1
    packed, edges = _varints(values)
    edges = np.concatenate([[0], edges])[2 * tops].tolist()
    return [(k, _deflated(packed[a:z])) for k, a, z in zip(n_kinds.tolist(), [0, *edges], edges)], totals


def _deflated(raw: bytes) -> bytes:
    """Histograms hold few repeats: Huffman codes alone are shorter, and sooner there."""
    packer = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS, zlib.DEF_MEM_LEVEL, zlib.Z_HUFFMAN_ONLY)
    return packer.compress(raw) + packer.flush()


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a damaged one raises ValueError."""
    parsed = []
    for b in blocks:
        if zlib.crc32(b[:-4]) != struct.unpack("<I", b[-4:])[0]:
            raise ValueError("damaged block")
        size, n, packed = struct.unpack_from("<III", b)
        parsed.append((size, n, zlib.decompress(b[12 : 12 + packed]), b[12 + packed : -4]))
    order = sorted(range(len(blocks)), key=lambda k: -parsed[k][0])
    parsed = [parsed[k] for k in order]
    sizes = np.array([p[0] for p in parsed], np.int64)
    lanes, steps = len(blocks), int(sizes[0]) if blocks else 0
    live = _live(sizes, steps)
    # for each lane and place in its histogram: the id there, where it begins and its count, in one number
    n_kinds = np.array([p[1] for p in parsed], np.int64)
    table = _from_varints(b"".join(p[2] for p in parsed), 2 * int(n_kinds.sum()))
    tops = np.cumsum(n_kinds)
    at = np.arange(int(n_kinds.sum())) + np.repeat(tops - n_kinds, n_kinds)
    gaps, counts = table[at], table[at + np.repeat(n_kinds, n_kinds)] + 1
    sums = np.concatenate([[0], np.cumsum(gaps)])
    kinds = sums[1:] - np.repeat(sums[tops - n_kinds], n_kinds)
    sums = np.concatenate([[0], np.cumsum(counts)])
    base, totals = sums[tops - n_kinds], np.maximum(sums[tops] - sums[tops - n_kinds], 1)
    held = kinds + 1 << 32 | sums[:-1] - np.repeat(base, n_kinds) << 16 | counts
    held = np.repeat(np.append(held, 1), np.append(counts, 1))  # one more, for a lane without any
    inverse = _inverse(totals)
    reader, model = _Reader([p[3] for p in parsed]), _Predictor(lanes)
    rows = np.zeros((lanes, steps + _PAD), np.uint32)
    turned = np.zeros((_TURN, lanes), np.int32)
    for t in range(steps):
        n = live[t]
        model.predict()
        place = reader.place(n)
        part = (place >> UNITS - 16).astype(np.int32)
        share_2, share_1, share_0 = model.share_2[:n], model.share_1[:n], model.share_0[:n]
        one = share_2 + share_1
        edge = one + share_0
        none = part >= edge
        past_2, past_1, past_0 = (part >= share_2).astype(np.int32), (part >= one).astype(np.int32), none.astype(np.int32)
        start = past_2 * share_2 + past_1 * share_1 + past_0 * share_0
        share = (share_2 + past_2 * share_1 + past_1 * share_0 - start).astype(np.int64) << UNITS - 16
        start = start.astype(np.int64) << UNITS - 16
        now = turned[t % _TURN]
        named_1 = model.named_1[:n]
        now[:n] = model.named_2[:n] + past_2 * (named_1 - model.named_2[:n]) + past_1 * (model.named_0[:n] - named_1)
        at = np.flatnonzero(none)
        if len(at):
            begin = start.take(at)
            unit = (65536 - edge.take(at)) * inverse.take(at) >> 16
            inside = (place.take(at) - begin) // unit
            found = held.take(base.take(at) + inside, mode="clip")  # only damage leads beyond the lane's own
            now[at] = found >> 32
            start[at] = begin + (found >> 16 & 65535) * unit
            share[at] = (found & 65535) * unit
        reader.narrow(n, start, share)
        reader.settle(n)
        model.learn(now)
        if t % _TURN == _TURN - 1 or t == steps - 1:
            k = t // _TURN * _TURN
            rows[:, k : t + 1] = turned[: t + 1 - k].T - 1
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    for k, o in enumerate(order):
        out[o] = rows[k, : sizes[k]]
    return out


def _shared_out(n: int) -> list[tuple[int, int]]:
    """Ranges of ``n`` blocks for equally many lanes, about ``LANES`` and at most half as many more."""
    parts = max(1, (2 * n + LANES) // (2 * LANES))
    return [(k * n // parts, (k + 1) * n // parts) for k in range(parts)]


class FileWriter:
    """Writes documents' ids in order; blocks are coded ``LANES`` at a time."""

    def __init__(self, out):
        self.out = out
        self.out.write(MAGIC)
        self.at = len(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.documents: list[tuple[int | str | None, int]] = []
        self.blocks: list[tuple[int, int]] = []  # bytes, ids

    def add(self, key: int | str | None, ids: np.ndarray) -> None:
        self.documents.append((key, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK * LANES * 3 // 2:  # so that the last blocks fill lanes too
            self._flush(False)

    def _flush(self, end: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        self.held = []
        whole = len(flat) if end else max(1, len(flat) // (BLOCK * LANES)) * BLOCK * LANES
        blocks = [flat[k : min(k + BLOCK, whole)] for k in range(0, whole, BLOCK)]
        for a, z in _shared_out(len(blocks)):
            some = blocks[a:z]
            for ids, raw in zip(some, encode_blocks(some)):
                self.out.write(raw)
                self.blocks.append((len(raw), len(ids)))
        self.held, self.n_held = [flat[whole:].copy()], len(flat) - whole

    def close(self) -> int:
        """The number of ids."""
        self._flush(True)
        index = zlib.compress(json.dumps({"documents": self.documents, "blocks": self.blocks}).encode(), 6)
        self.out.write(index + struct.pack("<II", len(index), zlib.crc32(index)) + MAGIC)
        return sum(n for _, n in self.documents)


def read_file(file) -> Iterator[tuple[int | str | None, np.ndarray]]:
    """(id, ids) of each document, in order."""
    size, tail = file.size(), 8 + len(MAGIC)
    end = file.read_at(tail, size - tail)
    n, crc = struct.unpack_from("<II", end)
    index = file.read_at(n, size - tail - n)
    if end[8:] != MAGIC or zlib.crc32(index) != crc:
        raise ValueError("damaged index")
    index = json.loads(zlib.decompress(index))
    documents = iter(index["documents"])
    at, held = len(MAGIC), np.zeros(0, np.uint32)
    key, wanted = next(documents, (None, None))
    blocks = index["blocks"]
    for first, last in _shared_out(len(blocks)):
        some = blocks[first:last]
        raw = file.read_at(sum(b for b, _ in some), at)
        at += len(raw)
        edges = np.cumsum([0, *(b for b, _ in some)]).tolist()
        held = np.concatenate([held, *decode_blocks([raw[a:z] for a, z in zip(edges, edges[1:])])])
        begin = 0
        while wanted is not None and len(held) - begin >= wanted:
            yield key, held[begin : begin + wanted]
            begin += wanted
            key, wanted = next(documents, (None, None))
        held = held[begin:]
    while wanted == 0:
        yield key, held[:0]
        key, wanted = next(documents, (None, None))
    if wanted is not None or len(held):
        raise ValueError("the file ends within a document")


def write_tokens(docs: DataFrame, path: str, end_id: int | None = 0, id_col: str = "doc_id", text: str = "text", documents_per_file: int = 20_000) -> DataFrame:
    """Encode and write all documents in ascending order of ids; gives ``file``, ``part`` (its place) and ``n_ids``."""
    spark = docs.sparkSession
    table = written(token_table(docs, path, end_id, id_col, text, keep=True), "tokens")
    parts = max(1, -(-table.count() // documents_per_file))
    folder = scratch(spark, "ids")
    kind_of = id_type(Tokenizer.from_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        forget()  # the texts are encoded
        release()
        part = TaskContext.get().partitionId()
        name = f"{folder}/ids-{part:06d}.lrc"
        with replacing(name) as out:
            writer, batch = FileWriter(out), first
            while batch is not None:
                for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    writer.add(key, np.frombuffer(raw, kind_of))
                batch = next(batches, None)
            n = writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([n], pa.int64())], names=["file", "part", "n_ids"])

    ranged = table.select("id", "ids").repartitionByRange(parts, "id").sortWithinPartitions("id", "ids")
    return written(ranged.mapInArrow(tidy(run), "file string, part bigint, n_ids bigint"), "manifest")


def read_tokens(manifest: DataFrame, id_kind: str = "bigint") -> DataFrame:
    """``id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (binary, unsigned 32-bit) from the files, a file to a task."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.select("part", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    spread = placed.repartitionByRange(max(1, manifest.count()), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                system, local = opened(name)
                with system.open_input_file(local) as file:
                    rows: list[tuple] = []
                    size = 0
                    for key, ids in read_file(file):
                        rows.append((None if key is None else str(key), at, len(ids), ids.astype("<u4").tobytes()))
                        at += len(ids)
                        size += len(ids)
                        if len(rows) == 2000 or size > ROWS_IDS:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    return spread.mapInArrow(tidy(run), "id string, start bigint, n_tokens bigint, ids binary").withColumn("id", F.col("id").cast(id_kind))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "start", "n_tokens", "ids"])
