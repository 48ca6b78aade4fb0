"""Exact byte-level BPE encoding with a tokenizers file, at the cost of one lookup a piece.

The file's pre-tokenizer never joins text across white space except for one leading space,
nor an ASCII letter or digit to a mark after it, so texts are cut there, all of a group of
texts together in numpy. Each piece is encoded once and remembered by its hash, up to
``REMEMBER`` pieces in flat arrays (some 30 MB); beyond that pieces are encoded again in
each group. Texts that hold a special token's string, a zero byte or white space beyond
ASCII go to the tokenizers library whole.

Pieces of letters that every Unicode version knows alike are merged by tiktoken from the
same file's ranks where :func:`ranks` proves that this gives the same ids, others by the
tokenizers library.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lipika.llm import flat as fl
from lipika.llm.flat import tidy

#: White space of the pre-tokenizer's patterns, as code points.
SPACE_CODES = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE = "".join(map(chr, SPACE_CODES))
REMEMBER = 1 << 19
_OUTER = re.compile(b"|".join(re.escape(chr(c).encode()) for c in SPACE_CODES if c > 127))
#: Blocks whose letters and numbers every Unicode version knows alike.
PLAIN = "!-~\xa1-\u024f\u2010-\u2027\u2030-\u205e"
_KNOWN = re.compile(f" ?[{PLAIN}]+")
_ALL_KNOWN = re.compile(f" ?[{PLAIN}]++(?:\n ?[{PLAIN}]++)*+")
#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# classes of bytes
_WHITE, _PLAIN, _MARK, _LEAD = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[c for c in SPACE_CODES if c < 128]] = _WHITE
_CLASS[[c for c in range(128) if chr(c).isalnum()]] = _PLAIN
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = _MARK
_CLASS[sorted({chr(c).encode()[0] for c in SPACE_CODES if c > 127})] = _LEAD


def cut(flat: np.ndarray) -> np.ndarray:
    """Where pieces start; zero bytes are pieces of their own."""
    kind = _CLASS[flat]
    white, zero = kind == _WHITE, flat == 0
    solid = ~(white | zero)
    starts = zero.copy()
    starts[:1] = True
    starts[1:] |= zero[:-1] | (white[1:] & ~white[:-1])  # texts, and white space
    starts[:-1] |= white[:-1] & solid[1:]  # the last of the white space: a space goes with the word after it
    starts[1:] |= solid[1:] & white[:-1] & (flat[:-1] != 32)
    starts[1:] |= (kind[1:] == _MARK) & (kind[:-1] == _PLAIN)
    return np.flatnonzero(starts)


def byte_symbols() -> list[str]:
    """The printable character for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = [""] * 256, 0
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + n)
            n += 1
    return table


@functools.lru_cache(2)
def ranks(path: str) -> dict[bytes, int] | None:
    """The file's tokens as bytes with their ids, if joining the pair whose token has the least id is the file's own rule.

    That holds if the merges' tokens have rising ids, are all tokens but the single bytes, and
    each token by itself is merged into one: then, when a pair's token has the least id of all,
    what stands in its place is what the token alone has before its last merge, so the pair is
    that merge's.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cuts = spec["model"], spec["pre_tokenizer"]
    symbols = byte_symbols()
    back = {s: b for b, s in enumerate(symbols)}
    made = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    alone = {model["vocab"].get(s) for s in symbols}
    plain = cuts["type"] == "ByteLevel" and cuts["use_regex"] and not cuts["add_prefix_space"] and spec["normalizer"] is None
    if not plain or None in made or None in alone or made != sorted(set(made)) or set(made) | alone != set(model["vocab"].values()) or max(alone) >= made[0]:
        return None
    merge = Tokenizer.from_file(path).model.tokenize
    if any(len(merge(t)) != 1 for t in model["vocab"]):
        return None
    return {bytes(back[c] for c in t): k for t, k in model["vocab"].items()}


class ByteEncoder:
    """Encodes texts into ids, as the tokenizers library does without special tokens; ``end_id`` follows each text."""

    def __init__(self, path: str, end_id: int | None = None, remember: int = REMEMBER, ranked: dict[bytes, int] | None = None):
        self.ranked = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranked, special_tokens={}) if ranked else None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = id_type(self.tokenizer)
        self.end = np.array([] if end_id is None else [end_id], self.kind)
        self.line_feed = int(self._whole("\n")[0])
        self.table, self.lists = fl.Table(remember), fl.Lists(self.kind)
        zero = np.zeros(1, np.uint8)
        self.table.add(fl.hashes(zero, np.array([0]), np.array([1])))
        self.lists.add([self.end])  # what ends a text

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _encode_new(self, new: list[str]) -> list[np.ndarray]:
        """Pieces without line feeds are encoded as the lines of one text."""
        found: list[np.ndarray] = [self.end] * len(new)
        by_rank, by_library = [], []
        if self.ranked and _ALL_KNOWN.fullmatch("\n".join(new)):  # as most often
            by_rank = list(range(len(new)))
        for k, p in enumerate(new if not by_rank else ()):
            if self.ranked and _KNOWN.fullmatch(p):
                by_rank.append(k)
            elif "\n" in p or p.isspace():
                found[k] = self._whole(p)
            else:
                by_library.append(k)
        library = lambda text: self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        for places, whole in ((by_rank, self.ranked and self.ranked.encode_ordinary), (by_library, library)):
            for at in range(0, len(places), 20_000):
                some = places[at : at + 20_000]
                ids = np.array(whole("\n".join([new[k] for k in some])), self.kind)
                edges = [-1, *np.flatnonzero(ids == self.line_feed).tolist(), len(ids)]
                for j, k in enumerate(some):
                    found[k] = ids[edges[j] + 1 : edges[j + 1]] if len(edges) == len(some) + 1 else self._whole(new[k])
        return found

    def _odd(self, flat: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Numbers of the texts that go to the library whole."""
        places = []
        raw = None
        if (flat == 0).sum() > len(marks):
            places += np.setdiff1d(np.flatnonzero(flat == 0), marks).tolist()
        if (_CLASS[flat] == _LEAD).any():
            raw = flat.tobytes()
            places += [m.start() for m in _OUTER.finditer(raw)]
        for s in self.special:
            if (flat == s[0]).any():
                raw = flat.tobytes() if raw is None else raw
                at = raw.find(s)
                while at >= 0:
                    places.append(at)
                    at = raw.find(s, at + 1)
        return np.unique(np.searchsorted(marks, places, "left")) if places else np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's end; no text may be null."""
        flat, marks = fl.joined(texts)
        odd = self._odd(flat, marks)
        if len(odd):
            return self._with_odd(texts, odd.tolist())
        starts = cut(flat)
        ends = np.append(starts[1:], len(flat))
        h = fl.hashes(flat, starts, ends)
        number = self.table.find(h).astype(np.int64)
        long = ends - starts > fl.LONGEST
        number[long] = -1
        missing = np.flatnonzero(number < 0)
        base = self.lists.n
        if len(missing):
            short = missing[~long[missing]]
            new, first, back = np.unique(h[short], return_index=True, return_inverse=True)
            rest = missing[long[missing]]
            at = np.concatenate([short[first], rest])
            self.lists.add(self._encode_new(fl.strings(flat, starts[at], ends[at])))
            number[short] = base + back
            number[rest] = base + len(new) + np.arange(len(rest))
        ids, stops = self.lists.gather(number)
        if len(missing):
            self.lists.keep(base + self.table.add(new))
        return ids, stops[flat[starts] == 0]

    def _with_odd(self, texts: pa.Array, odd: list[int]) -> tuple[np.ndarray, np.ndarray]:
        parts, sizes, at = [], [], 0
        for k in [*odd, len(texts)]:
            if k > at:
                ids, ends = self.encode(texts.slice(at, k - at))
                parts.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            if k < len(texts):
                ids = np.concatenate([self._whole(texts[k].as_py()), self.end])
                parts.append(ids)
                sizes.append([len(ids)])
            at = k + 1
        return np.concatenate(parts), np.cumsum(np.concatenate(sizes).astype(np.int64))


#: A worker's encoder for the tasks of one table (its key), so that what it remembers is not learnt again by each.
_KEPT: dict[str, ByteEncoder] = {}


def kept(name: str, make: Callable[[], ByteEncoder]) -> ByteEncoder:
    """The encoder of a table in this worker; one that another table left is let go."""
    if name not in _KEPT:
        forget()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Let go of the encoder that a table with ``keep`` left in this worker."""
    _KEPT.clear()


def token_table(docs: DataFrame, path: str, end_id: int | None = 0, id_col: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """``id`` (the id column), ``n`` (long) and ``ids`` (binary: little-endian unsigned 16-bit where all ids fit, else 32-bit).

    ``end_id`` is appended to each document. A null text is empty. With ``keep``, workers keep their
    encoder after a task, until another table's or :func:`forget`, and it remembers twice as many pieces.
    """

    ranked = docs.sparkSession.sparkContext.broadcast(ranks(path))  # of the vocabulary's size
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda: ByteEncoder(path, end_id, 2 * REMEMBER if keep else REMEMBER, ranked.value)
        encoder = kept(name, make) if keep else make()  # or its memory goes with the task
        for batch in batches:
            at = 0
            for texts in fl.groups(batch.column(1)):
                ids, ends = encoder.encode(texts)
                n = pa.array(np.diff(ends, prepend=0), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), n, fl.binary(ids, ends)], names=["id", "n", "ids"])
                at += len(texts)

    id_name = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), f"id {id_name}, n bigint, ids binary")


def id_type(tokenizer: Tokenizer) -> str:
    """How ids are stored."""
    return "<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
