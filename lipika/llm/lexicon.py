"""BPE encoding and decoding through a minimal acyclic transducer.

The corpus's most frequent words (counted over all documents, at most ``LEXICON_WORDS``)
are encoded once and compiled into an acyclic automaton over UTF-8 bytes in which equal
suffixes share their states. Each arc outputs a number; the sum along a word's path is the
word's place in a table of ids. The automaton is a few flat arrays in one file image, which
every worker maps into memory. Words that are not in it are merged exactly, pair by pair.

The tokenizer's rules (NFC, white space, lower case, words, byte symbols, end-of-word
suffix) follow its file. Texts that hold a special token's string or a zero byte, words
outside the Latin and punctuation blocks and very long words are given to the tokenizers
library.

Texts are cut at white space, all of a group of texts together in numpy. Each stretch is
encoded once and found again by its hash, up to ``REMEMBER`` stretches in flat arrays; the
bytes of what was found are compared with the text's, so that a hash two stretches share
changes nothing.

Defined results: a null text is empty. Ties and repeated rows are encoded row by row.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lipika.llm import flat as fl
from lipika.llm.tokens import SPACE, SPACE_CODES, byte_symbols
from lipika.llm.topk import most_frequent
from lipika.session import written

LEXICON_WORDS = 1 << 16
LONGEST = 64
#: Bytes of texts that are encoded together: what is new in them is encoded once.
GROUP = 1 << 21
#: Stretches that a worker remembers.
REMEMBER = 1 << 19
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(f"[{SPACE}]+")
#: Blocks whose letters and numbers every Unicode version knows alike.
_PLAIN = re.compile("[!-~\xa1-ɏ‐-‧‰-⁞]+\\Z")
# white space (and the zero byte after each text) among single bytes; longer ones by their first three bytes
_WHITE = np.zeros(256, bool)
_WHITE[[0, *(c for c in SPACE_CODES if c < 128)]] = True
_OUTER = [chr(c).encode() for c in SPACE_CODES if c > 127]
_LEAD = np.zeros(256, bool)
_LEAD[sorted({c[0] for c in _OUTER})] = True
_CODES = np.array([int.from_bytes(c.ljust(3, b"\0"), "big") for c in _OUTER], np.int32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.int32).max
_ARRAYS = ("first", "labels", "targets", "adds", "final", "offsets", "ids")


class WordBpe:
    """Exact encoding of single words by the file's merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: k for k, m in enumerate(merges)}
        self.suffix = model["end_of_word_suffix"] or ""
        words = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern, self.lines = regex.compile(words), regex.compile(f"\n|{words}")
        self.symbols = byte_symbols()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}

    def normal(self, text: str) -> str:
        """NFC and lower case. Capital sigma has one lower form, as in a mapping by character."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def chunks(self, normal: str) -> list[str]:
        """Stretches without white space."""
        if _SEPARATORS.search(normal):
            return [c for c in _SPACES.split(normal) if c]
        return normal.split()

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the pair of least rank is joined, the leftmost first, until none is left."""
        parts = [self.symbols[b] for b in word.encode("utf-8")]
        parts[-1] += self.suffix
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                r = ranks.get((parts[k], parts[k + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.vocab[p] for p in parts]

    @functools.cached_property
    def _pairs(self) -> tuple[fl.Table, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of ids numbered by rank, what each is joined to, and the ids of bytes inside and at the end of a word."""
        pairs = sorted(self.ranks, key=self.ranks.__getitem__)
        ids = np.array([(self.vocab[a], self.vocab[b]) for a, b in pairs], np.int64).reshape(-1, 2)
        table = fl.Table(len(pairs))
        table.add((ids[:, 0] << 32 | ids[:, 1]).astype(np.uint64) * _ODD)  # an odd factor: no two pairs share a key
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        return table, made, *(np.array([self.vocab[s + end] for s in self.symbols], np.int64) for end in ("", self.suffix))

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`merge` for many words, none empty: all ids one after another, and how many each has. A round joins one pair of each word."""
        table, made, inside, ending = self._pairs

        def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            found = table.find((left << 32 | right).astype(np.uint64) * _ODD)
            return np.where(found < 0, np.int32(_NONE), found)

        raw = [w.encode("utf-8") for w in words]
        count = np.fromiter(map(len, raw), np.int64, len(raw))
        data, last = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(count) - 1
        parts = inside[data]
        parts[last] = ending[data[last]]
        rank = np.full(len(parts), _NONE, np.int32)
        rank[:-1] = ranked(parts[:-1], parts[1:])
        rank[last] = _NONE
        word, done = np.arange(len(words)), []
        while len(word):
            least = np.minimum.reduceat(rank, np.cumsum(count) - count)
            going = least < _NONE
            if not going.all():
                live = np.repeat(going, count)
                done.append((word[~going], count[~going], parts[~live]))
                parts, rank = parts[live], rank[live]
                word, count, least = word[going], count[going], least[going]
            if not len(word):
                break
            at = np.flatnonzero(rank == np.repeat(least, count))
            owner = np.repeat(np.arange(len(word)), count)[at]
            at = at[np.append(True, owner[1:] != owner[:-1])]  # the leftmost in each word
            first = np.cumsum(count) - count
            parts[at] = made[least]
            more, before = at[at + 2 < first + count], at[at > first]
            rank[at] = _NONE
            rank[more] = ranked(parts[more], parts[more + 2])
            rank[before - 1] = ranked(parts[before - 1], parts[before])
            stay = np.ones(len(parts), bool)
            stay[at + 1] = False
            parts, rank, count = parts[stay], rank[stay], count - 1
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, count, parts = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word)
        return parts[fl.spread((np.cumsum(count) - count)[order], count[order])], count[order]


def compile_lexicon(words: Iterable[str], ids: Iterable[list[int]]) -> bytes:
    """The file image of the automaton of distinct words and their ids."""
    entries = sorted((w.encode("utf-8"), i) for w, i in zip(words, ids))
    # states as dictionaries of arcs; equal finished states are one (a register of what they hold)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (state, byte, next state) along the last word

    def finish(keep: int) -> None:
        while len(path) > keep:
            state, byte, child = path.pop()
            signature = (final[child], tuple(sorted(arcs[child].items())))
            arcs[state][byte] = register.setdefault(signature, child)

    last = b""
    for word, _ in entries:
        shared = next((k for k, (x, y) in enumerate(zip(word, last)) if x != y), min(len(word), len(last)))
        finish(shared)
        state = path[-1][2] if path else 0
        for byte in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte, len(arcs) - 1))
            state = len(arcs) - 1
        final[state] = True
        last = word
    finish(0)
    # number the reachable states; count the words below each (children come first)
    place, order, stack = {0: 0}, [0], [0]
    while stack:
        for child in arcs[stack.pop()].values():
            if child not in place:
                place[child] = len(order)
                order.append(child)
                stack.append(child)
    below: dict[int, int] = {}
    todo = [0]
    while todo:
        state = todo[-1]
        waiting = [c for c in arcs[state].values() if c not in below]
        if waiting:
            todo += waiting
            continue
        below[state] = final[state] + sum(below[c] for c in arcs[state].values())
        todo.pop()
    first, labels, targets, adds = [0], [], [], []
    for state in order:
        before = int(final[state])
        for byte, child in sorted(arcs[state].items()):
            labels.append(byte)
            targets.append(place[child])
            adds.append(before)
            before += below[child]
        first.append(len(labels))
    sizes = np.cumsum([0, *(len(i) for _, i in entries)])
    arrays = {
        "first": np.array(first, np.int32),
        "labels": np.array(labels, np.uint8),
        "targets": np.array(targets, np.int32),
        "adds": np.array(adds, np.int32),
        "final": np.array([final[s] for s in order], np.uint8),
        "offsets": sizes.astype(np.int32),
        "ids": np.array([x for _, i in entries for x in i], np.uint32),
    }
    head = json.dumps([[k, arrays[k].dtype.str, len(arrays[k])] for k in _ARRAYS]).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(arrays[k].tobytes() for k in _ARRAYS)


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            size = int.from_bytes(f.read(4), "little")
            layout = json.loads(f.read(size))
        image, at = np.memmap(path, np.uint8, "r"), 4 + size
        for name, kind, n in layout:
            width = np.dtype(kind).itemsize
            setattr(self, name, image[at : at + n * width].view(kind) if at % width == 0 else np.frombuffer(image[at : at + n * width].tobytes(), kind))
            at += n * width
        owners = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first))
        self.arcs = owners << 8 | self.labels  # sorted: states in order, their labels too

    @classmethod
    def from_image(cls, image: bytes) -> Lexicon:
        """Maps a temporary file that needs no name once it is mapped."""
        fd, path = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(image)
            return cls(path)
        finally:
            os.unlink(path)

    def places(self, words: list[str]) -> np.ndarray:
        """Each word's place in the table, or -1: all words walk the automaton together, a byte a step."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(sizes) - sizes
        state, out = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        alive = np.flatnonzero(sizes > 0) if len(self.arcs) else np.zeros(0, np.int64)
        ended = np.zeros(len(raw), bool)
        step = 0
        while len(alive):
            wanted = state[alive] << 8 | flat[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            ok = self.arcs[at] == wanted
            alive, at = alive[ok], at[ok]
            out[alive] += self.adds[at]
            state[alive] = self.targets[at]
            step += 1
            over = sizes[alive] == step
            ended[alive[over]] = self.final[state[alive[over]]] == 1
            alive = alive[~over]
        return np.where(ended, out, -1)

    def lookup(self, words: list[str]) -> list[list[int] | None]:
        at = self.places(words)
        return [None if k < 0 else self.ids[self.offsets[k] : self.offsets[k + 1]].tolist() for k in at.tolist()]


def _inserted(ids: np.ndarray, count: np.ndarray, places: list[int], more: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive lists of ids (``count`` of each) with other lists in the places of empty ones."""
    if not places:
        return ids, count
    sizes = np.fromiter(map(len, more), np.int64, len(more))
    ids = np.insert(ids, np.repeat((np.cumsum(count) - count)[places], sizes), [x for i in more for x in i])
    count = count.copy()
    count[places] = sizes
    return ids, count


class Runs(fl.Lists):
    """Lists that are given one after another in one array."""

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        if self.n + len(sizes) > len(self.first):
            room = max(2 * len(self.first), self.n + len(sizes))
            self.first, self.count = np.resize(self.first, room), np.resize(self.count, room)
        total = int(sizes.sum())
        if self.used + total > len(self.pool):
            self.pool = np.resize(self.pool, max(3 * len(self.pool) // 2, self.used + total))
        self.first[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.count[self.n : self.n + len(sizes)] = sizes
        self.pool[self.used : self.used + total] = flat
        self.n, self.used = self.n + len(sizes), self.used + total


class Codec:
    """Encoder and decoder of whole texts: automaton first, exact merges for the rest; a bounded memory of stretches."""

    def __init__(self, path: str, lexicon: Lexicon, remember: int = REMEMBER):
        self.bpe = WordBpe(path)
        self.lexicon = lexicon
        self.remember = remember
        self.special = [s.encode("utf-8") for s in self.bpe.special]
        self.table, self.lists, self.raw = fl.Table(remember), Runs("<u4"), Runs("u1")
        size = max(self.bpe.tokens) + 1
        texts = [self.bpe.tokens.get(i, "") for i in range(size)]
        self.size, self.texts = size, pa.array([*(" " + t for t in texts), *texts], pa.string())  # within a text, and as its first

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """As the library without a decoder, the tokens with single spaces between; ``ends`` are the texts' among all ids."""
        which, first = ids.astype(np.int32), np.append(0, ends[:-1])[: len(ends)]
        which[first[first < ends]] += self.size
        found = self.texts.take(pa.array(which))
        _, offsets, data = found.buffers()
        edges = np.frombuffer(offsets, np.int32)[found.offset : found.offset + len(found) + 1]
        return pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(edges[np.append(0, ends)]), data])

    def _library(self, text: str) -> list[int]:
        return self.bpe.library.encode(text, add_special_tokens=False).ids

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and where in it each word's begin and how many they are."""
        at = self.lexicon.places(words)
        known = at >= 0
        first, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[known] = self.lexicon.offsets[at[known]]
        count[known] = self.lexicon.offsets[at[known] + 1] - first[known]
        rest = np.flatnonzero(~known).tolist()
        long = [k for k in rest if len(words[k]) > LONGEST]
        merged = [k for k in rest if len(words[k]) <= LONGEST]
        ids, sizes = self.bpe.merge_all([words[k] for k in merged])
        whole = [self._library(words[k]) for k in long]
        count[merged], count[long] = sizes, [len(i) for i in whole]
        first[merged + long] = len(self.lexicon.ids) + np.cumsum(count[merged + long]) - count[merged + long]
        return np.concatenate([self.lexicon.ids, ids.astype(np.uint32), np.array([x for i in whole for x in i], np.uint32)]), first, count

    def _encode_new(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches one after another, and how many each has; they are cut into words as the lines of one text."""
        new = [self.bpe.normal(c) for c in new]
        other = [k for k, c in enumerate(new) if not _PLAIN.match(c)]
        lines = new.copy()
        for k in other:
            lines[k] = ""
        number = {"\n": 0}
        at = np.array([number.setdefault(w, len(number)) for w in self.bpe.lines.findall("\n".join(lines))], np.int64)
        ids, first, count = self._words(list(number)[1:])
        first, count = np.append(0, first), np.append(0, count)
        stops = np.cumsum(count[at])
        ends = np.append(stops[at == 0], stops[-1:])
        if not len(stops):  # one line without words
            ends = np.zeros(len(new), np.int64)
        return _inserted(ids[fl.spread(first[at], count[at])], np.diff(ends, prepend=0), other, [self._library(new[k]) for k in other])

    def _odd(self, flat: np.ndarray, marks: np.ndarray) -> list[int]:
        """Numbers of the texts that go to the library whole."""
        places = np.setdiff1d(np.flatnonzero(flat == 0), marks).tolist()
        raw = flat.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                places.append(at)
                at = raw.find(s, at + 1)
        return np.unique(np.searchsorted(marks, places, "left")).tolist() if places else []

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's end; no text may be null."""
        flat, marks = fl.joined(texts)
        odd = self._odd(flat, marks)
        if odd:
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            ids, ends = self.encode(pc.if_else(pa.array(mask), "", texts))
            ids, count = _inserted(ids, np.diff(ends, prepend=0), odd, [self._library(texts[k].as_py()) for k in odd])
            return ids, np.cumsum(count)
        lead = np.flatnonzero(_LEAD[flat])
        if len(lead):
            two = flat[lead] < 0xE0
            code = flat[lead].astype(np.int32) << 16 | flat[lead + 1].astype(np.int32) << 8 | np.where(two, 0, flat[lead + 2])
            white = np.isin(code, _CODES)
            at, two = lead[white], two[white]
            flat[at] = flat[at + 1] = 32
            flat[at[~two] + 2] = 32
        starts, ends = fl.words(flat, _WHITE)
        ids, stops, k = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        while k < len(starts):  # a long text in parts
            z = max(k + 1, int(np.searchsorted(ends, starts[k] + 2 * GROUP, "right")))
            a = starts[k]
            i, s = self._pieces(flat[a : ends[z - 1]], starts[k:z] - a, ends[k:z] - a)
            ids.append(i)
            stops.append(stops[-1][-1] + s)
            k = z
        return np.concatenate(ids), np.concatenate(stops)[np.searchsorted(starts, marks)]

    def _pieces(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches of an array, and where each's end."""
        h = fl.hashes(flat, starts, ends)
        number = self.table.find(h).astype(np.int64)
        long = ends - starts > fl.LONGEST
        number[long] = -1
        missing = np.flatnonzero(number < 0)
        base, fresh = self.lists.n, h[:0]
        if len(missing):
            short, rest = missing[~long[missing]], missing[long[missing]]
            fresh, first, back = np.unique(h[short], return_index=True, return_inverse=True)
            at = np.concatenate([short[first], rest])
            self.lists.extend(*self._encode_new(fl.strings(flat, starts[at], ends[at])))
            self.raw.extend(flat[fl.spread(starts[at], ends[at] - starts[at])], ends[at] - starts[at])
            number[short] = base + back
            number[rest] = base + len(fresh) + np.arange(len(rest))
        same = np.array_equal(self.raw.count[number], ends - starts) and np.array_equal(self.raw.gather(number)[0], flat[~_WHITE[flat]])
        found = self.lists.gather(number) if same else None
        kept = base + self.table.add(fresh[: max(0, self.remember - self.table.n)])  # what came first is met most often
        self.lists.keep(kept)
        self.raw.keep(kept)
        return found or self._one_by_one(fl.strings(flat, starts, ends))

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches known by themselves, where hashes are not enough."""
        number: dict[str, int] = {}
        at = np.array([number.setdefault(p, len(number)) for p in pieces], np.int64)
        ids, count = self._encode_new(list(number))
        return ids[fl.spread((np.cumsum(count) - count)[at], count[at])], np.cumsum(count[at])

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        ids, ends = self.encode(pa.array([t or "" for t in texts], pa.string()))
        return list(zip(fl.binary(ids, ends).to_pylist(), self.decode(ids, ends).to_pylist()))


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``word``, ``n`` over all documents: counted in each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = [(w, n) for c, n in counts.items() if _PLAIN.match(c) for w in bpe.pattern.findall(c)]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(bpe.chunks(bpe.normal(t)))
            if len(counts) > 200_000:
                yield out()
        yield out()

    return docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


_BPES: dict[str, WordBpe] = {}


def _bpe(path: str) -> WordBpe:
    if path not in _BPES:
        _BPES[path] = WordBpe(path)
    return _BPES[path]


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(path: str, image: bytes) -> Codec:
    key = (path, hashlib.md5(image).hexdigest())
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(path, Lexicon.from_image(image))
    return _CODECS[key]


def build(docs: DataFrame, path: str, text: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """The lexicon image of the corpus's most frequent words (of those met twice); at most ``size`` words reach the driver."""
    counts = written(word_counts(docs, path, text).filter("n > 1"), "words")
    top = most_frequent(counts, size, "word").select("word").toPandas()["word"].tolist()
    bpe = _bpe(path)
    words = [w for w in top if len(w) <= LONGEST]
    return compile_lexicon(words, [bpe.merge(w) for w in words])


def encode(docs: DataFrame, path: str, image: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids`` (binary, unsigned 32-bit) and ``decoded`` of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(image)  # a few MB: at most LEXICON_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, shared.value)
        for batch in batches:
            at = 0
            for texts in fl.groups(batch.column(1), GROUP):
                ids, ends = codec.encode(texts)
                n = pa.array(np.diff(ends, prepend=0), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), n, fl.binary(ids, ends), codec.decode(ids, ends)], names=["id", "n_tokens", "ids", "decoded"])
                at += len(texts)

    id_name = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"id {id_name}, n_tokens bigint, ids binary, decoded string").withColumnRenamed("id", id_col)
