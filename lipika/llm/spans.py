"""Substring deduplication over sliding runs of sentences.

A text is cut into sentences; a sentence of over ``LONG`` words is cut further after words
chosen by their own hash, so that the same passage is cut alike wherever it stands. From
each sentence on, and back from each, the run of the fewest consecutive sentences is hashed
that has ``run`` of them and ``min_words`` words; so short sentences make longer runs, and
the first and the last sentences of a passage are in some run inside it. The hashes meet in
one global count. A run that has occurred before, in the order of ids and positions, marks
all its sentences, and marked sentences are removed.

Defined results: a null text stays null and a blank one stays as it is. A text of fewer
than ``run`` sentences is one run. Rows with equal id and text are one occurrence, so
neither is cut because of the other; null ids come last in the order. All other columns
are passed through, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.columns import free_name
from lipika.llm.flat import release, slices, tidy
from lipika.session import written

LONG = 20
_END = re.compile(r"[.!?]+\s+|\n\s*")
_WORD = re.compile(r"\S+")


def sentences(text: str, long: int | None = LONG) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence; together they cover the text. Those of over ``long`` words are cut further (None: never)."""
    out: list[tuple[int, int, list[str]]] = []
    at = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        words = text[at:end].split()
        if not words and out:
            out[-1] = (out[-1][0], end, out[-1][2])
            at = end
        elif words and long and len(words) > long:
            first, begin = 0, at
            for k, m in enumerate(_WORD.finditer(text, at, end)):
                if k + 1 < len(words) and zlib.crc32(words[k].encode("utf-8", "replace")) & 7 == 0:
                    out.append((begin, m.end(), words[first : k + 1]))
                    first, begin = k + 1, m.end()
            out.append((begin, end, words[first:]))
            at = end
        elif words:
            out.append((at, end, words))
            at = end
    return out


def spans_of(sizes: list[int], run: int, min_words: int) -> list[tuple[int, int]]:
    """(first, end) of the runs to hash: from each sentence on, and back from each, the fewest that are enough."""
    n = len(sizes)
    run = min(run, n)
    total = [0]
    for k in sizes:
        total.append(total[-1] + k)
    out, end, first = set(), 0, 0
    for k in range(n):
        end = max(end, k + run)
        while end <= n and total[end] - total[k] < min_words:
            end += 1
        if end <= n:
            out.add((k, end))
        stop = k + 1
        while first + 1 <= stop - run and total[stop] - total[first + 1] >= min_words:
            first += 1
        if stop >= run and total[stop] - total[first] >= min_words:
            out.add((first, stop))
    return sorted(out)


def span_hashes(text: str | None, run: int, min_words: int, long: int | None = LONG) -> list[tuple[int, int, int]]:
    """(position, sentences, hash) of each run."""
    cut = sentences(text, long) if text else []
    joined = [" ".join(s[2]) for s in cut]
    out = []
    for a, z in spans_of([len(s[2]) for s in cut], run, min_words):
        h = xxhash.xxh64_intdigest(" ".join(joined[a:z]).encode("utf-8", "replace"))
        out.append((a, z - a, h - (1 << 64) if h >> 63 else h))
    return out


def run_hashes(text: str | None, run: int, min_words: int) -> list[tuple[int, int]]:
    """(position, hash) of pieces of ``run`` sentences that together cover each run; a longer run has several."""
    out = []
    for at, n, h in span_hashes(text, run, min_words):
        for k in sorted({*range(0, n - run, run), max(0, n - run)}):
            out.append((at + k, h if n <= run else xxhash.xxh64_intdigest(b"%d %d" % (h, k)) - (1 << 63)))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run: int = 2, min_words: int = 12, long: int | None = LONG) -> DataFrame:
    """The frame with repeated sentences cut from ``text``, and ``removed``: array of (start, end) in the old text."""
    row = free_name(docs, "row_key")
    keyed = docs.withColumn(row, F.xxhash64(F.col(text)))  # with the id, a row's key
    id_type = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, rows, at, ns, hs = [], [], [], [], []
            for i, r, t in zip(*(c.to_pylist() for c in batch.columns)):
                found = span_hashes(t, run, min_words, long)
                ids += [i] * len(found)
                rows += [r] * len(found)
                at += [x[0] for x in found]
                ns += [x[1] for x in found]
                hs += [x[2] for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(rows, pa.int64()), pa.array(at, pa.int32()), pa.array(ns, pa.int32()), pa.array(hs, pa.int64())], names=["id", "row", "at", "n", "h"]
            )

    runs = written(keyed.select(id_col, row, text).mapInArrow(tidy(hashed), f"id {id_type}, row bigint, at int, n int, h bigint"), "runs")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "at")
    repeated = written(runs.groupBy("h").agg(F.count("*").alias("times"), F.min(place).alias("first")).filter("times > 1"), "repeated")
    # runs that make up a thousandth of all each are a thousand at most: they are broadcast, so no task gets all rows of one
    hot = F.col("times") >= max(1000, runs.count() // 1000)
    few, rest = F.broadcast(repeated.filter(hot)), repeated.filter(~hot)
    met = runs.join(few, "h").unionByName(runs.join(few, "h", "left_anti").join(rest, "h"))
    later = met.filter(~place.eqNullSafe(F.col("first"))).select("id", "row", "at", "n")
    marks = later.groupBy("id", "row").agg(F.collect_set(F.struct("at", "n")).alias("at"))  # at most twice a document's sentences

    first_mark, out_text, out_removed = free_name(docs, "marks"), free_name(docs, "new_text"), free_name(docs, "removed")
    id_mark, row_mark = free_name(docs, "marked_id"), free_name(docs, "marked_row")
    marks = marks.select(F.col("id").alias(id_mark), F.col("row").alias(row_mark), F.col("at").alias(first_mark))
    joined = keyed.join(marks, keyed[id_col].eqNullSafe(F.col(id_mark)) & (F.col(row) == F.col(row_mark)), "left")
    span = "struct<start:int,end:int>"

    @F.pandas_udf(f"struct<t:string,r:array<{span}>>")
    def cut(texts, marks):
        import pandas as pd

        new, removed = [], []
        for t, at in zip(texts, marks):
            if t is None or at is None or not len(at):
                new.append(t)
                removed.append([])
                continue
            parts = sentences(t, long)
            gone = sorted({k for a in at for k in range(a["at"], a["at"] + a["n"])})
            lost = set(gone)
            new.append("".join(t[a:z] for k, (a, z, _) in enumerate(parts) if k not in lost))
            merged: list[dict] = []
            for k in gone:
                a, z, _ = parts[k]
                if merged and merged[-1]["end"] == a:
                    merged[-1]["end"] = z
                else:
                    merged.append({"start": a, "end": z})
            removed.append(merged)
        release()
        return pd.DataFrame({"t": new, "r": removed})

    done = joined.withColumn(out_text, cut(F.col(text), F.col(first_mark)))
    columns = [F.col(f"{out_text}.t").alias(c) if c == text else F.col(c) for c in docs.columns]
    return done.select(*columns, F.col(f"{out_text}.r").alias(out_removed))
