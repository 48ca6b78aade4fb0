"""Language identification with interpolated Kneser-Ney character models.

Training counts character 4-grams (lower case; anything but letters and marks is one space)
of the labelled rows for each language. The highest order uses these counts, each lower
order continuation counts (how many characters precede a gram), and every order is
interpolated with the one below by absolute discounting. All of that - counts, continuation
counts, contexts' totals and discounts - is taken in Spark over all grams. The model is kept
as sorted arrays of 64-bit gram keys and read by binary search. A text gets the language
whose model has the least cross-entropy per character.

Rejection is calibrated on rows that the counts have not seen: about ``CALIBRATION_ROWS``, a tenth at
most, chosen by the hash of id and text. A language's limit is the 99.9 % quantile of their
cross-entropy and a quarter of a bit; labels of fewer than ``LEAST_ROWS`` rows are learned
from all of these and have no limit.

Bounds: more than ``MAX_LANGUAGES`` labels are an error. Up to ``MAX_GRAMS`` grams of each
order, shared among the languages, are arrays in memory (four languages of the test tables
have 15,000 each). A language with more has all its arrays of that order in files of the
shared folder, sorted by Spark; workers map them and search them just the same. Memory is
then bounded and no gram is left out. Only the tabulated probabilities are limited to the
most frequent grams; others are computed when a text has them.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is not
rejected. Without labelled rows everything is ``und``. Rows without label are not learned
from. Repeated rows count as often as they occur. Other columns are not read.
"""

from __future__ import annotations

import math
import posixpath
import shutil
import tempfile
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipika.columns import free_name
from lipika.llm.files import opened, replacing
from lipika.llm.flat import release, release_driver, slices, tidy
from lipika.llm.topk import most_frequent
from lipika.session import scratch, written

ORDER = 4
MAX_LANGUAGES = 64
MAX_GRAMS = 400_000
CALIBRATION_ROWS = 20_000
#: Labels with fewer rows are learned from all of them and reject nothing.
LEAST_ROWS = 1000
UNKNOWN = "und"
_SYMBOLS = 1 << 16
_CHUNK = 1 << 18
_LETTER: list[np.ndarray] = []


def symbols(text: str | None) -> np.ndarray:
    """The text as 16-bit symbols: letters and their marks in lower case, single spaces for all else; code points beyond 16 bits share the 6,400 private ones."""
    if not text:
        return np.zeros(0, np.uint64)
    if not _LETTER:
        _LETTER.append(np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)]))
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _LETTER[0][cp]
    if not letter.any():
        return np.zeros(0, np.uint64)
    out = np.where(letter, np.where(cp < _SYMBOLS, cp, 0xE000 + cp % 6400), 32)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return out[keep].astype(np.uint64)


def grams(text: str | None) -> np.ndarray:
    """Keys of the 4-grams, one for each symbol; three spaces stand before the text."""
    s = symbols(text)
    if not len(s):
        return s
    p = np.concatenate([np.full(ORDER - 1, 32, np.uint64), s])
    n = len(s)
    return (p[:n] << np.uint64(48)) | (p[1 : n + 1] << np.uint64(32)) | (p[2 : n + 2] << np.uint64(16)) | p[3 : n + 3]


def gram_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """``lang``, ``gram`` (the key as signed long), ``n`` over all rows with a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def flush(name: str) -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held.pop(name)), return_counts=True)
            size[name] = 0
            return pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        for batch in slices(batches):
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = grams(t)
                if len(g):
                    held.setdefault(name, []).append(g)
                    size[name] = size.get(name, 0) + len(g)
                    if size[name] >= 4 * _CHUNK:
                        yield flush(name)
        for name in list(held):
            yield flush(name)

    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), text)
    return rows.mapInArrow(tidy(run), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


#: The arrays of a level in files, as they stand in its tuple.
_PARTS = {"keys": "<u8", "counts": "<f8", "contexts": "<u8", "totals": "<f8", "kinds": "<f8"}


def _mapped(uri: str, kind: str) -> np.ndarray:
    """A file's values, mapped: where it lies, or from a copy that goes when the process ends."""
    system, path = opened(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with tempfile.NamedTemporaryFile(prefix="lipika-grams-") as copy:
        with system.open_input_stream(path, compression=None) as source:
            shutil.copyfileobj(source, copy, 1 << 20)
        copy.flush()
        return np.memmap(copy.name, kind, "r")


def _stored(rows: DataFrame) -> str:
    """Write the arrays of one language and order; the folder's URI. ``rows``: ``gram``, ``n``, ``context``, ``total``, ``kinds``."""
    folder = scratch(rows.sparkSession, "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, size = None, 0
        with replacing(f"{folder}/keys") as keys, replacing(f"{folder}/counts") as counts, replacing(f"{folder}/contexts") as contexts, replacing(f"{folder}/totals") as totals, replacing(f"{folder}/kinds") as kinds:
            for batch in batches:
                gram, n, context, total, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
                first = np.ones(len(gram), bool)
                first[1:] = context[1:] != context[:-1]
                if len(gram):
                    first[0] = last is None or context[0] != last
                    last = context[-1]
                size += len(gram)
                keys.write(gram.tobytes())
                counts.write(n.astype("<f8").tobytes())
                contexts.write(context[first].tobytes())
                totals.write(total[first].astype("<f8").tobytes())
                kinds.write(kind[first].astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["n"])

    # keys are unsigned
    ordered = rows.select("gram", "n", "context", "total", "kinds").repartition(1).sortWithinPartitions(F.col("gram") < 0, "gram")
    ordered.mapInArrow(tidy(run), "n bigint").collect()  # one row
    return folder


@dataclass
class KneserNey:
    """One language: for each order, from the highest, sorted keys with counts, sorted contexts with totals and distinct successors, and the discount."""

    levels: list[tuple] = field(default_factory=list)
    #: Folders of the levels that are mapped files, by their place; these travel as their names.
    files: dict[int, str] = field(default_factory=dict)
    #: The grams to tabulate, where these are not all of the highest order.
    frequent: np.ndarray | None = None

    def add(self, order: int, folder: str, discount: float) -> None:
        """A level whose arrays are in files."""
        self.files[len(self.levels)] = folder
        self.levels.append((order, *(_mapped(posixpath.join(folder, x), kind) for x, kind in _PARTS.items()), discount))

    def __reduce__(self):
        return _assembled, ([(v[0], self.files[k], v[6]) if k in self.files else v for k, v in enumerate(self.levels)], self.frequent)

    @classmethod
    def of_counts(cls, keys: np.ndarray, counts: np.ndarray) -> KneserNey:
        """From all grams of a small corpus."""
        out = cls()
        for order in range(ORDER, 0, -1):
            contexts, first, kinds = np.unique(keys >> np.uint64(16), return_index=True, return_counts=True)
            totals = np.add.reduceat(counts, first).astype(float) if len(keys) else np.zeros(0)
            out.levels.append((order, keys, counts.astype(float), contexts, totals, kinds.astype(float), discount_of(int((counts == 1).sum()), int((counts == 2).sum()))))
            keys, counts = np.unique(keys & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)
        return out

    def probability(self, wanted: np.ndarray, level: int = 0) -> np.ndarray:
        """P(last symbol | the ones before) of gram keys."""
        if level == ORDER:
            return np.full(len(wanted), 1.0 / _SYMBOLS)
        order, keys, counts, contexts, totals, kinds, discount = self.levels[level]
        lower = self.probability(wanted & np.uint64((1 << 16 * (order - 1)) - 1), level + 1)
        if not len(keys):
            return lower
        c, known = _find(contexts, wanted >> np.uint64(16))
        g, seen = _find(keys, wanted)
        total = np.where(known, totals[c], 1.0)
        own = np.where(seen, np.maximum(counts[g] - discount, 0.0), 0.0)
        return np.where(known, own / total + discount * kinds[c] / total * lower, lower)


def _assembled(levels: list[tuple], frequent: np.ndarray | None) -> KneserNey:
    out = KneserNey(frequent=frequent)
    for v in levels:
        if len(v) == 3:
            out.add(*v)
        else:
            out.levels.append(v)
    return out


def discount_of(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


class Model:
    """All languages, with the log-probabilities of the frequent grams tabulated."""

    def __init__(self, models: dict[str, KneserNey]):
        self.languages = sorted(models)
        self.models = [models[k] for k in self.languages]
        self.keys = np.unique(np.concatenate([m.levels[0][1] if m.frequent is None else m.frequent for m in self.models])) if models else np.zeros(0, np.uint64)
        self.bits = self._bits(self.keys)
        self.limits = np.full(len(self.languages), np.inf)

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([-np.log2(m.probability(keys)) for m in self.models], 1).astype(np.float32) if self.models else np.zeros((len(keys), 0), np.float32)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, bits per symbol for each language) of each text."""
        n, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        held, rows, size = [], [], 0

        def flush() -> None:
            if not held or not self.languages:
                return
            keys = np.concatenate(held)
            at, seen = _find(self.keys, keys)
            bits = self.bits[at]
            if not seen.all():
                new, back = np.unique(keys[~seen], return_inverse=True)
                bits[~seen] = self._bits(new)[back]
            starts = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]])
            np.add.at(out, rows, np.add.reduceat(bits, starts, axis=0, dtype=np.float64))

        for k, t in enumerate(texts):
            g = grams(t)
            n[k] = len(g)
            for a in range(0, len(g), _CHUNK):
                held.append(g[a : a + _CHUNK])
                rows.append(k)
                size += len(held[-1])
                if size >= _CHUNK:
                    flush()
                    held, rows, size = [], [], 0
        flush()
        return n, out / np.maximum(n, 1)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, bits per symbol, rejected). A short text may exceed the limit by 8 / sqrt(symbols) bits."""
        n, e = self.entropies(texts)
        out = []
        for k in range(len(texts)):
            if not n[k] or not self.languages:
                out.append((UNKNOWN, 0.0, None, False))
                continue
            best = int(e[k].argmin())
            weights = np.exp2(-(e[k] - e[k, best]) * min(int(n[k]), 64))
            out.append((self.languages[best], float(1 / weights.sum()), float(e[k, best]), bool(e[k, best] > self.limits[best] + 8 / math.sqrt(n[k]))))
        return out


def _levels(counts: DataFrame, names: list[str], most: int) -> dict[str, KneserNey]:
    """The models from ``lang``, ``gram``, ``n``: all grams, in memory up to ``most`` of each order and in files beyond."""
    out = {name: KneserNey() for name in names}
    keys = counts
    for order in range(ORDER, 0, -1):
        each = max(1, most // len(names))
        stats = keys.groupBy("lang").agg(F.count("*").alias("grams"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()  # one row a language
        context = F.shiftrightunsigned("gram", 16)
        contexts = keys.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        joined = keys.select("lang", "gram", "n", context.alias("context")).join(contexts, ["lang", "context"])
        rows = joined.filter(F.col("lang").isin([r["lang"] for r in stats if r["grams"] <= each])).toArrow()
        for r in stats:
            model, discount = out[r["lang"]], discount_of(r["once"], r["twice"])
            if r["grams"] > each:
                of = F.col("lang") == r["lang"]
                if order == ORDER:
                    top = most_frequent(keys.filter(of), each, "gram").select("gram").toArrow()
                    model.frequent = np.sort(top["gram"].to_numpy().view(np.uint64))
                model.add(order, _stored(joined.filter(of)), discount)
                continue
            own = rows.filter(pc.equal(rows["lang"], r["lang"]))
            gram, n = own["gram"].to_numpy().view(np.uint64), own["n"].to_numpy().astype(float)
            by = np.argsort(gram)
            held, first = np.unique(own["context"].to_numpy().view(np.uint64), return_index=True)
            model.levels.append((order, gram[by], n[by], held, own["total"].to_numpy()[first].astype(float), own["kinds"].to_numpy()[first].astype(float), discount))
        if order > 1:
            lower = F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1).cast("long"))
            keys = written(keys.groupBy("lang", lower.alias("gram")).agg(F.count("*").alias("n")), "grams")
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text", most_languages: int = MAX_LANGUAGES, most_grams: int = MAX_GRAMS) -> Model:
    """The model of all labelled rows of the frame, but for those by which rejection is calibrated."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = {r["l"]: r["n"] for r in labelled.groupBy(F.col(lang).cast("string").alias("l")).agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(rows) > most_languages:
        raise ValueError(f"more than {most_languages} labels; give most_languages")
    parts = max(10, sum(rows.values()) // CALIBRATION_ROWS)
    large = [name for name, n in rows.items() if n >= LEAST_ROWS]
    aside = F.col(lang).cast("string").isin(large) & (F.pmod(F.xxhash64(id_col, text), F.lit(parts)) == 0)
    counts = written(gram_counts(labelled.filter(~aside), lang, text), "grams")
    names = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    model = Model(_levels(counts, names, most_grams) if names else {})
    sample = labelled.filter(aside).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sums = sample.mapInArrow(tidy(_own_entropy(docs, model)), "lang string, e double")
    for r in sums.groupBy("lang").agg(F.percentile_approx("e", 0.999, 10_000).alias("e"), F.count("*").alias("n")).collect():  # one row a language
        if r["n"] >= 50:
            model.limits[model.languages.index(r["lang"])] = r["e"] + 0.25
    release_driver(docs.sparkSession)
    return model


def _own_entropy(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: k for k, name in enumerate(shared.value.languages)}
        for batch in slices(batches):
            langs = batch.column(0).to_pylist()
            n, e = shared.value.entropies(batch.column(1).to_pylist())
            rows = [(x, float(e[k, place[x]])) for k, x in enumerate(langs) if x in place and n[k]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["lang", "e"])

    return run


def predict(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """The frame with a struct column (language, score, bits, rejected), and the name of that column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("language string, score double, bits double, rejected boolean")
    def of(texts):
        import pandas as pd

        rows = []
        for at in range(0, len(texts), 200):
            rows += shared.value.predict([t if isinstance(t, str) else None for t in texts.iloc[at : at + 200]])
        release()
        return pd.DataFrame(rows, columns=["language", "score", "bits", "rejected"])

    name = free_name(docs, "language")
    return docs.withColumn(name, of(F.col(text))), name


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 1 when divided by 3 (null: no)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
