"""Masked pseudo-likelihood of documents under a bidirectional window network.

Each word is predicted from the ``SIDE`` words on either side of it, never from itself. The
network (numpy, single precision): embeddings of the window, one tanh layer, and a softmax in
two steps, the upper and the lower half of the word's number. A document's score is the sum
of the conditional log-probabilities of all its words.

Vocabulary: words (between ASCII white space, in lower case; commas and full stops stand
alone) are counted over all documents. The most frequent ``KNOWN`` have numbers of their own
and the others share ``SHARED`` by hash; among those that share a number, a word has its part
of their count in the corpus, from a written table of all words. Training runs over all
documents too: each task trains a copy on its rows, with every word as a target once in each of
``ROUNDS``, and the copies are averaged, weighted by their targets. So the scores depend, a
little, on how the rows are dealt to tasks; the same table read by the same splits gives the
same scores. What is gathered are word counts and one set of weights for each task, which
grow with the corpus; what reaches the driver (the vocabulary and one set of weights) has a
fixed size.

Defined results: a null or blank text has no words, sum 0 and no mean. Repeated rows count
as often as they occur, in training too. Without any word the untrained network scores.
Other columns are not read. Texts of any length are worked on as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.llm import flat as fl
from lipika.llm.flat import tidy
from lipika.llm.topk import most_frequent
from lipika.session import written

SIDE = 2
HALF = 64
WORDS = HALF * HALF
SHARED = 256
KNOWN = WORDS - SHARED - 1
DIM, HIDDEN = 8, 32
ROUNDS = 1
BATCH = 2048
RATE = 0.08
SHAPES = {
    "embed": (WORDS, DIM),
    "w": (2 * SIDE * DIM, HIDDEN),
    "b": (HIDDEN,),
    "upper": (HIDDEN, HALF),
    "upper_b": (HALF,),
    "given": (HALF, HIDDEN),
    "lower": (HIDDEN, HALF),
    "lower_b": (HALF,),
}
_OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]
N_WEIGHTS = sum(int(np.prod(s)) for s in SHAPES.values())


_SPACE = np.zeros(256, bool)
_SPACE[[0, *range(9, 14), 32]] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a group of texts: their bytes in lower case, where words start and end, the words' hashes, and the text of each word."""
    flat, marks = fl.joined(pc.utf8_lower(texts))
    starts, ends = fl.words(flat, _SPACE, b",.")
    return flat, starts, ends, fl.hashes(flat, starts, ends), np.searchsorted(marks, starts)


class Vocabulary:
    """Word -> number, by hash. 0 is outside the text; unknown words share the last ``SHARED`` numbers."""

    def __init__(self, known: list[str]):
        self.table = fl.Table(max(1, len(known)))
        flat, marks = fl.joined(pa.array(known, pa.string()))
        self.table.add(fl.hashes(flat, np.concatenate([[0], marks[:-1] + 1]).astype(np.int64), marks) if len(known) else np.zeros(0, np.uint64))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        found = self.table.find(hashes)
        return np.where(found < 0, WORDS - SHARED + bucket_of(hashes), found + 1).astype(np.int16)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(SHARED)).astype(np.int32)


class Network:
    """The weights, as views of one flat array; embeddings come first."""

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(20240101)
            flat = np.concatenate([(rng.standard_normal(s) * (0.1 if len(s) > 1 else 0)).ravel() for s in SHAPES.values()])
        self.flat = np.array(flat, np.float32)
        self.flat_grad = np.zeros(N_WEIGHTS, np.float32)
        self.part, self.grad, at = {}, {}, 0
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            self.part[name], self.grad[name] = self.flat[at : at + n].reshape(shape), self.flat_grad[at : at + n].reshape(shape)
            at += n
        self.squares = np.full(N_WEIGHTS, 1e-2, np.float32)

    def forward(self, context: np.ndarray, target: np.ndarray) -> tuple:
        """``context`` (n, 2 * SIDE) and ``target`` (n) are word numbers; the last item is log P(target | context)."""
        p = self.part
        x = p["embed"].take(context.ravel(), axis=0).reshape(len(context), -1)
        h = x @ p["w"]
        h += p["b"]
        np.tanh(h, out=h)
        up, low = np.divmod(target, HALF)
        g = h + p["given"].take(up, axis=0)
        row, logs, parts = np.arange(len(target)) * HALF, 0.0, []
        for z, bias, k in ((h @ p["upper"], "upper_b", up), (g @ p["lower"], "lower_b", low)):
            z += p[bias]
            np.minimum(z, 80, out=z)  # what exp can hold; such logits are not met
            top = z.take(row + k)
            np.exp(z, out=z)
            total = z.sum(axis=1)
            logs = logs + (top - np.log(total))
            parts += [z, total]
        return x, h, g, up, low, row, *parts, logs

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        return self.forward(context, target)[-1]

    def step(self, context: np.ndarray, target: np.ndarray) -> float:
        """One Adagrad step on a batch; the mean log-probability before it."""
        p, n, grad = self.part, len(target), self.grad
        x, h, g, up, low, row, a, total_a, b, total_b, logs = self.forward(context, target)
        for z, total, k in ((a, total_a, up), (b, total_b, low)):
            z *= (1 / (n * total))[:, None]
            z.ravel()[row + k] -= np.float32(1 / n)
        np.matmul(h.T, a, out=grad["upper"])
        np.matmul(g.T, b, out=grad["lower"])
        np.matmul(_ones(n), a, out=grad["upper_b"])
        np.matmul(_ones(n), b, out=grad["lower_b"])
        dg = b @ p["lower"].T
        np.matmul(_EYE.take(up, axis=0).T, dg, out=grad["given"])
        dh = a @ p["upper"].T
        dh += dg
        h *= h
        np.subtract(1, h, out=h)
        dh *= h
        np.matmul(x.T, dh, out=grad["w"])
        np.matmul(_ones(n), dh, out=grad["b"])
        dx = (dh @ p["w"].T).reshape(-1, DIM)
        flat = context.ravel()
        order = np.argsort(flat, kind="stable")  # of 16-bit numbers: a radix sort
        ordered = flat.take(order)
        first = np.flatnonzero(np.diff(ordered, prepend=-1))
        sums = np.add.reduceat(dx.take(order, axis=0), first, axis=0)
        kinds = ordered.take(first)
        # embeddings: only rows that were met
        squares = self.squares[: WORDS * DIM].reshape(WORDS, DIM)
        squares[kinds] += sums * sums
        p["embed"][kinds] -= RATE * sums / np.sqrt(squares[kinds])
        rest, flat_grad = self.squares[WORDS * DIM :], self.flat_grad[WORDS * DIM :]
        rest += flat_grad * flat_grad
        self.flat[WORDS * DIM :] -= RATE * flat_grad / np.sqrt(rest)
        return float(logs.mean())


_EYE = np.eye(HALF, dtype=np.float32)


def _ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


def windows(numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers around each place; ``numbers`` has ``SIDE`` zeros at both ends, which places do not count."""
    return np.stack([numbers[at + SIDE + o] for o in _OFFSETS], axis=1)


def padded(numbers: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' numbers with ``SIDE`` zeros at both ends of each text, and each word's place for :func:`windows`."""
    at = np.arange(len(numbers)) + owner * 2 * SIDE
    out = np.zeros(len(numbers) + 2 * SIDE * texts, np.int16)
    out[at + SIDE] = numbers
    return out, at


def score_texts(network: Network, vocabulary: Vocabulary, hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log-probability of each text, given its words' hashes."""
    numbers = vocabulary.numbers(hashes)
    flat, at = padded(numbers, owner, texts)
    sums = np.zeros(texts)
    for k in range(0, len(at), BATCH):
        some = at[k : k + BATCH]
        logs = network.log_probabilities(windows(flat, some), flat[some + SIDE])
        first = int(owner[k])
        part = np.bincount(owner[k : k + BATCH] - first, logs.astype(np.float64))
        sums[first : first + len(part)] += part
    return np.bincount(owner, minlength=texts), sums


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``h`` (its hash), ``bucket`` and ``n`` of all documents, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in fl.groups(batch.column(0), 1 << 23):
                flat, starts, ends, h, _ = words_of(texts)
                kinds, first, n = np.unique(h, return_index=True, return_counts=True)
                found = pa.array(fl.strings(flat, starts[first], ends[first]), pa.string())
                yield pa.RecordBatch.from_arrays([found, pa.array(kinds.view(np.int64)), pa.array(bucket_of(kinds)), pa.array(n)], names=["word", "h", "bucket", "n"])

    rows = docs.select(F.make_valid_utf8(F.col(text).cast("string"))).mapInArrow(tidy(run), "word string, h bigint, bucket int, n bigint")
    return written(rows.groupBy("word", "h", "bucket").agg(F.sum("n").alias("n")), "words")


def vocabulary_of(docs: DataFrame, text: str = "text", counts: DataFrame | None = None) -> list[str]:
    """The most frequent ``KNOWN`` words of all documents, ties by word; ``counts`` are theirs if known."""
    counts = word_counts(docs, text) if counts is None else counts
    return [r["word"] for r in most_frequent(counts, KNOWN, "word").collect()]


def shares(counts: DataFrame, known: list[str]) -> DataFrame:
    """``h`` and ``log_share`` of the words without a number: the log of each one's part of its bucket's count."""
    numbered = counts.sparkSession.createDataFrame([(w,) for w in known], "word string")
    rest = counts.join(F.broadcast(numbered), "word", "left_anti")
    totals = rest.groupBy("bucket").agg(F.sum("n").alias("total"))  # one row a bucket
    return rest.join(F.broadcast(totals), "bucket").select("h", F.log(F.col("n") / F.col("total")).alias("log_share"))


def _mean(copies: DataFrame, flat: np.ndarray) -> np.ndarray:
    """The weighted mean of the copies' weights, summed by a tree of tasks; ``flat`` where there is none."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(N_WEIGHTS), 0.0
        for batch in batches:
            for w, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                total += w * x.values.to_numpy()
                n += w
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / n).astype(np.float32)], pa.list_(pa.float32()))], names=["n", "flat"])

    rows = written(copies, "weights")  # one row a task, trained once
    parts = rows.count()
    while parts > 8:
        parts = -(-parts // 8)
        rows = rows.repartition(parts).mapInArrow(tidy(summed), "n double, flat array<float>")
    found = rows.coalesce(1).mapInArrow(tidy(summed), "n double, flat array<float>").collect()
    return np.array(found[0]["flat"], np.float32) if found else flat


def train(docs: DataFrame, known: list[str], text: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """The flat weights after ``rounds`` of training on all documents and averaging."""
    flat = Network().flat
    for _ in range(rounds):
        start = docs.sparkSession.sparkContext.broadcast((known, flat))  # a fixed size

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            vocabulary, network = Vocabulary(start.value[0]), Network(start.value[1])
            n = 0
            held_c, held_t = np.zeros((0, 2 * SIDE), np.int16), np.zeros(0, np.int16)
            for batch in batches:
                for texts in fl.groups(batch.column(0)):
                    h, owner = words_of(texts)[3:]
                    flat, at = padded(vocabulary.numbers(h), owner, len(texts))
                    c, g = np.concatenate([held_c, windows(flat, at)]), np.concatenate([held_t, flat[at + SIDE]])
                    whole = len(g) // BATCH * BATCH
                    for k in range(0, whole, BATCH):
                        network.step(c[k : k + BATCH], g[k : k + BATCH])
                    held_c, held_t, n = c[whole:], g[whole:], n + whole
            if len(held_t):
                network.step(held_c, held_t)
                n += len(held_t)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.float64()), pa.array([network.flat], pa.list_(pa.float32()))], names=["n", "flat"])

        copies = docs.select(F.make_valid_utf8(F.col(text).cast("string"))).mapInArrow(tidy(run), "n double, flat array<float>")
        flat = _mean(copies, flat)
    return flat


def score(docs: DataFrame, known: list[str], flat: np.ndarray, id_col: str = "doc_id", text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """``id_col``, ``n_words``, ``log_probability`` (the sum) and ``mean_log_probability``.

    With ``counts`` (of a corpus that holds ``docs``) a word without a number has its bucket's
    probability times its part of the bucket's count; without them, the bucket's.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, flat))
    rare_words = counts is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, network = Vocabulary(shared.value[0]), Network(shared.value[1])
        for batch in batches:
            done = 0
            for texts in fl.groups(batch.column(2)):
                h, owner = words_of(texts)[3:]
                n, sums = score_texts(network, vocabulary, h, owner, len(texts))
                rare = vocabulary.table.find(h) < 0 if rare_words else np.zeros(len(h), bool)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[rare], minlength=len(texts)))]), pa.int32())
                words = pa.ListArray.from_arrays(ends, pa.array(h[rare].view(np.int64)))
                columns = [batch.column(0).slice(done, len(texts)), batch.column(1).slice(done, len(texts)), pa.array(n, pa.int64()), pa.array(sums), words]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_words", "log_probability", "words"])
                done += len(texts)

    id_name = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.make_valid_utf8(F.col(text).cast("string")).alias("text"))
    out = rows.mapInArrow(tidy(run), f"row bigint, id {id_name}, n_words bigint, log_probability double, words array<bigint>")
    if rare_words:
        out = written(out, "scores")
        each = out.select("row", F.explode("words").alias("h"))
        parts = each.join(shares(counts, known), "h").groupBy("row").agg(F.sum("log_share").alias("within"))
        out = out.join(parts, "row", "left").withColumn("log_probability", F.col("log_probability") + F.coalesce("within", F.lit(0.0)))
    out = out.select(F.col("id").alias(id_col), "n_words", "log_probability")
    mean = F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words"))
    return out.withColumn("mean_log_probability", mean)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Vocabulary, training and scores over the same documents."""
    counts = word_counts(docs, text)
    known = vocabulary_of(docs, text, counts)
    return score(docs, known, train(docs, known, text), id_col, text, counts)
