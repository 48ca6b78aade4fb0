"""Groups of texts that share a given part of their word shingles: SimHash on the pigeonring, min-hash keys, then an exact comparison.

A text is the set of hashes of its runs of ``words`` words, and two are linked if they share
0.8 of all their shingles (Jaccard). Candidates are found in two steps.

First the pigeonring: SimHashes of 256 bits are a ring of 16 segments. If two differ in at
most ``RING_TAU`` bits, the proportional budgets force ``RUN`` consecutive segments to be
equal; these are the keys under which they meet, and a candidate must pass all budgets and the
full Hamming distance. That finds the closest copies, and what it links is compared no more.

At a similarity of 0.8 some 39 bits differ, which leaves no key of a useful length, so the
rest meets under min-hash keys: ``bands`` of them, each from the least values of ``rows``
functions, so that texts of similarity s have some key in common with a probability of
1 - (1 - s ** rows) ** bands, wherever they differ. Candidates from there are pruned by the
ring as well, with budgets for ``TAU`` bits (39 and 51 in the smallest sets, with a deviation
of 6, so that loses none in practice; unlike texts differ in 128). What is left is compared
by the texts, exactly.

Large keys: equal sets are one node. Keys with at most ``small`` nodes give their pairs. In
a larger one each node is first compared with the key's least node. Once the components of
these links are known, only pairs of nodes in different components can still matter, and all
of those that can be similar enough are compared (:func:`_open_pairs`): a shingle that only
one component holds is in no such pair. The others are compared with a pivot first, a node
of the key's main component with few shingles of its own, which links most. Then a pair
shares at most the lesser number that its nodes share with the pivot, and the lesser number
that they do not. Both are true bounds, so no pair that shares a key is left out unless it
is linked already or cannot be similar.

Defined results: a null or blank text is the empty set; all of them are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipika.llm.components import components
from lipika.llm.flat import release_driver, slices, tidy
from lipika.llm.ring import chain_keys, hamming, segment_masks, simhash, within_budgets
from lipika.session import written

SEED = 42
CHUNK = 1 << 11
BLOCK = 256
#: Texts are linked if FIVE * shared >= FOUR * all shingles of both.
FOUR, FIVE = 4, 5
#: Bits of 256 in which SimHashes of similar sets differ at most, and segments in each word of 64.
TAU, PER_WORD, WIDTH = 96, 4, 4
#: Bits in which SimHashes differ at most that meet on the ring, and the segments that its budgets then force to be equal.
RING_TAU, RUN = 7, 2


def run_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; A-Z are lower-cased."""
    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    if words == 1:
        return np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts))
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))


def hashes(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    return np.unique(run_hashes(text, words))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240102)
    return rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, np.uint64)


def keys_of(found: np.ndarray, rows: int, bands: int, functions: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """One key for each band; none of an empty set."""
    if not len(found):
        return []
    a, c = functions
    least = np.full(rows * bands, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[at : at + CHUNK, None] * a + c).min(axis=0))
    parts = least.reshape(bands, rows)
    return [xxhash.xxh64_intdigest(p.tobytes(), k) - (1 << 63) for k, p in enumerate(parts)]


def signatures(docs: DataFrame, id_col: str, text: str, words: int, rows: int, bands: int) -> DataFrame:
    """``id_col``, ``text_key`` (hash of the text), ``node`` (hash of the set), ``size`` (of the set), ``keys``, ``fp`` (SimHash)."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = _functions(rows * bands)
        for batch in slices(batches):
            nodes, sizes, keys, prints = [], [], [], []
            for t in batch.column(2).to_pylist():
                found = hashes(t, words)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63))
                sizes.append(len(found))
                keys.append(keys_of(found, rows, bands, functions))
                prints.append(simhash(found, WIDTH))
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, kind), pa.array(prints, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "node", "size", "keys", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, F.xxhash64(text).alias("text_key"), text).mapInArrow(tidy(run), f"id {id_type}, text_key bigint, node bigint, size bigint, keys array<bigint>, fp array<bigint>")
    return out.withColumnRenamed("id", id_col)


def _alike(pairs: DataFrame, texts: DataFrame, words: int, tau: int = TAU) -> DataFrame:
    """The pairs ``(a, b)`` whose SimHashes are within the budgets for ``tau`` bits and whose sets are similar enough. ``texts``: ``node``, ``text``, ``fp``."""
    side = lambda k, c: texts.select(F.col("node").alias(k), F.col(c).alias(f"{c[0]}{k}"))
    pairs = pairs.join(side("a", "fp"), "a").join(side("b", "fp"), "b").filter(_near(F.col("fa"), F.col("fb"), tau)).select("a", "b")
    sided = pairs.join(side("a", "text"), "a").join(side("b", "text"), "b")  # texts only of what is left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, there = None, np.zeros(0, np.uint64)
        for batch in slices(batches):
            a, b, ta, tb = (batch.column(k) for k in range(4))
            fits = []
            for i, node in enumerate(b.to_pylist()):
                if node != last:  # rows of equal b mostly follow each other
                    last, there = node, hashes(tb[i].as_py(), words)
                here = hashes(ta[i].as_py(), words)
                both = len(np.intersect1d(here, there, assume_unique=True))
                fits.append(FIVE * both >= FOUR * (len(here) + len(there) - both))
            mask = pa.array(fits, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return sided.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a bigint, b bigint")


def _pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct pairs that meet and whose sizes allow the similarity."""
    x = left.select(*on, F.col("node").alias("x"), F.col("size").alias("sx"), F.col("part").alias("px"))
    y = right.select(*on, F.col("node").alias("y"), F.col("size").alias("sy"), F.col("part").alias("py"))
    met = x.join(y, on).filter("x < y").filter("px <> py").filter(FIVE * F.least("sx", "sy") >= FOUR * F.greatest("sx", "sy"))
    return met.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _met(keyed: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of the keys with few nodes and of the others' nodes with their least one, and the rows of those others. ``keyed``: ``node``, ``size``, ``part``, ``bucket``."""
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("node", "size", "part")).alias("least")).filter("n > 1")
    shared = written(keyed.join(counts, "bucket"), "buckets")
    few, many = shared.filter(F.col("n") <= small), shared.filter(F.col("n") > small)
    star = many.filter("part <> least.part").filter(FIVE * F.least("size", "least.size") >= FOUR * F.greatest("size", "least.size"))
    star = star.select(F.col("least.node").alias("a"), F.col("node").alias("b"))
    return _pairs(few, few, ["bucket"]).unionByName(star).distinct(), many


def _near(a: Column, b: Column, tau: int) -> Column:
    return within_budgets(a, b, segment_masks(WIDTH, PER_WORD), tau) & (hamming(a, b, WIDTH) <= tau)


def ring_pairs(nodes: DataFrame, small: int) -> DataFrame:
    """Pairs ``(a, b)`` that meet under the ring's keys and differ in at most ``RING_TAU`` bits. ``nodes``: ``node``, ``size``, ``fp``.

    Of keys with more than ``small`` nodes only pairs with the least node; the others are left to the min-hash keys.
    """
    keys = chain_keys(F.col("fp"), segment_masks(WIDTH, PER_WORD), RUN)
    keyed = nodes.select("node", F.explode(keys).alias("k")).select("node", F.xxhash64("k.start", "k.bits").alias("bucket"))
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    rows = keyed.join(counts, "bucket").join(nodes.select("node", "size", "fp"), "node")  # only rows of shared keys get their SimHashes
    rows = written(rows, "buckets")
    side = lambda df, k: df.select("bucket", *(F.col(c).alias(k + c) for c in ("node", "size", "fp")))
    fits = (FIVE * F.least("xsize", "ysize") >= FOUR * F.greatest("xsize", "ysize")) & _near(F.col("xfp"), F.col("yfp"), RING_TAU)
    few, many = rows.filter(F.col("n") <= small), rows.filter(F.col("n") > small)
    met = side(few, "x").join(side(few, "y"), "bucket").filter(F.col("xnode") < F.col("ynode")).filter(fits)
    star = side(many.filter("node = least"), "x").join(side(many.filter("node > least"), "y"), "bucket").filter(fits)
    return met.unionByName(star).select(F.col("xnode").alias("a"), F.col("ynode").alias("b")).distinct()


def _parted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The frame with ``part``, the component of each node."""
    return nodes.join(components(edges).select("node", F.col("root").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))


def links(nodes: DataFrame, texts: DataFrame, words: int, small: int) -> DataFrame:
    """Edges ``(a, b)`` that connect all similar nodes that share a key. ``nodes``: ``node``, ``size``, ``keys``, ``fp``; written."""
    ring = written(_alike(ring_pairs(nodes, small), texts, words, RING_TAU), "links")
    release_driver(nodes.sparkSession)
    keyed = _parted(nodes.select("node", "size", "keys"), ring).select("node", "size", "part", F.explode("keys").alias("bucket"))
    pairs, many = _met(keyed, small)
    edges = written(ring.unionByName(_alike(pairs, texts, words)), "links")
    release_driver(nodes.sparkSession)
    if not many.limit(1).count():
        return edges
    more, pairs = _open_pairs(_parted(many.drop("part"), edges), texts, words)
    return edges.unionByName(more).unionByName(_alike(pairs, texts, words))


def _open_pairs(many: DataFrame, texts: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Edges between pivots and nodes similar to them, and distinct pairs that share a large key, can be similar and are in different components even so.

    ``many``: ``bucket``, ``node``, ``size``, ``part``, ``n`` (of the key). A pair is judged under the least large key that it shares.
    """
    spark = many.sparkSession
    many = written(many.select("bucket", "node", "size", "part", "n"), "parts")
    release_driver(spark)
    parts = many.groupBy("bucket", "part").agg(F.count("*").alias("m"))
    open_ = parts.groupBy("bucket").agg(F.max(F.struct("m", "part")).alias("most"), F.count("*").alias("k")).filter("k > 1").select("bucket", F.col("most.part").alias("main"))
    rows = many.join(open_, "bucket")

    # the shingles of each node that some other component holds too
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [hashes(t, words).view(np.int64) for t in batch.column(2).to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(h) for h in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(np.concatenate(found))], names=["node", "part", "shingle"])

    members = rows.select("node", "part").distinct().join(texts.select("node", "text"), "node")
    held = written(members.select("node", "part", "text").mapInArrow(tidy(run), "node bigint, part bigint, shingle bigint"), "shingles")
    common = held.groupBy("shingle").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("shingle")
    kept = written(held.join(common, "shingle").groupBy("node").agg(F.collect_list("shingle").alias("common")), "common")
    release_driver(spark)

    # a similar pair shares 0.8 of each of its nodes; the pivot is a node of the main component with few shingles of its own
    able = rows.join(kept.select("node", F.size("common").alias("c")), "node").filter(FIVE * F.col("c") >= FOUR * F.col("size"))
    able = written(able, "able")
    best = F.max(F.struct((F.col("part") == F.col("main")).alias("own"), (F.col("c") / F.col("size")).alias("share"), "node"))
    against = able.join(able.groupBy("bucket").agg(best.alias("best")).select("bucket", F.col("best.node").alias("pivot")), "bucket")
    pivots = kept.select(F.col("node").alias("pivot"), F.col("common").alias("theirs"))
    over = against.select("pivot", "node").distinct().join(pivots, "pivot").join(kept, "node").select("pivot", "node", F.size(F.array_intersect("common", "theirs")).alias("o"))
    keys = able.groupBy("node").agg(F.collect_list("bucket").alias("keys"))
    rows = written(against.join(over, ["pivot", "node"]).join(keys, "node"), "open")
    release_driver(spark)

    # a pivot and a node of another component share the ``o`` shingles and no others, so that is their similarity
    there = rows.select(F.col("node").alias("pivot"), F.col("size").alias("psize"), F.col("part").alias("ppart")).distinct()
    like = rows.join(there, "pivot").filter("part <> ppart").filter((FOUR + FIVE) * F.col("o") >= FOUR * (F.col("size") + F.col("psize")))
    like = written(like.select("pivot", "node", "part", "ppart").distinct(), "links")
    roots = components(like.select(F.col("part").alias("a"), F.col("ppart").alias("b")))
    for name in ("part", "main"):
        to = roots.select(F.col("node").alias(name), F.col("root").alias("to"))
        rows = rows.join(to, name, "left").withColumn(name, F.coalesce("to", name)).drop("to")
    rows = written(rows, "open")
    release_driver(spark)

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    side = lambda df, k: df.select("bucket", "block", *(F.col(c).alias(k + c) for c in ("node", "size", "part", "c", "o", "keys")))
    x = side(rows.filter("part <> main").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))), "x")
    y = side(rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")), "y")
    both = F.least("xo", "yo") + F.least(F.expr("xc - xo"), F.expr("yc - yo"))  # at most so many in common
    first = F.array_min(F.array_intersect("xkeys", "ykeys")) == F.col("bucket")
    met = x.join(y, ["bucket", "block"]).filter(F.col("xpart") != F.col("ypart")).filter((FOUR + FIVE) * both >= FOUR * (F.col("xsize") + F.col("ysize"))).filter(first)
    pairs = met.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct()
    return like.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")), pairs


def similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, rows: int = 4, bands: int = 32, small: int = 16) -> DataFrame:
    """``id_col``, ``text_key`` (hash of the text), ``node`` and ``root`` (the same for all rows that links reach) of each row."""
    found = written(signatures(docs, id_col, text, words, rows, bands), "signatures")
    nodes = written(found.groupBy("node").agg(F.min(F.struct(id_col, "text_key")).alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "nodes")
    # one row's text for each node
    owner = nodes.select("node", "fp", F.col(f"least.{id_col}").alias(id_col), F.col("least.text_key").alias("text_key"))
    source = docs.select(id_col, F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    texts = written(owner.join(source, [id_col, "text_key"]).select("node", "text", "fp").dropDuplicates(["node"]), "texts")
    release_driver(docs.sparkSession)
    edges = written(links(nodes, texts, words, small), "links")
    release_driver(docs.sparkSession)
    roots = written(components(edges), "roots")
    release_driver(docs.sparkSession)
    return found.select(id_col, "text_key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
