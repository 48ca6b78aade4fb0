"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is a ring of consecutive segments. If two fingerprints differ in at most
``tau`` of their bits, then at some segment of the ring starts a chain whose first l
segments differ in at most l * tau / m bits, for every l (m segments). The first segments
of such a chain, as many as have a budget below one bit, are therefore equal: they are the
key under which candidates meet. A candidate must then have a chain within the budgets
before its full Hamming distance is looked at.

Large groups: identical fingerprints are one node. With ``tau`` <= 2 a key that more than
``small`` nodes share is never expanded into pairs: its nodes are linked exactly, through
the fingerprints that lie between them: two fingerprints differ in at most two bits if and
only if they share one of their one-bit neighbours (or are such neighbours), so it is
enough to tie each node to the least node of each of its neighbours' stars.

Defined results: a null or blank text has the fingerprint zero and is linked like any
other. Repeated rows stay. A component's id is its least id; null ids are ignored there
and rows with them get the id of their component. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipika.columns import free_name
from lipika.llm import shingles
from lipika.llm.components import components
from lipika.llm.flat import slices, tidy
from lipika.llm.ring import as_long, chain_keys, hamming, segment_masks, simhash, within_budgets
from lipika.llm.shingles import run_hashes
from lipika.session import written

BLOCK = 256


def fingerprint(text: str | None, words: int = 3, width: int = 1, distinct: bool = False) -> np.ndarray:
    """SimHash of the text's shingles, repeats included unless ``distinct``."""
    h = run_hashes(text, words)
    return simhash(np.unique(h) if distinct else h, width)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keys: dict | None = None, check: dict | None = None) -> DataFrame:
    """``id_col``, ``key`` and ``fp`` (arrays of long): the fingerprint that gives keys and the one that is compared.

    ``keys`` and ``check`` are arguments of :func:`fingerprint`; without ``keys`` both are the same.
    """
    check = check or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            fps = [fingerprint(t, **check) for t in texts]
            ks = fps if keys is None else [fingerprint(t, **keys) for t in texts]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ks, kind), pa.array(fps, kind)], names=["id", "key", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text).mapInArrow(tidy(run), f"id {id_type}, key array<bigint>, fp array<bigint>")
    return out.withColumnRenamed("id", id_col)


def links(nodes: DataFrame, tau: int, key_masks: list[tuple[int, int]], masks: list[tuple[int, int]], run: int, width: int, small: int = 16) -> DataFrame:
    """Edges ``(a, b)`` that connect all nodes whose fingerprints differ in at most ``tau`` bits.

    ``nodes``: ``node`` (long, unique), ``key``, ``fp``. Keys with at most ``small`` nodes give
    their pairs. Larger ones are linked through shared one-bit neighbours where ``tau`` <= 2;
    for a larger ``tau`` all their nodes are compared, in blocks. Both are exact.
    """
    keyed = nodes.select("node", F.explode(chain_keys(F.col("key"), key_masks, run)).alias("k"))
    keyed = keyed.select("node", F.xxhash64("k.start", "k.bits").alias("bucket"), F.col("k.start").alias("start"))
    prints = nodes.select("node", "fp")

    def close(a: Column, b: Column) -> Column:
        return within_budgets(a, b, masks, tau) & (hamming(a, b, width) <= tau)

    def met(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Close pairs of the keys with few nodes, and the nodes of the others (with the least node of their key).

        Only rows of shared keys get their fingerprints, by a join on the node.
        """
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
        shared = written(rows.join(sizes, "bucket").join(prints, "node"), "buckets")
        few = shared.filter(F.col("n") <= small)
        left = few.select("bucket", F.col("node").alias("a"), F.col("fp").alias("fa"))
        right = few.select("bucket", F.col("node").alias("b"), F.col("fp").alias("fb"))
        pairs = left.join(right, "bucket").filter("a < b").filter(close(F.col("fa"), F.col("fb"))).select("a", "b")
        return pairs, shared.filter(F.col("n") > small)

    edges, many = met(keyed)
    if tau <= 2 and width == 1:
        word = F.get(F.col("fp"), F.lit(0))
        flips = F.array(*([word] + [word.bitwiseXOR(as_long(1 << b)) for b in range(64)]))
        near = many.select("node", "fp").distinct().select("node", F.explode(flips).alias("between"))
        stars = near.groupBy("between").agg(F.min("node").alias("m"))
        return edges.unionByName(near.join(stars, "between").filter("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    left = many.select("bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("node").alias("a"), F.col("fp").alias("fa"))
    right = many.select("bucket", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), F.col("node").alias("b"), F.col("fp").alias("fb"))
    pairs = left.join(right, ["bucket", "block"]).filter("a < b").filter(close(F.col("fa"), F.col("fb"))).select("a", "b")
    return edges.unionByName(pairs).distinct()


#: Arguments of :func:`lipika.llm.shingles.similar`: a pair with 0.8 of its 5-word shingles in common is met with a probability of 1 - (1 - 0.8 ** 4) ** 32, all but 5e-8.
#: Candidates must have a chain within the budgets and at most TAU of 256 bits apart (see :mod:`lipika.llm.shingles`) before their texts are compared.
WIDE = {"words": 5, "rows": 4, "bands": 32}


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The frame with the row of least id of each component; rows without an id take part in none and stay.

    Rows that share an id but not their text are documents of their own; of equal rows one stays.
    """
    found = shingles.similar(docs.filter(F.col(id_col).isNotNull()), id_col, text, **(how or WIDE))
    one = F.min(F.struct(id_col, "text_key")).alias("one")
    key = free_name(docs, "text_key")
    kept = written(found.groupBy("root").agg(one).select(f"one.{id_col}", F.col("one.text_key").alias(key)), "kept")
    rows = docs.withColumn(key, F.xxhash64(text)).join(kept, [id_col, key], "left_semi").dropDuplicates([id_col, key])
    rows = rows.select(docs.columns)
    return rows.unionByName(docs.filter(F.col(id_col).isNull()))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    words: int = 3,
    tau: int = 2,
    width: int = 1,
    per_word: int = 5,
    small: int = 16,
) -> DataFrame:
    """``id_col``, ``fp`` (array of long) and ``component_id`` (the least id that links reach).

    ``words`` in a shingle, ``width`` words of 64 bits, ``per_word`` segments in each. A key
    takes as many segments as the budgets force to be equal, at least one.
    """
    masks = segment_masks(width, per_word)
    run = max(1, math.ceil(len(masks) / tau) - 1) if tau else len(masks)
    fps = written(fingerprints(docs, id_col, text, check={"words": words, "width": width}), "fingerprints")
    node = F.get("fp", F.lit(0)) if width == 1 else F.xxhash64("fp")
    fps = fps.withColumn("node", node)
    nodes = fps.groupBy("node").agg(F.min(id_col).alias("least_id"), F.first("fp").alias("fp"), F.first("key").alias("key"))
    nodes = written(nodes, "nodes")
    roots = components(links(nodes, tau, masks, masks, run, width, small))
    linked = roots.join(nodes.select("node", "least_id"), "node")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_node = linked.select("node", "root").join(least, "root").select("node", "component_id")
    classes = nodes.select("node", "least_id").join(by_node, "node", "left").select("node", F.coalesce("component_id", "least_id").alias("component_id"))
    return fps.join(classes, "node").select(id_col, "fp", "component_id")
