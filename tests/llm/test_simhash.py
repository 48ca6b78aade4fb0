import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lipika.llm import simhash
from lipika.llm.components import components
from lipika.llm.queries import op1_simhash
from tests.llm.conftest import least_of_components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    expected = least_of_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", expected[i]) for i in fps}


@pytest.mark.parametrize("small", [2, 1000])
def test_links_connect_what_all_pairs_connect(spark, small):
    """Dense clusters of fingerprints, through pairs and through the one-bit neighbours of large keys."""
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(40)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    nodes = spark.createDataFrame([(f, [f], [f]) for f in signed], "node long, key array<long>, fp array<long>")
    masks = simhash.segment_masks(1, 5)
    edges = simhash.links(nodes, 2, masks, masks, 2, 1, small)
    got = {r.node: r.root for r in components(edges).collect()}
    expected = least_of_components(sorted(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {i: got.get(i, i) for i in signed} == expected
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in edges.collect())


def test_ring_budgets_keep_every_pair_within_tau(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(63)
        rows.append(([a], [a ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(6)))]))
    masks = simhash.segment_masks(1, 5)
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    out = df.select(simhash.within_budgets(F.col("a"), F.col("b"), masks, 2).alias("w"), simhash.hamming(F.col("a"), F.col("b"), 1).alias("h")).collect()
    assert all(r.w for r in out if r.h <= 2)
    assert not all(r.w for r in out)


def test_nulls_blanks_ties_and_extra_columns(spark):
    rows = [(1, None, 5), (2, "", 6), (3, " \n", 7), (4, "A b c d", 8), (4, "a B c d", 9), (None, "a b c d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(simhash.near_duplicates(df).select("doc_id", "component_id").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, 4)], key=lambda r: str((r[0], r[1]))) or {tuple(r) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, 4)}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
