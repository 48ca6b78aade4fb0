import gc
import random
import re
import time

import pytest

from lipika.llm import shingles, simhash
from lipika.llm.flat import trim_jvm
from tests.llm.conftest import least_of_components


def plain(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def like(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.keep_one(df, **(simhash.WIDE | how)).collect()}


def test_large_keys_lose_no_pair(spark):
    """One template with many variants, most of them too far apart: keys hold over 16 nodes, and their pairs are beside the least node."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for v in range(60):
        variant = list(base)
        for k in rng.sample(range(0, 120, 6), 3):
            variant[k] = f"v{v}x{k}"
        near = list(variant)
        near[119] = f"end{v}"
        texts += [" ".join(variant), " ".join(near)]
    sets = [plain(t) for t in texts]
    expected = set(least_of_components(range(len(texts)), lambda a, b: like(sets[a], sets[b])).values())
    assert 30 < len(expected) <= 60
    functions = shingles._functions(128)
    held = {}
    for t in texts:
        for k in shingles.keys_of(shingles.hashes(t, 5), 4, 32, functions):
            held[k] = held.get(k, 0) + 1
    assert max(held.values()) > 16
    assert kept(spark, texts) == expected
    assert kept(spark, texts, small=1000) == expected


def test_block_edits_are_found_and_less_alike_texts_stay(spark):
    """Copies whose last words were replaced in one piece, on both sides of 0.8."""
    rng = random.Random(8)
    texts = []
    for d in range(40):
        w = [f"d{d}w{rng.randrange(10**6)}" for _ in range(200)]
        for share in (16, 30):
            texts += [" ".join(w), " ".join(w[: 200 - share] + [f"d{d}s{share}t{k}" for k in range(share)])]
    sets = [plain(t) for t in texts]
    expected = least_of_components(range(len(texts)), lambda a, b: like(sets[a], sets[b]))
    assert len(set(expected.values())) == 80
    assert kept(spark, texts) == set(expected.values())


def test_rows_of_one_id_with_different_texts(spark):
    one, other = (" ".join(f"{x}{k}" for k in range(100)) for x in "ab")
    rows = [(1, one), (2, other), (2, one), (3, one), (3, " ".join(f"c{k}" for k in range(100))), (3, one)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text[0]) for r in got.collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_close_copies_meet_on_the_ring(spark):
    """All pairs whose SimHashes differ in at most RING_TAU bits share a key of equal segments, as the budgets say."""
    rng = random.Random(3)
    rows, fps = [], []
    for _ in range(40):
        fp = rng.getrandbits(256)
        for k in range(4):
            fps.append(fp ^ sum(1 << b for b in rng.sample(range(256), rng.randrange(3 * k + 1))))
    split = lambda f: [(f >> 64 * w & (1 << 64) - 1) - (1 << 64) * (f >> 64 * w + 63 & 1) for w in range(4)]
    rows = [(k, 100, split(f)) for k, f in enumerate(fps)]
    got = {(r.a, r.b) for r in shingles.ring_pairs(spark.createDataFrame(rows, "node long, size long, fp array<long>"), 16).collect()}
    close = {(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= shingles.RING_TAU}
    assert len(close) > 60 and close <= got


def test_large_keys_give_no_pair_that_cannot_be_similar(spark):
    """A large group of near copies, each with edits of its own: the kept rows are those of all pairs, and few pairs are compared."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for v in range(160):
        words = list(base)
        for k in rng.sample(range(150), rng.randrange(7)):
            words[k] = rng.choice((f"v{v}x{k}", f"x{rng.randrange(5)}"))
        texts.append(" ".join(words))
    sets = [plain(t) for t in texts]
    expected = least_of_components(range(len(texts)), lambda a, b: like(sets[a], sets[b]))
    assert len(set(expected.values())) > 10
    assert kept(spark, texts) == set(expected.values())

    parts = {x: k for k, x in enumerate(sorted(set(expected.values())))}
    large = [(7, k, len(sets[k]), parts[expected[k]], len(texts)) for k in range(len(texts))] + [(9, k, len(sets[k]), parts[expected[k]], 30) for k in range(30)]
    many = spark.createDataFrame(large, "bucket long, node long, size long, part long, n long")
    apart = {(a, b) for b in range(len(texts)) for a in range(b) if expected[a] != expected[b]}
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    links, pairs = shingles._open_pairs(many, nodes, 5)
    got = [(r.a, r.b) for r in pairs.collect()]
    assert not links.count() and set(got) <= apart and len(got) == len(set(got)) and len(got) < len(apart) / 10

    # were no pair linked yet, the pivots' links and the similar ones among the pairs would connect all
    links, pairs = shingles._open_pairs(many.withColumn("part", many.node), nodes, 5)
    found = {(r.a, r.b) for r in links.collect()} | {(r.a, r.b) for r in pairs.collect() if like(sets[r.a], sets[r.b])}
    assert all(like(sets[a], sets[b]) for a, b in found)
    assert least_of_components(range(len(texts)), lambda a, b: (a, b) in found) == expected


def test_the_driver_gives_freed_native_memory_back(spark):
    """Many small pieces of native memory, all but a few of them freed: the C library keeps them until it is told to trim."""
    jvm = spark.sparkContext._jvm
    df = spark.createDataFrame([(1, "one text"), (2, "another text")], "doc_id long, text string")

    def kept_mb(work):
        trim_jvm(spark)
        some, few = jvm.java.util.ArrayList(), jvm.java.util.ArrayList()
        for _ in range(3000):
            some.add(jvm.java.nio.ByteBuffer.allocateDirect(60_000))
        for k in range(0, 3000, 50):
            few.add(some.get(k))
        some = None
        gc.collect()
        time.sleep(1)  # py4j lets go
        jvm.System.gc()
        time.sleep(1)  # the JVM frees the buffers
        work()
        size, unit = re.search(r"\((-?\d+)([BKMG])", trim_jvm(spark)).groups()
        assert few.size() == 60
        return -int(size) * {"B": 1e-6, "K": 1e-3, "M": 1, "G": 1e3}[unit]

    if not re.search(r"RSS\+Swap: .*\(", trim_jvm(spark)):
        pytest.skip("this JVM cannot trim")
    assert kept_mb(lambda: None) > 60
    assert kept_mb(lambda: simhash.keep_one(df)) < 40
