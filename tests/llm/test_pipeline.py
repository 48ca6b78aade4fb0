import re
from collections import Counter

import corpus_pipeline
from lipika.llm import simhash
from lipika.session import written
from tests.llm.conftest import least_of_components
from tests.llm.test_spans import brute

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def passes(text):
    """The policy, stated plainly."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    grams = Counter(zip(words, words[1:], words[2:]))
    repeated = {k + o for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    body = "".join(words)
    upper, lower, marks = sum(c.isupper() for c in body), sum(c.islower() for c in body), body.count("!")
    return not (
        n < 50
        or 100 * len(repeated) > 50 * n
        or 10 * sum(body.count(c) for c in "#*$%&|<>") > n
        or (len(lines) >= 4 and 10 * (len(lines) - len(set(lines))) > 3 * len(lines))
        or not 2 * n <= len(body) <= 20 * n
        or (upper > 2 * lower and upper >= 50)
        or (4 * marks > n and marks >= 10)
    )


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "language_id", "near_duplicates", "repeated_passages", "packing"]

    ruled = written(stages["quality_rules"](spark, docs, SF), "t")
    assert ruled.columns == columns
    assert {r.doc_id for r in ruled.collect()} == {i for i, t in rows.items() if passes(t)}

    spoken = written(stages["language_id"](spark, ruled, SF), "t")
    assert spoken.columns == columns
    before, after = ruled.count(), spoken.count()
    assert after >= 0.98 * before  # all of these are in the four languages

    single = written(stages["near_duplicates"](spark, spoken, SF), "t")
    assert single.columns == columns
    texts = {r.doc_id: shingles(r.text) for r in spoken.collect()}
    like = lambda a, b: len(texts[a] & texts[b]) / len(texts[a] | texts[b])
    kept = {r.doc_id for r in single.collect()}
    sure = least_of_components(sorted(texts), lambda a, b: like(a, b) >= 0.85)
    loose = least_of_components(sorted(texts), lambda a, b: like(a, b) >= 0.7)
    for group in set(sure.values()):
        assert len(kept & {i for i in sure if sure[i] == group}) <= 1
    assert set(loose.values()) <= kept

    cut = written(stages["repeated_passages"](spark, single, SF), "t")
    assert cut.columns == columns
    found = {r.doc_id: r for r in cut.collect()}
    expected = brute(sorted((r.doc_id, r.text) for r in single.collect()), 2, 12)
    assert {i: r.text for i, r in found.items()} == expected
    assert all(r.n_chars == len(r.text) for r in found.values())

    pieces = stages["packing"](spark, cut, SF).collect()
    assert {p.doc_id for p in pieces} == found.keys()
    tokens = Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert all(tokens[p.doc_id] == p.doc_tokens for p in pieces)


def test_run_goes_through_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_keep_one_with_nulls_ties_and_hot_groups(spark):
    text = " ".join(f"w{k}" for k in range(200))
    near = [(k, text.replace(f" w{k} ", f" x{k} ", 1), "z") for k in range(2, 60)]
    other = [(900, " ".join(f"v{k}" for k in range(200)), "z"), (901, None, "z"), (902, "", "z"), (900, " ".join(f"v{k}" for k in range(200)), "z"), (None, text, "z")]
    df = spark.createDataFrame(near + other, "doc_id long, text string, node string")
    got = simhash.keep_one(df, **(simhash.WIDE | {"small": 4}))
    assert sorted((r.doc_id or 0 for r in got.collect())) == [0, 2, 900, 901]
    assert simhash.keep_one(df.limit(0)).count() == 0
