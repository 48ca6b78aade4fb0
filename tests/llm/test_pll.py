import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lipika.llm import pll
from lipika.llm.queries import op2_lm_score


def plain_log_probability(network, numbers, k):
    p = network.part
    window = [numbers[k + o] if 0 <= k + o < len(numbers) else 0 for o in (-2, -1, 1, 2)]
    h = np.tanh(np.concatenate([p["embed"][w] for w in window]) @ p["w"] + p["b"])
    up, low = divmod(int(numbers[k]), pll.HALF)
    out = 0.0
    for z, i in ((h @ p["upper"] + p["upper_b"], up), ((h + p["given"][up]) @ p["lower"] + p["lower_b"], low)):
        z = z.astype(float)
        out += z[i] - np.log(np.exp(z).sum())
    return out


def plain_words(text):
    return re.findall(r"[,.]|[^,.\s\x00]+", (text or "").lower(), re.ASCII)


def numbers_of(vocabulary, text):
    return vocabulary.numbers(pll.words_of(pa.array([text or ""]))[3])


def test_scores_equal_word_by_word(monkeypatch):
    monkeypatch.setattr(pll, "BATCH", 7)
    rng = np.random.default_rng(0)
    network = pll.Network(rng.standard_normal(pll.N_WEIGHTS) * 0.3)
    vocabulary = pll.Vocabulary(["a", "b", "c", "."])
    texts = ["a b c. a", None, "", "a", "b zz yy a c, c b a " * 5, "  "]
    h, owner = pll.words_of(pa.array([t or "" for t in texts]))[3:]
    for text, n, total in zip(texts, *pll.score_texts(network, vocabulary, h, owner, len(texts))):
        numbers = numbers_of(vocabulary, text)
        assert n == len(numbers) == len(plain_words(text))
        assert total == pytest.approx(sum(plain_log_probability(network, numbers, k) for k in range(n)), rel=1e-4, abs=1e-6)


def test_step_follows_the_gradient():
    rng = np.random.default_rng(3)
    context, target = rng.integers(0, pll.WORDS, (32, 4)), rng.integers(0, pll.WORDS, 32)
    network = pll.Network()
    before = network.log_probabilities(context, target).mean()
    for _ in range(60):
        network.step(context, target)
    assert network.log_probabilities(context, target).mean() > before + 2


def test_natural_order_scores_higher_than_shuffled(spark):
    rng = random.Random(2)
    cycle = [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(300):
        s = rng.randrange(40)
        texts.append(" ".join(cycle[(s + k) % 40] for k in range(60)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    known = pll.vocabulary_of(df)
    assert sorted(known) == sorted(cycle)
    flat = pll.train(df, known, rounds=3)
    shuffled = [(k, " ".join(rng.sample(t.split(), 60))) for k, t in enumerate(texts[:50])]
    a = {r.doc_id: r.log_probability for r in pll.score(df, known, flat).collect()}
    b = {r.doc_id: r.log_probability for r in pll.score(spark.createDataFrame(shuffled, "doc_id long, text string"), known, flat).collect()}
    assert all(a[k] > b[k] for k in b)


def test_query_covers_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op2_lm_score(spark, sf).collect()}
    assert rows.keys() == docs.keys()
    assert all(r.n_words == len(plain_words(docs[i])) and r.log_probability < 0 for i, r in rows.items())
    assert np.mean([r.mean_log_probability for r in rows.values()]) > -np.log(pll.WORDS)


def test_nulls_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "a b"), (3, "a b"), (None, "a b")], "doc_id long, text string")
    rows = pll.score_corpus(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.mean_log_probability is None) for r in rows) == [(0, 2, False), (1, 0, True), (2, 0, True), (3, 2, False), (3, 2, False)]
    assert len({r.log_probability for r in rows if r.n_words}) == 1
    assert pll.score_corpus(df.limit(0)).count() == 0


def test_every_position_is_a_target_in_each_round(spark, tmp_path, monkeypatch):
    """Words at any one place of a text train the output layers: a word that stands only there is learned."""
    seen = str(tmp_path / "targets")
    step = pll.Network.step

    def noted(self, context, target):
        with open(seen, "a") as f:
            f.write("".join(f"{t}\n" for t in target.tolist()))
        return step(self, context, target)

    monkeypatch.setattr(pll.Network, "step", noted)
    words = [f"w{k}" for k in range(21)]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    made = pll.Vocabulary(words)

    class Local:
        """The frame's interface as far as the training task: runs it here."""

        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            out = [b for b in run(iter([pa.RecordBatch.from_arrays([pa.array([" ".join(words)])], names=["text"])]))]
            spark_rows = [(r["n"], r["flat"]) for b in out for r in b.to_pylist()]
            return spark.createDataFrame(spark_rows, schema)

    pll.train(Local(), words, rounds=2)
    with open(seen) as f:
        assert sorted(map(int, f.read().split())) == sorted(2 * numbers_of(made, " ".join(words)).tolist())
    assert len(pll.train(df, words, rounds=1)) == pll.N_WEIGHTS


def test_rare_words_count_by_their_own_frequency(spark, monkeypatch):
    """Two words of one bucket, one three times as frequent: the scores differ by its logarithm, and the parts of a bucket sum to one."""
    monkeypatch.setattr(pll, "KNOWN", 1)
    bucket = {}
    for k in range(10**6):
        same = bucket.setdefault(int(pll.bucket_of(pll.words_of(pa.array([f"r{k}"]))[3])[0]), [])
        same.append(f"r{k}")
        if len(same) == 2:
            break
    a, b = same
    rows = [(1, f"the {a} the"), (2, f"the {b} the"), (3, f"the {b} {b} the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.log_probability for r in pll.score_corpus(df).collect()}
    assert got[2] - got[1] == pytest.approx(np.log(3), abs=1e-4)
    part = pll.shares(pll.word_counts(df), ["the"]).collect()
    assert len(part) == 2 and sum(np.exp(r.log_share) for r in part) == pytest.approx(1)


def test_query_equals_brute_force(spark, monkeypatch):
    """Counts, shares and every word's probability by plain loops, with the weights that training gives."""
    monkeypatch.setattr(pll, "KNOWN", 12)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(30).coalesce(1)
    texts = {r.doc_id: r.text for r in df.collect()}
    counts = Counter(w for t in texts.values() for w in plain_words(t))
    known = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:12]]
    assert pll.vocabulary_of(df) == known
    network, vocabulary = pll.Network(pll.train(df, known)), pll.Vocabulary(known)
    number = {w: int(numbers_of(vocabulary, w)[0]) for w in counts}
    total = Counter()
    for w, n in counts.items():
        if w not in known:
            total[number[w]] += n
    got = {r.doc_id: r for r in pll.score_corpus(df).collect()}
    for i in sorted(texts)[:6]:
        ws = plain_words(texts[i])[:]
        numbers = [number[w] for w in ws]
        expected = sum(plain_log_probability(network, numbers, k) for k in range(len(ws)))
        expected += sum(np.log(counts[w] / total[number[w]]) for w in ws if w not in known)
        assert got[i].n_words == len(ws) and got[i].log_probability == pytest.approx(expected, rel=1e-3)


def test_long_texts_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b, " * 150_000, 5, 6, 7)], "doc_id long, text string, row long, n_words long, h long")
    r = pll.score_corpus(df).first()
    assert r.n_words == 450_000 and r.log_probability < 0
