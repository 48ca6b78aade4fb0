import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lipika.llm import langid
from lipika.llm.queries import op5_language_id


def brute_probability(text):
    """Interpolated Kneser-Ney with dictionaries: a function of four symbols."""
    padded = [32] * 3 + langid.symbols(text).tolist()
    level = Counter(tuple(padded[k : k + 4]) for k in range(len(padded) - 3))
    levels = []
    for _ in range(4):
        once, twice = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = defaultdict(int), defaultdict(int)
        for g, c in level.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        levels.append((level, total, kinds, d))
        level = Counter(g[1:] for g in level)

    def p(g, k=0):
        if not g:
            return 1 / 65536
        counts, total, kinds, d = levels[k]
        low = p(g[1:], k + 1)
        h = g[:-1]
        return max(counts[g] - d, 0) / total[h] + d * kinds[h] / total[h] * low if total.get(h) else low

    return p


def key(g):
    return sum(int(c) << 16 * (3 - k) for k, c in enumerate(g))


def test_kneser_ney_equals_dictionaries():
    text = "the cat sat on the mat, that cat; the hat of the cat is flat. " * 2 + "thé end"
    keys, n = np.unique(langid.grams(text), return_counts=True)
    model = langid.KneserNey.of_counts(keys, n)
    p = brute_probability(text)
    probes = [tuple(map(ord, g)) for g in ("the ", "cat ", "zzzz", "that", " thé", "q at", "atx ")]
    got = model.probability(np.array([key(g) for g in probes], np.uint64))
    assert got == pytest.approx([p(g) for g in probes])
    some = [chr(c) for c in sorted({c for g in map(tuple, [langid.symbols(text)]) for c in g})]
    mass = sum(p((ord("t"), ord("h"), ord("e"), ord(c))) for c in some)
    assert 0.99 < mass <= 1.0 + 1e-9


def test_symbols():
    assert "".join(map(chr, langid.symbols("Ab,  c1É!"))) == "ab c é "
    kara = "".join(map(chr, (0x995, 0x9BE, 0x9B0, 0x9CD, 0x9AF)))  # vowel signs and viramas stay
    assert "".join(map(chr, langid.symbols(kara + "1" + kara))) == kara + " " + kara
    assert len(set(langid.symbols(chr(0x10400 + 40) + chr(0x10400 + 41)).tolist())) == 2
    assert len(langid.symbols("12 !")) == 0 and len(langid.symbols(None)) == 0


def test_held_out_accuracy_and_fold(spark):
    import zlib

    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op5_language_id(spark, sf).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in lang}
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)


def test_rejection_nulls_and_empty_tables(spark):
    base = [(k, f"the quick brown fox number {k} jumps over the lazy dog again and again", "en", 1) for k in range(1500)]
    odd = [(9900, None, None, 1), (9901, "12 ?", "en", 1), (9902, "ﬀж" * 200, None, 1), (9902, "ﬀж" * 200, None, 1), (None, "the lazy dog", None, 1)]
    df = spark.createDataFrame(base + odd, "doc_id long, text string, lang string, language int")
    found, name = langid.predict(df, langid.fit(df))
    assert name == "language_1"
    got = {(r.doc_id, r[name].language, r[name].rejected) for r in found.filter("doc_id >= 9900 or doc_id is null").collect()}
    assert got == {(9900, "und", False), (9901, "und", False), (9902, "en", True), (None, "en", False)}
    none, name = langid.predict(df.limit(1), langid.fit(df.filter("lang = 'xx'")))
    assert none.first()[name].language == "und"
    assert langid.predict(df.limit(0), langid.fit(df.limit(0)))[0].count() == 0
    assert not spark.range(1).select(langid.held_out(F.lit(None).cast("long")).alias("h")).first().h and math.isfinite(1.0)


def test_statistics_are_those_of_all_grams(spark):
    """The model from Spark equals one from arrays; with a small lookup table its totals and discounts stay."""
    text = "le chat est sur la table et le chien dort sous la table " * 3 + "fin"
    df = spark.createDataFrame([(1, text, "fr"), (2, text[:40], "fr"), (3, "the end", "en")], "doc_id long, text string, lang string")
    counts = langid.gram_counts(df, "lang", "text")
    keys, n = np.unique(np.concatenate([langid.grams(text), langid.grams(text[:40])]), return_counts=True)
    whole = langid.KneserNey.of_counts(keys, n)
    for most in (1000, 20):
        made = langid._levels(counts, ["en", "fr"], most)["fr"]
        for a, b in zip(made.levels, whole.levels):
            assert a[0] == b[0] and a[6] == b[6] and len(a[1]) <= len(b[1])
            at = np.searchsorted(b[3], a[3])
            assert (b[3][at] == a[3]).all() and (a[4] == b[4][at]).all() and (a[5] == b[5][at]).all()
        if most == 1000:
            assert made.probability(keys) == pytest.approx(whole.probability(keys))


def test_models_are_gathered_as_arrays(spark, monkeypatch):
    """No Python object for each value of a model: the driver's memory is small."""
    rows = [(k, " ".join(chr(0x4E00 + (k * 131 + j * j) % 9000) for j in range(200)), "zh") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = langid.gram_counts(df, "lang", "text").localCheckpoint()
    assert counts.count() > 50_000
    langid._levels(counts, ["zh"], 1000)  # what is loaded once
    taken = []
    monkeypatch.setattr(type(df), "toPandas", lambda self: taken.append(self) or pytest.fail("rows as Python objects"))
    tracemalloc.start()
    made = langid._levels(counts, ["zh"], 400_000)["zh"]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert not taken and len(made.levels[0][1]) == counts.count()
    assert peak < 200 * counts.count() / 1e6


def test_labels_null_ids_long_texts_and_extra_columns(spark):
    rows = [(None, f"text number {k} of all", "en", 1, 2) for k in range(300)] + [(1, "a long text of letters, " * 100_000, "en", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, gram int, n int")
    model = langid.fit(df)
    found, name = langid.predict(df, model)
    assert found.count() == 301 and {r[name].language for r in found.select(name).collect()} == {"en"}
    many = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="labels"):
        langid.fit(many, most_languages=4)


def test_query_equals_brute_force(spark):
    """The least cross-entropy of plain dictionaries over the rows that are learned from names the same languages."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    seen = docs.filter(~langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()
    texts = {x: [r.text for r in seen if r.lang == x] for x in {r.lang for r in seen}}
    models = {}
    for x, ts in texts.items():
        keys, n = np.unique(np.concatenate([langid.grams(t) for t in ts]), return_counts=True)
        models[x] = langid.KneserNey.of_counts(keys, n)
    got = {r.doc_id: r for r in op5_language_id(spark, sf).collect()}
    for r in docs.collect()[::7]:
        g = langid.grams(r.text)
        if len(g):
            bits = {x: float(-np.log2(m.probability(g)).mean()) for x, m in models.items()}
            best = min(sorted(bits), key=bits.get)
            assert (got[r.doc_id].lang_pred, got[r.doc_id].bits) == (best, pytest.approx(bits[best], rel=1e-4))


def test_no_gram_is_left_out_beyond_the_arrays_in_memory(spark):
    """Levels in files hold every gram, travel as names and predict as those in memory do."""
    import pickle

    kara = "".join(map(chr, (0x995, 0x9BE, 0x9B0, 0x9CD, 0x9AF, 0xAC00, 0xD7A3)))  # the last two make keys beyond the signed range
    rows = [(k, f"{kara} le chat numero{chr(97 + k % 26)} est sur la table {chr(0xAC00 + k)}", "fr") for k in range(60)]
    rows += [(k, f"the end of row{chr(97 + k % 26)} and of the words in it", "en") for k in range(60, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = langid.gram_counts(df, "lang", "text")
    for name, made in langid._levels(counts, ["en", "fr"], 20).items():
        keys, n = np.unique(np.concatenate([langid.grams(t) for _, t, x in rows if x == name]), return_counts=True)
        whole = langid.KneserNey.of_counts(keys, n)
        back = pickle.loads(pickle.dumps(made))
        assert len(pickle.dumps(made)) < 4000 and len(made.frequent) == 10 and 0 in made.files
        for m in (made, back):
            assert all((np.asarray(x) == np.asarray(y)).all() for a, b in zip(m.levels, whole.levels, strict=True) for x, y in zip(a, b, strict=True))
        assert back.probability(keys) == pytest.approx(whole.probability(keys))
    small, large = langid.fit(df, most_grams=20), langid.fit(df)
    got, expected = ([tuple(r["language"]) for r in langid.predict(df, m)[0].orderBy("doc_id").collect()] for m in (small, large))
    assert [r[0] for r in got] == [r[0] for r in expected] and [r[2] for r in got] == pytest.approx([r[2] for r in expected], rel=1e-5)
