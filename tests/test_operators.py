import json
import random

import pytest
from pyspark.sql import functions as F

from lipika import charset as ch
from lipika.errors import ConfigError, EmptyCorpusError, LoadError, VocabSizeError
from lipika.functions import text as T
from lipika.operators import corpus, dictionary, metrics, scoring, subword
from lipika.session import written
from lipika.sources import artefacts
from lipika.sources import text as sources

SENTENCES = list(sources.SAMPLE)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, SENTENCES[k % len(SENTENCES)]) for k in range(200)], "doc_id long, t string").cache()


def test_merges_equal_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    rng = random.Random(4)
    for _ in range(6):
        texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(8)) for _ in range(30)]
        counts: dict[str, int] = {}
        for t in texts:
            for w in subword.pre_tokens(t):
                counts[w] = counts.get(w, 0) + 1
        vocab, merges = subword.learn_merges(counts, 60, "xyz")
        lib = Tokenizer(models.BPE(unk_token="<unk>"))
        lib.pre_tokenizer = pre_tokenizers.Metaspace()
        lib.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=60, special_tokens=list(ch.SPECIALS), initial_alphabet=list("xyz"), show_progress=False))
        assert lib.get_vocab() == vocab
        model = subword.Model(dictionary.Dictionary("grapheme", {}), vocab, merges)
        for t in texts[:5]:
            assert [i for w in subword.pre_tokens(t) for i in model.encode_word(w)[0]] == lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize(("scheme", "algo"), [("grapheme", "bpe"), ("akshara", "bpe"), ("akshara", "unigram"), ("hybrid", "bpe")])
def test_models_keep_texts_and_clusters_whole(spark, docs, scheme, algo, tmp_path):
    model = subword.train(docs, "doc_id", "t", scheme=scheme, algo=algo, vocab_size=1500, min_atom_freq=1, k_fused=5)
    odd = spark.createDataFrame([(0, SENTENCES[0]), (1, "a b  c"), (2, ""), (3, None), (4, "日"), (5, chr(0x995) + ch.VIRAMA + chr(0x9A3) + " x")], "doc_id long, t string")
    rows = {r.doc_id: r for r in subword.encode(odd, model, "doc_id", "t").collect()}
    assert [rows[k].roundtrip_ok for k in range(6)] == [True, True, True, True, False, True]
    assert rows[2].ids == [] and rows[3].ids == [] and rows[0].n_cut == 0
    r = scoring.report(docs, model, "doc_id", "t").first()
    assert r.roundtrip_ok and r.n_fragmented == 0 and r.n_texts == 200 and r.fertility == r.n_tokens / r.n_words
    back = {x.doc_id: x.text for x in subword.decode(subword.encode(odd, model, "doc_id", "t"), model, "doc_id").collect()}
    assert back[0] == rows[0].norm and back[1] == "a b  c"
    artefacts.save(spark, model, str(tmp_path))
    again = artefacts.load(spark, str(tmp_path))
    assert (again.vocab, again.merges, again.made, again.scores) == (model.vocab, model.merges, model.made, model.scores)


def test_guard_takes_out_boundaries_inside_chunks():
    made = dictionary.Dictionary("hybrid", {"a": "A", "b": "B", "c": "C"})
    vocab = {t: k for k, t in enumerate([*ch.SPECIALS, "A", "B", "C", ch.MARKER, "AB", "BC", ch.MARKER + "AB"])}
    model = subword.Model(made, vocab, [("B", "C")])
    ids, parts, cut = model.encode_groups(["AB", "C", " ", "C"])
    assert parts == [ch.MARKER, "AB", "C", ch.MARKER, "C"] and cut == 0
    assert model.decode(ids) == "abc c"


def test_dictionary_order_and_unknowns(spark):
    df = spark.createDataFrame([(0, "xy"), (1, "xy zz"), (2, "é é")], "doc_id long, t string")
    made = dictionary.learn(df, "doc_id", "t", "grapheme", 2)
    singles = [p for p in made.atoms if len(p) == 1]
    assert singles == sorted(singles) and "é" in made.atoms and made.num_longer == 1 and len(singles) == 224 + 1
    assert list(made.atoms.values())[0] == chr(0xF0000)
    coded = dictionary.encode(spark.createDataFrame([(0, "x 日"), (1, ""), (2, "é")], "doc_id long, t string"), made, "doc_id", "t")
    atoms = {r.doc_id: r.atoms for r in coded.collect()}
    assert atoms[0] == made.atoms["x"] + " " + made.unknown and atoms[1] == "" and atoms[2] == made.atoms["é"]
    assert {r.doc_id: r.text for r in dictionary.decode(coded, made, "doc_id", "atoms").collect()} == {0: "x ", 1: "", 2: "é"}


def test_errors(spark, docs, tmp_path):
    empty = docs.limit(0)
    with pytest.raises(EmptyCorpusError):
        subword.train(empty, "doc_id", "t", vocab_size=1500)
    with pytest.raises(ConfigError):
        dictionary.check_size(dictionary.Dictionary("grapheme", {str(k): str(k) for k in range(300)}), 256)
    with pytest.raises(VocabSizeError):
        subword.train(docs, "doc_id", "t", vocab_size=10)
    with pytest.raises(ConfigError):
        subword.train(docs, "doc_id", "t", scheme="hybrid", algo="unigram")
    with pytest.raises(LoadError):
        artefacts.load(spark, str(tmp_path / "none"))


def test_mixes_and_slices(spark):
    rows = [("a", k, f"a{k}") for k in range(5)] + [("b", k, f"b{k}") for k in range(50)]
    lines = spark.createDataFrame(rows, "source string, doc_id long, line string")
    got = corpus.weighted_mix(lines, {"a": 1, "b": 3}, 80, ["doc_id"]).collect()
    by = {s: [r.line for r in sorted(got, key=lambda r: r.place) if r.source == s] for s in "ab"}
    assert by["a"] == [f"a{k % 5}" for k in range(20)] and by["b"] == [f"b{k % 50}" for k in range(60)]
    assert corpus.targets({"a": 1, "b": 1, "c": 1e-9}, 5) == {"a": 2, "b": 2, "c": 1}
    with pytest.raises(ConfigError):
        corpus.weighted_mix(lines, {"a": 1, "zz": 1}, 10, ["doc_id"])
    with pytest.raises(ConfigError):
        corpus.configured({"corpus_sources": {"other": 1.0}}, {"a": lines}, order=["doc_id"])
    mixed = corpus.configured({"corpus_sources": {"a": 1.0, "gone": 2.0}, "total_lines": 7}, {"a": lines.filter("source = 'a'").drop("source")}, ("gone",), ["doc_id"])
    assert mixed.count() == 7
    assert sorted(r.place for r in corpus.placed(lines, ["line"], rows=7).collect()) == list(range(55))


def test_held_out_ends_after_the_article(spark):
    docs = spark.createDataFrame([(k, "x\n\ny" if k % 2 else "z") for k in range(10)], "doc_id long, text string")
    got = corpus.held_out(docs, 2, 4, ["doc_id"]).orderBy("doc_id", "line_no").collect()
    assert [(r.doc_id, r.line) for r in got] == [(2, "z"), (3, "x"), (3, "y"), (4, "z")]


def test_sources(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "a.txt").write_bytes(b"one\n\n two\xff\n")
    (tmp_path / "d" / "e" / "b.txt").write_text("deep\n", encoding="utf-8")
    assert [r.line for r in sources.load_file(spark, str(tmp_path / "a.txt")).collect()] == ["one", " two�"]
    assert sources.load_paths(spark, [str(tmp_path / "*.txt"), str(tmp_path / "gone")]).count() == 2
    assert {r.line for r in sources.load_dir(spark, str(tmp_path)).collect()} == {"one", " two�", "deep"}
    with pytest.raises(ConfigError):
        sources.load_file(spark, str(tmp_path / "gone"))
    table = spark.createDataFrame([(1, "a b c d\nx", "web"), (2, "日日日日", "web"), (3, "e f g h", "pdf")], "doc_id long, text string, type string")
    table.write.parquet(str(tmp_path / "t"))
    (tmp_path / "s1.txt").write_text(" p \n\t\nq\n", encoding="utf-8")
    (tmp_path / "s2.txt").write_text("r\n\x0b\ns\n", encoding="utf-8")
    slices = lambda *a, **k: [r.line for r in sources.line_slice(spark, [str(tmp_path / "s*.txt")], *a, **k).orderBy(*sources.ORDER).collect()]
    assert slices() == ["p", "q", "r", "s"] and slices(1, 2) == ["q", "r"] and slices(0, 9, max_files=1) == ["p", "q"]
    assert [p.rsplit("/", 1)[-1] for p in sources.landed(spark, str(tmp_path), ["s2.txt", "s1.txt"])] == ["s2.txt", "s1.txt"]
    with pytest.raises(ConfigError):
        sources.landed(spark, str(tmp_path), ["s3.txt"])
    for name in ("train", "validation", "test"):
        spark.createDataFrame([(k, f"{name}{k}") for k in range(2)], "doc_id long, text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert [r.text for r in sources.splits(spark, str(tmp_path), offset=1, limit=3).orderBy("split_no", "doc_id").collect()] == ["train1", "validation0", "validation1"]
    got = sources.documents(spark, str(tmp_path / "t"), "web", limit=5, clean=True)
    assert [(r.doc_id, r.line) for r in got.collect()] == [(1, "a b c d")]


def test_pairwise_and_interior_cuts(spark):
    k, v, t = chr(0x995), ch.VIRAMA, chr(0x9A4)
    df = spark.createDataFrame([([k + v, t],), ([k, "", "b"],), (["a"],), ([],)], "s array<string>")
    assert [r.n for r in df.select(scoring.pairwise(F.col("s")).alias("n")).collect()] == [1, 0, 0, 0]
    text = k + v + t + " a" + k  # clusters of 3, 1, 1 and 1 code points
    cuts = spark.createDataFrame([(text, [3, 4]), (text, [5, 2, 1]), (text, None), ("", [])], "t string, b array<int>")
    got = [tuple(r.f) for r in cuts.select(scoring.cut_clusters(F.col("t"), F.col("b")).alias("f")).collect()]
    assert got == [(3, 0), (3, 1), (None, None), (0, 0)]


def test_places_are_whole_at_three_million_rows(spark):
    """With a payload, ties and repeated rows; read twice by different columns."""
    df = spark.range(3_000_000, numPartitions=12).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_000))).alias("k"), F.repeat(F.lit("x"), 20).alias("payload"))
    df = df.unionByName(df.limit(5)).unionByName(spark.createDataFrame([(None, "y")], df.schema))
    got = written(corpus.placed(df, ["k"]).select("k", "place", "payload"), "placed")
    n = 3_000_006
    s = got.agg(F.count("*"), F.countDistinct("place"), F.min("place"), F.max("place")).first()
    assert tuple(s) == (n, n, 0, n - 1)
    assert got.filter("place = 0").first().payload == "y"
    some = corpus.offset_limit(df, 2_500_000, 100, ["k"]).agg(F.count("*").alias("n"), F.min("k").alias("low")).first()
    low = got.filter("place = 2500000").first().k
    assert (some.n, some.low) == (100, low)


def test_places_in_groups_with_nulls_and_slices_past_the_end(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3), ("a", None)], "g string, k int")
    got = sorted((r.g or "", r.k or 0, r.place) for r in corpus.placed(df, ["k"], within=["g"], rows=1).collect())
    assert got == [("", 1, 0), ("", 2, 1), ("a", 0, 0), ("a", 3, 1)]
    assert corpus.offset_limit(df, 4, 5, ["k"]).count() == 0 and corpus.offset_limit(df.limit(0), 0, 5, ["k"]).count() == 0
    assert corpus.offset_limit(df, 1, None, ["k"], rows=1).count() == 3


def test_register_slices_do_not_meet(spark):
    df = spark.createDataFrame([("a" if k % 3 else "b", k) for k in range(30)], "source string, doc_id long")
    got = corpus.register_slices(df, {"a": 4, "b": 2}, 3, ["doc_id"]).collect()
    parts = {(r.source, r.part): sorted(x.doc_id for x in got if (x.source, x.part) == (r.source, r.part)) for r in got}
    assert parts == {("a", "train"): [1, 2, 4, 5], ("a", "held_out"): [7, 8, 10], ("b", "train"): [0, 3], ("b", "held_out"): [6, 9, 12]}
    again = corpus.versioned(df.orderBy(F.rand(1)), "v2").collect()
    assert sorted(again) == sorted(corpus.versioned(df, "v2").collect())


def test_dictionary_keeps_rows_of_one_id_apart_and_gives_spans(spark):
    made = dictionary.Dictionary("grapheme", {"a": chr(0xF0000), "b": chr(0xF0001), "bc": chr(0xF0002), "c": chr(0xF0003)})
    df = spark.createDataFrame([(1, "ab"), (1, "c d"), (2, None), (3, "")], "id long, t string")
    rows = dictionary.encode(df, made, "id", "t").collect()
    assert [(r.id, None if r.spans is None else [tuple(s) for s in r.spans]) for r in rows] == [(1, [(0, 1), (1, 2)]), (1, [(0, 1), (2, 3)]), (2, None), (3, [])]
    back = dictionary.decode(dictionary.encode(df, made, "id", "t"), made, "id", "atoms")
    assert [r.text for r in back.collect()] == ["ab", "c ", None, ""]
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()


def test_offsets_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "c"), (2, None)], "id long, t string")
    rows = T.chunk_rows(df, "id", "t")
    assert [(r.id, r.chunk, r.start, r.end) for r in rows.collect()] == [(1, "a", 0, 1), (1, "b", 1, 2), (1, "c", 0, 1)]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_error_rates(spark):
    ka = chr(0x995) + chr(0x9BE)
    df = spark.createDataFrame([(ka + "b", "ab", 0), ("a x c", "a b c", 1), ("", "", 2), ("abcdef", "abcdxf", 3)], "h string, r string, k int")
    h, r = F.col("h"), F.col("r")
    got = df.select(metrics.gcer(h, r).alias("g"), metrics.cer(h, r).alias("c"), metrics.wer(h, r).alias("w"), metrics.made_up(h, r).alias("m")).collect()
    assert [tuple(x) for x in got] == [(0.5, 1.0, 1.0, None), (0.2, 0.2, 1 / 3, 1.0), (None, None, None, None), (1 / 6, 1 / 6, 1.0, 2 / 3)]
    kept = metrics.agreeing(df.select("k", h.alias("text")), df.select("k", r.alias("text")), "k", most=0.2).collect()
    assert [x.k for x in kept] == [1, 3]


def test_superwords(spark, docs):
    m = ch.MARKER
    coded = spark.createDataFrame([([m + "a", "x", m + "b", m + "a", "x", m + "b"],), (None,), ([],)], "tokens array<string>")
    pairs = subword.superwords(coded, 5)
    assert [tuple(r) for r in pairs.collect()] == [("x", m + "b", 2)]
    assert [r.tokens for r in subword.with_superwords(coded, pairs).collect()] == [[m + "a", "x" + m + "b", m + "a", "x" + m + "b"], None, []]


def test_surfaces_join_into_the_text(spark, docs):
    model = subword.train(docs, "doc_id", "t", vocab_size=1500, min_atom_freq=1)
    assert scoring.surface_mismatches(subword.encode(docs, model, "doc_id", "t")).count() == 0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from lipika import cli

    monkeypatch.setattr(cli, "session", lambda *a: spark)
    (tmp_path / "x.txt").write_text("\n".join(SENTENCES * 3), encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps({"corpus_sources": {"one": 2, "gone": 1}, "paths": {"one": [str(tmp_path / "x.txt")], "gone": []}, "total_lines": 30}))
    model = str(tmp_path / "m")
    size = ["--vocab-size", "1500", "--min-atom-freq", "1", "--model", model]
    assert cli.main(["train", "--corpus-config", str(tmp_path / "c.json"), *size]) == 0
    assert json.loads(capsys.readouterr().out)["n_texts"] == 30
    assert cli.main(["train", "--input", str(tmp_path / "x.txt"), "--limit", "5", "--scheme", "akshara", *size]) == 0
    assert json.loads(capsys.readouterr().out)["n_texts"] == 5
    assert cli.main(["evaluate", "--model", model, "--text", SENTENCES[0]]) == 0 and json.loads(capsys.readouterr().out)["roundtrip_ok"]
    assert cli.main(["encode", "--model", model, "--text", "a b"]) == 0 and json.loads(capsys.readouterr().out)["roundtrip_ok"]
    assert cli.main(["akshara", "--text", "a"]) == 0 and json.loads(capsys.readouterr().out)["codepoints"] == ["U+0061"]
    assert cli.main(["featurize", "--text", chr(0x995)]) == 0 and json.loads(capsys.readouterr().out)["kind"] == "akshara"
    assert cli.main(["compare", model, "--text", SENTENCES[0]]) == 0 and "fertility" in capsys.readouterr().out
    assert cli.main(["glyphs"]) in (0, 2)
    capsys.readouterr()
    assert cli.main(["evaluate", "--model", str(tmp_path / "none"), "--text", "a"]) == 1
    assert cli.main(["train", "--corpus-config", str(tmp_path / "x.txt"), *size]) == 1
    assert "error" in capsys.readouterr().err


def test_stream_of_rows(spark, tmp_path):
    from lipika.streaming import rows

    spark.createDataFrame([("bn", SENTENCES[0]), ("bn", SENTENCES[1])], "lang string, text string").write.parquet(str(tmp_path / "in"))
    q = rows.running_fertility(rows.read(spark, str(tmp_path / "in"), "lang string, text string"), "lang").writeStream.outputMode("complete").format("memory").queryName("fert").start()
    try:
        q.processAllAvailable()
        r = spark.sql("select * from fert").first()
        assert r.n_words == sum(len(s.split()) for s in SENTENCES[:2]) and r.fertility == r.n_aksharas / r.n_words
    finally:
        q.stop()


def test_glyph_check_is_skipped_without_the_library(spark, docs):
    from lipika.functions import shaping

    assert shaping.validate(docs, "t")["status"] in ("skipped", "pass", "fail")
