import hashlib
import random
import time

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lipika.llm import lexicon
from lipika.llm.queries import op3_lexicon_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def codec(words):
    bpe = lexicon.WordBpe(PATH)
    return lexicon.Codec(PATH, lexicon.Lexicon.from_image(lexicon.compile_lexicon(words, [bpe.merge(w) for w in words])))


def test_automaton_is_exact_and_shares_suffixes():
    words = [a + b for a in ("walk", "talk", "stalk", "é") for b in ("ing", "ed", "s", "")]
    lex = lexicon.Lexicon.from_image(lexicon.compile_lexicon(words, [[k, k + 1] for k in range(len(words))]))
    assert lex.lookup(words) == [[k, k + 1] for k in range(len(words))]
    assert lex.lookup(["walki", "", "x", "walkings"]) == [None] * 4
    assert len(lex.final) < 25
    empty = lexicon.Lexicon.from_image(lexicon.compile_lexicon([], []))
    assert empty.lookup(["a", ""]) == [None, None]


def test_codec_equals_the_library():
    rng = random.Random(9)
    bits = ["the", "World", "É", "é", "ΑΣ", "İ", "ß", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "don't", "12", "²", "...", "!?", "日本", "🙂", "<|endoftext|>", "ǅ", "’", "—", "a" * 70, "K", "ﬁ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(10))) for _ in range(3000)] + [None, "", " "]
    t = library()
    c = codec(["the", "world", "é", "walk"])
    for remember in (10**6, 3):
        c.remember = remember
        got = [g for at in range(0, len(texts), 1000) for g in c.encode_batch(texts[at : at + 1000])]
        for text, (raw, decoded) in zip(texts, got):
            ids = t.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(raw, "<u4").tolist() == ids, text
            assert decoded == t.decode(ids, skip_special_tokens=False)


def test_query_equals_the_library(spark):
    t = library()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op3_lexicon_bpe(spark, SF).collect()}
    for r in docs:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_nulls_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (1, "a b"), (1, "a b"), (None, "")], "doc_id long, text string")
    image = lexicon.build(df, PATH)
    got = sorted((r.n_tokens, r.decoded) for r in lexicon.encode(df, PATH, image).collect())
    assert got == [(0, ""), (0, ""), (2, "a</w> b</w>"), (2, "a</w> b</w>")]
    none = df.limit(0)
    assert lexicon.encode(none, PATH, lexicon.build(none, PATH)).count() == 0


def test_words_merged_together_equal_words_merged_alone():
    rng = random.Random(4)
    bpe = lexicon.WordBpe(PATH)
    words = ["".join(rng.choice("aabeinorst'.!éß—’") for _ in range(rng.randrange(1, 30))) for _ in range(3000)] + ["a", "aaaaaaaaa", "é"]
    ids, count = bpe.merge_all(words)
    ends = np.cumsum(count)
    assert [ids[z - n : z].tolist() for z, n in zip(ends, count)] == [bpe.merge(w) for w in words]
    assert [len(x) for x in bpe.merge_all([])] == [0, 0]


def test_new_words_cost_less_than_merging_each_alone():
    rng = random.Random(5)
    c = codec(["the"])
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(15_000)]
    text = " ".join(words)
    c.encode_batch(["some words to begin with"])
    began = time.process_time()
    (raw, _), = c.encode_batch([text])
    took, began = time.process_time() - began, time.process_time()
    alone = [x for w in words for x in c.bpe.merge(w)]
    assert np.frombuffer(raw, "<u4").tolist() == alone
    assert took < time.process_time() - began


def test_stretches_that_share_a_hash_keep_their_own_ids(monkeypatch):
    hashes = lexicon.fl.hashes
    monkeypatch.setattr(lexicon.fl, "hashes", lambda *a: hashes(*a) & np.uint64(7))
    t = library()
    c = codec(["the"])
    rng = random.Random(6)
    for _ in range(20):
        texts = [" ".join(rng.choice(["the", "eht", "walk", "klaw", "É", "日本", "x" * 70]) for _ in range(rng.randrange(9))) for _ in range(20)]
        for text, (raw, decoded) in zip(texts, c.encode_batch(texts)):
            ids = t.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(raw, "<u4").tolist() == ids
            assert decoded == t.decode(ids, skip_special_tokens=False)


def test_zero_bytes_special_tokens_and_all_white_space(spark):
    bits = ["a", "B", "\0", "<|endoftext|>", *lexicon.SPACE, "\u0301", "\u200b", "日本", "x" * 70]
    rng = random.Random(7)
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(8))) for _ in range(2000)] + ["日本", "\u3000", "\0", ""]
    t = library()
    for c, at in ((codec(["a"]), slice(None)), (codec([]), slice(-4, None))):
        for text, (raw, decoded) in zip(texts[at], c.encode_batch(texts[at])):
            ids = t.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(raw, "<u4").tolist() == ids, text
            assert decoded == t.decode(ids, skip_special_tokens=False)
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    got = dict(lexicon.encode(df, PATH, lexicon.build(df, PATH)).select("doc_id", "n_tokens").collect())
    assert got == {k: len(t.encode(x or "", add_special_tokens=False).ids) for k, x in enumerate([*texts, None])}


def test_texts_longer_than_a_group(monkeypatch):
    monkeypatch.setattr(lexicon, "GROUP", 16)
    rng = random.Random(8)
    t = library()
    c = codec(["the"])
    texts = [" ".join(rng.choice(["the", "Walk", "é", "\u3000", "日本", "x" * 70]) for _ in range(n)) for n in (0, 1, 400, 3)]
    for some in ([""], [], texts):
        for text, (raw, decoded) in zip(some, c.encode_batch(some), strict=True):
            ids = t.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(raw, "<u4").tolist() == ids
            assert decoded == t.decode(ids, skip_special_tokens=False)
