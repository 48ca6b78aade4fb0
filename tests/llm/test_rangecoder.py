import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lipika.llm import rangecoder, tokens
from lipika.llm.queries import op4_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def some_blocks(rng):
    words = [rng.integers(0, 50_000, rng.integers(1, 5)) for _ in range(60)]
    return [
        *(rng.integers(0, 50_257, int(k)) for k in rng.integers(0, 200, 30)),
        np.concatenate([words[k] for k in rng.zipf(1.5, 900) % 60]),
        np.zeros(700, int),
        np.array([5]),
        np.array([], int),
        np.arange(2000) % 3,
        rng.integers(0, 4_000_000, 50),
    ]


@pytest.mark.parametrize("seed", range(3))
def test_blocks_round_trip(seed):
    blocks = some_blocks(np.random.default_rng(seed))
    coded = rangecoder.encode_blocks(blocks)
    for a, b in zip(blocks, rangecoder.decode_blocks(coded)):
        assert a.tolist() == b.tolist()
    alone = [rangecoder.decode_blocks([c])[0].tolist() for c in coded]
    assert alone == [b.tolist() for b in blocks]
    assert coded == [rangecoder.encode_blocks([b])[0] for b in blocks]  # a block does not depend on its lane
    assert len(coded[31]) < 60  # one repeated id


def test_damage_is_seen():
    raw = rangecoder.encode_blocks([np.arange(500)])[0]
    with pytest.raises(ValueError):
        rangecoder.decode_blocks([raw[:80] + bytes([raw[80] ^ 1]) + raw[81:]])


def test_files_keep_documents(monkeypatch):
    monkeypatch.setattr(rangecoder, "BLOCK", 64)
    monkeypatch.setattr(rangecoder, "LANES", 5)
    rng = np.random.default_rng(7)
    docs = [(k if k % 7 else None, rng.integers(0, 300, int(n)).astype(np.uint32)) for k, n in enumerate([0, 0, 3, 700, 64, 0, 128, 1, 2000, 0])]
    out = io.BytesIO()
    w = rangecoder.FileWriter(out)
    for k, ids in docs:
        w.add(k, ids)
    assert w.close() == sum(len(i) for _, i in docs)

    class File:
        def size(self):
            return len(out.getvalue())

        def read_at(self, n, at):
            return out.getvalue()[at : at + n]

    assert [(k, i.tolist()) for k, i in rangecoder.read_file(File())] == [(k, i.tolist()) for k, i in docs]
    assert isinstance(pa.__version__, str)


def test_blocks_of_several_groups_of_lanes():
    rng = np.random.default_rng(11)
    blocks = [rng.zipf(1.3, int(n)) % 50_257 for n in rng.integers(0, 300, 2 * rangecoder._GROUP + 9)]
    coded = rangecoder.encode_blocks(blocks)
    assert coded == [rangecoder.encode_blocks([b])[0] for b in blocks]
    assert [b.tolist() for b in rangecoder.decode_blocks(coded)] == [b.tolist() for b in blocks]


def test_the_last_blocks_of_a_file_fill_lanes(monkeypatch):
    # a few blocks by themselves cost several times as much an id
    monkeypatch.setattr(rangecoder, "BLOCK", 64)
    monkeypatch.setattr(rangecoder, "LANES", 8)
    lanes = []
    for name in ("encode_blocks", "decode_blocks"):
        monkeypatch.setattr(rangecoder, name, lambda some, f=getattr(rangecoder, name): lanes.append(len(some)) or f(some))
    out = io.BytesIO()
    w = rangecoder.FileWriter(out)
    ids = np.arange(64 * 11 - 5, dtype=np.uint32) % 300
    w.add(1, ids)
    w.close()

    class File:
        def size(self):
            return len(out.getvalue())

        def read_at(self, n, at):
            return out.getvalue()[at : at + n]

    assert [(k, i.tolist()) for k, i in rangecoder.read_file(File())] == [(1, ids.tolist())]
    assert lanes == [11, 11]


def test_a_worker_keeps_the_encoder_of_one_table():
    made = []
    make = lambda: made.append(1) or len(made)
    assert [tokens.kept(name, make) for name in ("a", "a", "b", "a")] == [1, 1, 2, 3]
    tokens.forget()
    assert tokens.kept("a", make) == 4
    tokens.forget()


def test_query_equals_the_library(spark):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    start, expected = 0, []
    for i, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op4_token_files(spark, SF).collect()) == expected


def test_nulls_ties_several_files_and_empty_tables(spark):
    df = spark.createDataFrame([(2, "b"), (1, None), (1, "a"), (None, "z z"), (3, "a b c")], "doc_id long, text string")
    rows = rangecoder.read_tokens(rangecoder.write_tokens(df, PATH, documents_per_file=2)).collect()
    got = sorted((r.start, r.id, r.n_tokens) for r in rows)
    assert [(i, n) for _, i, n in got] in ([(None, 3), (1, 1), (1, 2), (2, 2), (3, 4)],)
    assert [s for s, _, _ in got] == [0, 3, 4, 6, 8]
    assert rangecoder.read_tokens(rangecoder.write_tokens(df.limit(0), PATH)).count() == 0
