import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lipika.llm import flat, packing, tokens
from lipika.llm.queries import op8_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def library(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encoder_equals_the_library():
    rng = random.Random(3)
    bits = ["the", "Of", "ménü", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "'re", "don't", "1", "23,", "x1.", "...", "?!", "—", "\xa0", "日本", "🙂", "\0", "\x1c", "²", "a.b", " ", " ", "<|endoftext|>", "é.", "İ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)] + [None, "", " ", "\n", "a ", " a", "a\n", "\na"]
    texts += ["long" * 40_000 + " end", "'t 't't x't9'll.'s"]
    for remember in (400_000, 5):
        enc = tokens.ByteEncoder(PATH, 0, remember)
        got = []
        for part in (texts[:1500], texts[1500:]):
            for some in flat.groups(pa.array(part, pa.string()), 10_000):
                ids, ends = enc.encode(some)
                got += [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [[*x, 0] for x in library(texts)]


def test_one_id_for_many_rows_is_dealt_over_salts(spark):
    df = spark.range(400).select(F.lit(7).alias("doc_id"), F.lit("a b c").alias("text"), F.lit(1).alias("n"), F.lit(2).alias("row"))
    rows = packing.pack(df, PATH, 16, rows_per_salt=10).collect()
    assert sum(r.length for r in rows) == 1600
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_remainder_once(seed):
    rng = np.random.default_rng(seed)
    window = 128
    histogram = rng.integers(0, [3, 40, 5, 300][seed], window)
    histogram[77] += [0, 500, 0, 4000][seed]
    made = packing.plan(histogram, window)
    at = {}
    for length in range(1, window):
        for rank in range(histogram[length]):
            pieces = made.remainder(length, rank)
            assert sum(p[2] for p in pieces) == length
            for s, o, n in pieces:
                at.setdefault(s, []).append((o, n))
    assert all(s < made.first_whole for s in at)
    short = 0
    for pieces in at.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end = o + n
        assert end <= window
        short += end < window
    assert short <= 1


def test_query_covers_every_id_once(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = dict(zip(docs, ([*x, 0] for x in library(docs.values()))))
    rows = op8_packing(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        end = 0
        for r in sorted(pieces, key=lambda r: r.start):
            piece = np.array(ids[d][r.start : r.start + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (end, zlib.crc32(piece), len(ids[d]))
            end += r.length
        assert end == len(ids[d])
    padding = 0
    for pieces in by_sequence.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end <= 1024
        padding += 1024 - end
    assert padding < 1024


def test_nulls_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, "")], "doc_id long, text string")
    rows = packing.pack(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows) == [(0, 3), (1, 1), (1, 1), (2, 1)]
    assert packing.pack(df.limit(0), PATH).count() == 0
