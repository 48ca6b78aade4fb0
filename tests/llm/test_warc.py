import base64
import gzip
import hashlib
import io

import pytest

from lipika.llm import warc
from lipika.llm.queries import op6_warc

SF = "/root/testdata/sf0.001"


def expected(pages, least=0):
    """Brute force over a list of (page_id, html)."""
    groups = {}
    for i, html in pages:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for payload, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i in ids:
            revisit = len(ids) > 1 and len(payload) >= least and i != top and top is not None
            out.append((i, len(payload), digest, "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_normalise_makes_members_that_read_alone(tmp_path):
    raw = [warc.record(k, f"http://x/{k}", b"<p>%d\r\n\r\nWARC/1.1</p>" % k * (k * 3000 % 7001)) for k in range(40)]
    whole = gzip.compress(b"".join(raw[:25])) + gzip.compress(b"".join(raw[25:]))
    (tmp_path / "a.warc.gz").write_bytes(whole)
    n = warc.normalise(*(f"file://{tmp_path}/{x}" for x in ("a.warc.gz", "b.warc.gz", "b.idx")))
    assert n == 40
    data = (tmp_path / "b.warc.gz").read_bytes()
    assert gzip.decompress(data) == b"".join(raw)
    import json

    at = 0
    for line, r in zip((tmp_path / "b.idx").read_text().splitlines(), raw):
        offset, length, kind, _ = json.loads(line)
        assert offset == at and kind == "response" and gzip.GzipFile(fileobj=io.BytesIO(data[offset : offset + length])).read() == r
        at += length
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(raw)[:-50]))
    with pytest.raises(ValueError):
        warc.normalise(*(f"file://{tmp_path}/{x}" for x in ("c.warc.gz", "d.warc.gz", "d.idx")))


def test_query_equals_brute_force(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op6_warc(spark, SF).collect()), key=str) == expected(pages)


def test_revisits_nulls_ties_and_extra_columns(spark):
    rows = [(1, "u", "aa"), (5, "u", "aa"), (3, None, "aa"), (5, "v", "aa"), (None, "u", "aa"), (7, "u", None), (8, "u", ""), (-2, "u", "é"), (None, None, "zz")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as keeper", "3 as sha")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(warc.archive_pages(df)).collect()), key=str)
    assert got == expected([(r[0], r[2]) for r in rows])
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(warc.archive_pages(df, 2)).collect()), key=str)
    assert got == expected([(r[0], r[2]) for r in rows], 2)
    assert warc.read(warc.archive_pages(df.limit(0))).count() == 0


def test_cut_and_padded_streams():
    whole = gzip.compress(b"a" * 3_000_000, mtime=0) + gzip.compress(bytes(range(256)) * 20, mtime=0)
    plain = b"a" * 3_000_000 + bytes(range(256)) * 20
    read = lambda data: b"".join(warc.inflated(io.BytesIO(data)))
    assert read(whole) == plain and read(whole + b"\0" * 1500) == plain and read(b"") == b""
    first = len(gzip.compress(b"a" * 3_000_000, mtime=0))
    for n in (first + 1, first + 5, first + 12, len(whole) - 1, len(whole) - 5, 3, first - 4):
        with pytest.raises(ValueError, match="cut off"):
            read(whole[:n])
    with pytest.raises(ValueError):
        read(whole[:-6] + b"xx" + whole[-4:])
    with pytest.raises(ValueError):
        read(whole + b"junk")


def test_long_payloads_and_urls(spark):
    df = spark.createDataFrame([(1, "http://x/a b\n", "<p>" * 1_000_000), (2, "http://x", "<p>" * 1_000_000)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.read(warc.archive_pages(df)).collect()}
    assert rows[1].refers_to == 2 and rows[1].url == "http://x/a%20b%0A" and rows[2].payload_bytes == 3_000_000
