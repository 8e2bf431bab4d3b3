import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import media, warc


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([None, 0, 1, 2]))
def test_png_round_trip(raw, kind):
    samples = np.frombuffer(media.payload(raw), dtype=np.uint8).reshape(-1, 64)
    assert (media.png_decode(media.png_encode(samples, kind)) == samples).all()


def test_every_filter_of_another_writer():
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, (10, 7), dtype=np.uint8)
    lines = []
    for k, line in enumerate(samples.astype(int)):
        above = samples[k - 1].astype(int) if k else np.zeros(7, int)
        kind = k % 5
        body = []
        for i in range(7):
            a, b, c = (line[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            body.append((line[i] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        lines.append(bytes([kind, *body]))
    import struct
    import zlib

    png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, 0, 0, 0, 0)) + media._chunk(b"tEXt", b"a\0b") + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert (media.png_decode(png) == samples).all()


def test_each_row_takes_the_filter_of_least_differences():
    flat, steps = np.full((1, 64), 200, dtype=np.uint8), np.arange(0, 128, 2, dtype=np.uint8)[None, :]
    noise = np.random.default_rng(4).integers(0, 256, (1, 64), dtype=np.uint8)
    samples = np.concatenate([np.zeros((1, 64), np.uint8), steps, noise, noise, flat])
    png = media.png_encode(samples)
    lines = zlib.decompress(png[41 : 41 + int.from_bytes(png[33:37], "big")])
    assert [lines[k * 65] for k in (0, 1, 3, 4)] == [0, 1, 2, 1]
    assert (media.png_decode(png) == samples).all()


def test_long_texts_are_sliced_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(media, "SLICE_BYTES", 1 << 20)
    texts = ["ab" * 700_000, None, "", "x" * 64, "y" * 65, "long " * 1_000_000]
    assert [n for _, n in media.slices(pa.array([t and t.encode() for t in texts]))] == [1, 4, 1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = {r["doc_id"]: r for r in media.features(media.to_media(docs)).collect()}
    assert all(rows[k]["payload_sha256"] == hashlib.sha256(media.payload((t or "").encode())).hexdigest() for k, t in enumerate(texts))


def test_damage_is_found():
    png = media.png_encode(np.arange(640, dtype=np.uint16).astype(np.uint8).reshape(-1, 64))
    for bad in (png[:-5], png[:40] + bytes([png[40] ^ 1]) + png[41:], b"x" + png[1:]):
        with pytest.raises(media.BadImage):
            media.png_decode(bad)


def test_cosine_hash_is_close_for_close_images():
    rng = np.random.default_rng(2)
    x = rng.integers(32, 122, (40, 64), dtype=np.uint8)
    y = x.copy()
    y[3, 5] ^= 7
    far = lambda a, b: bin(int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).count("1")
    assert far(media.cosine_hash(x), media.cosine_hash(y)) <= 4 < far(media.cosine_hash(x), media.cosine_hash(rng.integers(32, 122, (40, 64), dtype=np.uint8)))


def test_media(spark, odd_docs, no_docs):
    rows = media.features(media.to_media(odd_docs)).collect()
    want = sorted((str(d.doc_id), len(t), hashlib.sha256(media.payload(t)).hexdigest()) for d in odd_docs.collect() for t in [(d.text or "").encode()])
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256) for r in rows) == want
    assert len({(r.payload_sha256, r.n_bytes, r.feature, r.media_sha256) for r in rows}) == len({(d.text or "") for d in odd_docs.collect()})
    assert media.features(media.to_media(no_docs)).count() == 0


@pytest.fixture
def pages(spark):
    html = "<p>é</p>\r\n\r\nWARC/1.0\r\n"
    rows = [(1, "http://a/", html), (2, "http://b/", html), (3, None, None), (4, "http://c/\r\nX: 1", ""), (5, "http://d/", "other"), (None, "http://e/", html), (None, "http://f/", "alone"), (5, "http://d/", "other"), (7, "http://g/", "x" * 100_000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc(spark, pages, tmp_path, compression):
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark, pages, path, compression=compression)
    rows = warc.read_warc(spark, path).collect()
    assert len(rows) == 9
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    html = pages.first().html
    kinds = {(r.record_id, r.record_type, r.refers_to, r.payload_digest, r.http_length) for r in rows}
    n = len(html.encode())
    assert ("<urn:page:2>", "response", None, f"sha1:{digest(html)}", n) in kinds
    assert ("<urn:page:1>", "revisit", "<urn:page:2>", f"sha1:{digest(html)}", n) in kinds
    assert ("<urn:page:none>", "revisit", "<urn:page:2>", f"sha1:{digest(html)}", n) in kinds
    assert ("<urn:page:3>", "revisit", "<urn:page:4>", f"sha1:{digest('')}", 0) in kinds
    assert sum(k == ("<urn:page:5>", "response", None, f"sha1:{digest('other')}", 5) for k in map(tuple, (r[:2] + (r.refers_to, r.payload_digest, r.http_length) for r in rows))) == 2
    assert all(r.payload == b"" for r in rows if r.record_type == "revisit")
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {html, "", "other", "alone", "x" * 100_000}
    few = warc.read_warc(spark, path, payload=False).where("record_type = 'response' AND target_uri IN ('http://b/', 'http://d/')")
    assert sorted(r.record_id for r in few.collect()) == ["<urn:page:2>", "<urn:page:5>", "<urn:page:5>"]
    assert few.first().payload is None


@pytest.mark.parametrize("fill", [4096 - 71, 5000, 20_000])
def test_long_http_headers_without_payload(spark, tmp_path, fill):
    body = b"x" * 7
    heads = [b"HTTP/1.1 200 OK\r\nSet-Cookie: " + b"c" * (fill + k) + b"\r\nContent-Length: 7\r\n\r\n" for k in range(8)]
    blocks = [*(head + body for head in heads), b"no HTTP " * 3000]
    with open(f"{tmp_path}/other.warc", "wb") as f:
        for k, block in enumerate(blocks):
            f.write(b"WARC/1.0\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(block)) + block + b"\r\n\r\n")
    want = [(f"<{k}>", None if k == 8 else 7, len(block)) for k, block in enumerate(blocks)]
    for payload in (True, False):
        rows = warc.read_warc(spark, f"file://{tmp_path}", payload=payload).collect()
        assert sorted((r.record_id, r.http_length, r.block_length) for r in rows) == want


def test_least_bytes(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark, pages, path, least_bytes=1000)
    assert {r.record_type for r in warc.read_warc(spark, path).collect()} == {"response"}


def test_no_pages(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark, pages.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_pushed_headers():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = warc.WarcReader({"path": "file:///x"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("a", "b")), GreaterThan(("block_length",), 3)]))
    assert left == [GreaterThan(("block_length",), 3)]
    assert reader.wanted == {"warc-type": {"response"}, "warc-target-uri": {"a", "b"}}
