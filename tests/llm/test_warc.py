import hashlib
import base64
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from tracewarden.llm import warc

PAGES = [(1, "http://a/", "same é"), (2, "http://b/", "same é"), (3, None, None), (4, "http://c/\r\nx", ""), (5, "u", "other"), (5, "u", "other"), (None, "n", "same é"), (7, "long", "<p>" + "x" * 200_000)]
SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(pages, min_bytes=0):
    out = []
    for i, _, html in pages:
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        top = max(same, default=None)
        revisit = top is not None and (i is None or i < top) and len((html or "").encode()) >= min_bytes
        out.append((i, len((html or "").encode()), digest(html), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_round_trip(spark, tmp_path, min_bytes):
    pages = PAGES + [(100 + k, f"http://h/{k}", f"<html><body>page {k} " + "common words of pages " * 20 + "</body></html>") for k in range(60)]
    df = spark.createDataFrame(pages, SCHEMA).withColumn("digest", F.lit("clash")).withColumn("keeper", F.lit(1)).repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, min_bytes=min_bytes)
    rows = warc.read_archives(spark, path, with_payload=True).collect()
    assert all(r.valid for r in rows)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == brute(pages, min_bytes)
    texts = {(i, h or "") for i, _, h in pages}
    assert all((r.page_id, r.payload.decode()) in texts for r in rows if r.record_type == "response")
    data = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part") and p.stat().st_size).read_bytes()
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).count() == 0


def test_frames_with_and_without_dictionary():
    samples = [b"payload number %d with words in common" % k * 3 for k in range(200)]
    raw = zstandard.train_dictionary(2048, samples)
    for pack in (lambda d: d, lambda d: zstandard.ZstdCompressor().compress(d)):
        d = pack(raw.as_bytes())
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw.as_bytes()))
        data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(d)) + d + b"".join(c.compress(s) + warc.EMPTY_FRAME for s in samples)
        assert list(warc.frames(data)) == samples
    plain = zstandard.ZstdCompressor().compress(b"x" * 300_000)
    assert list(warc.frames(plain + warc.EMPTY_FRAME + plain)) == [b"x" * 300_000] * 2
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames(plain[:-5]))


def test_broken_records_are_reported(spark, tmp_path):
    good = warc.record(3, "http://a/", b"body", None, False, "2024-01-01T00:00:00Z")
    broken = [good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Content-Length: 4", b"Content-Length: 5"), good[:-1], good.replace(b"body", b"bodY"), good.replace(b"WARC-Type: response\r\n", b""), good.replace(b"sha1:", b"md5:")]
    assert warc.parse(good)[:4] == (3, 4, digest("body"), "response")
    for b in broken:
        with pytest.raises((ValueError, KeyError)):
            warc.parse(b)
    c = zstandard.ZstdCompressor()
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "part-0").write_bytes(c.compress(good) + c.compress(broken[0]) + c.compress(good)[:-3])
    rows = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert [r.valid for r in rows] == [True, False, False] and rows[1].error == "version line"


def test_an_archive_cut_at_any_byte_and_numbers_beyond_64_bits(spark, tmp_path):
    c = zstandard.ZstdCompressor()
    good = warc.record(3, "http://a/", b"body", None, False, "2024-01-01T00:00:00Z")
    data = struct.pack("<II", warc.DICTIONARY_MAGIC + 1, 3) + b"abc" + c.compress(good) + warc.EMPTY_FRAME
    for n in range(len(data)):
        try:
            assert all(x == good for x in warc.frames(data[:n]))
        except (ValueError, zstandard.ZstdError):
            pass
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "part-0").write_bytes(c.compress(warc.record(1 << 70, "u", b"body", None, False, "2024-01-01T00:00:00Z")) + c.compress(good))
    (tmp_path / "w" / "part-1").write_bytes(c.compress(good) + data[:6])
    rows = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert sorted((r.page_id or 0, r.valid) for r in rows) == [(0, False), (0, False), (3, True), (3, True)]
