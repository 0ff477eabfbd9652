"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: each task writes one archive through Spark's own writer, so any store that Spark writes to will do. Every frame is followed by an
empty skippable frame, which readers pass over; Spark's text writer puts it as its line separator. Equal payloads are stored once:
the record with the largest id is the response, the others revisit it.
Reading: archives are read as whole binary files, so an archive should stay below about a hundred MB (a task's share of the input); the reader loads
the dictionary, decodes one frame per record and validates version, headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, narrow, schema, write_shared

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: The dictionary is trained on at most so many payloads, of each at most so many code points; it changes sizes, never contents.
SAMPLE_PAYLOADS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 16_384, 32_768


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> bytes:
    return b"<urn:x-page:%s>" % (b"null" if page_id is None else b"%d" % page_id)


def _page_id(urn: str) -> int | None:
    if not (urn.startswith("<urn:x-page:") and urn.endswith(">")):
        raise ValueError("record id")
    return None if urn[12:-1] == "null" else int(urn[12:-1])


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has the headers of the answer but no payload."""
    digest = base32_sha1(payload).encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _urn(page_id), b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + "".join(url.split("\r")).replace("\n", "").encode("utf-8", "replace"))
    head.append(b"WARC-Payload-Digest: sha1:" + digest)
    if revisit:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + _urn(refers_to)]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line")
        out[name.decode("ascii").strip().lower()] = value.decode("utf-8").strip()
    return out


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, str | None, bytes]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of a record; ValueError where it breaks the format."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError("version line")
    h = _headers(lines[1:])
    if any(x not in h for x in REQUIRED):
        raise ValueError("missing header")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("content length")
    answer, gap, payload = rest[:n].partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("block")
    size = int(_headers(answer.split(b"\r\n")[1:])["content-length"])
    algorithm, _, digest = h["warc-payload-digest"].partition(":")
    if algorithm != "sha1":
        raise ValueError("digest algorithm")
    kind, refers = h["warc-type"], None
    if kind == "response":
        if len(payload) != size or base32_sha1(payload) != digest:
            raise ValueError("payload")
    elif kind == "revisit":
        if payload:
            raise ValueError("payload of a revisit")
        refers = _page_id(h["warc-refers-to"])
    else:
        raise ValueError("record type")
    return _page_id(h["warc-record-id"]), size, digest, kind, refers, h.get("warc-target-uri"), payload


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time; the dictionary comes from the leading skippable frame, if there is one."""
    import zstandard

    view, at, dictionary = memoryview(content), 0, None
    while at < len(view):
        if len(view) - at < 4:
            raise ValueError("magic number")
        magic = struct.unpack_from("<I", view, at)[0]
        if magic in SKIPPABLE:
            if len(view) - at < 8:
                raise ValueError("skippable frame")
            size = struct.unpack_from("<I", view, at + 4)[0]
            if at + 8 + size > len(view):
                raise ValueError("skippable frame")
            if at == 0 and magic == DICTIONARY_MAGIC:
                raw = bytes(view[8 : 8 + size])
                if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                dictionary = zstandard.ZstdCompressionDict(raw)
            at += 8 + size
            continue
        out, one = [], zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        while not one.eof:
            part = view[at : at + 65536]
            if not part:
                raise ValueError("frame cut short")
            out.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
        yield b"".join(out)


def train_dictionary(df: DataFrame, payload_col: str) -> bytes:
    """A dictionary from a bounded sample of payloads; b"" where they are too few to train on."""
    import zstandard

    rows = df.select(F.substring(payload_col, 1, SAMPLE_CHARS)).where(f"length(`{payload_col}`) > 0").limit(SAMPLE_PAYLOADS).collect()
    samples = [r[0].encode() for r in rows]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> None:
    """Writes a record per row below path, an archive per task.

    Of rows with equal payloads of at least min_bytes, those with the largest id are responses, the others revisit it. Equality is that of SHA-1 and length.
    A null payload is empty, a null id is below all others and is written as null. Rows that repeat are written as often as they occur;
    rows that share the largest id are all responses. An empty table gives a folder without archives.
    Payloads are shuffled once, by id and digest, so that no group of copies meets in one task; groups are found on ids and digests alone.
    """
    pages = narrow(df, page_id=id_col, url=url_col, html=payload_col).withColumn("html", F.coalesce("html", F.lit("")))
    pages = pages.withColumn("digest", F.concat_ws(":", F.sha1(F.encode("html", "UTF-8")), F.octet_length("html").cast("string")))
    ids = pages.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    groups = ids.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    revisits = ids.join(groups, "digest").where("page_id is null and keeper is not null or page_id < keeper").groupBy(F.col("page_id").alias("p"), F.col("digest").alias("g")).agg(F.max("keeper").alias("keeper"))
    rows = pages.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("g")), "left").select("page_id", "url", "html", "keeper")
    dictionary = train_dictionary(pages, "html")

    def run(batches):
        import pyarrow as pa
        import zstandard

        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True, write_content_size=True)
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            if first and dictionary:
                packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
                out.append(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
            first = False
            for page_id, url, html, keeper in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3)))):
                out.append(compress.compress(record(page_id, url, html, keeper, keeper is not None, date)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    frames_ = rows.mapInArrow(run, schema(value="binary"))
    frames_.select(F.col("value").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode("ascii")).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, valid, error (and payload).

    A record that breaks the format comes as valid = false with the fault in error; a frame that can't be decoded ends its archive so.
    """
    out = schema(page_id="long", payload_bytes="long", payload_digest="string", record_type="string", refers_to="long", url="string", valid="boolean", error="string", **({"payload": "binary"} if with_payload else {}))

    def records(content: bytes) -> Iterator[tuple]:
        import zstandard

        try:
            for data in frames(content):
                try:
                    *fields, payload = parse(data)
                    if any(isinstance(x, int) and not -(1 << 63) <= x < 1 << 63 for x in fields):
                        raise ValueError("number beyond 64 bits")
                    yield (*fields, True, None, payload)
                except (ValueError, KeyError, UnicodeDecodeError) as e:
                    yield (None, None, None, None, None, None, False, str(e) or "record", None)
        except (ValueError, zstandard.ZstdError) as e:
            yield (None, None, None, None, None, None, False, str(e), None)

    def run(batches):
        import pyarrow as pa

        target = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in out])
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for row in records(content.as_py()):
                    rows.append(row)
                    if len(rows) == 2000:
                        yield _batch(rows, target)
                        rows = []
                if rows:
                    yield _batch(rows, target)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(run, out)


def _batch(rows: list[tuple], target):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target)
