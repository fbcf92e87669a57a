"""WARC archives compressed with Zstandard: one frame per record, the dictionary in front.

An archive starts with a skippable frame that holds the dictionary (itself a Zstandard frame); every
record follows as a frame of its own, so that a reader can start at any of them. Tasks write whole
archives, named by attempt, and only archives of tasks that succeeded are listed in the manifest that
the reader follows: a lost executor leaves at most an archive that nobody reads. Writer and reader
stream record by record; memory is bounded by one record.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import durable, shared_dir, table

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: The dictionary is fitted on the payloads of at most this many pages, of at most this many bytes each.
DICTIONARY_PAGES, DICTIONARY_PAGE_BYTES, DICTIONARY_BYTES = 256, 16_384, 32_768
MIN_REVISIT_BYTES = 100
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def fit_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample payloads; empty where there is too little to fit one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def _line(value: str) -> str:
    """A header value: control characters and spaces at its ends would break the line, so they are escaped."""
    return "".join(f"%{b:02X}" if b < 33 or b == 127 else chr(b) for b in value.encode("utf-8", "replace") if b < 128) if value.isascii() else "".join(
        c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value
    )


def response_name(page_id: int | None, digest: str) -> uuid.UUID:
    """The record id of a page's response, which its revisits can name without having seen it."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, name: uuid.UUID | None = None) -> bytes:
    """``name`` is the record id, by default that of the page's response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    name = name or response_name(page_id, digest)
    head = [
        "WARC/1.1", f"WARC-Type: {REVISIT if is_revisit else RESPONSE}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{response_name(refers_to, digest)}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and block of one record; refuses bad versions, headers and lengths."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no WARC version line: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"missing header {name}")
    if not headers["content-length"].isdigit() or len(rest) != (n := int(headers["content-length"])) + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {headers['content-length']} does not fit {len(rest)} bytes")
    return headers, rest[:n]


def _http(block: bytes) -> tuple[int, bytes]:
    """The declared length of an HTTP response and the body that is there."""
    head, found, body = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"HTTP/"):
        raise WarcError("the block is no HTTP response")
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length":
            return int(value), body
    raise WarcError("the HTTP response has no Content-Length")


def decode_record(raw: bytes) -> tuple:
    """A RECORD row; the payload of a response is checked against its length and digest."""
    h, block = parse_record(raw)
    declared, body = _http(block)
    kind, digest = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == RESPONSE:
        if len(body) != declared or hashlib.sha256(body).hexdigest() != digest:
            raise WarcError(f"payload of {h['warc-record-id']} does not fit its length and digest")
    elif kind != REVISIT or body:
        raise WarcError(f"unexpected record type {kind}, or a revisit with a payload")
    page = h.get("warc-page-id")
    to = h["warc-refers-to-page-id"] if kind == REVISIT else None
    if to is not None and h.get("warc-refers-to") != f"<urn:uuid:{response_name(int(to), digest)}>":
        raise WarcError(f"{h['warc-record-id']} refers to a record that is not the response of page {to}")
    return int(page) if page is not None else None, declared, digest, kind, int(to) if to is not None else None, h.get("warc-target-uri"), body if kind == RESPONSE else None


def read_frames(source) -> Iterator[bytes]:
    """The records of an archive, from a binary stream: dictionary first, then a frame each."""
    head = source.read(8)
    if len(head) < 8:
        raise WarcError("the archive is shorter than its dictionary frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise WarcError(f"no dictionary frame in front: {magic:#x}")
    body = source.read(size)
    if len(body) != size:
        raise WarcError("the dictionary frame is cut short")
    dictionary = zstandard.ZstdDecompressor().decompress(body) if body[:4] == struct.pack("<I", FRAME_MAGIC) else bytes(body)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    buffer = b""
    while buffer or (buffer := source.read(1 << 18)):
        one, out = decoder.decompressobj(), io.BytesIO()
        while True:
            out.write(one.decompress(buffer))
            if one.eof:
                buffer = one.unused_data
                break
            if not (buffer := source.read(1 << 18)):
                raise WarcError("the last frame is cut short")
        yield out.getvalue()


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _uri(folder: str) -> str:
    return folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder


def write_archives(pages: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Manifest of the archives written: ``pages`` has page_id, url, payload, digest, refers_to, is_revisit."""
    folder = _uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        path, n, out, told = f"{base}/part-{uuid.uuid4().hex}.warc.zst", 0, None, set()
        kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        coder = zstandard.ZstdCompressor(level=3, dict_data=kept, write_checksum=True, write_content_size=True)
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(path, compression=None)
                out.write(dictionary_frame(dictionary))
            columns = [batch.column(i) for i in range(6)]
            for i in range(len(batch)):
                page_id, url, payload, digest, refers, again = (c[i].as_py() for c in columns)
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{path}:{n}") if again or page_id is None or (page_id, digest) in told else None
                told = told | {(page_id, digest)} if len(told) < 16 else {(page_id, digest)}
                out.write(coder.compress(record_bytes(page_id, url, payload, digest, refers, again, name)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return pages.select("page_id", "url", "payload", "digest", "refers_to", "is_revisit").mapInArrow(write, MANIFEST)


def read_archives(manifest: DataFrame, folder: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The records of the manifest's archives, validated; ``columns`` limits what is kept of RECORD."""
    folder = _uri(folder)
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = dict(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True))
    keep = list(columns) or names
    schema = ", ".join(c for c in RECORD.split(", ") if c.split()[0] in keep)
    keep = [c.split()[0] for c in schema.split(", ")]
    at = [names.index(c) for c in keep]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[c]) for i, c in zip(at, keep, strict=True)], keep)

        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, n, size = [], 0, 0
                with fs.open_input_stream(path, compression=None) as source:
                    for raw in read_frames(source):
                        rows.append(decode_record(raw))
                        n += 1
                        size += len(raw) if "payload" in keep else 200
                        if size > 1 << 22:
                            yield told(rows)
                            rows, size = [], 0
                if n != records:
                    raise WarcError(f"{path} has {n} records, the manifest says {records}")
                if rows:
                    yield told(rows)

    return manifest.select("path", "records").mapInArrow(read, schema)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to, is_revisit: of equal payloads the smallest id is the response.

    Ids and digests alone decide; payloads meet the decision by digest, in a join that can be split.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.filter(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    )
    firsts = durable(firsts, "warc-firsts")
    again = F.coalesce(F.col("first") < F.col("page_id"), F.col("first").isNotNull())
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", F.when(again, F.col("first")).alias("refers_to"), again.alias("is_revisit"))


def archive_pages(pages: DataFrame, folder: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """Write one record per page and read the archives back: RECORD rows.

    A null page text is an empty payload; payloads under 100 bytes are always responses. A page
    without an id is a revisit where an equal payload has one. Repeated rows with the smallest id are
    responses each, and those in different archives share their record id, as copies of one record. An empty table writes no archive and gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    sample = pages.select(F.substring(F.coalesce("html", F.lit("")).cast("binary"), 1, DICTIONARY_PAGE_BYTES).alias("s")).limit(DICTIONARY_PAGES)
    dictionary = fit_dictionary([bytes(r["s"]) for r in sample.collect() if r["s"]])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    manifest = durable(write_archives(with_revisits(pages), folder, dictionary), "warc-manifest")
    return read_archives(manifest.repartition(max(1, manifest.count()), "path"), folder, columns)  # about an archive for each task


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"), columns=("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
QUERIES = {"op6_warc": op6_warc}
ORACLE = {"op6_warc": SQL}
