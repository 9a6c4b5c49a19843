"""Dictionary-compressed web archives: written per task, read back per archive.

A Zstandard dictionary is built from a bounded sample of the records (those with the
smallest hashes; `sample_records` is its size). Every archive begins with a skippable
frame (magic 0x184D2A5D) that holds the dictionary, and every record is one frame
compressed with it, so a record can be read alone. Too few or too small records for a
trained dictionary give a raw one, and no records at all give none.

Equal payloads are found by their digests, merged before the shuffle: the record with
the smallest page id is the response, the others are revisits that refer to it, without
the body but with its HTTP headers. A digest that many pages share is split over tasks.

Each task writes archives of at most `archive_bytes` of payload under names of its own
attempt; the written manifest lists those of the attempts that succeeded, and only those
are read. Folder and manifest lie in the shared folder. Archives are read as streams.

Defined results: a NULL html is an empty payload; a NULL or unprintable url is left out
or percent-encoded in the header; NULL page ids are never responses for others unless
all of a payload are NULL; repeated rows with the smallest id are all responses; payloads
below `min_payload` bytes are responses; an empty table gives no archives and no rows.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import ship_by_value
from tallymark.llm.common import written
from tallymark.operators.skew import hot_from_counts, lookup_join
from tallymark.session import new_shared_path

ship_by_value(__name__)

#: Fixed values of the formats.
MAGIC = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
SAMPLE_RECORDS = 2048
SAMPLE_BYTES = 4 << 20
ARCHIVE_BYTES = 64 << 20


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode("ascii")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers, with the full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    body = http.encode("ascii") + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if url:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if kind == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8") + body + b"\r\n\r\n"


def read_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Headers and block of every record of an archive, as a stream."""
    import zstandard

    head = stream.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == MAGIC:
        dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]))
        head = b""
    source = _After(head, stream)
    plain = io.BufferedReader(
        zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True), 1 << 16
    )
    while line := plain.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := plain.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            headers[name] = value
        size = int(headers["Content-Length"])
        block = plain.read(size)
        if len(block) != size or plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends early")
        yield {"headers": headers, "block": block}


class _After:
    """Bytes already read, then the rest of the stream."""

    def __init__(self, head: bytes, stream) -> None:
        self.head, self.stream = head, stream

    def read(self, size: int = -1) -> bytes:
        if self.head:
            out, self.head = self.head, b""
            return out
        return self.stream.read(size)


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; a raw one of the samples' ends if they do not suffice."""
    import zstandard

    size = min(size, sum(map(len, samples)) // 8)
    if size >= 1024 and len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


def _sampled_dictionary(pages: DataFrame, records: int, most_bytes: int) -> bytes:
    """One task sees at most `records` rows of at most `most_bytes` / 16 each. Tasks pass
    on only the share of their rows, by hash, that makes up about twice as many."""
    unit = 1 << 40
    share = int(unit * min(1.0, 2 * records / max(pages.count(), 1)))
    rank = F.pmod(F.xxhash64("page_id", "payload"), F.lit(unit))
    sample = (
        pages.withColumn("rank", rank)
        .filter(F.col("rank") <= share)
        .select("rank", F.substring("payload", 1, most_bytes // 16).alias("payload"))
        .orderBy("rank", "payload")
        .limit(records)
    )

    def train(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, held = [], 0
        for frame in frames:
            for payload in frame.column(1).to_pylist():
                if payload and held < most_bytes:
                    samples.append(record(None, None, payload, "", "response", None))
                    held += len(payload)
        yield pa.RecordBatch.from_arrays([pa.array([build_dictionary(samples)], pa.binary())], ["dictionary"])

    rows = sample.coalesce(1).mapInArrow(train, "dictionary binary").collect()
    return max((row["dictionary"] for row in rows), key=len, default=b"")


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_payload: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    sample_records: int = SAMPLE_RECORDS,
    level: int = LEVEL,
) -> DataFrame:
    """Writes archives below `folder` (default: the shared folder); returns the written
    manifest: path, records."""
    spark = pages.sparkSession
    folder = folder or new_shared_path(spark, "warc")
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    dictionary = spark.sparkContext.broadcast(_sampled_dictionary(source, sample_records, SAMPLE_BYTES))
    hashed = source.withColumn("sha1", F.sha1("payload"))
    counts = written(
        hashed.filter(F.length("payload") >= min_payload)
        .groupBy("sha1")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("page_id").alias("first"))
        .filter("_rows > 1"),
        "payloads",
    )
    known = lookup_join(
        hashed, counts.select("sha1", "first"), ["sha1"], ["page_id", "url"], hot=hot_from_counts(counts, ["sha1"])
    )

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        content = dictionary.value
        shared = zstandard.ZstdCompressionDict(content) if content else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared)
        out, name, records, size, done = None, "", 0, 0, []
        for frame in frames:
            for page, address, body, sha1, first in zip(*[c.to_pylist() for c in frame.columns], strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{root}/{name}")
                    if content:
                        out.write(struct.pack("<II", MAGIC, len(content)) + content)
                kind = "response" if first is None or page == first else "revisit"
                digest = digest_text(bytes.fromhex(sha1))
                out.write(packer.compress(record(page, address, body, digest, kind, first)))
                records, size = records + 1, size + len(body)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", records))
                    out, records, size = None, 0, 0
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
            ["path", "records"],
        )

    rows = known.select("page_id", "url", "payload", "sha1", "first")
    return written(rows.mapInArrow(write, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives listed, one archive per task and more."""
    tasks = max(1, manifest.count())

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "http_length", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for frame in frames:
            for path in frame.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(place) as stream:
                    for one in read_records(stream):
                        headers = one["headers"]
                        http, _, body = one["block"].partition(b"\r\n\r\n")
                        length = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
                        page, refers = headers.get("Page-Id"), headers.get("Refers-To-Page")
                        kind = headers["WARC-Type"]
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (
                            len(body) != length or digest_text(hashlib.sha1(body).digest()) != digest
                        ):
                            raise ValueError(f"{path}: the payload of page {page} is damaged")
                        rows.append(
                            (
                                None if page is None else int(page),
                                headers.get("WARC-Target-URI"),
                                kind,
                                None if refers is None else int(refers),
                                digest,
                                length,
                                body if kind == "response" else None,
                            )
                        )
                        held += len(body)
                        if held > 1 << 23 or len(rows) >= 4096:
                            yield _rows(rows, names, types)
                            rows, held = [], 0
                yield _rows(rows, names, types)

    schema = (
        "page_id long, url string, record_type string, refers_to long, payload_digest string, "
        "http_length long, payload binary"
    )
    return manifest.select("path").repartition(min(tasks, 10_000), "path").mapInArrow(read, schema)


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Query: write all pages, read the archives back."""
    return read_archives(write_archives(pages)).select(
        "page_id", F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


SQL = """
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggr(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(sha1(html), (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY html) AS first
      FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))
"""
