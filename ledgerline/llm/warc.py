"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame per record."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import new_path, write_down

# Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

DATE = "2024-01-01T00:00:00Z"
LEAST_REVISIT = 1000        # bytes of a payload that may be written as a revisit
ARCHIVE_BYTES = 32 << 20    # an archive is closed beyond this size
SAMPLE_BYTES = 1 << 20      # of the first records, for an archive's dictionary
DICTIONARY_BYTES = 1 << 14
READ_BYTES = 1 << 20


def place(path: str):
    """The file system that a path or URI names, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_sha1(digest: str) -> str:
    """A labelled digest in base 32 as bare hexadecimal."""
    return base64.b32decode(digest.partition(":")[2]).hex()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record; line ends cannot occur in a header's value."""
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return VERSION + b"\r\n" + b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None) -> bytes:
    """The response of a page, or, with ``response_id``, its revisit, which has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if response_id is not None else http + payload
    headers = [("WARC-Type", "response" if response_id is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"),
               ("WARC-Date", DATE), ("WARC-Target-URI", url or "urn:none"), ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Block-Digest", base32_sha1(block)), ("WARC-Payload-Digest", digest)]
    if response_id is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{response_id}>")]
    return record(headers, block)


class ArchiveWriter:
    """Archives of bounded size in a folder; names are new for each attempt of a task."""

    def __init__(self, folder: str):
        self.folder, self.waiting, self.size, self.stream, self.written = folder, [], 0, None, []

    def add(self, data: bytes) -> None:
        self.waiting.append(data)
        self.size += len(data)
        if self.stream is None and self.size >= SAMPLE_BYTES:
            self._begin()
        elif self.stream is not None:
            self._flush()
            if self.stream.tell() >= ARCHIVE_BYTES:
                self.close()

    def _begin(self) -> None:
        import zstandard

        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, [w[:1 << 16] for w in self.waiting]).as_bytes()
        except zstandard.ZstdError:  # too few records to learn from
            trained = b"".join(w[:512] for w in self.waiting)[:DICTIONARY_BYTES]
        fs, folder = place(self.folder)
        fs.create_dir(folder, recursive=True)
        name = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
        self.stream = fs.open_output_stream(name, compression=None)
        self.written.append([name, 0])
        packed = zstandard.ZstdCompressor(level=19).compress(trained)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        kind = zstandard.DICT_TYPE_AUTO if trained[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        self.compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained, dict_type=kind), write_checksum=True)
        self._flush()

    def _flush(self) -> None:
        for data in self.waiting:
            self.stream.write(self.compressor.compress(data))
            self.written[-1][1] += 1
        self.waiting = []

    def close(self) -> None:
        if self.stream is None and self.waiting:
            self._begin()
        if self.stream is not None:
            self.stream.close()
        self.stream, self.size = None, 0


def frames(stream: io.RawIOBase) -> Iterator[bytes]:
    """The content of each frame after the dictionary's; a file may be longer than memory, a record not."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("an archive without its leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("the leading frame is not a dictionary's")
    packed = stream.read(size)
    if len(packed) != size:
        raise ValueError("the dictionary is cut off")
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(packed) if packed[:4] == struct.pack("<I", FRAME) else packed
    kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind) if raw else None)
    left = b""
    while True:
        left = left or stream.read(READ_BYTES)
        if not left:
            return
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            if not left:
                left = stream.read(READ_BYTES)
                if not left:
                    raise ValueError("a record's frame is cut off")
            parts.append(one.decompress(left))
            left = one.unused_data
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, validated: version, needed headers, length, end and block digest."""
    head, end, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION or not end:
        raise ValueError("not a WARC record")
    pairs = [line.decode().partition(":") for line in lines]
    headers = {k: v.strip() for k, _, v in pairs}
    lacking = [k for k in NEEDED if k not in headers]
    if lacking or len(headers) != len(pairs):
        raise ValueError(f"headers missing or given twice: {lacking}")
    length = int(headers["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length is not its Content-Length")
    block = rest[:length]
    if "WARC-Block-Digest" in headers and base32_sha1(block) != headers["WARC-Block-Digest"]:
        raise ValueError("a block differs from its digest")
    return headers, block


def _page_of(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", record_id or "")
    return int(found[1]) if found else None


def read_page(data: bytes) -> dict:
    headers, block = parse_record(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?m)^Content-Length: ([0-9]+)\r?$", http)[1])
    if headers["WARC-Type"] == "response" and (len(payload) != length or base32_sha1(payload) != headers["WARC-Payload-Digest"]):
        raise ValueError("a payload differs from its length or digest")
    return {"page_id": _page_of(headers["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": hex_sha1(headers["WARC-Payload-Digest"]),
            "record_type": headers["WARC-Type"], "refers_to": _page_of(headers.get("WARC-Refers-To")), "url": headers["WARC-Target-URI"],
            "payload": payload}


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per page to archives in ``folder`` and returns ``path, records`` of those that count.

    Of pages with equal payloads (html in UTF-8, null is empty) of at least ``LEAST_REVISIT`` bytes, the
    one of greatest ``page_id`` is written as response and all others as revisits of it; equal rows with
    that id are responses both. Each task writes files of new names, and the manifest that Spark commits
    names one attempt's, so lost executors and repeated tasks leave no record twice. Files are closed
    beyond ``ARCHIVE_BYTES``; a payload is shuffled once, and those of a large group of copies are split.
    """
    hashed = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("html"))
    hashed = hashed.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html"))
    repeated = hashed.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest", "bytes") \
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    placed = hashed.join(repeated, ["digest", "bytes"], "left").select(
        "page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("last")), None).otherwise(F.col("last")).alias("response_id"))

    def write(batches):
        import pyarrow as pa

        writer = ArchiveWriter(folder)
        for batch in batches:
            for page_id, url, html, response_id in zip(*[batch.column(c) for c in ("page_id", "url", "html", "response_id")], strict=True):
                payload = html.as_py()
                writer.add(page_record(page_id.as_py(), url.as_py(), payload, base32_sha1(payload), response_id.as_py()))
        writer.close()
        yield pa.RecordBatch.from_pydict({"path": [w[0] for w in writer.written], "records": [w[1] for w in writer.written]},
                                         schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return write_down(placed.mapInArrow(write, "path string, records long"))


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the manifest's archives, validated: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to, url`` and, unless left out, ``payload`` (empty for revisits). A damaged
    record, or a number of records unlike the manifest's, fails the read."""
    fields = [("page_id", "long"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"),
              ("refers_to", "long"), ("url", "string"), *[("payload", "binary")] * payloads]
    files = manifest.count()
    spread = manifest.repartition(max(1, files), "path") if files else manifest

    def read(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(k, kinds[t]) for k, t in fields])
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                fs, _ = place(folder)
                rows, n, held = [], 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        rows.append({k: v for k, v in read_page(data).items() if payloads or k != "payload"})
                        n, held = n + 1, held + (len(data) if payloads else 200)
                        if held > READ_BYTES * 8:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if n != records:
                    raise ValueError(f"{path} holds {n} records, not {records}")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spread.mapInArrow(read, ", ".join(f"{k} {t}" for k, t in fields))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads the records back, without payloads.

    Null and empty html have an empty payload, a null url is ``urn:none``, rows with null ids are
    responses unless another copy has an id, repeated rows are records each; empty tables give an
    empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = new_path(spark)
    return read_archives(spark, write_archives(pages, folder), folder, payloads=False)


#: The records' fields by plain SQL, for DuckDB.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS bytes FROM pages),
last AS (SELECT html, max(page_id) AS last FROM p WHERE bytes >= 1000 GROUP BY html)
SELECT page_id, bytes AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN last ON p.html = last.html
"""
