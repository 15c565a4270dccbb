"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page_id. Each range is written by one task to files of its own, and a new file begins where
the compressed size passes a limit. Every record is a gzip member; headers, ids and digests come from the row alone, so
a task that runs again writes the same bytes. Files are written under temporary names and renamed; a range's manifest is
written last and names its files with sizes and digests. So a range without a manifest was not completed, whatever
files it left.

Of equal payloads of at least `least` bytes the one with the smallest page_id is a response and the others
revisit it. The digests of all pages are summed up first; which page revisits which then travels as a row of its own that
sorts just before the page, so payloads are exchanged once and no digest's pages meet in one task.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import put, scratch, store, written

#: Compressed bytes after which a new file begins.
ROLL = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, file string, records long, bytes long, sha256 string"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page: int | None, copy: int) -> str:
    h = hashlib.sha256(f"{page}/{copy}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-4{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def target(url: str) -> str:
    """A URL fit for a header: control and white space characters as percent escapes."""
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page: int | None, copy: int, url: str | None, payload: bytes, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, copy)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target(url)}"] if url else []), *([f"X-Page-ID: {page}"] if page is not None else []),
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers, 0)}", f"X-Refers-To-Page-ID: {refers}"] if refers is not None else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """page_id and refers_to of the pages whose payload a page with a smaller id has too."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    keys = written(keys.filter((F.col("size") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest"), "digests")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("digest", "refers_to")
    return keys.join(first, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to")


def write(pages: DataFrame, folder: str | None = None, least: int = 100, roll: int = ROLL) -> DataFrame:
    """Writes a record per row and returns the manifest: shard, file, records, bytes, sha256.

    pages: page_id (integer), url and html; other columns are ignored. Null html is an empty payload, a null url gives no
    target. A row with a null page_id is a response, and none revisits it. Rows that share a page_id are records of their
    own; with the same payload too they are all responses, or all revisit the same page. An empty table gives no files.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    marks = revisits(pages, least).distinct().select("page_id", F.lit(0).alias("kind"), F.col("digest").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to")
    rows = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to")).unionByName(marks)
    placed = rows.repartitionByRange("page_id").sortWithinPartitions("page_id", "kind", "url", "html")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        files: list[tuple] = []

        def records() -> Iterator[bytes]:
            page, copy, marked = object(), 0, {}
            for batch in batches:
                for key, kind, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    if page != key:
                        page, copy, marked = key, 0, {}
                    if kind == 0:
                        marked[url] = refers
                        continue
                    payload = (html or "").encode()
                    to = marked.get(hashlib.sha256(payload).hexdigest()) if marked else None
                    yield member(record(key, copy, url, payload, to))
                    copy += 1

        source = records()
        pending = next(source, None)
        while pending is not None:
            name, digest, held = f"part-{shard:06d}-{len(files):05d}.warc.gz", hashlib.sha256(), [0, 0]

            def fill() -> Iterator[bytes]:
                nonlocal pending
                while pending is not None and held[1] < roll:
                    data, pending = pending, next(source, None)
                    digest.update(data)
                    held[0], held[1] = held[0] + 1, held[1] + len(data)
                    yield data

            put(f"{folder}/{name}", fill())
            files.append((shard, f"{folder}/{name}", held[0], held[1], digest.hexdigest()))
        if files:
            names = [f.split()[0] for f in MANIFEST.split(", ")]
            put(f"{folder}/part-{shard:06d}.manifest.json", [json.dumps([dict(zip(names, f)) for f in files]).encode()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files), [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()])], names)

    return written(placed.mapInArrow(task, MANIFEST), "warc-manifest")


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file of gzip members."""
    data, unpack = bytearray(), zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            data += unpack.decompress(chunk)
            chunk = unpack.unused_data
            if not unpack.eof:
                break
            unpack = zlib.decompressobj(31)
            head, _, rest = bytes(data).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
            n = int(headers["content-length"])
            if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
                raise ValueError("not a whole WARC record")
            yield headers, rest[:n]
            data = bytearray()
    if data:
        raise ValueError("the archive ends within a record")


def read(manifest: DataFrame) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type and refers_to. Digests of blocks and payloads and each
    file's digest and number of records are checked; a mismatch is an error."""

    def pages(path: str, records: int, sha256: str) -> Iterator[tuple]:
        files, at = store(path)
        digest, n = hashlib.sha256(), 0

        def chunks() -> Iterator[bytes]:
            with files.open_input_stream(at, compression=None) as f:
                while data := f.read(1 << 20):
                    digest.update(data)
                    yield data

        for headers, block in parse(chunks()):
            n += 1
            http, _, payload = block.partition(b"\r\n\r\n")
            said = headers["warc-payload-digest"].removeprefix("sha256:")
            kind, refers = headers["warc-type"], headers.get("x-refers-to-page-id")
            size = int(http.decode().rpartition("Content-Length: ")[2])
            wrong = kind == "response" and (hashlib.sha256(payload).hexdigest() != said or len(payload) != size)
            if wrong or "sha256:" + hashlib.sha256(block).hexdigest() != headers["warc-block-digest"]:
                raise ValueError(f"a digest differs in {path}")
            page = headers.get("x-page-id")
            yield page and int(page), size, said, kind, refers and int(refers)
        if n != records or digest.hexdigest() != sha256:
            raise ValueError(f"{path} is not the file that its manifest names")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PAGE.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for file in zip(*(batch.column(c).to_pylist() for c in ("file", "records", "sha256"))):
                rows: list[tuple] = []
                for row in pages(*file):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    n = max(1, manifest.count())
    return manifest.repartition(n, "file").mapInArrow(task, PAGE)


SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first < page_id THEN first END AS refers_to FROM f
"""
