"""Operator 8: WARC archives with revisits resolved.

Headers alone are shuffled by payload digest; the record with the largest id of each digest is the response and the
others become revisits of it. Archives are written with fresh headers, one gzip member a record, and parsed back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

#: Fixed value of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
#: About 100 bytes each.
BROADCAST_ROWS = 250_000


def resolve(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """id, url, body, sha1 and ``original``: the id of the response that a row revisits, and ``revisit``.

    Null bodies are empty; null ids count as smaller than all others. Of repeated rows with the response's id, one is the
    response and the others revisit it. Bodies below ``min_bytes`` are all responses. Only ids and digests meet by digest,
    in a join whose heavy keys Spark can split. The rows found to share a digest are broadcast to the bodies if they are
    at most ``BROADCAST_ROWS``; else bodies are shuffled once, by id and digest.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("sha1", F.sha1("body"))
    headers = rows.where(F.octet_length("body") >= min_bytes).groupBy("id", "sha1").agg(F.count("*").alias("same"))
    originals = headers.groupBy("sha1").agg(F.max("id").alias("original"), F.sum("same").alias("n")).where("n > 1").drop("n")
    found = C.stage_table(headers.join(originals, "sha1").select(F.col("id").alias("id2"), F.col("sha1").alias("sha2"), "original", "same"), "revisits")
    size = found.agg(F.count("*").alias("n"), F.max("same").alias("same")).first()
    both = rows.join(F.broadcast(found) if size["n"] <= BROADCAST_ROWS else found, rows["id"].eqNullSafe(F.col("id2")) & (rows["sha1"] == F.col("sha2")), "left")
    first = F.col("id").eqNullSafe(F.col("original"))
    if (size["same"] or 0) > 1:  # repeated rows have to meet, to tell one of them
        first &= F.row_number().over(Window.partitionBy("id", "sha1").orderBy("url")) == 1
    return both.withColumn("revisit", F.col("sha2").isNotNull() & ~first).select("id", "url", "body", "original", "revisit")


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(i: int | None, url: str | None, body: bytes, original: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header alone."""
    name = lambda x: f"<{URN}{'' if x is None else x}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(i)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append("WARC-Payload-Digest: sha1:" + base32(hashlib.sha1(body).digest()))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(original)}"]
    else:
        block += body
    lines += ["WARC-Block-Digest: sha1:" + base32(hashlib.sha1(block).digest()), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(resolved: DataFrame, out_dir: str, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = 64 << 20) -> DataFrame:
    """Write the records; one row for each archive. A retried task writes the same bytes under the same name."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, n = TaskContext.get().partitionId(), 0, bytearray(), 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, n
            path = f"{out_dir}/pages-{part:06d}-{seq:06d}.warc.gz"
            C.write_file(path, bytes(held))
            out = pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [len(held)]})
            seq, held, n = seq + 1, bytearray(), 0
            return out

        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(5))):
                i, url, body, original, revisit = (x.as_py() for x in row)
                held += gzip.compress(record(i, url, body.encode(), original, revisit, date), 6, mtime=0)
                n += 1
                if len(held) >= archive_bytes:
                    yield flush()
        if n:
            yield flush()

    return C.stage_table(resolved.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def parse(raw: bytes) -> dict:
    """Headers of a record by lower-case name, and its ``block``."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    found = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    return found | {"block": rest[: int(found["content-length"])]}


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; responses' digests are verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(x) if (x := urn.removeprefix(f"<{URN}").removesuffix(">")) else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                fs, local = C.filesystem(path)
                with fs.open_input_stream(local, compression=None) as f:
                    for raw in _stream_members(f):
                        r = parse(raw)
                        http, _, body = r["block"].partition(b"\r\n\r\n")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        digest = r["warc-payload-digest"].removeprefix("sha1:")
                        if r["warc-type"] == "response" and (len(body) != n or base32(hashlib.sha1(body).digest()) != digest):
                            raise ValueError(f"{path}: {r['warc-record-id']} is damaged")
                        rows.append((number(r["warc-record-id"]), n, digest, r["warc-type"], number(r["warc-refers-to"]) if "warc-refers-to" in r else None))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    return manifest.select("path").repartition(C.partitions(spark)).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 5, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _stream_members(f, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Gzip members of a stream, one in memory at a time."""
    data, d, out = b"", zlib.decompressobj(31), bytearray()
    while True:
        data = data or f.read(chunk)
        if not data:
            return
        out += d.decompress(data)
        data = b""
        if d.eof:
            yield bytes(out)
            data, d, out = d.unused_data, zlib.decompressobj(31), bytearray()


def deduplicate(pages: DataFrame, out_dir: str, min_bytes: int = 0) -> DataFrame:
    """Resolve, write and read back; an empty table writes no archive and gives no rows."""
    return read_archives(pages.sparkSession, write_archives(resolve(pages, min_bytes), out_dir))
