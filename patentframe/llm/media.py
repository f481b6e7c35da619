"""Operator 6: content-addressed media in tar shards.

Payloads are stored as lossless 8-bit grey PNG images, one member for each distinct payload, named by its SHA-256. Rows carry
digest, shard, offset and length; metadata columns come from a range read of the PNG header alone.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

WIDTH = 192
#: Fixed values of the PNG format: signature, and length of the signature with the header chunk.
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33
ENTRIES = "id long, n_bytes long, digest string, path string, offset long, length long"
#: Payloads with copies of which at most so many are broadcast (about 50 bytes each), so that one row of each stores it.
BROADCAST_ROWS = 250_000


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of the image width."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    plain = np.zeros((len(rows), WIDTH + 1), np.uint8)
    plain[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first bytes of an image."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, packed = 8, b""
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if data[at + 4 : at + 8] == b"IDAT":
            packed += data[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean sample and the shares, in 255ths, of 16 ranges of samples."""
    samples = np.frombuffer(payload, np.uint8)
    shares = np.bincount(samples >> 4, minlength=16) * 255 // len(samples)
    return f"{samples.mean():.4f}:" + shares.astype(np.uint8).tobytes().hex()


def store(docs: DataFrame, out_dir: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 64 << 20) -> DataFrame:
    """Write payloads to tar shards; a row for each document with its payload's digest, and with the place if it stored it.

    Null texts are empty (a payload of spaces). Digests are met first: of rows with equal payloads those of the least id store
    theirs and the others have no place (``canonical`` tells it), so a text held by a third of all rows is stored once. If
    over ``BROADCAST_ROWS`` payloads have copies, every row stores its own. Either way a shard has one member a payload.
    Repeated rows and null ids are kept as rows; an empty table writes no shard.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, shard, waiting = TaskContext.get().partitionId(), 0, bytearray(), []
        known: dict[str, tuple[str, int, int]] = {}  # of the shard at hand
        where = lambda: f"{out_dir}/media-{part:06d}-{seq:06d}.tar"

        def close() -> None:
            nonlocal seq, shard
            if shard:
                C.write_file(where(), bytes(shard) + bytes(1024))
                seq, shard = seq + 1, bytearray()
                known.clear()

        def passed_on() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*waiting), kinds)], ["id", "n_bytes", "digest", "path", "offset", "length"])
            waiting.clear()
            return out

        for batch in batches:
            for i, text, digest, own in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(k).to_pylist() for k in (2, 3))):
                raw = text.as_py().encode()
                if own and digest not in known:
                    image = to_png(pad(raw))
                    info = tarfile.TarInfo(digest + ".png")
                    info.size = len(image)
                    shard += info.tobuf(tarfile.USTAR_FORMAT)
                    known[digest] = where(), len(shard), len(image)
                    shard += image + bytes(-len(image) % 512)
                waiting.append((i, len(raw), digest, *(known[digest] if own else (None, None, None))))
                if len(shard) >= shard_bytes:
                    close()
                if len(waiting) >= 10_000:
                    yield passed_on()
        close()
        if waiting:
            yield passed_on()

    size = F.octet_length("text")
    padding = F.greatest(F.ceil(size / WIDTH), F.lit(1)) * WIDTH - size
    rows = C.ids_and_texts(docs, id_col, text_col).select(F.col("id").cast("long"), "text")
    rows = rows.withColumn("digest", F.sha2(F.concat("text", F.repeat(F.lit(" "), padding.cast("int"))), 256))
    shared = rows.groupBy("digest").agg(F.min("id").alias("owner"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("shared"), "owner")
    shared = C.stage_table(shared, "media-shared")
    if shared.count() <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(shared), F.col("digest") == F.col("shared"), "left")
        rows = met.select("id", "text", "digest", (F.col("shared").isNull() | F.col("id").eqNullSafe(F.col("owner"))).alias("own"))
    else:
        rows = rows.withColumn("own", F.lit(True))
    return C.stage_table(rows.mapInArrow(write, ENTRIES), "media-entries")


READ = "digest string, shard string, offset long, length long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, depth int"


def read_media(places: DataFrame, whole: bool = True) -> DataFrame:
    """Range reads of stored members (digest, path, offset, length): the header's columns, and with ``whole`` the payload's."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows = []
            for digest, p, offset, length in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if p != path:
                    fs, local = C.filesystem(p)
                    path, file = p, fs.open_input_file(local)
                head, place = png_header(file.read_at(min(HEADER_BYTES, length), offset)), (digest, p.rpartition("/")[2], offset, length)
                if whole:
                    image = file.read_at(length, offset)
                    payload = from_png(image)
                    rows.append((*place, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload), *head))
                else:
                    rows.append((*place, head[0] * head[1], None, None, length, None, None, *head))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 13, kinds)], [x.split()[0] for x in READ.split(", ")])

    spread = places.select("digest", "path", "offset", "length").repartitionByRange(C.partitions(places.sparkSession), "path", "offset").sortWithinPartitions("path", "offset")
    return spread.mapInArrow(read, READ)


def canonical(entries: DataFrame) -> DataFrame:
    """One stored place for each digest."""
    return entries.where("path is not null").groupBy("digest").agg(F.min(F.struct("path", "offset", "length")).alias("at")).select("digest", "at.*")


def media_columns(docs: DataFrame, out_dir: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store, read back, and give every document its payload's columns, with digest, shard (a file name), offset and length.

    Equal texts get equal values. Width, height and depth are of the header's range read, the others of the payload's. Null
    texts are empty; null ids and repeated rows are rows like any other; an empty table gives none.
    """
    entries = store(docs, out_dir, id_col, text_col)
    found = read_media(canonical(entries))
    return entries.select(F.col("id").alias("doc_id"), "n_bytes", "digest").join(found, "digest")
