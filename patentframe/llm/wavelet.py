"""Operator 1: token ids in wavelet-matrix shards.

A shard is one file: a header, the documents' ids and starts, its tokens by falling frequency, and one zstd-compressed
bit-plane for each bit of a token's place among those. Rank and select over the planes answer access, counting and
occurrence lookup without expanding the shard.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C
from .pretokens import encoder, groups

MAGIC = b"PFWM0001"


class BitPlane:
    """Bits with rank and select: one sampled rank for every ``BLOCK`` words, an eighth of a bit for each bit."""

    BLOCK = 8

    def __init__(self, packed: bytes, n: int):
        words = np.zeros(((n + 63) // 64 // self.BLOCK + 1) * self.BLOCK, np.uint64)
        words.view(np.uint8)[: len(packed)] = np.frombuffer(packed, np.uint8)
        self.words, self.n = words, n
        ones = np.bitwise_count(words).reshape(-1, self.BLOCK).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def rank1(self, at):
        """Ones in [0, at); scalar or array."""
        at = np.asarray(at, np.int64)
        word, block = at >> 6, (at >> 6) // self.BLOCK
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        near = np.minimum(block[..., None] * self.BLOCK + np.arange(self.BLOCK), len(self.words) - 1)
        within = np.where(near < word[..., None], np.bitwise_count(self.words[near]), 0).sum(axis=-1, dtype=np.int64)
        return self.before[block] + within + np.bitwise_count(self.words[np.minimum(word, len(self.words) - 1)] & low)

    def select(self, nth, bit: int) -> np.ndarray:
        """Where the ``nth`` (from 0) of the bits equal to ``bit`` stand: by sampled ranks, then words, then bits."""
        nth = np.asarray(nth, np.int64)
        before = self.before if bit else np.arange(len(self.before)) * (64 * self.BLOCK) - self.before
        block = np.searchsorted(before, nth, side="right") - 1
        near = block[:, None] * self.BLOCK + np.arange(self.BLOCK)
        held = self.words[near] if bit else ~self.words[near]
        ends = np.cumsum(np.bitwise_count(held), axis=1, dtype=np.int64)
        left = nth - before[block]
        k = (ends <= left[:, None]).sum(axis=1)
        rows = np.arange(len(nth))
        left -= np.where(k, ends[rows, k - 1], 0)
        word, at, width = held[rows, k], np.zeros(len(nth), np.int64), 32
        while width:  # halves of the word that hold too few are passed over
            low = word >> at.astype(np.uint64) & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            past = ones <= left
            left, at, width = left - np.where(past, ones, 0), at + np.where(past, width, 0), width >> 1
        return (near[rows, k] << 6) + at

    def get(self, at):
        at = np.asarray(at, np.int64)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)


class WaveletMatrix:
    """Reader of one shard's bytes; planes are decompressed as they are first needed."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        (length,) = struct.unpack_from("<Q", data, 8)
        head = json.loads(data[16 : 16 + length])
        self._data, self._base = data, 16 + length
        self.n, self.zeros, self._parts = head["n"], head["zeros"], head["parts"]
        self.levels = len(self.zeros)
        self._planes: dict[int, BitPlane] = {}
        self.alphabet = np.frombuffer(self._part(3), "<u4")
        self._place = {t: k for k, t in enumerate(self.alphabet.tolist())}

    def _part(self, k: int) -> bytes:
        start, end = self._parts[k]
        return zstandard.ZstdDecompressor().decompress(self._data[self._base + start : self._base + end], max_output_size=1 << 31)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Documents' ids, and where each starts in the shard, with the end."""
        ids, missing = np.frombuffer(self._part(0), "<i8"), np.frombuffer(self._part(1), np.uint8)
        return [None if m else int(x) for x, m in zip(ids, missing)], np.frombuffer(self._part(2), "<i8")

    def plane(self, level: int) -> BitPlane:
        if level not in self._planes:
            self._planes[level] = BitPlane(self._part(4 + level), self.n)
        return self._planes[level]

    def access(self, i: int) -> int:
        """The token at ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = 0
        for level in range(self.levels):
            p = self.plane(level)
            bit, ones = int(p.get(i)), int(p.rank1(i))
            place = place << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return int(self.alphabet[place])

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        place = self._place.get(token)
        if place is None:
            return 0, 0
        for level in range(self.levels):
            ones_start, ones_end = map(int, self.plane(level).rank1([start, end]))
            if place >> (self.levels - 1 - level) & 1:
                start, end = self.zeros[level] + ones_start, self.zeros[level] + ones_end
            else:
                start, end = start - ones_start, end - ones_end
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often ``token`` occurs in [start, end)."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of ``token``, ascending: its range at the bottom is carried up again by select."""
        a, b = self._range(token, 0, self.n)
        place, at = self._place.get(token, 0), np.arange(a, b)
        for level in reversed(range(self.levels)):
            bit = place >> (self.levels - 1 - level) & 1
            at = self.plane(level).select(at - self.zeros[level] * bit, bit)
        return at

    def tokens(self) -> np.ndarray:
        """The whole sequence: the stable partitions are undone from the lowest plane up."""
        values = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            bits, zeros = self.plane(level).bits(), self.zeros[level]
            up = np.empty_like(values)
            up[np.flatnonzero(~bits)] = values[:zeros]
            up[np.flatnonzero(bits)] = values[zeros:] | values.dtype.type(1 << (self.levels - 1 - level))
            values = up
        return self.alphabet[values]


def build_shard(doc_ids: list[int | None], rows: list[np.ndarray], lengths: list[int] | None = None) -> bytes:
    """One shard of documents' token ids, one row each, or as many ids each as ``lengths`` say."""
    lengths = [len(r) for r in rows] if lengths is None else lengths
    tokens = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    counts = np.bincount(tokens)
    alphabet = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    levels = max(1, (len(alphabet) - 1).bit_length())
    place = np.zeros(len(counts), np.uint16 if levels <= 16 else np.uint32)
    place[alphabet] = np.arange(len(alphabet))
    values = place[tokens]
    squeeze = zstandard.ZstdCompressor(level=1).compress
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    parts = [
        squeeze(np.array([x or 0 for x in doc_ids], "<i8").tobytes()),
        squeeze(np.array([x is None for x in doc_ids], np.uint8).tobytes()),
        squeeze(starts.astype("<i8").tobytes()),
        squeeze(alphabet.astype("<u4").tobytes()),
    ]
    zeros = []
    for level in range(levels):
        bits = (values & values.dtype.type(1 << (levels - 1 - level))) != 0
        parts.append(squeeze(np.packbits(bits, bitorder="little").tobytes()))
        low = values[np.flatnonzero(~bits)]  # much quicker than values[~bits]
        zeros.append(len(low))
        values = np.concatenate([low, values[np.flatnonzero(bits)]])
    ends = np.cumsum([len(p) for p in parts]).tolist()
    head = json.dumps({"n": len(tokens), "zeros": zeros, "parts": list(zip([0, *ends], ends))}).encode()
    return MAGIC + struct.pack("<Q", len(head)) + head + b"".join(parts)


MANIFEST = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("within", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_docs", T.LongType()),
    T.StructField("bytes", T.LongType()),
])


def write_shards(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 21) -> DataFrame:
    """Encode all texts and write shards in ascending id order; returns the manifest, a row for each shard.

    ``part``/``within``: the range partition, and the tokens of that partition before the shard. Null texts are empty
    (one end id); null ids come first; rows with equal ids are ordered by a hash of their text, and equal rows are kept.
    A document is never split; a longer one makes its shard larger. An empty table writes no file. Ids must be whole
    numbers, or texts of them: any other text ends the job with a cast error. Special tokens' strings give special
    tokens, as the library's call does.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, seq, done = TaskContext.get().partitionId(), encoder(tokenizer), 0, 0
        ids: list = []
        rows: list[np.ndarray] = []
        end, held = np.array([end_id], np.uint32), 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, done, held, ids, rows
            path, data = f"{out_dir}/part-{part:06d}-{seq:06d}.wvm", build_shard(ids, rows, [len(r) + 1 for r in rows[::2]])
            C.write_file(path, data)
            out = pa.RecordBatch.from_pydict({"path": [path], "part": pa.array([part], pa.int32()), "within": [done], "n_tokens": [held], "n_docs": [len(ids)], "bytes": [len(data)]})
            seq, done, held, ids, rows = seq + 1, done + held, 0, [], []
            return out

        for batch in batches:
            encoded = (row for texts in groups(batch.column(1)) for row in enc.encode(texts))
            for i, row in zip(batch.column(0).to_pylist(), encoded):
                ids.append(i)
                rows += [row, end]
                held += len(row) + 1
                if held >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    ordered = C.ids_and_texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(C.partitions(docs.sparkSession), "id", "tie").sortWithinPartitions("id", "tie").select(F.col("id").cast("long"), "text")
    return C.stage_table(ordered.mapInArrow(write, MANIFEST), "wavelet-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame, of: Callable[[np.ndarray], dict] | None = None) -> DataFrame:
    """Read the shards back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only a count for each range partition reaches the driver.
    """
    totals = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, before = [], 0
    for part in sorted(totals):
        base.append((part, before))
        before += totals[part]
    bases = spark.createDataFrame(base, "part int, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                shard = WaveletMatrix(C.read_file(path))
                ids, starts = shard.documents()
                raw, at = memoryview(shard.tokens().astype("<u4").tobytes()), starts.tolist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()),
                    "start": pa.array(starts[:-1] + first),
                    "n_tokens": pa.array(np.diff(starts)),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])], pa.int64()),
                })

    shards = manifest.join(F.broadcast(bases), "part").select("path", (F.col("base") + F.col("within")).alias("first"))
    return shards.repartition(C.partitions(spark)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
