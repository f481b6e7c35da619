"""Operator 3: byte-level BPE by two tiers.

Whole pre-tokens of the vocabulary are found by a minimal perfect hash; the others are merged with a heap of pair ranks
over a linked list of bytes. A task keeps a bounded memo of pre-tokens it has met.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from . import _common as C
from .pretokens import BYTE_LEVEL, ODD, Codes, Ragged


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [t for _, t in ranked]


def _mix(h: np.ndarray, d) -> np.ndarray:
    x = (h ^ (np.asarray(d, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct keys: n keys, n slots; by hash and displace, lone keys take free slots outright."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(h)) != n:
            raise ValueError("keys must be distinct")
        bucket = (h >> np.uint64(20)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_of = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        for b in np.argsort(-(cuts[1:] - cuts[:-1]), kind="stable"):
            members = order[cuts[b] : cuts[b + 1]]
            if len(members) < 2:
                break
            d = 0
            while True:
                tries = np.arange(d, d + 64, dtype=np.uint64)
                slots = np.sort((_mix(h[members][None, :], tries[:, None]) % np.uint64(n)).astype(np.int64), axis=1)
                good = ~taken[slots].any(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1)
                if good.any():
                    d += int(np.argmax(good))
                    break
                d += 64
            self.shift[b] = d
            slots = (_mix(h[members], d) % np.uint64(n)).astype(np.int64)
            taken[slots] = True
            self.slot_of[members] = slots
        free = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(cuts[1:] - cuts[:-1] == 1):
            self.slot_of[order[cuts[b]]] = slot = next(free)
            self.shift[b] = -1 - slot
        self.key_at = np.empty(n, np.int64)
        self.key_at[self.slot_of] = np.arange(n)
        self.hash_at = np.empty(n, np.uint64)
        self.hash_at[self.slot_of] = h

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Each key's number among the keys, or -1; equal 64-bit hashes still need a comparison of bytes."""
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if not self.n or not len(h):
            return np.full(len(h), -1, np.int64)
        shift = self.shift[((h >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, (_mix(h, shift.astype(np.uint64)) % np.uint64(self.n)).astype(np.int64))
        return np.where(self.hash_at[slot] == h, self.key_at[slot], -1)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, the leftmost of equals, is merged until none has a rank."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    prev = list(range(-1, n - 1))
    pair = [-1] * n  # rank of the part here with the next one
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            pair[i] = r
            heap.append((r, i))
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if pair[i] != r:
            continue
        j = end[i]
        e = end[i] = end[j]
        pair[j] = -1
        if e < n:
            prev[e] = i
            r = ranks.get(piece[i : end[e]])
            pair[i] = -1 if r is None else r
            if r is not None:
                heapq.heappush(heap, (r, i))
        else:
            pair[i] = -1
        p = prev[i]
        if p >= 0:
            r = ranks.get(piece[p:e])
            pair[p] = -1 if r is None else r
            if r is not None:
                heapq.heappush(heap, (r, p))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def white_space(pattern: str) -> str:
    """``\\s`` and ``\\S`` as the Unicode property, as the tiktoken library has them."""
    return pattern.replace("\\S", "\\P{White_Space}").replace("\\s", "\\p{White_Space}")


class ByteBpe:
    def __init__(self, tokens: list[bytes], table: PerfectHash, pattern: str, most: int = 400_000):
        self.tokens, self.table, self.pattern, self.most = tokens, table, regex.compile(white_space(pattern)), most
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.codes, self.rows = Codes(), Ragged()
        #: The quick pattern says the same as this one on Latin text.
        self.quick = pattern == "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"

    def encode(self, text: str) -> np.ndarray:
        if len(self.codes) > self.most:
            self.codes, self.rows = Codes(), Ragged()
        found = BYTE_LEVEL.findall(text) if self.quick and not ODD.search(text) else [m.group() for m in self.pattern.finditer(text)]
        codes = np.fromiter(map(self.codes.__getitem__, found), np.int64, len(found))
        if self.codes.pending:
            pieces = [x.encode() for x in self.codes.pending]
            known = self.table.find(pieces).tolist()
            self.rows.add([[k] if k >= 0 and self.tokens[k] == p else merge_bytes(p, self.ranks) for k, p in zip(known, pieces)])
            self.codes.pending = []
        return self.rows.take(codes)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each Python worker; the vocabulary is of fixed size."""
    if (path, pattern) not in _CODECS:
        tokens = load_ranks(path)
        _CODECS[path, pattern] = ByteBpe(tokens, PerfectHash(tokens), pattern)
    return _CODECS[path, pattern]


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Null texts are empty: 0 tokens and the digest of nothing. Rows are independent, so repeated rows, null ids and other
    columns change nothing; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = C.ids_and_texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
