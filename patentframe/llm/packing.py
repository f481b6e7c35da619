"""Operator 5: best-fit packing after a Martello-Toth dominance reduction.

Only the histogram of piece lengths, at most ``capacity`` counts, reaches the driver. There the reduction fixes bins
that provably dominate all others for their longest piece, the rest is packed best fit decreasing, both on counts, and
the few bin patterns that result are dealt back to the pieces by their rank among pieces of equal length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C
from .pretokens import encoder, groups

#: A bin pattern: so many bins, each with these (length, how many) in order.
Pattern = tuple[int, list[tuple[int, int]]]


def _smallest(counts: Counter, lengths: list[int], used: int, n: int) -> int | None:
    """Sum of the n smallest pieces beside one of length ``used``; None if there are fewer."""
    total = left = 0
    left = n
    for x in lengths:
        take = min(left, counts[x] - (x == used))
        total, left = total + take * x, left - take
        if not left:
            return total
    return None


def _best_pair(counts: Counter, lengths: list[int], used: int, room: int) -> int:
    """The largest sum of two pieces beside one of length ``used`` that fits; 0 if none does."""
    have = [x for x in lengths if counts[x] - (x == used) > 0]
    low, high, best = 0, len(have) - 1, 0
    while low <= high:
        a, b = have[low], have[high]
        if a + b > room:
            high -= 1
        elif low == high and counts[a] - (a == used) < 2:
            break
        else:
            best, low = max(best, a + b), low + 1
    return best


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], Counter]:
    """Martello and Toth's reduction by dominance: fixed bins, and what is left to pack.

    For the longest piece j, in turn: alone if nothing fits beside it; with k, the longest piece that fits, if the two
    fill a bin, if no two pieces fit beside j, or if no three do and no two that do are longer than k. In each case every
    feasible bin with j can be exchanged for the fixed one without needing more bins.
    """
    left, fixed = Counter({x: n for x, n in counts.items() if n > 0}), []
    lengths = sorted(left)
    for j in reversed(lengths.copy()):
        while left[j] > 0:
            lengths = [x for x in lengths if left[x] > 0] if any(left[x] <= 0 for x in lengths[:3]) else lengths
            room, one = capacity - j, _smallest(left, lengths, j, 1)
            if one is None or one > room:
                fixed.append((left[j], [(j, 1)]))
                left[j] = 0
                break
            at = bisect.bisect_right(lengths, room) - 1
            while at >= 0 and left[lengths[at]] - (lengths[at] == j) <= 0:
                at -= 1
            k = lengths[at]
            if k != room:
                two = _smallest(left, lengths, j, 2)
                if two is not None and two <= room:
                    three = _smallest(left, lengths, j, 3)
                    if three is not None and three <= room or k < _best_pair(left, lengths, j, room):
                        break
            n = left[j] // 2 if k == j else min(left[j], left[k])
            fixed.append((n, [(j, 2)] if k == j else [(j, 1), (k, 1)]))
            left[j] -= n
            left[k] -= n
    return fixed, +left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing on counts: each length goes to the fullest bins that still have room, else to new ones."""
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, inside: list[tuple[int, int]]) -> None:
        if n:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append((n, inside))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect.bisect_left(rooms, x)
            if at < len(rooms):
                room = rooms[at]
                bins, inside = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, inside = capacity, []
                bins = -(-n // (capacity // x))
            each = room // x
            full = min(bins, n // each)
            rest = min(n - full * each, each - 1) if full < bins else 0
            put(room - each * x, full, [*inside, (x, each)])
            if rest:
                put(room - rest * x, 1, [*inside, (x, rest)])
            put(room, bins - full - (rest > 0), inside)
            n -= full * each + rest
    return [p for room in rooms for p in open_[room]]


def plan_bins(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def deal(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For pieces of each length by rank: from rank ``low`` on, ``each`` a bin from ``bin`` on, at ``offset`` there."""
    rows, seen, first = [], Counter(), 0
    for bins, inside in patterns:
        offset = 0
        for x, each in inside:
            rows.append((x, seen[x], first, each, offset))
            seen[x] += bins * each
            offset += x * each
        first += bins
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "low", "bin", "each", "offset"), cols))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each text with its end id; ``local``: rank in its task among equal lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, seen, end = TaskContext.get().partitionId(), encoder(tokenizer, special_as_text), Counter(), np.array([end_id], np.uint32)
        for batch in batches:
            rows: list[tuple] = []
            encoded = (ids for texts in groups(batch.column(1)) for ids in enc.encode(texts))
            for i, ids in zip(batch.column(0).to_pylist(), encoded):
                ids = np.concatenate([ids, end]).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((i, piece, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                    seen[len(own)] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "local")
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 7, kinds)], names)

    return C.ids_and_texts(docs, id_col, text_col).select(F.col("id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Null and empty texts are one piece with the end id alone; null ids and repeated rows are pieces like any other;
    equal lengths are exchangeable, so ties need no order; an empty table gives no rows. Ids must be whole numbers, or
    texts of them: any other text ends the job with a cast error. Special tokens' strings give special tokens, as the
    library's call does, unless ``special_as_text``.
    """
    with C.batches_of(docs.sparkSession, 1000):
        pieces = C.stage_table(cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, special_as_text), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    table = deal(plan_bins({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    # capacity and counts bound the keys: length * 2^44 + rank
    keys = table["length"] * (1 << 44) + table["low"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            past = rank - table["low"][at]
            cols = {k: batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            cols["sequence_id"] = pa.array(table["bin"][at] + past // table["each"][at])
            cols["offset"] = pa.array(table["offset"][at] + past % table["each"][at] * length)
            yield pa.RecordBatch.from_pydict(cols)

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
