"""Operator 7: SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are sorted by population count and cut into tiles, written as files. Tile pairs whose population
counts differ by more than the radius are skipped; the others are compared whole, with exclusive-or and bit counts. A
tile pair gives a spanning forest of its links, so a group of near copies costs links in proportion to its size. Where a
similarity is asked for, sketches discard pairs that are clearly apart; the others are compared by their texts' sets of
shingles, unless they are linked already.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .components import components

SEED = 42
#: Bins of the one-permutation sketch, a byte each, that stands for a text's set of shingles where a similarity is asked for.
BINS = 512
#: How often bytes of different hashes are equal.
CHANCE = 1 / 255
#: Over five standard errors (0.018) of the estimate at a similarity of 0.8: pairs below by so much aren't compared by their sets.
TOLERANCE = 0.1
#: Sets of fewer shingles have wider bounds, as one shingle makes a difference: of the estimate, and this many bits more.
FEW, FEW_TOLERANCE, FEW_BITS = 16, 0.3, 6
#: Hashes of shingles a task holds at once (8 bytes each), besides one pair of texts.
MOST_HASHES = 4_000_000


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words of the text, A-Z in lower case; of the whole if there are fewer."""
    found = text.encode().lower().split()  # of bytes: A-Z and the six ASCII spaces alone
    if not found:
        return np.zeros(0, np.uint64)
    line = memoryview(b" ".join(found))
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1].tolist()
    hash_ = xxhash.xxh64_intdigest
    return np.array([hash_(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def simhash(h: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def sketch(h: np.ndarray) -> np.ndarray:
    """One permutation of the set of shingles: the least hash of each bin, a byte of it; 0 for an empty bin."""
    bins, rest = (h >> np.uint64(55)).astype(np.int64), h & np.uint64((1 << 55) - 1)
    out = np.full(BINS, np.uint64(1 << 63), np.uint64)
    np.minimum.at(out, bins, rest)
    return np.where(out >> np.uint64(63), 0, out % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the sets behind rows of sketches."""
    some = (a > 0) | (b > 0)
    equal = ((a == b) & some).sum(axis=1) / np.maximum(1, some.sum(axis=1))
    return (equal - CHANCE) / (1 - CHANCE)


@dataclass
class Texts:
    """Texts in files of a shared folder, one a task, of which sets of shingles are made again where two are compared."""

    folder: str
    words: int
    held: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    size: int = 0

    def path(self, part: int) -> str:
        return f"{self.folder}/texts-{part:012d}"

    def set_of(self, part: int, at: int, size: int) -> np.ndarray:
        """The sorted distinct hashes of the text at a place."""
        got = self.held.get((part, at))
        if got is None:
            fs, path = C.filesystem(self.path(part))
            with fs.open_input_file(path) as f:
                raw = f.read_at(size, at)
            text = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
            got = np.unique(shingle_hashes(text.decode(), self.words))
            if self.size + len(got) > MOST_HASHES:
                self.held, self.size = {}, 0
            self.held[part, at] = got
            self.size += len(got)
        return got


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets, as sorted distinct hashes; 1 for two empty ones."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 1.0
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


PLACE = ("part", "at", "size", "n")


def fingerprints(docs: DataFrame, words: int, texts: Texts | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, uid, fp, sketch, node of every row, and the columns ``keep`` under ``row``; written to the shared folder.

    ``uid`` numbers rows. ``node`` is what is compared: the fingerprint or, with ``texts``, a hash of the set of shingles.
    Then fingerprints are of distinct shingles, texts are written to its folder and ``place`` tells where, and how many distinct shingles they have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        to, at, attempt = None, 0, TaskContext.get().taskAttemptId()  # an attempt that fails leaves a file nobody reads
        try:
            for batch in batches:
                fps, sketches, nodes, places = [], [], [], []
                for text in batch.column(1):
                    text = text.as_py()
                    h = shingle_hashes(text, words)
                    own = h if texts is None else np.unique(h)  # similarity is of sets, so repeats don't count there
                    fp = simhash(own)
                    fps.append(fp)
                    if texts is None:
                        sketches.append(b"")
                        nodes.append(fp)
                        continue
                    raw = text.encode()
                    data = len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)
                    if to is None:
                        fs, path = C.filesystem(texts.path(attempt))
                        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        to = fs.open_output_stream(path, compression=None)
                    to.write(data)
                    sketches.append(sketch(own).tobytes())
                    nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                    places.append({"part": attempt, "at": at, "size": len(data), "n": len(own)})
                    at += len(data)
                new = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, nodes)]
                kind = pa.struct([("part", pa.int64()), ("at", pa.int64()), ("size", pa.int32()), ("n", pa.int32())])
                place = [] if texts is None else [pa.array(places, kind)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), new[0], pa.array(sketches, pa.binary()), new[1], *place, *batch.columns[3:]], ["id", "uid", "fp", "sketch", "node", *["place"] * len(place), *batch.schema.names[3:]])
        finally:
            if to is not None:
                to.close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("uid"), *([F.struct(*keep).alias("row")] if keep else []))
    schema = "id long, uid long, fp long, sketch binary, node long" + (", place struct<part:bigint,at:bigint,size:int,n:int>" if texts else "") + (f", row {rows.schema['row'].dataType.simpleString()}" if keep else "")
    with C.batches_of(docs.sparkSession, 1000):
        return C.stage_table(rows.mapInArrow(run, schema), "fingerprints")


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as (i, j), at most one a node: each to the least of its component."""
    nodes, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = back[: len(i)], back[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


class Tile:
    """Fingerprints by population count, with the counts' range for each run of rows."""

    def __init__(self, data: bytes):
        got = np.load(io.BytesIO(data))
        self.fp, self.node, self.sketch = got["fp"], got["node"], got["sketch"]
        self.place = [got[k] for k in PLACE] if "n" in got else None
        self.ones = np.stack([np.bitwise_count(self.fp), np.bitwise_count(self.fp & np.uint64(0xFFFFFFFF))]).astype(np.int64)

    def runs(self, step: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        return [(k, min(k + step, len(self.fp)), self.ones[:, k : k + step].min(axis=1), self.ones[:, k : k + step].max(axis=1)) for k in range(0, len(self.fp), step)]


class Groups:
    """Components of the links found so far; ``root`` names each node's."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def join(self, i: int, j: int) -> None:
        x, y = int(self.root[i]), int(self.root[j])
        own = [self.members.pop(k, [k]) for k in (x, y)]
        if len(own[0]) < len(own[1]):
            x, own = y, own[::-1]
        self.root[own[1]] = x
        own[0].extend(own[1])
        self.members[x] = own[0]


def alike(a: Tile, b: Tile, i: np.ndarray, j: np.ndarray, offset: int, least: float, texts: Texts, groups: Groups) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that are alike by ``least`` or more, as their sets tell, and that link two components."""
    out: list[tuple[int, int]] = []
    for k in range(0, len(i), 8192):
        x, y = i[k : k + 8192], j[k : k + 8192]
        n, m = a.place[3][x].astype(np.int64), b.place[3][y].astype(np.int64)
        some = (groups.root[x] != groups.root[y + offset]) & (np.minimum(n, m) >= least * np.maximum(n, m))
        x, y, few = x[some], y[some], np.maximum(n, m)[some] < FEW
        some = likeness(a.sketch[x], b.sketch[y]) >= least - np.where(few, FEW_TOLERANCE, TOLERANCE)
        x, y = x[some], y[some]
        for r in np.unique(x).tolist():
            own = y[x == r]
            for c in own[groups.root[r] != groups.root[own + offset]].tolist():
                if groups.root[r] != groups.root[c + offset] and jaccard(texts.set_of(*(int(p[r]) for p in a.place[:3])), texts.set_of(*(int(p[c]) for p in b.place[:3]))) >= least:
                    groups.join(r, c + offset)
                    out.append((r, c))
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def compare(a: Tile, b: Tile, same: bool, radius: int, least: float | None, texts: Texts | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles as a forest of nodes. Runs whose counts, of all or of the low bits, differ too much are skipped."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    wide = radius + (FEW_BITS if least is not None else 0)
    groups = Groups(len(a.fp) + (0 if same else len(b.fp))) if least is not None else None
    size = 0
    offset = 0 if same else len(a.fp)
    nodes = a.node if same else np.concatenate([a.node, b.node])
    cols = b.runs(4096)
    for r0, r1, low, high in a.runs(64):
        for c0, c1, low2, high2 in cols:
            if same and c1 <= r0:
                continue
            gap = np.maximum(0, np.maximum(low - high2, low2 - high))
            if gap[0] > wide or gap[1] > wide:
                continue
            bits = np.bitwise_count(a.fp[r0:r1, None] ^ b.fp[None, c0:c1])
            near = bits <= radius
            if wide > radius:
                few, few2 = np.flatnonzero(a.place[3][r0:r1] < FEW), np.flatnonzero(b.place[3][c0:c1] < FEW)
                near[np.ix_(few, few2)] |= bits[np.ix_(few, few2)] <= wide
            if not near.any():
                continue
            i, j = np.nonzero(near)
            i, j = i + r0, j + c0
            if same:
                i, j = i[i < j], j[i < j]
            if least is not None and len(i):
                i, j = alike(a, b, i, j, offset, least, texts, groups)
            if len(i):
                held.append((i, j + offset))
                size += len(i)
            if size > 1 << 20:
                held = [forest(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = forest(*map(np.concatenate, zip(*held)))
    return nodes[i], nodes[j]


def links(marked: DataFrame, radius: int, least: float | None = None, tiles: int = 64, tile_rows: int = 8192, most_rows: int = 1 << 18, texts: Texts | None = None) -> DataFrame:
    """(u, v) links of nodes within the radius, and alike by the sets of their ``texts`` if ``least`` is given; enough for components.

    A tile holds 1/``tiles`` of the distinct fingerprints, ``tile_rows`` at least and about ``most_rows`` at most, so a task's memory has a
    bound whatever the input (146 MB a tile with sketches and places). Only pairs of file names are shuffled.
    """
    spark = marked.sparkSession
    place = [] if texts is None else ["place"]
    distinct = C.stage_table(marked.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "sketch", *place))), "distinct")
    count = distinct.count()
    n_tiles = max(1, min(tiles, -(-count // tile_rows)), -(-count // most_rows))
    out_dir = C.new_dir(spark, "tiles")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        fp, node = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in ("fp", "node"))
        raw = b"".join(x for b in got for x in b.column("sketch").to_pylist())
        path, to = f"{out_dir}/tile-{TaskContext.get().partitionId():06d}.npz", io.BytesIO()
        places = {k: np.concatenate([b.column(k).to_numpy() for b in got]) for k in PLACE} if place else {}
        np.savez(to, fp=fp.view(np.uint64), node=node, sketch=np.frombuffer(raw, np.uint8).reshape(len(fp), -1), **places)
        C.write_file(path, to.getvalue())
        ones = np.bitwise_count(fp.view(np.uint64))
        yield pa.RecordBatch.from_pydict({"path": [path], "low": pa.array([int(ones.min())], pa.int32()), "high": pa.array([int(ones.max())], pa.int32())})

    ones = F.bit_count("fp")
    columns = ["fp", "node", "sketch", *(f"place.{k}" for k in PLACE if place)]
    ordered = distinct.select(*columns, ones.alias("ones"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("half"))
    ordered = ordered.repartitionByRange(n_tiles, "ones", "half", "fp", "node").sortWithinPartitions("ones", "half", "fp", "node").drop("ones", "half")
    table = C.stage_table(ordered.mapInArrow(cut, "path string, low int, high int"), "tiles-list")
    # a pair is met once, where the tile that begins later begins
    begun = table.select("path", "low", F.explode(F.sequence("low", F.col("high") + radius + (FEW_BITS if least is not None else 0))).alias("k"))
    later = table.select(F.col("path").alias("path2"), F.col("low").alias("k"))
    pairs = begun.join(later, "k").where("(low, path) <= (k, path2)").select("path", "path2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                a = Tile(C.read_file(p))
                u, v = compare(a, a if p == q else Tile(C.read_file(q)), p == q, radius, least, texts)
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    spread = C.stage_table(pairs, "tile-pairs").repartition(max(C.partitions(spark), n_tiles))
    return spread.mapInArrow(run, "u long, v long")


def classes(marked: DataFrame, radius: int, least: float | None = None, texts: Texts | None = None) -> DataFrame:
    """(node, root, least_id, least_uid) of every node: the least (id, uid) of its component; null ids count last."""
    root = components(links(marked, radius, least, texts=texts))
    own = marked.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")).alias("first"))
    by_node = C.stage_table(own.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
    by_root = by_node.groupBy("root").agg(F.min("first").alias("least"))
    return by_node.join(by_root, "root").select("node", "root", F.col("least.id").alias("least_id"), F.col("least.uid").alias("least_uid"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, least: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    Null and empty texts, and those of spaces alone, have fingerprint 0 and are linked like any other. Null ids are
    never a component's id unless it has no other. Repeated rows are members like any other; an empty table gives none.
    """
    texts = None if least is None else Texts(C.new_dir(docs.sparkSession, "texts"), words)
    marked = fingerprints(docs, words, texts, id_col, text_col)
    found = classes(marked, radius, least, texts).select("node", "least_id")
    return marked.join(found, "node").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, radius: int = 20, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the least id of each component, one of each; all columns are kept.

    Texts are linked if their sets of ``words``-word shingles are alike by ``least`` or more (64-bit hashes of shingles stand
    for them; a sketch only discards pairs below ``least`` by ``TOLERANCE``), and their fingerprints, of the same sets, differ in at most ``radius`` bits: at a similarity of 0.8 about 10 do, and over 20 in fewer
    than one pair of a thousand from 10 shingles on. Of 4 against 5 it is 1 of 190, so below ``FEW`` ``FEW_BITS`` more may differ.
    """
    texts = Texts(C.new_dir(docs.sparkSession, "texts"), words)
    marked = fingerprints(docs, words, texts, id_col, text_col, docs.columns)
    kept = classes(marked.drop("row"), radius, least, texts).select(F.col("least_uid").alias("uid")).distinct()
    return marked.join(kept, "uid", "left_semi").select("row.*")
