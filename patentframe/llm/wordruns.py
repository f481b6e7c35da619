"""Operator 4 over words: removal of repeated passages that begin or end inside lines.

The suffix array, common prefixes and intervals are those of ``linededup``; a word stands for a line. As words are many, only those
that may belong to a repeated passage are put in order: of every ``min_words`` words in a row, the least of the hashes of the runs
of half as many words is taken, as equal passages take equal hashes. Places whose hash is taken once in all documents repeat nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import linededup as L

#: Odd multipliers that mix two hashes, in order.
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text whose words are hashed at once, unless one text is longer.
TEXT_BYTES = 4_000_000
#: What stands between a word's white space and the next word; white space is as in ``linededup.SPACES``.
NEXT_WORD = r"(?<=[ \t\n\x0B\f\r])(?=[^ \t\n\x0B\f\r])"


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * MIX[0] + b
    return (x ^ (x >> np.uint64(29))) * MIX[1]


def slide(x: np.ndarray, size: int, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``join`` over each ``size`` values in a row, by doubling and two windows that cover them."""
    p = 1
    while 2 * p <= size and len(x) > p:
        x, p = join(x[:-p], x[p:]), 2 * p
    rest = size - p
    if len(x) <= rest:
        return x[:0]
    return join(x[: len(x) - rest], x[rest:]) if rest else x


def sampled(texts: list[bytes], min_words: int) -> tuple[np.ndarray, ...]:
    """text, start (a word), size, gram: from each of ``size`` words on, the passages of ``min_words`` words take the hash ``gram``.

    A hash at one place is taken from as many starts as a passage has runs at most; more are several places'.
    """
    words = [t.split() for t in texts]  # bytes: at the six characters of linededup.SPACES
    counts = np.array([len(w) for w in words], np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    text, first = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts) - counts
    half = -(-min_words // 2)
    span = min_words - half + 1
    least = slide(slide(hashes, half, mixed), span, np.minimum)
    at = np.flatnonzero(text[: len(least)] == text[min_words - 1 :][: len(least)])
    least = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (text[at[1:]] != text[at[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    pieces = -(-size // span)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, size = np.repeat(begin, pieces) + k * span, np.minimum(np.repeat(size, pieces) - k * span, span)
    own = text[at[begin]]
    return own, at[begin] - first[own], size, least[begin]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return C.ids_and_texts(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")


def _in_parts(b: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch as UTF-8, some at a time, and the number of the first."""
    texts, begin, size = b.column("text").cast(pa.binary()), 0, 0
    for k in range(b.num_rows):
        size += len(texts[k].as_buffer())
        if size >= TEXT_BYTES or k == b.num_rows - 1:
            yield begin, texts.slice(begin, k + 1 - begin).to_pylist()
            begin, size = k + 1, 0


def places(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """id, hash (of the text), start, size, gram of all documents, as ``sampled`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, texts in _in_parts(b):
                own, start, size, gram = sampled(texts, min_words)
                rows = pa.array(own + begin)
                cols = [b.column("id").take(rows), b.column("hash").take(rows), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(gram.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "hash", "start", "size", "gram"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "id long, hash long, start int, size int, gram long")


def words_near(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """Words that may belong to a repeated passage, in the columns of ``linededup.lines_of``: pos counts all words of the text."""
    taken = C.stage_table(places(docs, min_words, id_col, text_col), "grams")
    again = taken.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    near = taken.join(again, "gram").groupBy(*L.KEY).agg(F.collect_list(F.struct("start", "size")).alias("near"))
    rows, near = _keyed(docs, id_col, text_col).alias("d"), near.alias("n")
    met = rows.join(near, F.col("d.id").eqNullSafe(F.col("n.id")) & (F.col("d.hash") == F.col("n.hash"))).select("d.id", "d.hash", "text", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words = b.column("text")[k].as_buffer().to_pybytes().split()
                own = b.column("near").slice(k, 1).flatten()
                start, size = own.field("start").to_numpy(), own.field("size").to_numpy()
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, start, 1)
                np.add.at(edges, start + size - 1 + min_words, -1)
                pos = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
                line = pa.array([xxhash.xxh3_128_digest(words[p]) for p in pos.tolist()], pa.binary())
                row = pa.array(np.full(len(pos), k))
                cols = [b.column("id").take(row), b.column("hash").take(row), pa.array(pos.astype(np.int32)), line, pa.array(np.ones(len(pos), np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "hash", "pos", "line", "words"])

    return met.mapInArrow(run, "id long, hash long, pos int, line binary, words int")


def later_passages(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash, runs: of each text, the runs (pos among its words, n words) that repeat earlier ones, by (id, hash, pos).

    Null ids, overlaps, repeated rows and empty tables are as in ``linededup.later_copies``.
    """
    words = C.stage_table(words_near(docs, min_words, id_col, text_col), "words")
    return L.copies_of(words, min_words)


def _without(text: Column, runs: Column) -> Column:
    """The text without the runs' words; a line that ends after a run's last word still ends there."""

    def with_gone(v: Column) -> Column:
        lead = F.when(text.rlike(r"^[ \t\n\x0B\f\r]"), 1).otherwise(0)
        each = F.transform(runs, lambda r: F.sequence(r["pos"] + lead, r["pos"] + r["n"] - 1 + lead))
        return F.struct(v["pieces"].alias("pieces"), F.array_distinct(F.flatten(each)).alias("gone"))

    def cut(v: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(v["pieces"]) - 1), v["gone"])
        ends = F.transform(F.array_except(F.transform(v["gone"], lambda k: k + 1), v["gone"]), lambda k: k - 1)
        ends = F.filter(ends, lambda k: F.contains(v["pieces"][k], F.lit("\n")))
        whole = F.transform(kept, lambda k: F.struct(k.alias("k"), v["pieces"][k].alias("x")))
        breaks = F.transform(ends, lambda k: F.struct(k.alias("k"), F.lit("\n").alias("x")))
        return F.array_join(F.transform(F.array_sort(F.concat(whole, breaks)), lambda p: p["x"]), "")

    return L._let(L._let(F.struct(F.split(text, NEXT_WORD).alias("pieces")), with_gone), cut)


def drop_passages(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The rows without later copies of passages of ``min_words`` words (2 at least) or more, ``count_col`` counted anew.

    Passages are equal if their words are, whatever white space stands between. A document of which nothing is left goes. Null texts
    have no words and stay null; repeated rows are treated alike; other columns stay as they are; an empty table gives no rows.
    ``docs`` is read three times, so it should be a table.
    """
    return L.left(docs, L.met(docs, later_passages(docs, min_words, id_col, text_col), _without, id_col, text_col), text_col, count_col)
