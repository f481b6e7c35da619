"""Operator 9: quality score by hashed word n-gram logistic regression, trained by FTRL-proximal updates.

Features are hashed word unigrams and bigrams, and the same of word shapes (case, digits, punctuation as it is), which
carry over to words never seen. A score is a sparse dot product of the counts with the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

WORDS = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class Settings:
    """Training takes at most ``most`` labelled ids, those with the smallest hash, one document of each, and of these, in the
    same order, as many as have ``most_features`` distinct features together (8 bytes each), the first in any case."""

    bits: int = 18
    alpha: float = 0.2
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    epochs: int = 4
    most: int = 6000
    most_features: int = 12_000_000


def shape(word: str) -> str:
    if word.isalpha():
        return "low" if word.islower() else "TOP" if word.isupper() and len(word) > 1 else "Cap" if word[0].isupper() else "mIx"
    return "digit" if word.isdigit() else "alnum" if word.isalnum() else word[:3]


class Hasher:
    """Text to hashed features; hashes of words are kept in a memo that restarts at ``most`` words."""

    def __init__(self, bits: int, most: int = 400_000):
        self.bits, self.most = bits, most
        self.reset()

    def reset(self) -> None:
        from .pretokens import Codes

        self.codes, self.hashes, self.n = Codes(), np.empty((1 << 14, 2), np.uint64), 0

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Features with repeats, and a value for each: one over the root of how many there are of its kind."""
        if len(self.codes) > self.most:
            self.reset()
        found = WORDS.findall(text)
        codes = np.fromiter(map(self.codes.__getitem__, found), np.int64, len(found))
        if new := self.codes.pending:
            while self.n + len(new) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
            self.hashes[self.n : self.n + len(new)] = [(xxhash.xxh3_64_intdigest(w, 1), xxhash.xxh3_64_intdigest(shape(w), 2)) for w in new]
            self.n += len(new)
            self.codes.pending = []
        kinds = []
        for k in (0, 1):
            h = self.hashes[codes, k]
            kinds += [h, h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)]
        features = np.concatenate([x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits) for x in kinds]).astype(np.int64)
        values = np.concatenate([np.full(len(x), 1 / np.sqrt(max(1, len(x)))) for x in kinds])
        return features, values


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> np.ndarray:
    """Weights, the bias last, of (distinct features, values, label) rows, taken in order ``epochs`` times."""
    dim = (1 << s.bits) + 1
    z, n = np.zeros(dim), np.zeros(dim)

    def weights(i) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for i, x, y in rows:
            i, x = np.append(i, dim - 1), np.append(x, 1.0)
            w = weights(i)
            g = (sigmoid(w @ x) - y) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - step * w
            n[i] += g * g
    return weights(slice(None)).astype(np.float32)


def held_out(key) -> F.Column:
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights from labelled rows that are not held out.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the largest holds, and of several
    documents the one with the smallest hash of its text. Without any labelled document all weights are 0. The sample's ids and
    labels are broadcast, its texts are hashed where they meet, and one task trains on the features; ``s`` bounds both.
    """
    known = labels.select(F.col(label_col).cast("int").alias("y"), F.col(id_col).alias("key")).where(F.col("y").isin(0, 1) & F.col("key").isNotNull() & ~held_out("key"))
    sample = known.groupBy("key").agg(F.max("y").alias("y")).withColumn("order", F.xxhash64("key")).orderBy("order", "key").limit(s.most)
    rows = C.ids_and_texts(docs, id_col, text_col)
    met = rows.join(F.broadcast(sample), rows["id"] == sample["key"])
    # a task passes on one document of an id, however many it has
    picked = met.groupBy("order", "key", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("order", F.xxhash64("text").alias("tie"), "y", "text")

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(s.bits)
        for batch in batches:
            out: list[list] = [[], []]
            for text in batch.column(3):
                features, values = hasher(text.as_py())
                sums = np.bincount(features, values, 1 << s.bits) if len(features) > 1 << 14 else None
                if sums is None:
                    distinct, back = np.unique(features, return_inverse=True)
                    total = np.bincount(back, values, len(distinct))
                else:
                    distinct = np.flatnonzero(sums)
                    total = sums[distinct]
                out[0].append(distinct.astype("<i4").tobytes())
                out[1].append(total.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["order", "tie", "y", "i", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        weights = train_ftrl([(np.frombuffer(i, "<i4"), np.frombuffer(x, "<f4").astype(float), y) for _, _, y, i, x in got], s)
        yield pa.RecordBatch.from_pydict({"weights": [weights.astype("<f4").tobytes()]})

    hashed = C.stage_table(picked.mapInArrow(hash_texts, "order long, tie long, y int, i binary, x binary"), "training-rows")
    sizes = sorted((r["order"], r["n"]) for r in hashed.select("order", (F.octet_length("i") / 4).alias("n")).collect())
    ends = np.cumsum([n for _, n in sizes])
    taken = max(1, int(np.searchsorted(ends, s.most_features, side="right")))
    if not sizes:
        return np.zeros((1 << s.bits) + 1, np.float32)
    got = hashed.where(F.col("order") <= sizes[min(taken, len(sizes)) - 1][0]).repartition(1).mapInArrow(train, "weights binary").collect()
    return np.frombuffer(got[0]["weights"], "<f4")


class Scorer:
    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.hasher = Hasher((len(weights) - 1).bit_length() - 1)

    def __call__(self, text: str) -> float:
        features, values = self.hasher(text)
        return float(sigmoid(self.weights[features] @ values + float(self.weights[-1])))


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null texts are scored as empty ones, by the bias alone; null ids aren't held out. Rows are scored each by its text, so repeated rows
    get equal scores and long texts count whole; an empty table gives no rows. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for batch in batches:
            scores = [scorer(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = C.ids_and_texts(docs, id_col, text_col).select("id", F.coalesce(held_out("id"), F.lit(False)).alias("held"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns; null texts are empty, repeated rows stay or go together,
    an empty table stays empty."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t.as_py() or "") >= threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
