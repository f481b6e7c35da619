"""Entity mentions, coreference labels and first-seen mentions; models are back ends behind one function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunking import boundary_chunks

#: A back end gives (text, label, start, end) of a chunk.
Backend = Callable[[str], list[tuple[str, str, int, int]]]
MENTION = "array<struct<text:string,label:string,start:int,end:int>>"

#: Expressions of the deterministic back end, by label.
PATTERNS = {"DATE": r"\b(?:1[89]|20)\d\d\b", "MONEY": r"\$\d+(?:\.\d+)?[MBK]?", "ORG": r"\b[A-Z]{3,}\b"}


def pattern_backend(patterns: dict[str, str] | None = None) -> Backend:
    compiled = [(k, re.compile(p, re.ASCII)) for k, p in (patterns or PATTERNS).items()]
    return lambda text: sorted(((m.group(), label, m.start(), m.end()) for label, p in compiled for m in p.finditer(text)), key=lambda x: (x[2], x[3]))


def extract(df: DataFrame, keep: list[str], text_col: str, load: Callable[[], Backend] = pattern_backend, size: int = 100_000, window: int = 200, line_break: str = "\n\n") -> DataFrame:
    """``keep``, chunk_id, text, label, start, end of every mention, in the text's own offsets.

    Texts are chunked at boundaries by expressions; ``load`` is called once a task and its back end gets chunk by chunk.
    """
    import pyarrow as pa

    chunks = df.select(*keep, F.posexplode(boundary_chunks(F.coalesce(F.col(text_col), F.lit("")), size, window, line_break)).alias("chunk_id", "c"))
    rows = chunks.select(*keep, "chunk_id", F.col("c.start").alias("at"), F.col("c.text").alias("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = load()
        for b in batches:
            found = [[(t, label, s + at, e + at) for t, label, s, e in backend(chunk)] for at, chunk in zip(b.column("at").to_pylist(), b.column("chunk").to_pylist())]
            kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            made = pa.array([[dict(zip(("text", "label", "start", "end"), m)) for m in row] for row in found], kind)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), b.column("chunk_id"), made], [*keep, "chunk_id", "mentions"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep, "chunk_id").schema.fields) + f", mentions {MENTION}"
    return rows.mapInArrow(run, schema).select(*keep, "chunk_id", F.explode("mentions").alias("m")).select(*keep, "chunk_id", "m.*")


def extract_native(df: DataFrame, keep: list[str], text_col: str, label: str, pattern: str) -> DataFrame:
    """Mentions of one expression without their offsets, by built-in functions."""
    return df.select(*keep, F.lit(label).alias("label"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))).alias("text"))


def coref_labels(mentions: DataFrame, chain: list[str], order: list[str], label: str = "label", default: str = "CORE") -> DataFrame:
    """Each mention's label along its chain: the first label so far, or ``default`` before there is one."""
    w = Window.partitionBy(*chain).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return mentions.withColumn("chain_label", F.coalesce(F.first(label, ignorenulls=True).over(w), F.lit(default)))


def first_mentions(mentions: DataFrame, doc: list[str], order: list[str]) -> DataFrame:
    """One mention of each span of a document: the first by order, coreference mentions before plain ones."""
    nth = F.row_number().over(Window.partitionBy(*doc, "start", "end").orderBy(*order))
    return mentions.withColumn("nth", nth).where("nth = 1").drop("nth")


def covering_labels(mentions: DataFrame, entities: DataFrame, doc: list[str], width: int = 64) -> DataFrame:
    """Mentions with ``label``: that of the first entity of their document that overlaps them, or null.

    Spans are dealt to the stretches of ``width`` characters they touch, so only spans near each other meet, however long
    a document is. An empty span touches nothing.
    """
    touched = lambda: F.explode(F.when(F.col("end") > F.col("start"), F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    e = entities.select(*doc, touched().alias("stretch"), F.col("start").alias("e_start"), F.col("end").alias("e_end"), F.col("label").alias("e_label"))
    m = mentions.drop("label")
    spans = m.select(*doc, "start", "end").distinct()
    met = spans.select("*", touched().alias("stretch")).join(e, [*doc, "stretch"]).where((F.col("e_start") < F.col("end")) & (F.col("e_end") > F.col("start")))
    first = met.groupBy(*doc, "start", "end").agg(F.min(F.struct("e_start", "e_end", "e_label")).alias("f"))
    return m.join(first, [*doc, "start", "end"], "left").select(*m.columns, F.col("f.e_label").alias("label"))


def compose(mentions: DataFrame, entities: DataFrame, chunks: DataFrame, doc: list[str], default: str = "CORE") -> DataFrame:
    """``doc``, text, label, start, end: mentions of chains with their chains' labels, and the entities at other spans.

    ``mentions`` has chain, idx, start, end, text; ``entities`` text, label, start, end; ``chunks`` chunk_id, start, end.
    A mention belongs to the chunk it lies in, or is left out; of mentions of one span the first (by chain, idx) counts. Its own label is
    that of the first entity that overlaps it, else that of its chain's mention 0 if both are in one chunk. Its chain's label is
    the first such one so far, by chunk and idx; before there is one, ``default``. Entities whose span a mention has are left out.
    """
    at = chunks.select(*doc, "chunk_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    placed = mentions.drop("chunk_id").join(at, doc).where((F.col("start") >= F.col("c_start")) & (F.col("end") <= F.col("c_end"))).drop("c_start", "c_end")
    own = covering_labels(placed, entities, doc)
    main = own.where("idx = 0").select(*doc, "chain", "chunk_id", F.col("label").alias("main_label"))
    own = own.join(main, [*doc, "chain", "chunk_id"], "left").withColumn("label", F.coalesce("label", "main_label"))
    kept = first_mentions(own, doc, ["chain", "idx"])
    named = coref_labels(kept, [*doc, "chain"], ["chunk_id", "idx"], default=default)
    columns = [*doc, "text", "label", "start", "end"]
    named = named.select(*doc, "text", F.col("chain_label").alias("label"), "start", "end")
    plain = first_mentions(entities.select(*columns), doc, ["label", "text"])
    return named.unionByName(plain.join(named.select(*doc, "start", "end"), [*doc, "start", "end"], "left_anti").select(*columns))
