"""Text to chunks: claims, boundary-aware chunks, the recursive splitter, positions."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import claim_number, trim_space

MARKER = r"(\d+\.\s)"
SEPARATORS = ("\n\n", "\n", " ", "")


def split_claims(text: Column, on: bool = True, compat: bool = False) -> Column:
    """Claims by their numbers; text before the first is a chunk of its own; without a number the whole text as it is.

    ``compat`` pairs pieces from the beginning, so that after such text numbers end up behind their predecessors.
    """
    if not on:
        return F.array(text)
    found = F.regexp_like(text, F.lit(MARKER))
    if compat:
        pieces, marks = F.split(text, MARKER), F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
        first = F.when(F.get(pieces, F.lit(0)) == "", 1).otherwise(0)
        # without text before it each number goes with what follows, otherwise with what precedes
        after = F.transform(marks, lambda m, k: F.concat(m, F.get(pieces, k + 1)))
        before = F.transform(pieces, lambda p, k: F.concat(p, F.coalesce(F.get(marks, k), F.lit(""))))
        parts = F.when(first == 1, after).otherwise(before)
    else:
        parts = F.split(text, rf"(?={MARKER})(?<!\d)")  # before the first digit of a number
    parts = F.filter(F.transform(parts, trim_space), lambda x: x != "")
    return F.when(found, parts).otherwise(F.array(text))


def boundary_chunks(text: Column, size: int = 100_000, window: int = 200, line_break: str = "\n\n", contiguous: bool = False) -> Column:
    """(start, end, text) from 0, size, 2 size, ...; a chunk but the last ends after the last sentence end or
    ``line_break`` in its last ``window`` characters. Text between an early end and the next start is left out unless
    ``contiguous``, where a chunk begins at the end of the one before.
    """
    if size <= window:
        raise ValueError("size must be above window")
    n = F.char_length(text)

    def end_of(start: Column) -> Column:
        full = F.least(start + size, n)
        tail = F.substring(text, full - window + 1, F.lit(window))
        kept = F.length(F.regexp_extract(tail, f"(?s)^(.*)(?:[.?!]|{line_break})", 1))
        hit = F.regexp_like(tail, F.lit(f"(?s)[.?!]|{line_break}"))
        return F.when((full < n) & hit, full - window + kept + 1).otherwise(full)

    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array(F.lit(0)))
    chunks = F.transform(starts, lambda s: F.struct(s.alias("start"), end_of(s).alias("end")))
    if contiguous:
        chunks = F.transform(chunks, lambda c, k: F.struct(F.when(k == 0, F.lit(0)).otherwise(F.get(chunks, k - 1)["end"]).alias("start"), c["end"].alias("end")))
    return F.transform(chunks, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.substring(text, c["start"] + 1, c["end"] - c["start"]).alias("text")))


def split_recursive(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the first separator that occurs, pieces still too long at the next
    ones; neighbouring chunks share up to ``overlap`` characters."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :]
    out: list[str] = []
    held: deque[str] = deque()
    total = 0  # characters of what is held, joined

    def flush() -> None:
        if chunk := sep.join(held).strip():
            out.append(chunk)

    for piece in text.split(sep) if sep else text:
        if len(piece) > size and rest:
            flush()
            held.clear()
            total = 0
            out += split_recursive(piece, size, overlap, rest)
            continue
        if held and total + len(sep) + len(piece) > size:
            flush()
            while held and (total > overlap or total + len(sep) + len(piece) > size):
                total -= len(held.popleft()) + (len(sep) if held else 0)
        total += len(piece) + (len(sep) if held else 0)
        held.append(piece)
    flush()
    return out


#: A splitter gives the pieces of a text, for a size and an overlap.
Splitter = Callable[[str, int, int], list[str]]

SENTENCE = re.compile(r"[^.!?]*[.!?]+[\"')\]]*\s*|[^.!?]+$")


def split_sentences(text: str, size: int = 1000, overlap: int = 200) -> list[str]:
    """Sentences by their marks, packed as long as they fit; a longer one is a chunk of its own. Sentences at the end of a
    chunk of up to ``overlap`` characters begin the next one."""
    out: list[str] = []
    held: deque[str] = deque()
    total = 0
    for sentence in SENTENCE.findall(text):
        if held and total + len(sentence) > size:
            out.append("".join(held))
            while held and (total > overlap or total + len(sentence) > size):
                total -= len(held.popleft())
        held.append(sentence)
        total += len(sentence)
    out.append("".join(held))
    return [x for x in map(str.strip, out) if x]


def _model_splitter(name: str, package: str, load: Callable[[], Callable[[str], list[str]]]) -> Splitter:
    """A splitter that packs a model's sentences; without its package, an error that says so."""
    def split(text: str, size: int, overlap: int) -> list[str]:
        try:
            sentences = load()
        except (ImportError, OSError, LookupError) as e:
            raise ValueError(f"splitter {name!r} needs the package {package!r} and its model here: {e}") from e
        return split_recursive("\n".join(sentences(text)), size, overlap, ("\n", " ", ""))

    return split


def _spacy() -> Callable[[str], list[str]]:
    import spacy

    nlp = spacy.load("en_core_web_sm")
    return lambda text: [s.text for s in nlp(text).sents]


def _nltk() -> Callable[[str], list[str]]:
    import nltk

    return nltk.tokenize.sent_tokenize


def _sentence_transformers() -> Callable[[str], list[str]]:
    from sentence_transformers import SentenceTransformer

    tokenizer = SentenceTransformer("all-mpnet-base-v2").tokenizer
    return lambda text: tokenizer.convert_ids_to_tokens(tokenizer(text)["input_ids"])


#: Back ends of the splitter by name; more can be registered by their function.
SPLITTERS: dict[str, Splitter] = {
    "recursive": split_recursive,
    "sentences": split_sentences,
    "spacy": _model_splitter("spacy", "spacy", _spacy),
    "nltk": _model_splitter("nltk", "nltk", _nltk),
    "sentence_transformers": _model_splitter("sentence_transformers", "sentence-transformers", _sentence_transformers),
}


def splitter_named(name: str) -> Splitter:
    if name not in SPLITTERS:
        raise ValueError(f"unknown splitter {name!r}; there are {', '.join(SPLITTERS)}")
    return SPLITTERS[name]


def split_texts(df: DataFrame, text_col: str, splitter: str = "recursive", size: int = 1000, overlap: int = 200) -> DataFrame:
    """The rows with ``chunks``, the splitter's pieces of each text; null texts have none."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    split, at = splitter_named(splitter), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks = pa.array([split(t.as_py() or "", size, overlap) for t in b.column(at)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, chunks], [*b.schema.names, "chunks"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("chunks", ArrayType(StringType()))]))


def sections(df: DataFrame, keep: list[str], named: dict[str, Column]) -> DataFrame:
    """A row for each section that has text: ``keep``, section, text."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("section"), c.alias("text")) for k, c in named.items())))
    return df.select(*keep, rows.alias("s")).select(*keep, "s.*").where("text is not null and text <> ''")


def decode_sections(page_content: Column) -> Column:
    """Page content as a map of sections; text that is no JSON object is one section without a name."""
    found = F.from_json(page_content, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.when(F.size(found) > 0, found).otherwise(F.create_map(F.lit(""), page_content))


def positions(df: DataFrame, keep: list[str], chunks: Column) -> DataFrame:
    """A row for each chunk: ``keep``, chunk_index from 0 within the section, total_chunks, chunk."""
    return df.withColumn("all_chunks", chunks).select(*keep, F.size("all_chunks").alias("total_chunks"), F.posexplode("all_chunks").alias("chunk_index", "chunk"))


def chunk_documents(docs: DataFrame, keep: list[str], claims: bool = True, size: int = 1000, overlap: int = 200, splitter: str = "recursive") -> DataFrame:
    """Chunks of documents with page_content: claims are split by number, whatever the case of their section's name, other
    sections by the splitter of that name."""
    rows = docs.select(*keep, F.explode(decode_sections(F.col("page_content"))).alias("section", "text")).where("text is not null and text <> ''")
    is_claims = F.lower("section") == "claims"
    rows = split_texts(rows, "text", splitter, size, overlap)
    made = F.when(is_claims, split_claims(F.col("text"), claims)).otherwise(F.col("chunks"))
    out = positions(rows, [*keep, "section"], made)
    return out.withColumn("claim_number", F.when((F.lower("section") == "claims") & F.lit(claims), claim_number(F.col("chunk"))))
