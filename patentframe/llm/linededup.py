"""Operator 4: removal of repeated line runs by a suffix array over line ids.

1. Prefix doubling ranks the suffixes of all documents' line sequences by their first 1, 2, 4, ... lines: a rank is how many
   suffixes sort before. Suffixes that share no further prefix with another drop out on the way.
2. The suffix array holds the suffixes whose shortest prefix of ``min_words`` words occurs again as far as the ranks of the two
   windows that cover it tell. It is sorted by these ranks and the ranks of the lines that follow, in range partitions.
3. Longest common prefixes of neighbours give the intervals of the array. An interval of m lines is a run that repeats, right-maximal;
   its first suffix in document order keeps its lines. Every other suffix takes the longest of its intervals' runs that begins
   earlier: the maximal run at its place. Intervals that cross partitions are completed from what neighbours share with a
   partition's first and last suffix: at most ``min_words`` numbers for each, folded on the driver.

A run counts from ``min_words`` words. Lines that follow are known as far as the next suffix's own shortest prefix reaches, as what is
beyond belongs to that suffix's run as well; so whole maximal runs go, of whatever length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

KEY = ["id", "hash"]
#: White space is these six characters, for words, blank lines and the ends of lines.
SPACES = " \t\n\x0b\f\r"
#: Suffixes a range partition of the array holds, about.
PART_ROWS = 400_000


def _trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash (of the text), pos among non-blank lines, line (MD5 of the trimmed line), words."""
    rows = C.ids_and_texts(docs, id_col, text_col)
    lines = F.filter(F.transform(F.split("text", "\n"), _trimmed), lambda x: x != "")
    rows = rows.select("id", F.xxhash64("text").alias("hash"), F.posexplode(lines).alias("pos", "x"))
    return rows.select("id", "hash", "pos", F.unhex(F.md5("x")).alias("line"), F.size(F.split("x", r"\s+")).alias("words"))


def ranks(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Classes of equal suffix prefixes (keys, n) with ``rank``: the suffixes in all classes that sort before.

    A range-partitioned sort with a running sum; only a total for each partition passes through the driver.
    """
    spark = classes.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part), pa.int32()), pa.array(ends - n, pa.int64())], [*b.schema.names, "part", "local"])
            before = int(ends[-1]) if len(n) else before

    ordered = classes.select(*keys, "n").repartitionByRange(*keys).sortWithinPartitions(*keys)  # small ones in few files
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", part int, local long"
    local = C.stage_table(ordered.mapInArrow(run, schema), "ranks")
    totals, bases, before = {r["part"]: r["n"] for r in local.groupBy("part").agg(F.sum("n").alias("n")).collect()}, [], 0
    for part in sorted(totals):
        bases.append((part, before))
        before += totals[part]
    bases = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    return local.join(bases, "part").select(*keys, (F.col("base") + F.col("local")).alias("rank"))


def suffix_ranks(lines: DataFrame, depth: int) -> list[DataFrame]:
    """For 1, 2, 4, ... up to ``depth`` lines: id, hash, pos, rank of suffixes whose prefix of that length occurs again.

    The first table also has ``words``.
    """
    repeated = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1")
    first = lines.join(ranks(repeated, ["line"]), "line").dropDuplicates([*KEY, "pos"]).select(*KEY, "pos", "words", "rank")
    levels, h = [C.stage_table(first, "suffixes")], 1
    while 2 * h <= depth:
        ahead = F.first("rank").over(Window.partitionBy(*KEY).orderBy("pos").rangeBetween(h, h))
        pairs = C.stage_table(levels[-1].select(*KEY, "pos", "rank", ahead.alias("rank2")).where("rank2 is not null").withColumnRenamed("rank", "rank1"), "pairs")
        again = pairs.groupBy("rank1", "rank2").agg(F.count("*").alias("n")).where("n > 1")
        levels.append(C.stage_table(pairs.join(ranks(again, ["rank1", "rank2"]), ["rank1", "rank2"]).select(*KEY, "pos", "rank"), "suffixes"))
        h *= 2
        if levels[-1].isEmpty():
            break
    return levels


SUFFIX = "id long, hash long, pos int, m int, a long, b long, tail binary"


def prefixes(begins: np.ndarray, words: np.ndarray, level_ranks: list[np.ndarray], min_words: int) -> tuple[np.ndarray, ...]:
    """Of repeated lines in order, which suffixes have a shortest prefix of ``min_words`` words that may occur again, with its
    length and the ranks of the two windows that cover it, and from where to where the lines go that follow it.

    ``begins`` says whether a line doesn't follow the one before it in its document. ``level_ranks`` are -1 where there is none.
    """
    n = len(words)
    ends = np.cumsum(words)
    starts = np.flatnonzero(begins)
    island_end = np.append(starts[1:], n)[np.cumsum(begins) - 1]
    last = np.searchsorted(ends, ends - words + min_words)  # the line that completes the prefix
    whole = np.flatnonzero(last < island_end)
    m = last[whole] - whole + 1
    level = np.int64(np.floor(np.log2(m)))
    fits = level < len(level_ranks)
    whole, m, level = whole[fits], m[fits], level[fits]
    table = np.stack(level_ranks) if level_ranks else np.zeros((1, n), np.int64)
    a, b = table[level, whole], table[level, whole + m - (1 << level)]
    some = (a >= 0) & (b >= 0)
    whole, m, a, b = whole[some], m[some], a[some], b[some]
    beyond = np.minimum(last[np.minimum(whole + 1, n - 1)] + 1, island_end[whole])
    return whole, m, a, b, whole + m, np.maximum(beyond, whole + m)


def suffixes(levels: list[DataFrame], min_words: int) -> DataFrame:
    """Rows of the suffix array, unsorted. ``tail``: the ranks of the lines after the shortest prefix, eight bytes each."""
    n_levels = len(levels)
    parts = [df.select(F.col("id").cast("long").alias("id"), "hash", "pos", F.lit(k).alias("level"), "rank", F.col("words") if not k else F.lit(0).alias("words")) for k, df in enumerate(levels)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    dealt = every.repartition(C.partitions(every.sparkSession), *KEY).sortWithinPartitions("id", "hash", "pos", "level")

    def of(b: pa.Table) -> pa.RecordBatch:
        hash_, pos, level, rank, words = (b.column(k).to_numpy() for k in ("hash", "pos", "level", "rank", "words"))
        missing = b.column("id").is_null().to_numpy()
        ids = b.column("id").fill_null(0).to_numpy()
        at = np.flatnonzero(level == 0)
        line = np.cumsum(level == 0) - 1  # a suffix that occurs again has a first line that does, right before it here
        table = np.full((n_levels, len(at)), -1, np.int64)
        table[level, line] = rank
        own = [x[at] for x in (ids, missing, hash_, pos)]
        begins = np.ones(len(at), bool)
        begins[1:] = (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1]) | (own[2][1:] != own[2][:-1]) | (own[3][1:] != own[3][:-1] + 1)
        i, m, x, y, low, high = prefixes(begins, words[at].astype(np.int64), list(table), min_words)
        sizes = high - low
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        lines = table[0][np.repeat(low - offsets[:-1], sizes) + np.arange(offsets[-1])].astype(">i8").tobytes()
        tail = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer((8 * offsets).astype(np.int32)), pa.py_buffer(lines)])
        ids_ = pa.array(own[0][i], pa.int64(), mask=own[1][i])
        cols = [ids_, pa.array(own[2][i]), pa.array(own[3][i].astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(x), pa.array(y), tail]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SUFFIX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if held and size >= 100_000:  # whole documents: cut where the last one so far begins
                t = pa.Table.from_batches([*held, b]).combine_chunks()
                h, i = t.column("hash").to_numpy(), t.column("id").fill_null(-1).to_numpy()
                other = np.flatnonzero((h != h[-1]) | (i != i[-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield of(t.slice(0, cut).combine_chunks())
                held, size = t.slice(cut).to_batches(), t.num_rows - cut
                continue
            held.append(b)
            size += b.num_rows
        if size:
            yield of(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, SUFFIX)


#: A suffix's place in document order: whether it has an id, the id, the text's hash, the line.
Place = tuple[bool, int, int, int]


def common(a: bytes, b: bytes) -> int:
    """How many lines of two tails are the same from the beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 8
    x, y = np.frombuffer(a, ">i8", n // 8), np.frombuffer(b, ">i8", n // 8)
    return int((x != y).argmax())


def longest_earlier(rows: list[tuple[tuple, bytes, Place]]) -> list[int]:
    """For each row of a sorted piece of the array (prefix, tail, place): the lines of the longest run that begins at it and,
    without overlap, at an earlier place of the piece; 0 if there is none.

    Neighbours' longest common prefixes open and close intervals, kept on a stack; an interval knows its first place and the one
    around it once it closes. Rows then go from their innermost interval outward.
    """
    depth: list[int] = []  # of each interval: lines beyond the prefix, first place, interval around it
    first: list[Place] = []
    around: list[int] = []
    stack: list[int] = []
    leaf: list[int] = []

    def open_(lines: int, place: Place) -> None:
        stack.append(len(depth))
        depth.append(lines)
        first.append(place)
        around.append(-1)

    def close(shared: int) -> None:
        """Close all intervals of more lines than neighbours share; -1 closes all."""
        while stack and depth[stack[-1]] > shared:
            top = stack.pop()
            if shared >= 0 and (not stack or depth[stack[-1]] < shared):
                open_(shared, first[top])
            if stack:
                around[top] = stack[-1]
                first[stack[-1]] = min(first[stack[-1]], first[top])

    last_key, last_tail = None, b""
    for key, tail, place in rows:
        close(common(last_tail, tail) if key == last_key else -1)
        if not stack or depth[stack[-1]] < len(tail) // 8:
            open_(len(tail) // 8, place)
        else:
            first[stack[-1]] = min(first[stack[-1]], place)
        leaf.append(stack[-1])
        last_key, last_tail = key, tail
    close(-1)

    out = []
    for (key, _, place), node in zip(rows, leaf):
        best = 0
        while node >= 0 and key[0] + depth[node] > best:
            lines, f = key[0] + depth[node], first[node]
            if f[:3] == place[:3]:
                lines = min(lines, place[3] - f[3])  # 0 for the first itself
            best, node = max(best, lines), around[node]
        out.append(best if best >= key[0] else 0)
    return out


def shared_with(end: tuple[tuple, bytes, Place], rows: list[tuple[tuple, bytes, Place]]) -> list[Place]:
    """For 0, 1, ... lines of the tail of ``end``: the first place among the ``rows``, sorted away from it, that share so much."""
    out: list[Place] = []
    for key, tail, place in rows:
        n = common(end[1], tail) if key == end[0] else -1
        if n < 0:
            break
        out = out or [place] * (n + 1)  # of the end itself
        for k in range(n + 1):
            out[k] = min(out[k], place)
    return out


def outside(summaries: list[dict]) -> list[tuple[list[tuple], list[tuple]]]:
    """For each partition in order, rows that stand for all suffixes before it and after it, as far as they share something."""

    def fold(near: str, far: str) -> list[list[tuple]]:
        found, key, tail, mins = [], None, b"", []
        for s in summaries if near == "first" else reversed(summaries):
            (k, t), (k2, t2) = s[near], s[far]
            shared = common(t, tail) if k == key else -1
            found.append([(k, t[: 8 * q], mins[q]) for q in range(min(shared + 1, len(mins)))])
            same = common(t2, tail) if k2 == key else -1
            own = s[f"{far}_mins"]
            mins = [min(own[q], mins[q]) if q <= same and q < len(mins) else own[q] for q in range(len(own))]
            key, tail = k2, t2
        return found

    before, after = fold("first", "last"), fold("last", "first")[::-1]
    return [(b, a[::-1]) for b, a in zip(before, after)]


COPY = "id long, hash long, pos int, n int"


def later_runs(found: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """id, hash, pos, n: from where each suffix that repeats an earlier run does so, and for how many lines."""
    import pickle

    spark, out_dir = found.sparkSession, C.new_dir(found.sparkSession, "suffix-array")
    parts = max(C.partitions(spark), -(-found.count() // part_rows))
    order = ["m", "a", "b", "tail", "id", "hash", "pos"]
    ordered = found.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def rows_of(t: pa.Table) -> list[tuple[tuple, bytes, Place]]:
        cols = {c: t.column(c).to_pylist() for c in order}
        places = [(i is not None, i or 0, h, p) for i, h, p in zip(cols["id"], cols["hash"], cols["pos"])]
        return list(zip(zip(cols["m"], cols["a"], cols["b"]), cols["tail"], places))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t, part = pa.Table.from_batches(got), TaskContext.get().partitionId()
        path, sink = f"{out_dir}/part-{part:06d}.arrow", pa.BufferOutputStream()
        with pa.ipc.new_file(sink, t.schema) as f:
            f.write_table(t)
        C.write_file(path, sink.getvalue().to_pybytes())
        rows = rows_of(t)
        ends = {k: (r[0], r[1]) for k, r in (("first", rows[0]), ("last", rows[-1]))}
        mins = {"first_mins": shared_with(rows[0], rows), "last_mins": shared_with(rows[-1], rows[::-1])}
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "ends": [pickle.dumps(ends | mins)]})

    table = C.stage_table(ordered.mapInArrow(write, "part int, path string, ends binary"), "suffix-array-list")
    listed = sorted(table.collect())  # a row for each partition, of at most min_words numbers
    near = outside([pickle.loads(r["ends"]) for r in listed])
    jobs = spark.createDataFrame([(r["path"], pickle.dumps(x)) for r, x in zip(listed, near)], "path string, near binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = pa.ipc.open_file(pa.BufferReader(C.read_file(path))).read_all()
                before, after = pickle.loads(more)
                rows = rows_of(t)
                n = np.array(longest_earlier([*before, *rows, *after])[len(before) : len(before) + len(rows)], np.int32)
                t = t.append_column("n", pa.array(n)).filter(pa.array(n > 0)).select(["id", "hash", "pos", "n"])
                yield from t.to_batches()

    return jobs.repartition(max(1, len(listed))).mapInArrow(run, COPY)


def later_copies(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash, runs: of each text, the runs (pos among its non-blank lines, n lines) that repeat earlier ones, by (id, hash, pos).

    Null ids come first. A run that overlaps its own first occurrence isn't a copy. Repeated rows (id and text) are one
    document and don't count as copies of each other. An empty table, or one without repeated lines, gives none.
    """
    return copies_of(lines_of(docs, id_col, text_col), min_words)


def copies_of(lines: DataFrame, min_words: int) -> DataFrame:
    """id, hash, runs as ``later_copies`` says, of rows in the columns of ``lines_of``."""
    found = C.stage_table(suffixes(suffix_ranks(lines, min_words), min_words), "suffix-rows")
    return later_runs(found).groupBy(*KEY).agg(F.collect_list(F.struct("pos", "n")).alias("runs"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, runs: Column) -> Column:
    """The text without the runs' lines, and those lines' numbers in the text."""

    def with_solid(v: Column) -> Column:
        numbers = F.transform(v["lines"], lambda x, k: F.when(_trimmed(x) != "", k))
        return F.struct(v["lines"].alias("lines"), F.array_compact(numbers).alias("solid"))

    def with_gone(v: Column) -> Column:
        each = F.transform(runs, lambda r: F.sequence(v["solid"][r["pos"]], v["solid"][r["pos"] + r["n"] - 1]))
        return F.struct(v["lines"].alias("lines"), F.array_sort(F.array_distinct(F.flatten(each))).alias("gone"))

    def cut(v: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(v["lines"]) - 1), v["gone"])
        return F.struct(F.array_join(F.transform(kept, lambda k: v["lines"][k]), "\n").alias("text"), v["gone"].alias("gone"))

    return _let(_let(_let(F.struct(F.split(text, "\n").alias("lines")), with_solid), with_gone), cut)


def met(docs: DataFrame, copies: DataFrame, without: Callable[[Column, Column], Column], id_col: str, text_col: str) -> DataFrame:
    """row, changed, new: each row with its ``copies``, and for those that have some what ``without`` makes of text and runs."""
    copies = copies.select(F.col("id").alias("id2"), F.col("hash").alias("hash2"), "runs")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("hash"))
    rows = rows.join(copies, F.col(f"row.{id_col}").cast("long").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2")), "left")
    changed = F.col("runs").isNotNull()
    rows = rows.select("row", changed.alias("changed"), F.when(changed, without(F.col(f"row.{text_col}"), F.col("runs"))).alias("new"))
    return rows


def left(docs: DataFrame, rows: DataFrame, text_col: str, count_col: str) -> DataFrame:
    """``docs`` with the new texts of ``met``, counted anew, without those that are blank since."""
    kept = F.when(F.col("changed"), F.col("new")).otherwise(F.col(f"row.{text_col}"))
    rows = rows.select("row", "changed", kept.alias("kept")).where(~F.col("changed") | (_trimmed(F.col("kept")) != ""))
    row = F.col("row").withField(text_col, F.col("kept"))
    if count_col in docs.columns:
        row = row.withField(count_col, F.when(F.col("changed"), F.char_length("kept")).otherwise(F.col(f"row.{count_col}")).cast(docs.schema[count_col].dataType))
    return rows.select(row.alias("row")).select("row.*")


def remove_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, joined by commas) and the text that is left, of every row.

    Lines end at a line feed; white space around them doesn't count, and words are what stands between white space. Null texts
    have no lines and stay null; blank lines are no part of a run, but go with one that encloses them. Repeated rows are treated
    alike, an empty table gives no rows.
    """
    rows = met(docs, later_copies(docs, min_words, id_col, text_col), _without, id_col, text_col)
    return rows.select(
        F.col(f"row.{id_col}").alias("doc_id"),
        F.coalesce(F.size(F.split(F.col(f"row.{text_col}"), "\n")), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("new.gone"), F.lit(0)).alias("n_removed"),
        F.coalesce(F.array_join("new.gone", ","), F.lit("")).alias("removed"),
        F.when(F.col("changed"), F.col("new.text")).otherwise(F.col(f"row.{text_col}")).alias("text"),
    )


def drop_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The rows without later copies of runs, ``count_col`` counted anew; a document of which nothing is left goes.

    Other columns stay as they are, whatever their names; null texts, null ids and repeated rows are as in ``remove_runs``, and an
    empty table gives no rows.
    """
    rows = met(docs, later_copies(docs, min_words, id_col, text_col), _without, id_col, text_col)
    return left(docs, rows.withColumn("new", F.col("new.text")), text_col, count_col)
