"""Operator 2: document fingerprints as invertible Bloom lookup sketches, by SQL functions alone.

A text's paragraphs, cut at sentence ends where they are long, are hashed to digests. Each digest falls into one cell of each of
three bands; a cell holds a count and the exclusive-ors of its digests and of their checks. Sketches of two versions subtract
cell by cell, and peeling recovers the digests that only one has. If peeling gets stuck, both texts' digests are dealt to
tables of about a dozen, each a sketch as large as the first; a table that gets stuck is dealt to four, and these to four
once more. What is stuck even then, a few digests, is compared as sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

#: Paragraphs are lines; longer ones are cut after a sentence of 40 characters or more, and after 160 in any case.
PARAGRAPH = r"[^\n]{40,160}?[.!?](?=\s|\z)|[^\n]{1,160}"
#: Three bands of so many cells. A digest's cell in a band is the top four bits of the digest rotated by the band's bits.
BAND = 16
ROTATIONS = (4, 8, 12)
ROUNDS = 20
#: How digests are dealt on a retry: about so many in each part, by the bits from here on. Parts of parts keep the work of a
#: text in proportion to its length.
DEALT = ((768, 16), (96, 26), (24, 36))
#: Further retries of a stuck table: four times as many tables, by the bits from here on.
AGAIN = (44, 50)
#: Levels of recovered digests: 0 the first sketch, 1 tables, 2 and 3 further retries, and the comparison of sets.
SETS = 2 + len(AGAIN)


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def digests(text: str) -> str:
    """Distinct paragraph digests of a text."""
    return f"transform(array_distinct(regexp_extract_all({text}, {_sql(PARAGRAPH)}, 0)), p -> xxhash64(p))"


CELL = "struct<j:int,c:int,k:bigint,x:int>"


def _runs(signed: str, band: int) -> str:
    """The cells of one band that hold something, of digests ``d`` that count as ``s``: digests are sorted by cell, and each run
    of a cell's digests is folded once."""
    r = ROTATIONS[band]
    rotated = f"sort_array(transform({signed}, e -> named_struct('r', shiftrightunsigned(e.d, {r}) | shiftleft(e.d, {64 - r}), 's', e.s)))"
    cell = f"{BAND * band} + cast(shiftrightunsigned(e.r, 60) as int)"
    done = "if(a.z.j < 0, a.out, concat(a.out, array(a.z)))"
    more = "named_struct('z', named_struct('j', a.z.j, 'c', a.z.c + e.s, 'k', a.z.k ^ e.r, 'x', a.z.x ^ hash(e.r)), 'out', a.out)"
    new = f"named_struct('z', named_struct('j', {cell}, 'c', e.s, 'k', e.r, 'x', hash(e.r)), 'out', {done})"
    start = f"named_struct('z', named_struct('j', -1, 'c', 0, 'k', 0L, 'x', 0), 'out', cast(array() as array<{CELL}>))"
    return f"aggregate({rotated}, {start}, (a, e) -> if(a.z.j = {cell}, {more}, {new}), a -> {done})"


def _signed(ds: str, sign: int) -> str:
    return f"transform({ds}, d -> named_struct('d', d, 's', {sign}))"


def cells(ds: str) -> str:
    """The sketch of an array of digests: count, rotated digests and checks of each cell, band by band."""
    runs = ", ".join(_runs(_signed(ds, 1), band) for band in range(len(ROTATIONS)))
    by_cell = f"map_from_entries(transform(concat({runs}), z -> named_struct('j', z.j, 'z', named_struct('c', z.c, 'k', z.k, 'x', z.x))))"
    return _let(by_cell, "m", f"transform(sequence(0, {BAND * len(ROTATIONS) - 1}), j -> coalesce(m[j], named_struct('c', 0, 'k', 0L, 'x', 0)))")


def difference_of(a: str, b: str) -> str:
    """The cells in which the sketches of two sets of digests would differ: the second set's are taken away as they fall."""
    signed = f"concat({_signed(a, 1)}, {_signed(b, -1)})"
    runs = ", ".join(_runs("v", band) for band in range(len(ROTATIONS)))
    return f"filter({_let(signed, 'v', f'concat({runs})')}, z -> z.c <> 0 OR z.k <> 0L)"


def subtract(a: str, b: str) -> str:
    """The cells in which two sketches differ, with their number ``j``."""
    return f"filter(transform(zip_with({a}, {b}, (a, b) -> named_struct('c', a.c - b.c, 'k', a.k ^ b.k, 'x', a.x ^ b.x)), (z, j) -> named_struct('j', j, 'c', z.c, 'k', z.k, 'x', z.x)), z -> z.c <> 0 OR z.k <> 0L)"


def _turned(d: str, band: str, back: bool) -> str:
    """A digest as it stands in a band's cells, or back."""
    left, right = ("shiftleft", "shiftrightunsigned") if back else ("shiftrightunsigned", "shiftleft")
    by = f"(({band} + 1) * 4)"
    return f"({left}({d}, {by}) | {right}({d}, 64 - {by}))"


RECOVERED = "array<struct<k:bigint,c:int,l:int>>"


def peel(difference: str, level: int = 0) -> str:
    """The recovered digests (k, c: 1 of the first text, -1 of the second, l: the level); null if peeling gets stuck."""
    band = "cast(shiftright(z.j, 4) as int)"
    pure = f"array_distinct(transform(filter(s.t, z -> abs(z.c) = 1 AND hash(z.k) = z.x), z -> named_struct('k', {_turned('z.k', band, True)}, 'c', z.c)))"
    places = ", ".join(f"{BAND * k} + cast(shiftright(y.k, {4 * k}) & 15L as int)" for k in range(len(ROTATIONS)))
    placed = f"transform({pure}, y -> named_struct('k', y.k, 'c', y.c, 'js', array({places})))"
    own = _turned("e.k", "cast(shiftright(a.j, 4) as int)", False)
    step = _let(own, "r", "named_struct('j', a.j, 'c', a.c - e.c, 'k', a.k ^ r, 'x', a.x ^ hash(r))")
    taken = f"filter(transform(s.t, z -> aggregate(filter(f, e -> array_contains(e.js, z.j)), z, (a, e) -> {step})), z -> z.c <> 0 OR z.k <> 0L)"
    got = f"transform(f, e -> named_struct('k', e.k, 'c', e.c, 'l', {level}))"
    round_ = _let(placed, "f", f"named_struct('t', if(size(f) = 0, s.t, {taken}), 'p', concat(s.p, {got}), 'go', size(f) > 0)")
    start = f"named_struct('t', {difference}, 'p', cast(array() as {RECOVERED}), 'go', true)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> if(s.go AND size(s.t) > 0, {round_}, s), s -> if(size(s.t) > 0, null, s.p))"


def _dealt(a: str, b: str, parts: str, shift: int, body, name: str) -> str:
    """``body`` of each part of two sets of digests, end to end."""
    own = lambda ds: f"filter({name}.{ds}, d -> pmod(shiftright(d, {shift}), {name}.n) = {name}g)"
    part = _let(f"named_struct('a', {own('a')}, 'b', {own('b')})", f"{name}p", body(f"{name}p.a", f"{name}p.b"))
    every = f"flatten(transform(sequence(0, {name}.n - 1), {name}g -> {part}))"
    return _let(f"named_struct('a', {a}, 'b', {b}, 'n', {parts})", name, every)


def _solved(a: str, b: str, level: int = 1) -> str:
    """Recovered digests of a small table, dealt to four again if it gets stuck."""
    if level == SETS:
        side = lambda x, y, c: f"transform(array_except({x}, {y}), k -> named_struct('k', k, 'c', {c}, 'l', {SETS}))"
        return f"concat({side(a, b, 1)}, {side(b, a, -1)})"
    larger = _dealt(a, b, "4", AGAIN[level - 1], lambda x, y: _solved(x, y, level + 1), f"q{level}") if level <= len(AGAIN) else _solved(a, b, SETS)
    return f"coalesce({peel(difference_of(a, b), level)}, {larger})"


def retried(a: str, b: str, depth: int = 0) -> str:
    """Recovered digests of two sets, dealt to parts, parts of parts and tables."""
    if depth == len(DEALT):
        return _solved(a, b)
    each, shift = DEALT[depth]
    parts = f"greatest(1, cast(ceil((size({a}) + size({b})) / {each}) as int))"
    return _dealt(a, b, parts, shift, lambda x, y: retried(x, y, depth + 1), f"d{depth}")


def differing(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """The digests that only one of two texts has, as peeling recovers them from their sketches, or from larger ones."""
    return f"coalesce({peel(subtract(cells_a, cells_b))}, {retried(a, b)})"


def likeness(a: str, b: str, found: str) -> str:
    """Shared digests, twice, over all digests of both; 1 where neither text has any."""
    return f"if(size({a}) + size({b}) = 0, 1D, 2D * (size({a}) - size(filter({found}, e -> e.c = 1))) / (size({a}) + size({b})))"


def printed(ds: str, sketch: str) -> str:
    """A sketch as a string: how many digests, then hexadecimal cells."""
    cell = "concat(hex(z.c), '.', hex(z.k), '.', lpad(right(hex(z.x), 8), 8, '0'))"
    return f"concat(size({ds}), ':', array_join(transform({sketch}, z -> if(z.c = 0, '', {cell})), ','))"


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Each row with ``next_``-columns of the next row by (id, tie); after the last comes the first.

    Rows are dealt to buckets between quantiles of the id, each beginning with an id that exists, so one shuffle brings
    neighbours together; the first row of a bucket is also sent to the end of the bucket before. Null ids come first.
    """
    spark = rows.sparkSession
    n = 4 * C.partitions(spark)
    got = rows.agg(F.min("id").alias("low"), F.percentile_approx("id", [k / n for k in range(n)], 100 * n).alias("cuts"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls")).first()
    cuts = sorted({got["low"], *(got["cuts"] or [])} - {None})
    starts = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    bucket = F.coalesce(F.size(F.filter(starts, lambda c: c <= F.col("id"))), F.lit(0))
    place = lambda at, late: F.struct(at.cast("int").alias("at"), F.lit(late).alias("late"))
    first = F.col("id").isNull() if got["nulls"] or not cuts else F.col("id") == cuts[0]
    places = F.array(place(bucket, 0), F.when(F.array_contains(starts, F.col("id")), place(bucket - 1, 1)), F.when(first, place(F.lit(len(cuts)), 2)))
    dealt = rows.withColumn("place", F.explode(F.filter(places, lambda x: x.isNotNull())))
    order = Window.partitionBy("place.at").orderBy("place.late", F.col("id").asc_nulls_first(), "tie")
    return dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried)).where("place.late = 0")


def differences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text, its edited text and the next row's, with digests, sketches and the digests recovered from them:
    id, text, edited, own, new, next_own, own_cells, new_cells, from_edited and from_next (k, c, l: see ``peel``).

    Null texts are empty. Rows with equal ids are ordered by a hash of their text; repeated rows are kept and next to
    each other. A lone row is its own next one. A text without paragraphs has no digests and is like another such text.
    """
    rows = C.ids_and_texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text")).select(F.col("id").cast("long").alias("id"), "text", "tie")
    rows = rows.withColumn("own", F.expr(digests("text"))).withColumn("own_cells", F.expr(cells("own")))
    near = with_next(rows, ["text", "own", "own_cells"])
    n = F.char_length("text")
    near = near.withColumn("quarter", F.floor(n / 4).cast("int"))
    near = near.withColumn("edited", F.concat(F.expr("left(text, char_length(text) - quarter)"), F.expr("left(next_text, quarter)")))
    near = near.withColumn("new", F.expr(digests("edited"))).withColumn("new_cells", F.expr(cells("new")))
    near = near.withColumn("from_edited", F.expr(differing("own", "new", "own_cells", "new_cells")))
    near = near.withColumn("from_next", F.expr(differing("own", "next_own", "own_cells", "next_own_cells")))
    return near.select("id", "text", "edited", "own", "new", "next_own", "own_cells", "new_cells", "from_edited", "from_next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row, and the level
    (see ``SETS``) that recovering the differences took. Rows are as in ``differences``."""
    named: dict[str, Column] = {
        "doc_id": F.col("id"),
        "n_chars": F.char_length("text").cast("long"),
        "edited_sha256": F.sha2("edited", 256),
        "fingerprint": F.expr(printed("own", "own_cells")),
        "edited_fingerprint": F.expr(printed("new", "new_cells")),
        "near_edited": F.expr(likeness("own", "new", "from_edited")),
        "near_next": F.expr(likeness("own", "next_own", "from_next")),
        "edited_level": F.expr("coalesce(array_max(transform(from_edited, e -> e.l)), 0)"),
        "next_level": F.expr("coalesce(array_max(transform(from_next, e -> e.l)), 0)"),
    }
    return differences(docs, id_col, text_col).select(*(c.alias(k) for k, c in named.items()))
