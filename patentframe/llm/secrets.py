"""Operator 10: secret scans through a trigram inverted index, by SQL functions alone.

Every rule's regular expression gives a Boolean query over trigrams that each of its matches must hold. One pass over
the texts meets those trigrams and scans for rules without mandatory ones. The index is a folder of postings for each
trigram: sorted document keys, in as many files as its length asks for. A query is a union of intersections: the rarest
trigram's postings give candidates, the other postings are read for them. Candidates alone are verified by the
expressions themselves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Candidates of which at most so many are broadcast to the texts (16 bytes each); more are joined by shuffling.
BROADCAST_ROWS = 250_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` means the same in Java and Python; a match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are taken whole, so the bound may stand in the expression
    # to the END line of the same kind, if there is one before other dashes of that sort; headers of a key have a few single dashes
    Rule("pem", r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:(?:[^-]*-(?!----)){0,64}[^-]*-----END \1PRIVATE KEY-----)?", base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
)

#: A Boolean query: True (no mandatory trigram), a trigram, or ("and" | "or", queries).
Query = object


def _both(kind: str, parts: list) -> Query:
    parts = [p for p in parts if not (kind == "and" and p is True)]
    if kind == "or" and any(p is True for p in parts) or not parts:
        return True
    parts = list(dict.fromkeys(x for p in parts for x in (p[1] if isinstance(p, tuple) and p[0] == kind else [p])))
    if kind == "or":  # a part that asks for all that another one asks for, and more, adds nothing
        asks = [set(p[1]) if isinstance(p, tuple) and p[0] == "and" else {p} for p in parts]
        parts = [p for p, a in zip(parts, asks) if not any(b < a for b in asks)]
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    return _both("or", [_both("and", [s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str, most: int = 32) -> Query:
    """The query of an expression, in lower case.

    Parts in sequence are joined into sets of strings while there are at most ``most``; where a part matches without end
    or too many strings, the set so far gives its trigrams and a new one begins.
    """
    from re import _constants as c
    from re import _parser as parser

    def strings(op, value) -> set[str] | Query:
        """All strings of a part in lower case, or what every match of it must hold."""
        if op is c.LITERAL:
            return {chr(value).lower()}
        if op is c.SUBPATTERN:
            return of(value[3])
        if op is c.BRANCH:
            found = [of(x) for x in value[1]]
            if all(isinstance(x, set) for x in found):
                return set().union(*found)
            return _both("or", [_of_strings(x) if isinstance(x, set) else x for x in found])
        if op is c.IN:
            if any(kind not in (c.LITERAL, c.RANGE) for kind, _ in value):
                return True
            size = sum(1 if kind is c.LITERAL else x[1] - x[0] + 1 for kind, x in value)
            return True if size > most else {chr(k).lower() for kind, x in value for k in ([x] if kind is c.LITERAL else range(x[0], x[1] + 1))}
        if op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, inside = value
            own = of(inside)
            if (low, high) == (0, 1) and isinstance(own, set):
                return own | {""}
            if low == high and isinstance(own, set) and len(own) ** low <= most:
                return reduce(lambda x, _: {a + b for a in x for b in own}, range(low), {""})
            return True if low == 0 else _of_strings(own) if isinstance(own, set) else own
        return True

    def of(parsed) -> set[str] | Query:
        done: list = []
        exact = {""}
        for op, value in parsed:
            got = strings(op, value)
            if isinstance(got, set) and len(exact) * len(got) <= most:
                exact = {a + b for a in exact for b in got}
                continue
            done += [_of_strings(exact), _of_strings(got) if isinstance(got, set) else got]
            exact = {""}
        return _both("and", [*done, _of_strings(exact)]) if done else exact

    got = of(parser.parse(pattern))
    return _of_strings(got) if isinstance(got, set) else got


def trigrams(q: Query) -> set[str]:
    return {q} if isinstance(q, str) else set().union(*map(trigrams, q[1])) if isinstance(q, tuple) else set()


def conjunctions(q: Query, most: int = 64) -> list[frozenset[str]]:
    """The query as a union of intersections, of which none holds another; [] if nothing is mandatory.

    Where an ``and`` would multiply to over ``most``, its widest parts are left out: more candidates, no fewer matches.
    """
    if q is True:
        return []
    if isinstance(q, str):
        return [frozenset([q])]
    parts = sorted((conjunctions(x, most) for x in q[1]), key=len)
    if q[0] == "or":
        found = [c for p in parts for c in p]
    else:
        found = parts[0]
        for p in parts[1:]:
            if len(found) * len(p) <= most:
                found = [a | b for a in found for b in p]
    found = sorted(set(found), key=lambda c: (len(c), sorted(c)))
    return [c for k, c in enumerate(found) if not any(b < c for b in found[:k])]


def trigram_pattern(wanted: set[str], wide: int = 5) -> str:
    """A Java expression that meets every wanted trigram at every place, as group 1, without consuming anything.

    A tree over the characters; where one has more than ``wide`` branches, classes ahead of groups of them are tried first.
    """
    def one(c: str) -> str:
        return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"

    def of(chars) -> str:
        return f"[{''.join(map(one, chars))}]" if len(chars) > 1 else one(*chars)

    def tree(strings: list[str]) -> str:
        if len(strings[0]) == 1:
            return of(strings)
        by: dict[str, list[str]] = {}
        for x in strings:
            by.setdefault(x[0], []).append(x[1:])
        branches = [(c, one(c) + tree(rest)) for c, rest in by.items()]
        if len(branches) > wide:
            branches = [branches[k : k + wide] for k in range(0, len(branches), wide)]
            branches = [("", f"(?={of([c for c, _ in part])})(?:{'|'.join(x for _, x in part)})") for part in branches]
        return f"(?:{'|'.join(x for _, x in branches)})" if len(branches) > 1 else branches[0][1]

    return f"(?=({tree(sorted(wanted))}))"


def spans(text: str, number: int, rule: Rule) -> Column:
    """Spans of a rule's leftmost non-overlapping matches, in code points: what lies between them is measured."""
    pattern = "'" + rule.pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = lambda g: f"regexp_extract_all({text}, {pattern}, {g})"
    pieces = f"zip_with(zip_with(split({text}, {pattern}, -1), {found(0)}, (p, m) -> named_struct('p', p, 'm', m)), {found(rule.group)}, (x, g) -> named_struct('p', x.p, 'm', x.m, 'g', g))"
    empty = f"cast(array() as array<struct<start:int,number:int,end:int,kind:string>>)"
    span = f"named_struct('start', a.at + char_length(x.p), 'number', {number}, 'end', a.at + char_length(x.p) + char_length(x.m), 'kind', '{rule.kind}')"
    step = f"named_struct('at', a.at + char_length(x.p) + char_length(x.m), 'out', if(char_length(x.g) >= {rule.least}, concat(a.out, array({span})), a.out))"
    return F.expr(f"aggregate({pieces}, named_struct('at', 0, 'out', {empty}), (a, x) -> if(x.m is null, a, {step}), a -> a.out)")


EMPTY = "cast(array() as array<struct<start:int,number:int,end:int,kind:string>>)"


def build_index(first: DataFrame) -> DataFrame:
    """The postings (trigram as hexadecimal bytes, id, hash) in a folder for each trigram, sorted by document.

    A trigram that many documents hold has several files of neighbouring documents; none is gathered in one row or task.
    """
    spark, path = first.sparkSession, C.new_dir(first.sparkSession, "trigram-postings")
    postings = first.select(F.explode("trigrams").alias("t"), "id", "hash").withColumn("t", F.lower(F.hex("t")))
    ordered = postings.repartitionByRange("t", "id", "hash").sortWithinPartitions("t", "id", "hash")
    ordered.write.partitionBy("t").parquet(path)
    return spark.read.schema(ordered.select("id", "hash", "t").schema).parquet(path)


def find_candidates(index: DataFrame, queries: list[Query]) -> DataFrame:
    """(id, hash, rules): the documents whose postings satisfy queries, and the numbers of those.

    Of each intersection the rarest postings are read first; the others are read for the documents found there alone.
    Only a count for each trigram reaches the driver.
    """
    spark = index.sparkSession
    code = lambda t: t.encode().hex()
    counts = {r["t"]: r["n"] for r in index.groupBy("t").agg(F.count("*").alias("n")).collect()}
    sets = [(k, sorted(map(code, c), key=lambda t: (counts.get(t, 0), t))) for k, q in enumerate(queries) for c in conjunctions(q)]
    sets = [(k, ts) for k, ts in sets if all(t in counts for t in ts)]

    def of(lists: dict[int, list[str]]) -> DataFrame:
        """The postings of each set's trigrams, as (set, t, id, hash)."""
        pairs = [(n, t) for n, ts in lists.items() for t in ts]
        read = index.where(F.col("t").isin(sorted({t for _, t in pairs})))  # other folders aren't opened
        return read.join(F.broadcast(spark.createDataFrame(pairs, "set int, t string")), "t").select("set", "t", "id", "hash")

    numbered = dict(enumerate(sets))
    found = of({n: ts[:1] for n, (_, ts) in numbered.items()}).select("set", "id", "hash").distinct()
    rest = {n: ts[1:] for n, (_, ts) in numbered.items() if len(ts) > 1}
    sizes = F.broadcast(spark.createDataFrame([(n, k, len(ts)) for n, (k, ts) in numbered.items()], "set int, rule int, size int"))
    me = ["set", "id", "hash"]
    found = C.stage_table(found, "rarest")
    others = of(rest).join(found.select(*(F.col(c).alias(f"_{c}") for c in me)), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in me]), "left_semi")
    met = found.withColumn("t", F.lit("")).unionByName(others).groupBy(*me).agg(F.size(F.collect_set("t")).alias("n"))
    return met.join(sizes, "set").where("n = size").groupBy("id", "hash").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows as (id, hash); (id, hash, found) of the texts with matches, spans by start, then rule; (id, hash, rules) of the candidates.

    Texts are told apart by their id and a 64-bit hash; repeated rows share what is found. Null texts are empty.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = set().union(*map(trigrams, queries))
    rows = C.ids_and_texts(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    empty = F.expr(EMPTY)
    scanned = [F.when(F.col("text").rlike(r.pattern), spans("text", k, r)).otherwise(empty) for k, (r, q) in enumerate(zip(rules, queries)) if q is True]
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(trigram_pattern(wanted)), F.lit(1))) if wanted else F.array().cast("array<string>")
    first = C.stage_table(rows.select("id", "hash", F.flatten(F.array(empty, *scanned)).alias("full"), held.alias("trigrams")), "trigrams")

    candidates = C.stage_table(find_candidates(build_index(first), queries), "candidates")
    met = candidates.select(F.col("id").alias("id2"), F.col("hash").alias("hash2"), "rules")
    if candidates.count() <= BROADCAST_ROWS:
        met = F.broadcast(met)
    met = rows.join(met, rows["id"].eqNullSafe(F.col("id2")) & (rows["hash"] == F.col("hash2")))
    verified = [F.when(F.array_contains("rules", k), spans("text", k, rules[k])).otherwise(empty) for k, q in enumerate(queries) if q is not True]
    second = met.select("id", "hash", F.flatten(F.array(empty, *verified)).alias("found")).where(F.size("found") > 0)
    both = second.union(first.select("id", "hash", "full").where(F.size("full") > 0))
    # a repeated row brings its spans again; per document there are as many as its text holds
    every = both.select("id", "hash", F.explode("found").alias("span")).distinct()
    return first.select("id", "hash"), every.groupBy("id", "hash").agg(F.array_sort(F.collect_list("span")).alias("found")), candidates


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count for each base rule, base_sha256, spans, and n_candidate (rules that the index asked to verify) of every row.

    Spans that begin together are in the rules' order. Null texts are empty, null ids and repeated rows are rows like any other, other
    columns aren't read, and an empty table gives no rows.
    """
    rows, found, candidates = find_spans(docs, rules, id_col, text_col)
    # a document is in at most one row of either, so their union by document has at most two
    both = found.select("id", "hash", "found", F.lit(0).alias("n")).unionByName(candidates.select("id", "hash", F.lit(None).alias("found"), F.size("rules").alias("n")))
    both = both.groupBy(F.col("id").alias("id2"), F.col("hash").alias("hash2")).agg(F.first("found", ignorenulls=True).alias("found"), F.max("n").alias("n"))
    base = [k for k, r in enumerate(rules) if r.base]
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    rows = rows.join(both, rows["id"].eqNullSafe(F.col("id2")) & (rows["hash"] == F.col("hash2")), "left").withColumn("found", F.coalesce("found", F.expr(EMPTY)))
    count = lambda k: F.size(F.filter("found", lambda x: x["number"] == k)).cast("long").alias(f"n_{rules[k].kind}")
    counts = [count(k) for k in base]
    of_base = F.sha2(listed(F.filter("found", lambda x: x["number"].isin(base))), 256).alias("base_sha256")
    return rows.select(F.col("id").alias("doc_id"), *counts, of_base, listed(F.col("found")).alias("spans"), F.coalesce("n", F.lit(0)).cast("long").alias("n_candidate"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", count_col: str | None = "n_chars") -> DataFrame:
    """The rows with ``mark`` in place of every run of overlapping spans, and their characters counted anew in ``count_col``.

    Null texts stay null, repeated rows are treated alike, other columns stay as they are, and an empty table stays empty.
    """
    _, found, _ = find_spans(docs, rules, id_col, text_col)
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("hash"))
    found = found.select(F.col("id").alias("id2"), F.col("hash").alias("hash2"), "found")
    rows = rows.join(found, F.col(f"row.{id_col}").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2")), "left")
    text = f"row.{text_col}"
    step = f"named_struct('at', greatest(a.at, x.end), 'out', if(x.start < a.at, a.out, concat(a.out, substring({text}, a.at + 1, x.start - a.at), '{mark}')))"
    cut = F.expr(f"aggregate(found, named_struct('at', 0, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substring({text}, a.at + 1)))")
    new = F.when(F.col("found").isNull(), F.col(text)).otherwise(cut)
    row = F.col("row").withField(text_col, new)
    out = rows.select(row.alias("row")).select("row.*")
    if count_col in docs.columns:
        out = out.withColumn(count_col, F.when(F.col(text_col).isNotNull(), F.char_length(text_col)).otherwise(F.col(count_col)).cast(docs.schema[count_col].dataType))
    return out
