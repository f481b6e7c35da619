"""Relations as JSON to nodes and edges, and merge statements for a graph store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas


def relations(df: DataFrame, keep: list[str], json_col: str) -> DataFrame:
    """A row for each relation (e_1, rel, e_2); malformed JSON and empty lists give none."""
    parsed = F.from_json(F.col(json_col), schemas.RELATIONS)["relations"]
    return df.select(*keep, F.explode(parsed).alias("r")).select(*keep, "r.*")


def edges(rels: DataFrame) -> DataFrame:
    """Distinct complete triples."""
    return rels.select("e_1", "rel", "e_2").where("e_1 is not null and rel is not null and e_2 is not null").distinct()


def nodes(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.select(F.col("e_1").alias("name")).union(edge_rows.select(F.col("e_2").alias("name"))).distinct()


def merge(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key, existing ones first: what a store would hold after a merge."""
    return existing.unionByName(new.join(existing.select(*key), key, "left_anti").dropDuplicates(key))


def merge_statement(e_1: Column, rel: Column, e_2: Column) -> Column:
    """A merge statement for an edge; quotes are escaped and relation names made identifiers."""
    quoted = lambda c: F.concat(F.lit("'"), F.regexp_replace(c, r"(['\\])", r"\\$1"), F.lit("'"))
    name = F.upper(F.regexp_replace(rel, r"\W+", "_"))
    return F.concat(F.lit("MERGE (a:Entity {name: "), quoted(e_1), F.lit("}) MERGE (b:Entity {name: "), quoted(e_2), F.lit("}) MERGE (a)-[:"), name, F.lit("]->(b)"))


def build(df: DataFrame, keep: list[str], text_col: str, entities: Callable[[str], list[str]], relate: Callable[[str, list[str]], str]) -> DataFrame:
    """Knowledge graph of texts: the entity back end, then the relation back end on its result; relations as rows."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            made = [relate(t, entities(t)) for t in (x.as_py() or "" for x in b.column(text_col))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(made, pa.string())], [*keep, "json"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return relations(df.select(*keep, text_col).mapInArrow(run, f"{kept}, json string"), keep, "json")


def chain_relations(text: str, found: list[str]) -> str:
    """Deterministic relation back end: each entity with the next one in the text."""
    import json

    return json.dumps({"relations": [{"e_1": a, "rel": "followed_by", "e_2": b} for a, b in zip(found, found[1:])]})
