"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (larger ones, or itself and smaller ones) are linked to the least of all."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    own = least.where("m < u").select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of longs to (node, root): root is the least node reachable; nodes without links are left out.

    Each round is written to the shared folder; rounds grow as the logarithm of the longest path. Only a count and a
    checksum of each round reach the driver.
    """
    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return r["n"], r["x"]

    now = C.stage_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = mark(now)
    while seen[0]:
        now = C.stage_table(_star(_star(now, True), False), "links")
        then, seen = seen, mark(now)
        if then == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
