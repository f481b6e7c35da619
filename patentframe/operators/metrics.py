"""Counters, histograms, status and batches of pipeline runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(df: DataFrame, size_col: str) -> DataFrame:
    """total_bytes and total_files."""
    return df.agg(F.coalesce(F.sum(size_col), F.lit(0)).alias("total_bytes"), F.count("*").alias("total_files"))


def counters(df: DataFrame, attributes: list[str], value: str) -> DataFrame:
    """Count and sum for each set of attributes."""
    return df.groupBy(*attributes).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def bucket(value: Column, bounds: list[float]) -> Column:
    """Number of the bucket: how many bounds are below the value; a bound belongs to the bucket it ends."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.when(value > b, 1).otherwise(0)
    return out


def histogram(df: DataFrame, attributes: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Count, least, most and sum for each set of attributes and bucket."""
    return df.groupBy(*attributes, bucket(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value).alias("total"))


def session_status(df: DataFrame, ok: Column) -> DataFrame:
    """n_total, n_ok, n_failed and the status of a session: empty without files, else success."""
    n = F.count("*")
    return df.agg(n.alias("n_total"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.when(n == 0, "empty").otherwise("success").alias("status"))


def first_error(df: DataFrame, order: str, error: str) -> DataFrame:
    """The first error by order; the rest stays in the rejects table."""
    return df.where(F.col(error).isNotNull()).agg(F.min_by(error, order).alias("first_error"), F.count("*").alias("errors"))


def row_numbers(df: DataFrame, key: str, name: str = "n_before") -> DataFrame:
    """The rows with how many sort before them by an integer key, unique and not null, without a sort of all in one task.

    Rows are numbered between quantiles of the key; only the quantiles and a count for each reach the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = df.agg(F.percentile_approx(key, [k / parts for k in range(parts)], 10_000).alias("cuts")).first()
    cuts = F.array(*map(F.lit, sorted(set(got["cuts"] or [])))).cast("array<bigint>")
    placed = df.withColumn("slot", F.size(F.filter(cuts, lambda c: c <= F.col(key))))
    before, pairs = 0, []
    for r in sorted(placed.groupBy("slot").count().collect(), key=lambda r: r["slot"]):
        pairs.append((r["slot"], before))
        before += r["count"]
    bases = F.broadcast(df.sparkSession.createDataFrame(pairs, "slot int, base long"))
    nth = F.row_number().over(Window.partitionBy("slot").orderBy(key)) - 1
    return placed.withColumn("nth", nth).join(bases, "slot").withColumn(name, F.col("base") + F.col("nth")).drop("slot", "nth", "base")


def batch_index(df: DataFrame, key: str, size: int) -> DataFrame:
    """The rows with the number of their batch of ``size`` by key."""
    return row_numbers(df, key).withColumn("batch", F.floor(F.col("n_before") / size)).drop("n_before")
