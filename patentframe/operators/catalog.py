"""Delivery catalogs to download tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import checksum_ok, download_url, file_size


def parse(df: DataFrame, json_col: str) -> DataFrame:
    return df.select(F.from_json(F.col(json_col), schemas.CATALOG).alias("p")).select("p.*")


def items(products: DataFrame, base_url: str = "https://example.org", folder: str = "data", strict_compat: bool = False) -> DataFrame:
    """A download task for each item: product, delivery, filename, file_path, expected_size, checksum, url."""
    rows = products.select("id", F.explode("deliveries").alias("d")).select("id", F.col("d.deliveryId").alias("delivery"), F.explode("d.items").alias("i"))
    text = lambda c: F.col(c).cast("string")
    return rows.select(
        F.col("id").alias("product"),
        "delivery",
        F.col("i.itemName").alias("filename"),
        F.concat(F.lit(folder + "/"), "i.itemName").alias("file_path"),
        file_size(F.col("i.fileSize"), strict_compat).alias("expected_size"),
        F.col("i.fileChecksum").alias("checksum"),
        download_url(F.lit(base_url), text("id"), text("delivery"), text("i.itemId")).alias("url"),
    )


def to_download(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Tasks whose file (path, content) isn't there with the expected checksum."""
    have = files.select(F.col("path").alias("file_path"), F.sha1("content").alias("checksum"))
    return tasks.join(have, ["file_path", "checksum"], "left_anti")


def verified(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Files (path, content) of tasks with ``is_ok``: whether the checksum matches."""
    return files.join(tasks, files["path"] == tasks["file_path"]).select("path", checksum_ok(F.col("content"), F.col("checksum")).alias("is_ok"))
