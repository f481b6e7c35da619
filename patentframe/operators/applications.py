"""Patent applications: nesting, validation with reasons, duplicates and those already imported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import patent_date

REQUIRED = ("application_number", "patent_number", "title", "decision", "cpc_labels", "ipcr_labels", "examiner_id", "examiner_name_last", "examiner_name_first", *schemas.CONTENT_FIELDS)


def nest(flat: DataFrame) -> DataFrame:
    """Flat JSON keys as metadata, dates, classification, examiner, inventors and content."""
    group = lambda names: F.struct(*names)
    return flat.select(
        group(schemas.TEXT_FIELDS).alias("metadata"),
        F.struct(*(patent_date(F.col(n)).alias(n) for n in schemas.DATE_FIELDS)).alias("dates"),
        group(schemas.CLASS_FIELDS).alias("classification"),
        group(schemas.EXAMINER_FIELDS).alias("examiner"),
        F.coalesce("inventor_list", F.array().cast(f"array<{schemas.INVENTOR}>")).alias("inventors"),
        group(schemas.CONTENT_FIELDS).alias("content"),
    )


def reasons(required: dict[str, Column], rules: dict[str, Column]) -> Column:
    """Names of required columns that are null, then of rules that hold (null: they don't), in order."""
    found = [F.when(c.isNull(), F.lit(k)) for k, c in required.items()] + [F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]
    return F.array_compact(F.array(*found))


def application_reasons() -> Column:
    """Why a flat application is rejected."""
    required = {n: F.col(n) for n in REQUIRED} | {"filing_date": patent_date(F.col("filing_date"))}
    inventor = F.exists(F.coalesce("inventor_list", F.array().cast(f"array<{schemas.INVENTOR}>")), lambda i: i["inventor_name_last"].isNull() | i["inventor_name_first"].isNull())
    return reasons(required, {"inventor_name": inventor, "accepted_but_abandoned": abandoned(patent_date(F.col("abandon_date")), F.col("decision"))})


def abandoned(abandon_date: Column, decision: Column) -> Column:
    """Accepted applications can't have been abandoned."""
    return abandon_date.isNotNull() & (F.lower(decision) == "accepted")


def with_key(df: DataFrame, key: str = "publication_number") -> DataFrame:
    """Rows whose key is there and not empty."""
    return df.where(F.col(key).isNotNull() & (F.col(key) != ""))


def not_existing(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return df.join(existing.select(key), key, "left_anti")


def outcomes(flat: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The flat rows with ``why`` (reasons) and ``outcome``: broken, skipped (no key), existing, rejected, or valid.

    Of the valid rows of a publication number the first by application number is inserted; see ``import_applications``.
    """
    broken = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in flat.columns else F.lit(False)
    key = F.col("publication_number")
    marked = flat.withColumn("why", application_reasons())
    outcome = F.when(broken, "broken").when(key.isNull() | (key == ""), "skipped")
    if existing is not None:
        known = existing.select(F.col("metadata.publication_number").alias("publication_number")).where("publication_number <> ''").distinct().withColumn("known", F.lit(True))
        marked = marked.join(known, "publication_number", "left")
        outcome = outcome.when(F.col("known"), "existing")
    return marked.withColumn("outcome", outcome.when(F.size("why") > 0, "rejected").otherwise("valid")).select(*flat.columns, "why", "outcome")


def import_applications(flat: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nested applications to insert, all other rows with their ``outcome``: broken, skipped, existing, rejected or duplicate).

    A row that isn't valid never keeps a valid one of its publication number out. Duplicates are told by an aggregate of keys and
    row hashes, so the rows of a key, of which there may be many, don't meet in a task; of equal rows one is inserted.
    """
    columns = ["application_number", "publication_number", "outcome", "why"]
    marked = outcomes(flat, existing)
    valid = marked.where("outcome = 'valid'").withColumn("row_hash", F.xxhash64(*flat.columns))
    firsts = valid.groupBy("publication_number").agg(F.min(F.struct("application_number", "row_hash")).alias("first"))
    met = valid.join(firsts, "publication_number")
    is_first = F.col("application_number").eqNullSafe(F.col("first.application_number")) & (F.col("row_hash") == F.col("first.row_hash"))
    inserted = met.where(is_first).dropDuplicates(["publication_number"])
    later = met.where(~is_first).select("application_number", "publication_number", F.lit("duplicate").alias("outcome"), "why")
    same = met.where(is_first).groupBy("application_number", "publication_number").agg(F.count("*").alias("n"), F.first("why").alias("why")).where("n > 1")
    same = same.select("application_number", "publication_number", F.lit("duplicate").alias("outcome"), "why", F.explode(F.sequence(F.lit(2), "n"))).select(*columns)
    return nest(inserted), marked.where("outcome <> 'valid'").select(*columns).unionByName(later).unionByName(same)


def count_outcomes(inserted: DataFrame, others: DataFrame) -> DataFrame:
    """outcome, n: how many applications were inserted and what became of the others."""
    return inserted.select(F.lit("inserted").alias("outcome")).unionByName(others.select("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))
