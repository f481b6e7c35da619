"""Applications as flat documents: 19 metadata fields and the page content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso_text

#: Section names of the page content, and the content field of each.
SECTIONS = (
    ("Title", "metadata.title"),
    ("Abstract", "content.abstract"),
    ("Claims", "content.claims"),
    ("Background", "content.background"),
    ("Summary", "content.summary"),
    ("Description", "content.full_description"),
)


def texts_or_none(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def distinct_countries(inventors: Column) -> Column:
    """Distinct countries but null and empty ones, sorted."""
    found = F.filter(F.transform(inventors, lambda i: i["inventor_country"]), lambda c: c.isNotNull() & (c != ""))
    return texts_or_none(F.array_sort(F.array_distinct(found)))


def metadata_fields() -> dict[str, Column]:
    """The 19 fields, from a nested application."""
    names = {n: F.col(f"metadata.{n}") for n in ("application_number", "publication_number", "title", "decision")}
    dates = {n: iso_text(F.col(f"dates.{n}")) for n in ("filing_date", "patent_issue_date", "abandon_date")}
    classes = {n: F.col(f"classification.{n}") for n in ("main_cpc_label", "main_ipcr_label", "uspc_class", "uspc_subclass")}
    lists = {n: texts_or_none(F.col(f"classification.{n}")) for n in ("cpc_labels", "ipcr_labels")}
    more = {
        "patent_number": F.col("metadata.patent_number"),
        "examiner_id": F.col("examiner.examiner_id"),
        "examiner_name": F.concat("examiner.examiner_name_first", F.lit(" "), "examiner.examiner_name_last"),
        "inventor_count": F.coalesce(F.size("inventors"), F.lit(0)),
        "inventor_countries": distinct_countries(F.col("inventors")),
        "filing_year": F.year("dates.filing_date"),
    }
    return names | dates | classes | lists | more


def page_content(sections: dict[str, Column]) -> Column:
    """Sections as a JSON object; missing ones are null."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in sections.items())), {"ignoreNullFields": "false"})


def documents(applications: DataFrame) -> DataFrame:
    """page_content and metadata of each application."""
    meta = F.struct(*(c.alias(k) for k, c in metadata_fields().items()))
    return applications.select(page_content({k: F.col(path) for k, path in SECTIONS}).alias("page_content"), meta.alias("metadata"))


def batches(df: DataFrame, size: int):
    """Lists of at most ``size`` rows, a partition at a time on the driver; the last may be shorter."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
