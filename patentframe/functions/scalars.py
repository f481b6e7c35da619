"""Scalar functions on columns: dates, file sizes, ids, claim numbers, archive kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Size units, by power of 1024, and the texts of sizes.
UNITS = (
    ("", "B", "BYTE", "BYTES"),
    ("K", "KB", "KIB"),
    ("M", "MB", "MIB"),
    ("G", "GB", "GIB"),
    ("T", "TB", "TIB"),
)
SIZE_TEXT = r"^(\d+)(?:[.,](\d+))?\s*([A-Za-z]*)$"


def trim_space(c: Column) -> Column:
    """Without white space of any kind at both ends, no-break and other wide spaces among it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def patent_date(c: Column) -> Column:
    """``yyyyMMdd`` or ``yyyy-MM-dd`` as a naive timestamp; blank and anything else, padded text included, is null."""
    compact = F.when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "yyyyMMdd"))
    dashed = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    return F.coalesce(compact, dashed).cast("timestamp_ntz")


def unit_multiplier(unit: Column) -> Column:
    """Bytes in a unit, in any case; 0 for an unknown one."""
    out = F.lit(0).cast("long")
    for power, names in enumerate(UNITS):
        out = F.when(F.upper(unit).isin(*names), F.lit(1024**power).cast("long")).otherwise(out)
    return out


def file_size(c: Column, strict_compat: bool = False) -> Column:
    """Bytes of texts such as ``1.5 GB``; a comma is a decimal sign too; 0 where the text says nothing.

    Integer arithmetic: the decimals times the unit, divided by their power of ten. With ``strict_compat`` a number
    without decimals is 0.
    """
    t = trim_space(c)
    whole, decimals, unit = (F.regexp_extract(t, SIZE_TEXT, k) for k in (1, 2, 3))
    times = unit_multiplier(unit)
    number = lambda x: x.try_cast("long")
    part = F.floor(F.try_multiply(number(decimals).cast("decimal(38,0)"), times.cast("decimal(38,0)")) / F.pow(F.lit(10), F.length(decimals)).cast("decimal(38,0)")).cast("long")
    fine = F.try_add(F.try_multiply(number(whole), times), F.when(decimals == "", F.lit(0).cast("long")).otherwise(part))
    found = t.rlike(SIZE_TEXT) & (F.lit(not strict_compat) | (decimals != ""))
    return F.coalesce(F.when(found, fine), F.lit(0).cast("long"))


def composite_id(country: Column, number: Column, kind: Column) -> Column:
    """Country, number and kind end to end; missing parts are empty."""
    return F.concat(*(F.coalesce(x, F.lit("")) for x in (country, number, kind)))


def claim_number(chunk: Column) -> Column:
    """The number a claim begins with, or null."""
    return F.regexp_extract(chunk, r"^(\d+)\.", 1).try_cast("int")


def archive_kind(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(p.endswith(".zip"), "zip").when(p.endswith(".tar.gz"), "tar.gz").when(p.endswith(".tgz"), "tgz").when(p.endswith(".tar"), "tar").otherwise("unknown")
    )


def archive_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)(\.tar\.gz|\.tgz|\.tar|\.zip)$", "")


def checksum_ok(content: Column, expected: Column) -> Column:
    """Whether the SHA-1 of the content is the expected lower-case hex."""
    return F.coalesce(F.sha1(content) == expected, F.lit(False))


def download_url(base: Column, product: Column, delivery: Column, item: Column) -> Column:
    return F.concat(base, F.lit("/products/"), product, F.lit("/delivery/"), delivery, F.lit("/item/"), item, F.lit("/download"))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
