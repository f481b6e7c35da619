"""Command line: run, download, download-file, extract, parse, import, chunk, config, queries, version."""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config as settings
from . import __version__
from .operators import applications, catalog, chunking, documents, exchange
from .sources import archive, download, readers


def download_(spark: SparkSession, c: settings.Config) -> dict:
    """Files of the products to ``files`` below the output, and what became of each as Parquet beside it."""
    products = download.read_catalog_http(spark, c.base_url, [int(x) for x in c.products.split(",") if x.strip()], c.retries, c.timeout, c.parallel).cache()
    missing = products.where("problem is not null").select(F.lit("catalog").alias("outcome"), "problem")
    tasks = catalog.items(products, c.base_url, strict_compat=c.strict_compat)
    got = download.download(tasks, f"{c.output}/files", c.skip_exists, c.verify_sha1, c.retries, c.timeout, c.parallel)
    try:
        return _written(got.unionByName(missing, allowMissingColumns=True), f"{c.output}/downloads", F.col("outcome").isin("ok", "skipped"))
    finally:
        products.unpersist()


def download_file(spark: SparkSession, c: settings.Config) -> dict:
    """One file by its URL, under its name below the output; without a URL there is nothing to do."""
    rows = [(c.file_name or c.file_url.rstrip("/").rpartition("/")[2], None, c.file_url)] if c.file_url else []
    tasks = spark.createDataFrame(rows, "file_path string, checksum string, url string")
    got = download.download(tasks, c.output, c.skip_exists, False, c.retries, c.timeout, 1)
    return _written(got, f"{c.output}/file-download", F.col("outcome").isin("ok", "skipped"))


def run(spark: SparkSession, c: settings.Config) -> dict:
    """Download, unpack and parse, each below the output, as far as there is something to do."""
    got = {"download": download_(spark, c)}
    if not got["download"]["ok"]:
        return got
    found = archive.expand(readers.read_archives(spark, f"{c.output}/files", deep=True), c.max_depth)
    wrote = archive.materialise(found, f"{c.output}/extracted")
    got["extract"] = _written(wrote, f"{c.output}/members", F.col("written").isNotNull())
    if not got["extract"]["ok"]:
        return got
    got["parse"] = parse(spark, replace(c, input=f"{c.output}/extracted", output=f"{c.output}/records"))
    return got


def extract(spark: SparkSession, c: settings.Config) -> dict:
    """Members of all archives below the input, nested ones included, as Parquet."""
    found = archive.expand(readers.read_archives(spark, c.input, deep=True), c.max_depth)
    return _written(found, c.output, F.col("problem").isNull())


def parse(spark: SparkSession, c: settings.Config) -> dict:
    """Exchange documents of all XML files below the input to patent records; rejects, and files that can't be read, beside them.

    Documents are parsed once, into a table beside the output that both are read from.
    """
    docs = readers.read_exchange_documents(spark, c.input)
    docs.write.mode("overwrite").parquet(c.output + "-documents")
    good, bad = exchange.split_rejects(spark.read.schema(docs.schema).parquet(c.output + "-documents"), c.reject_scope)
    rejects = bad.select("file", "country", "doc_number", "kind", "status", "problem")
    missing = readers.unreadable(readers.list_files(spark, c.input, readers.XML_FILES))
    rejects.unionByName(missing, allowMissingColumns=True).write.mode("overwrite").parquet(c.output + "-rejects")
    return _written(exchange.patent_records(good), c.output, F.lit(True))


def import_(spark: SparkSession, c: settings.Config) -> dict:
    """New applications of a directory, appended to the output, in folders by ``partition_by`` if given; all others with
    their outcome beside it. Counts each outcome."""
    existing = spark.read.parquet(c.existing) if c.existing else None
    good, others = applications.import_applications(readers.read_applications(spark, c.input).cache(), existing)
    named = {"filing_year": F.year("dates.filing_date"), "decision": F.col("metadata.decision")}
    good = good.select("*", *(named[k].alias(k) for k in c.partitions()))
    counts = {r["outcome"]: r["n"] for r in applications.count_outcomes(good, others).collect()}
    others.write.mode("append").parquet(c.output + "-rejects")
    return _written(good, c.output, F.lit(True), "append", c.partitions()) | {"outcomes": counts}


def chunk(spark: SparkSession, c: settings.Config) -> dict:
    """Chunks of stored applications."""
    docs = documents.documents(readers.read_stored(spark, c.input)).select("metadata.application_number", "page_content")
    return _written(chunking.chunk_documents(docs, ["application_number"], c.split_claims, c.chunk_size, c.chunk_overlap, c.splitter), c.output, F.lit(True))


def _written(df, path: str, ok, mode: str = "overwrite", by: tuple[str, ...] = ()) -> dict:
    """Write, and give the session's counters, which are observed while it is written."""
    from pyspark.sql import Observation

    seen = Observation("session")
    df.observe(seen, F.count("*").alias("total"), F.count_if(ok).alias("ok")).write.mode(mode).partitionBy(*by).parquet(path)
    return {"total": seen.get["total"], "ok": seen.get["ok"], "status": "success" if seen.get["total"] else "empty"}


def logged(path: str, command: str, begun: float, got: dict) -> None:
    """Append a command's counters to a log of JSON lines."""
    line = {"command": command, "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(begun)), "seconds": round(time.time() - begun, 3), **got}
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(line) + "\n")


COMMANDS = {"run": run, "download": download_, "download-file": download_file, "extract": extract, "parse": parse, "import": import_, "chunk": chunk}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="patentframe")
    p.add_argument("command", choices=[*COMMANDS, "config", "queries", "version"])
    p.add_argument("--config", action="append", help="may be given again: later files win")
    for f in fields(settings.Config):
        p.add_argument("--" + f.name.replace("_", "-"))
    args = vars(p.parse_args(argv))
    command, path = args.pop("command"), args.pop("config")
    c = settings.load(path, args)
    if command == "config":
        print(settings.shown(c))
    elif command == "version":
        print(__version__)
    elif command == "queries":
        from .registry import QUERIES

        print("\n".join(QUERIES))
    else:
        begun = time.time()
        got = COMMANDS[command](SparkSession.builder.appName("patentframe").getOrCreate(), c)
        print(got)
        if c.log:
            logged(c.log, command, begun, got)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
