"""Sources: TSV, feather, JSON and XML directories, archives as files, catalogs, stored applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars
from ..operators import exchange
from .files import open_file

XML_FILES = "*.[xX][mM][lL]"


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated text with a header; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", "\t")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by the given order."""
    return df.orderBy(*order).limit(n)


def read_feather(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """Feather (Arrow IPC) files by URI, a task each, a batch at a time; the schema is that of the first."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    rows = paths.select("path") if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    first = rows.first()
    if first is None:
        raise ValueError("no feather files")
    with open_file(first["path"]) as f:
        schema = from_arrow_schema(pa.ipc.open_file(f).schema)

    def load(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                with open_file(p) as f:
                    file = pa.ipc.open_file(f)
                    for k in range(file.num_record_batches):
                        yield file.get_batch(k)

    return rows.mapInArrow(load, schema)


def read_applications(spark: SparkSession, directory: str) -> DataFrame:
    """One JSON application in each ``*.json`` of a directory; ``_corrupt_record`` holds what can't be parsed."""
    schema = schemas.APPLICATION_JSON + ", _corrupt_record string"
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(directory)


def read_exchange_documents(spark: SparkSession, directory: str, encoding: str = "UTF-8") -> DataFrame:
    """Every exchange-document of all XML files below a directory, at any depth and whatever its namespace prefix, with its file's path.

    Files are cut where documents end, so one file is read by as many tasks as its size asks for. Unreadable files are passed
    over; ``unreadable`` names them.
    """
    reader = spark.read.format("text").option("lineSep", "exchange-document>").option("encoding", encoding).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    pieces = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", XML_FILES).load(directory)
    # what the cut took is put back; a start tag without attributes is cut like an end tag, and is a document without attributes
    whole = F.concat("value", F.when(F.col("value").rlike(r"</(?:[\w.-]+:)?$"), "exchange-document>").when(F.col("value").rlike(r"<(?:[\w.-]+:)?$"), "exchange-document/>").otherwise(""))
    return exchange.parse_xml(pieces.select(F.col("_metadata.file_path").alias("file"), whole.alias("xml")), whole=False)


def unreadable(files: DataFrame) -> DataFrame:
    """file and problem of those of the files (path) that can't be opened and read."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                try:
                    with open_file(path) as f:
                        f.read(1)
                except OSError as e:
                    out.append((path, f"unreadable: {type(e).__name__}"))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in list(zip(*out)) or [(), ()]], ["file", "problem"])

    return files.select("path").mapInArrow(run, "file string, problem string")


def list_files(spark: SparkSession, directory: str, names: str) -> DataFrame:
    """path of the files below a directory by a pattern of their names; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(directory).select("path")


def read_archives(spark: SparkSession, directory: str, deep: bool = False) -> DataFrame:
    """Archive files of a directory (all below it if ``deep``): path, modificationTime, length, content, kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).load(directory)
    return files.withColumn("kind", scalars.archive_kind(F.col("path"))).where("kind <> 'unknown'")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOG).option("multiLine", True).json(path)


def read_stored(spark: SparkSession, path: str, query: Column | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Stored applications; the query and the projection reach the Parquet scan."""
    df = spark.read.parquet(path)
    df = df if query is None else df.where(query)
    return df.select(*columns) if columns else df
