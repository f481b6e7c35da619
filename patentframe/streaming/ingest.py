"""Incremental import of application JSON; an extension, as the batch import skips what exists already."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.applications import import_applications


def applications_stream(spark: SparkSession, directory: str) -> DataFrame:
    schema = schemas.APPLICATION_JSON + ", _corrupt_record string"
    return spark.readStream.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(directory)


def ingest(stream: DataFrame, target: str, rejects: str, checkpoint: str) -> StreamingQuery:
    """Append new applications to ``target`` and all others to ``rejects``; runs over what is there and ends.

    A batch that is run again finds its own rows in the target, so nothing is inserted twice.
    """

    def each(batch: DataFrame, _: int) -> None:
        try:
            existing = batch.sparkSession.read.parquet(target)
        except AnalysisException:
            existing = None
        good, others = import_applications(batch, existing)
        good.write.mode("append").parquet(target)
        others.write.mode("append").parquet(rejects)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
