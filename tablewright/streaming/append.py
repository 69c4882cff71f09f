"""Idempotent appends from a stream, and counts by event time with late data bounded."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import insert_missing


def append_new(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append the rows of each batch whose key the table lacks; a batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(keys)
        try:
            rows = insert_missing(batch.sparkSession.read.schema(batch.schema).parquet(path), rows, keys)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each kind and window; rows later than the bound are let go by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select("window.start", "window.end", by, "n")
