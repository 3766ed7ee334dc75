"""Incremental arrival: new raw files become dated partitions, each taken once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType


def stream_raw_csv(spark: SparkSession, path: str, columns: Sequence[str], files_per_batch: int = 100) -> DataFrame:
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(path)


def ingest_available(raw: DataFrame, path: str, date_col: str, checkpoint: str) -> StreamingQuery:
    """Appends all files that have arrived to dt= folders, then stops; the checkpoint keeps files from being taken twice."""
    rows = raw.withColumn("dt", F.date_format(F.col(date_col).try_cast("date"), "yyyy-MM-dd")).where("dt IS NOT NULL")
    return rows.writeStream.format("parquet").partitionBy("dt").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
