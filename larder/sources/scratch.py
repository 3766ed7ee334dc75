"""Tables on the way: written to the folder that the driver and all executors share, and deleted when used up."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's; on one machine (tests) a fresh one where neither is set."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larder-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/larder-{uuid.uuid4().hex}-{name}"


#: What goes to a Python worker at once while a table is written: whole texts make the default of 10,000 rows too large.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def written(df: DataFrame, name: str, parts: int | None = None, settings: Mapping[str, str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    parts: at most so many files; settings: of the session, for this write alone.
    """
    path, conf = fresh_path(df.sparkSession, name), df.sparkSession.conf
    during = {**ARROW, **(settings or {})}
    before = {k: conf.get(k) for k in during}
    for k, v in during.items():
        conf.set(k, v)
    try:
        (df.coalesce(parts) if parts else df).write.parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table from written(), once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
