"""Ingest of dated partitions that a crash cannot leave half done.

A run writes its dates to a folder of its own, then publishes them, some at a time: each by one rename, all by one file of
entries in the manifest, rows and checksum of each date.  Only dates in the manifest count.  What a run that died leaves behind (staged dates, a folder without
an entry) is taken away by the next run, which writes those dates again.  One run at a time may write to a root.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MANIFEST, STAGING = "_manifest", "_staging"
#: Dates that one file of the manifest lists, and renames at a time.
TOGETHER, PARALLEL = 250, 8
ENTRY = "dt string, rows bigint, checksum string, run string"


class Folders:
    """The few file operations that publishing needs, on whatever file system the root is."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root, self.fs = root.rstrip("/"), self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename(self, name: str, to: str) -> None:
        self.fs.mkdirs(self.path(to).getParent())
        if not self.fs.rename(self.path(name), self.path(to)):
            raise OSError(f"cannot rename {self.root}/{name} to {to}")

    def write(self, name: str, text: str) -> None:
        """A small file that is there whole or not at all."""
        part = f"{STAGING}/{uuid.uuid4().hex}"
        out = self.fs.create(self.path(part))
        out.write(bytearray(text.encode()))
        out.close()
        self.delete(name)
        self.rename(part, name)

    def dates(self) -> list[str]:
        """Dates that have a folder, listed or not."""
        root = self._path(self.root)
        found = [s.getPath().getName() for s in self.fs.listStatus(root) if s.isDirectory()] if self.fs.exists(root) else []
        return sorted(n[3:] for n in found if n.startswith("dt="))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(dt, rows, checksum, run) of every published date; none where nothing has been published."""
    if not Folders(spark, root).exists(MANIFEST):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(f"{root.rstrip('/')}/{MANIFEST}")


def summed(rows: DataFrame) -> DataFrame:
    """(dt, rows, checksum): the checksum adds up a hash of each row, so it does not depend on order or files."""
    columns = sorted(c for c in rows.columns if c != "dt")
    return rows.groupBy("dt").agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(20,0)")).cast("string").alias("checksum"))


def publish_date(folders: Folders, run: str, dt: str) -> None:
    """Puts a staged date where readers look; a folder without an entry, left by a run that died, goes first."""
    folders.delete(f"dt={dt}")
    folders.rename(f"{STAGING}/{run}/dt={dt}", f"dt={dt}")


def list_dates(folders: Folders, name: str, run: str, entries: Sequence) -> None:
    """Makes dates count: one file with a line (dt, rows, checksum) each."""
    folders.write(f"{MANIFEST}/{name}.json", "".join(json.dumps({"dt": r["dt"], "rows": r["rows"], "checksum": r["checksum"], "run": run}) + "\n" for r in entries))


def ingest_new_partitions(df: DataFrame, root: str, date_col: str) -> DataFrame:
    """Publishes the dates that the manifest does not have, as dt= folders; returns them as (dt).  Running it again writes nothing.

    Rows without a date are left out.  Rows are gathered by date, large dates in several tasks and small ones together, as
    Spark sizes them at run time.  Counts and checksums are of what was written, and one row a date reaches the driver.  Where
    no date is new, dates are all that is read.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    folders = Folders(spark, root)
    folders.delete(STAGING)
    have = manifest(spark, root).select("dt")
    fresh = df.withColumn("dt", F.date_format(F.col(date_col).cast("date"), "yyyy-MM-dd")).where("dt IS NOT NULL").join(F.broadcast(have), "dt", "left_anti")
    if fresh.select("dt").isEmpty():
        return spark.createDataFrame([], "dt string")
    stage = f"{folders.root}/{STAGING}/{run}"
    fresh.hint("rebalance", F.col("dt")).write.partitionBy("dt").parquet(stage)
    staged = summed(spark.read.schema(StructType([*[f for f in fresh.schema if f.name != "dt"], StructField("dt", StringType())])).parquet(stage)).orderBy("dt").collect()
    with ThreadPool(PARALLEL) as pool:
        for k in range(0, len(staged), TOGETHER):
            pool.map(lambda r: publish_date(folders, run, r["dt"]), staged[k : k + TOGETHER])
            list_dates(folders, f"{run}-{k}", run, staged[k : k + TOGETHER])
    folders.delete(STAGING)
    return spark.createDataFrame([(r["dt"],) for r in staged], "dt string")


def adopt_partitions(spark: SparkSession, root: str) -> DataFrame:
    """Gives dt= folders that another writer has finished an entry, so that they count; returns their dates."""
    folders, known = Folders(spark, root), {r["dt"] for r in manifest(spark, root).select("dt").collect()}
    new = [d for d in folders.dates() if d not in known]
    if new:
        list_dates(folders, f"{uuid.uuid4().hex}-adopted", "adopted", summed(_dates_of(spark, folders, new)).collect())
    return spark.createDataFrame([(d,) for d in new], "dt string")


def _dates_of(spark: SparkSession, folders: Folders, dates: list[str]) -> DataFrame:
    rows = spark.read.option("basePath", folders.root).parquet(*[f"{folders.root}/dt={d}" for d in dates])
    return rows.withColumn("dt", F.col("dt").cast("string"))


def read_ingested(spark: SparkSession, root: str, dt_from: str | None = None, dt_to: str | None = None) -> DataFrame:
    """Rows of the published dates within the bounds; no other folder is opened."""
    dates = [r["dt"] for r in manifest(spark, root).select("dt").orderBy("dt").collect()]  # one a day
    dates = [d for d in dates if (dt_from is None or d >= dt_from) and (dt_to is None or d <= dt_to)]
    if not dates:
        raise ValueError(f"no date has been published in {root}")
    return _dates_of(spark, Folders(spark, root), dates)


def verify_ingested(spark: SparkSession, root: str) -> DataFrame:
    """(dt, rows, n_found, status) of every date: ok, missing (an entry without rows), changed, or unlisted (rows without an entry)."""
    folders = Folders(spark, root)
    dates = folders.dates()
    none = spark.createDataFrame([], "dt string, n_found bigint, own string")
    found = summed(_dates_of(spark, folders, dates)).toDF("dt", "n_found", "own") if dates else none
    rows = manifest(spark, root).join(found, "dt", "full")
    same = (F.col("rows") == F.col("n_found")) & F.col("checksum").eqNullSafe(F.col("own"))
    status = F.when(F.col("rows").isNull(), "unlisted").when(F.col("n_found").isNull(), "missing").when(same, "ok").otherwise("changed")
    return rows.select("dt", "rows", "n_found", status.alias("status"))


def published_dates(spark: SparkSession, root: str) -> DataFrame:
    """(date_day, rows) of a root from its manifest alone; where there is none, from the folders' names, rows unknown."""
    folders = Folders(spark, root)
    if folders.exists(MANIFEST):
        return manifest(spark, root).select(F.col("dt").try_cast("date").alias("date_day"), "rows")
    return spark.createDataFrame([(d,) for d in folders.dates()], "dt string").select(F.col("dt").try_cast("date").alias("date_day"), F.lit(None).cast("bigint").alias("rows"))
