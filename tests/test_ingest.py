"""Ingest with a manifest, coverage from it, and database tables."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from larder.operators import quality
from larder.plans import sinks
from larder.plans.retail import Retail
from larder.sources import io, jdbc, manifest
from larder.streaming import ingest as streaming

SF = "/root/testdata/sf0.001"


def days(spark, *counts):
    """counts[i] rows of day i."""
    start = datetime.date(2020, 1, 1)
    return spark.createDataFrame([(start + datetime.timedelta(i), f"r{i}-{k}", k) for i, n in enumerate(counts) for k in range(n)], "d date, name string, n int")


def names_of(df):
    return sorted(r["name"] for r in df.collect())


@pytest.mark.parametrize("fails", ["before a rename", "after a rename", "before the entries", "within the entries"])
def test_a_run_that_dies_between_dates_is_made_good(spark, tmp_path, monkeypatch, fails):
    root, rows = str(tmp_path / "fact"), days(spark, 3, 4, 5)
    publish, enter = manifest.publish_date, manifest.list_dates

    def dies(folders, run, dt):
        if fails == "before a rename" and dt == "2020-01-02":
            raise RuntimeError("killed")
        publish(folders, run, dt)
        if fails == "after a rename" and dt == "2020-01-02":
            raise RuntimeError("killed")

    def dies_too(folders, name, run, entries):
        if entries[0]["dt"] == "2020-01-02":
            if fails == "within the entries":
                folders.fs.create(folders.path(f"{manifest.STAGING}/part")).close()
            raise RuntimeError("killed")
        enter(folders, name, run, entries)

    with monkeypatch.context() as m:
        m.setattr(manifest, "TOGETHER", 1)
        m.setattr(manifest, "publish_date", dies)
        m.setattr(manifest, "list_dates", dies_too)
        with pytest.raises(RuntimeError):
            manifest.ingest_new_partitions(rows, root, "d")
    assert names_of(manifest.read_ingested(spark, root)) == [f"r0-{k}" for k in range(3)]  # only what was published counts
    assert sorted(r["dt"] for r in manifest.ingest_new_partitions(rows, root, "d").collect()) == ["2020-01-02", "2020-01-03"]
    assert names_of(manifest.read_ingested(spark, root)) == names_of(rows)
    assert names_of(spark.read.parquet(root)) == names_of(rows)  # what is left behind is no data
    assert {r["status"] for r in manifest.verify_ingested(spark, root).collect()} == {"ok"}
    assert manifest.ingest_new_partitions(rows, root, "d").count() == 0


def test_a_job_that_fails_while_writing_publishes_nothing(spark, tmp_path):
    root = str(tmp_path / "fact")
    bad = days(spark, 2, 2).withColumn("n", F.when(F.col("name") == "r1-1", F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        manifest.ingest_new_partitions(bad, root, "d")
    assert manifest.manifest(spark, root).count() == 0
    with pytest.raises(ValueError, match="no date"):
        manifest.read_ingested(spark, root)
    manifest.ingest_new_partitions(days(spark, 2, 2), root, "d")
    assert manifest.read_ingested(spark, root).count() == 4


def test_entries_bounds_and_odd_dates(spark, tmp_path):
    root = str(tmp_path / "fact")
    rows = days(spark, 1, 0, 2).withColumn("d", F.col("d").cast("string")).unionByName(spark.createDataFrame([(None, "none", 1)], "d string, name string, n int"))
    manifest.ingest_new_partitions(rows, root, "d")
    entries = {r["dt"]: r["rows"] for r in manifest.manifest(spark, root).collect()}
    assert entries == {"2020-01-01": 1, "2020-01-03": 2}
    assert names_of(manifest.read_ingested(spark, root, "2020-01-02")) == ["r2-0", "r2-1"]
    assert names_of(manifest.read_ingested(spark, root, None, "2020-01-02")) == ["r0-0"]
    assert manifest.ingest_new_partitions(rows.limit(0), root, "d").count() == 0


def test_verify_sees_what_has_changed(spark, tmp_path):
    root = str(tmp_path / "fact")
    manifest.ingest_new_partitions(days(spark, 2, 2, 2), root, "d")
    folders = manifest.Folders(spark, root)
    folders.delete("dt=2020-01-01")
    days(spark, 0, 2).withColumn("n", F.lit(9)).write.mode("overwrite").parquet(f"{root}/dt=2020-01-02")
    days(spark, 1).write.parquet(f"{root}/dt=2021-01-01")
    status = {r["dt"]: r["status"] for r in manifest.verify_ingested(spark, root).collect()}
    assert status == {"2020-01-01": "missing", "2020-01-02": "changed", "2020-01-03": "ok", "2021-01-01": "unlisted"}
    assert [r["dt"] for r in manifest.adopt_partitions(spark, root).collect()] == ["2021-01-01"]
    assert manifest.verify_ingested(spark, root).where("status = 'unlisted'").count() == 0


def test_streamed_partitions_count_once_adopted(spark, tmp_path):
    raw, root = str(tmp_path / "raw"), str(tmp_path / "fact")
    io.write_csv(days(spark, 2, 1).withColumn("d", F.col("d").cast("string")), raw)
    streaming.ingest_available(streaming.stream_raw_csv(spark, raw, ["d", "name", "n"]), root, "d", str(tmp_path / "mark")).awaitTermination()
    manifest.adopt_partitions(spark, root)
    assert {(r["dt"], r["rows"]) for r in manifest.manifest(spark, root).collect()} == {("2020-01-01", 2), ("2020-01-02", 1)}


def test_coverage_reads_no_data_file(spark, tmp_path):
    roots = {n: str(tmp_path / n) for n in ("a", "b", "plain")}
    manifest.ingest_new_partitions(days(spark, 1, 0, 3), roots["a"], "d")
    manifest.ingest_new_partitions(days(spark, 0, 0, 2, 4), roots["b"], "d")
    io.write_dated(days(spark, 1), roots["plain"], "2020-01-02")
    found = quality.coverage_of_dates({n: manifest.published_dates(spark, root) for n, root in roots.items()})
    got = {r["table"]: (str(r["first_date"]), str(r["last_date"]), r["n_dates"], r["n_missing"], r["n_rows"]) for r in found.collect()}
    assert got == {"a": ("2020-01-01", "2020-01-03", 2, 2, 4), "b": ("2020-01-03", "2020-01-04", 2, 2, 6), "plain": ("2020-01-02", "2020-01-02", 1, 3, None)}
    assert all("/_manifest/" in f for f in found.inputFiles())
    assert "parquet" not in found._jdf.queryExecution().executedPlan().toString().lower()


URL = "jdbc:derby:memory:larder_test;create=true"
RENAME = "RENAME TABLE {0} TO {1}"


def test_database_round_trip_in_ranges_with_pushed_filters(spark):
    rows = spark.range(1000).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") % 7 > 0, F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))).alias("day"))
    jdbc.write_jdbc(rows, URL, "t1", rename=RENAME, column_types="name VARCHAR(40)")
    back = jdbc.read_jdbc(spark, URL, "t1", column='"k"', rows_a_part=200)
    assert back.rdd.getNumPartitions() == 5 and sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    by_day = jdbc.read_jdbc(spark, URL, "t1", column='"day"', rows_a_part=400)  # rows without a day are read too
    assert by_day.rdd.getNumPartitions() == 3 and by_day.count() == 1000
    plan = back.where("name = 'n7' AND k > 3").select("k")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(name,n7)" in plan and "ReadSchema: struct<k:int>" in plan
    assert jdbc.read_jdbc(spark, URL, "t1").count() == jdbc.read_jdbc(spark, URL, "t1", column='"k"').count() == 1000


def test_a_failed_overwrite_leaves_the_old_table(spark):
    jdbc.write_jdbc(spark.range(5), URL, "t2", rename=RENAME)
    bad = spark.range(100).withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        jdbc.write_jdbc(bad, URL, "t2", rename=RENAME)
    assert jdbc.read_jdbc(spark, URL, "t2").count() == 5
    with pytest.raises(Exception):  # a swap that fails half way is taken back
        jdbc.write_jdbc(spark.range(7), URL, "t2", rename="RENAME TABLE {0} TO {1}_no such statement")
    assert jdbc.read_jdbc(spark, URL, "t2").count() == 5
    jdbc.write_jdbc(spark.range(3), URL, "t2", rename=RENAME)
    assert jdbc.read_jdbc(spark, URL, "t2", column='"ID"' if "ID" in jdbc.read_jdbc(spark, URL, "t2").columns else '"id"').count() == 3
    empty = spark.range(0)
    jdbc.write_jdbc(empty, URL, "t2", rename=RENAME)
    assert jdbc.read_jdbc(spark, URL, "t2", column='"id"').count() == 0


def test_registered_round_trips_report_what_was_left_behind(spark):
    rows = sinks.verified(Retail(spark, SF)).groupBy("status").agg(F.max("dt"), F.count("*")).collect()
    assert {r["status"] for r in rows} == {"ok", "unlisted"} and ("unlisted", sinks.UNLISTED, 1) in [tuple(r) for r in rows]


def test_entries_are_plain_json(spark, tmp_path):
    manifest.ingest_new_partitions(days(spark, 2), str(tmp_path / "f"), "d")
    (entry,) = (tmp_path / "f" / "_manifest").glob("*-0.json")
    assert json.loads(entry.read_text()).keys() == {"dt", "rows", "checksum", "run"}


def test_a_run_without_a_new_date_reads_dates_only(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path / "fact"), days(spark, 3, 4)
    manifest.ingest_new_partitions(rows, root, "d")
    monkeypatch.setattr(manifest, "summed", lambda df: pytest.fail("rows were written and summed"))
    assert manifest.ingest_new_partitions(rows, root, "d").count() == 0
    assert manifest.ingest_new_partitions(rows.where("false"), str(tmp_path / "none"), "d").columns == ["dt"]


def test_registered_ingest_stages_its_sales_once(spark, monkeypatch):
    ingest, asked = manifest.ingest_new_partitions, []
    monkeypatch.setattr(manifest, "ingest_new_partitions", lambda df, *a: asked.append(df.inputFiles()) or ingest(df, *a))
    assert sinks.ingest(Retail(spark, SF)).count() > 0
    assert len(asked) == 3 and not any("lineitem" in f for files in asked for f in files)
