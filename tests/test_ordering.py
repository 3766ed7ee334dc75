"""Ranks in ranges and exact quantiles against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import analyses, ordering
from larder.plans import retail

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ranges", [1, 7])
def test_rank_is_that_of_one_sort(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1.0, 2.5, float("inf"), -3.0]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "x double, i int").repartition(4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ordering.with_rank(df, [F.desc_nulls_last("x"), F.asc("i")], "place")
        assert "SinglePartition" not in plan(ranked)
        got = {r["i"]: r["place"] for r in ranked.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [got[i] for _, i in want] == list(range(1, 501))


def test_rank_of_an_empty_table(spark):
    assert ordering.with_rank(spark.range(0), [F.asc("id")], "place").count() == 0


def test_stockout_risk_has_no_window_in_one_task(spark):
    assert "SinglePartition" not in plan(retail.Retail(spark, SF).stockout_risk())


@pytest.mark.parametrize(("bracket", "bins"), [(10_000, 512), (3, 2), (1, 4)])
def test_quantiles_are_those_of_numpy(spark, monkeypatch, bracket, bins):
    monkeypatch.setattr(ordering, "BRACKET", bracket)
    monkeypatch.setattr(ordering, "BINS", bins)
    rng = random.Random(bracket)
    make = {"wide": lambda: rng.uniform(-1e12, 1e12), "ties": lambda: float(rng.choice([0, 0, 0, 1, 5])), "tiny": lambda: rng.random() * 1e-9 + 1, None: lambda: rng.gauss(0, 1), "one": lambda: 7.0}
    rows = [(k, f(), rng.choice([None, 1.0, 2.0])) for k, f in make.items() for _ in range(1 if k == "one" else 137)] + [("wide", None, None), ("none", None, 1.0), ("ties", float("nan"), float("inf"))]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    qs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r["k"], r["column"], r["q"]): r["value"] for r in ordering.quantiles(df, ["x", "y"], qs, ["k"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for c, at in (("x", 1), ("y", 2)):
            own = [r[at] for r in rows if r[0] == k and r[at] is not None and np.isfinite(r[at])]
            want |= {(k, c, q): float(np.quantile(own, q)) for q in qs if own}
    assert got.keys() == want.keys()
    assert all(got[x] == pytest.approx(want[x], rel=1e-12, abs=1e-12) for x in want)


def test_medians_and_descriptions(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), ("b", None)], "k string, v double")
    assert analyses.medians(df, ["v"]).collect() == [(2.0,)]
    assert analyses.medians(df.where("k = 'b'"), ["v"]).first()["v"] is None
    got = {r["k"]: (r["n"], r["p25"], r["p50"], r["most"]) for r in analyses.describe_by(df, "k", "v").collect()}
    assert got == {"a": (2, 1.25, 1.5, 2.0), None: (1, 5.0, 5.0, 5.0), "b": (0, None, None, None)}
    got = {r["k"]: (r["mean"], r["median"]) for r in analyses.stats_by(df, ["k"], "v", ("mean", "median")).collect()}
    assert got == {"a": (1.5, 1.5), None: (5.0, 5.0), "b": (None, None)}


def test_histogram_counts_rows_without_a_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, None)], "k string, v double")
    assert sorted(map(tuple, analyses.histogram(df, "v", 4, "k").collect()), key=repr) == [("a", 0, 1), ("a", 3, 1), (None, 0, 1)]


@pytest.mark.parametrize("name", ["mart_store_daily_sales", "an_summary"])
def test_distinct_counts_multiply_no_rows(spark, name):
    assert "Expand" not in plan(retail.BUILDERS[name](retail.Retail(spark, SF)))


def test_summary_of_an_empty_mart_and_of_nulls(spark):
    mart = retail.Retail(spark, SF).mart_store_daily_sales()
    row = analyses.an_summary(mart.limit(0)).first()
    assert row["total_days"] == row["total_stores"] == 0 and row["avg_daily_units"] is None
    odd = mart.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in mart.dtypes])
    row = analyses.an_summary(odd).first()
    assert (row["total_days"], row["total_stores"], row["holiday_days"]) == (0, 0, 0)
