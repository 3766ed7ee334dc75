"""Small cases with known answers."""

import datetime
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.functions import scalars as sc
from larder.operators import analyses, features, forecasting, monitoring, quality, reorder, risk, staging
from larder.sources import io, samples


def test_text_numbers_and_dates(spark):
    rows = spark.createDataFrame([("", ), ("  ",), (".",), ("12.50",), (" 7 ",), ("x",), (None,), ("2025-12-30",)], "v string")
    got = rows.select(sc.money("v").cast("double"), sc.number("v", "int"), sc.day("v"), sc.text("v")).collect()
    assert [r[0] for r in got] == [None, None, None, 12.5, 7.0, None, None, None]
    assert [r[1] for r in got] == [None, None, None, None, 7, None, None, None] or got[3][1] == 12
    assert got[7][2] == datetime.date(2025, 12, 30) and got[2][2] is None and got[2][3] == "."


def test_flags_and_ratios(spark):
    rows = spark.createDataFrame([("True",), ("t",), ("1",), ("yes",), ("false",), ("0",), (None,)], "v string")
    assert [r[0] for r in rows.select(sc.flag("v")).collect()] == [True] * 4 + [False] * 3
    assert spark.range(1).select(sc.ratio(F.lit(1), F.lit(0)), sc.clipped(F.lit(None).cast("double"), 0, 1), sc.at_least(F.lit(None).cast("int"), 0)).first() == (None, None, None)


def test_calendar(spark):
    rows = spark.createDataFrame([(datetime.date(2025, 3, 31),), (datetime.date(2025, 4, 1),), (datetime.date(2024, 2, 29),)], "d date")
    d = F.col("d")
    got = rows.select(sc.fiscal_year(d), sc.fiscal_month(d), sc.season(F.month(d)), sc.iso_weekday(d), sc.sunday_weekday(d)).collect()
    assert [tuple(r) for r in got] == [(2024, 12, "Spring", 1, 1), (2025, 1, "Spring", 2, 2), (2023, 11, "Winter", 4, 4)]


def test_right_closed(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (3.0,), (9.0,), (None,)], "x double")
    assert [r[0] for r in rows.select(sc.right_closed(F.col("x"), [2.0, 3.0], ["low", "medium", "high"])).collect()] == ["low", "low", "medium", "medium", "high", None]


def test_dedup_prefers_received_and_handles_copies(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", "2020-01-01", 2), ("b", None, 3), ("b", None, 3)], "id string, d string, n int")
    assert sorted(map(tuple, staging.dedup_latest(rows, ["id"], ["d"]).collect())) == [("a", "2020-01-01", 2), ("b", None, 3)]


def test_clean_names(spark):
    assert staging.clean_names(spark.createDataFrame([(1, 2, 3)], ["Store Nbr", "unitSales", "store.nbr"])).columns == ["store_nbr", "unit_sales", "store_nbr_2"]


def _series(spark, q):
    start = datetime.date(2020, 1, 1)
    return spark.createDataFrame([(start + datetime.timedelta(i), "s", "p", float(x), 10.0) for i, x in enumerate(q)], "date date, store_id string, product_id string, quantity_sold double, unit_price double")


def test_windows_against_pandas(spark):
    q = np.random.default_rng(1).integers(0, 50, 80)
    df = _series(spark, q)
    rows = features.with_trend(features.with_ewm(features.with_rolling(features.with_lags(df)))).orderBy("date").toPandas()
    s = pd.Series(q, dtype=float)
    for w in (7, 14, 28):
        r = s.shift(1).rolling(w, min_periods=max(1, w // 2))
        for name, want in (("mean", r.mean()), ("std", r.std().fillna(0)), ("min", r.min()), ("max", r.max())):
            assert np.allclose(rows[f"roll_{name}_{w}"], want, equal_nan=True)
    for span in (7, 14):
        assert np.allclose(rows[f"ewm_mean_{span}"], s.shift(1).ewm(span=span, min_periods=3).mean(), equal_nan=True)
    slope = s.shift(1).rolling(14, min_periods=5).apply(lambda x: np.polyfit(np.arange(len(x.dropna())), x.dropna(), 1)[0], raw=False)
    assert np.allclose(rows["demand_trend_14d"], slope, equal_nan=True)


def test_long_series_keeps_finite_weights(spark):
    q = np.random.default_rng(2).integers(0, 50, 5000)
    rows = features.with_ewm(_series(spark, q)).orderBy("date").toPandas()
    for span in (7, 14):
        assert np.allclose(rows[f"ewm_mean_{span}"], pd.Series(q, dtype=float).shift(1).ewm(span=span, min_periods=3).mean(), equal_nan=True)


def test_features_do_not_look_ahead(spark):
    q = list(np.random.default_rng(3).integers(0, 50, 60))
    full = features.with_ewm(features.with_rolling(_series(spark, q))).where("date <= '2020-02-10'").orderBy("date").toPandas()
    cut = features.with_ewm(features.with_rolling(_series(spark, q[:41]))).orderBy("date").toPandas()
    pd.testing.assert_frame_equal(full, cut)


def test_risk_orders_unknown_last(spark):
    inv = spark.createDataFrame([("s", "p1", 5, 1, 0, False, False), ("s", "p2", -2, 1, 0, True, True), ("s", "p3", 5, 1, 0, False, False), ("s", "p4", None, None, None, None, None)], "store_id string, product_id string, quantity_on_hand int, reorder_point int, quantity_on_order int, is_out_of_stock boolean, needs_reorder boolean")
    demand = spark.createDataFrame([("s", "p2", 2.0), ("s", "p3", 1.0), ("s", "p4", 5.0)], "store_id string, product_id string, avg_daily_demand double")
    products = spark.createDataFrame([("p1", "a", "c", "x"), ("p2", "b", "c", "x"), ("p3", "d", "c", None), ("p4", "e", "c", "x")], "product_id string, product_name string, category string, supplier_id string")
    suppliers = spark.createDataFrame([("x", "X", 10.0, 0.5)], "supplier_id string, supplier_name string, avg_actual_lead_time_days double, calculated_on_time_rate double")
    rows = risk.stockout_risk(inv, demand, products, suppliers).orderBy("risk_rank").collect()
    assert [r["product_id"] for r in rows] == ["p2", "p4", "p1", "p3"]
    assert rows[0]["risk_score"] == 20.0 and rows[2]["days_of_stock_remaining"] == float("inf") and rows[3]["risk_score"] is None
    assert (rows[1]["quantity_on_hand"], rows[1]["quantity_on_order"], rows[1]["risk_score"]) == (0, 0, 20.0)  # unknown counts as none


def test_reorder_rounding_and_extrapolation(spark):
    fc = spark.createDataFrame([("s", p, datetime.date(2020, 1, 1), h, float(h)) for p in ("a", "b", "c") for h in range(1, 8)], "store_id string, product_id string, forecast_generated_date date, horizon_day int, predicted_quantity double")
    inv = spark.createDataFrame([("s", "a", 1, 0), ("s", "b", 100, 0), ("s", "c", 1, 0)], "store_id string, product_id string, quantity_on_hand int, quantity_on_order int")
    sup = spark.createDataFrame([("a", "x", 2.5, 1.0), ("b", "x", 9.0, 1.0), ("c", "y", None, None)], "product_id string, supplier_id string, avg_actual_lead_time_days double, calculated_on_time_rate double")
    std = spark.createDataFrame([("s", "a", 0.0)], "store_id string, product_id string, demand_std_14d double")
    rows = {r["product_id"]: r for r in reorder.reorder_recommendations(fc, inv, sup, std).collect()}
    assert rows["a"]["forecast_demand_lead_time"] == 3.0 and rows["a"]["risk_tier"] == "High"  # 2.5 days round to 2
    assert rows["b"]["forecast_demand_lead_time"] == 28.0 + 2 * 1.0 and rows["b"]["safety_stock"] == 0.0
    assert rows["a"]["recommendation_date"] == rows["a"]["inference_date"]
    dated = reorder.reorder_recommendations(fc, inv, sup, std, recommendation_date="2020-02-03").first()
    assert dated["recommendation_date"] == datetime.date(2020, 2, 3) and dated["inference_date"] == datetime.date(2020, 1, 1)
    tiers = [r["risk_tier"] for r in reorder.sort_by_tier(reorder.reorder_recommendations(fc, inv, sup, std)).collect()]
    assert tiers == sorted(tiers, key=lambda t: reorder.TIERS.index(t) if t else 9)
    assert rows["c"]["risk_tier"] is None and rows["c"]["reason"] == "no supplier figures"


def test_metrics_without_demand(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0)], "target double, forecast double")
    assert forecasting.forecast_metrics(rows, []).first()["wape"] is None


def test_baselines_short_history(spark):
    rows = spark.createDataFrame([("s", "p", datetime.date(2020, 1, d), float(d)) for d in (1, 2, 3)], "store_id string, product_id string, date date, target double")
    assert tuple(forecasting.baseline_values(rows).first())[2:] == (3.0, 2.0, 2.0)


def test_rules_pass_and_fail(spark):
    rows = spark.createDataFrame([(1, "a", datetime.date(2020, 1, 1)), (1, "b", None), (None, "c", datetime.date(2021, 1, 1))], "k int, v string, d date")
    status = lambda df: [r["status"] for r in df.collect()]
    assert status(quality.not_null(rows, ["k", "v"])) == ["error", "pass"]
    assert status(quality.unique(rows, "k", severity="warn")) == ["warn"] and status(quality.unique(rows, "v")) == ["pass"]
    assert status(quality.unique_combination(rows, ["k", "v"])) == ["pass"]
    assert status(quality.accepted_values(rows, "v", ["a", "b"])) == ["error"]
    parents = spark.createDataFrame([(2,)], "k int")
    assert quality.relationships(rows, "k", parents, "k").first()["n_failed"] == 2
    assert status(quality.accepted_range(rows, "k", 1, 1)) == ["pass"]
    assert status(quality.date_range(rows, "d", "2020-01-01", "2020-12-31")) == ["error"]
    assert {r["table"]: r["status"] for r in quality.availability({"a": rows, "b": rows.limit(0), "c": None}).collect()} == {"a": "ok", "b": "empty", "c": "missing"}


def test_ks_distance(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, 400).round(1), rng.normal(0.5, 1, 300).round(1)
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= x).mean() - (b <= x).mean()) for x in grid)
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "x double")
    assert abs(monitoring.ks_distance(frame(a), frame(b), "x").first()["ks"] - want) < 1e-12


def test_histogram_counts_every_row(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(101)], "x double")
    assert sum(r["n"] for r in analyses.histogram(rows, "x", 10).collect()) == 101


def test_ingest_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("2020-01-01", 1), ("2020-01-02", 2)], "d string, v int")
    path = str(tmp_path / "fact")
    assert io.ingest_new_partitions(rows, path, "d").count() == 2
    more = rows.unionByName(spark.createDataFrame([("2020-01-03", 3)], "d string, v int"))
    assert [r["dt"] for r in io.ingest_new_partitions(more, path, "d").collect()] == ["2020-01-03"]
    assert spark.read.parquet(path).count() == 3


def test_csv_round_trip_and_samples(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "b", c'), ("2", None)], "k string, v string")
    io.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(tuple, io.read_raw_csv(spark, str(tmp_path / "csv"), ["k", "v"]).collect())) == [("1", 'a "b", c'), ("2", None)]
    many = spark.range(1000).withColumnRenamed("id", "k")
    kept = samples.sample_by_key({"a": many, "b": many}, many, "k", 0.3)
    assert kept["a"].exceptAll(kept["b"]).isEmpty() and kept["a"].count() == 300


def test_a_days_rows_are_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(60_000).selectExpr("if(id % 100 = 0, '2020-01-02', '2020-01-01') AS d", "sha2(cast(id AS string), 256) AS v").repartition(4)
        io.ingest_new_partitions(rows, str(tmp_path / "fact"), "d")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "fact" / "dt=2020-01-01").glob("*.parquet"))) > 3
    assert spark.read.parquet(str(tmp_path / "fact")).count() == 60_000


def test_bernoulli_and_dates(spark, monkeypatch):
    rows = spark.range(10_000)
    some = samples.bernoulli_sample(rows, 0.2, "id", 7)
    assert 1800 < some.count() < 2200 and some.exceptAll(samples.bernoulli_sample(rows, 0.2, "id", 7)).isEmpty()
    monkeypatch.setenv("PIPELINE_DATE", "2025-03-01")
    assert io.resolve_date("2025-02-01") == datetime.date(2025, 2, 1) and io.resolve_date() == datetime.date(2025, 3, 1)
    monkeypatch.delenv("PIPELINE_DATE")
    assert abs((io.resolve_date() - datetime.datetime.now(datetime.UTC).date()).days) <= 1


def test_best_fold_is_the_latest_with_rows(spark):
    rows = spark.createDataFrame([(1, "train"), (1, "val"), (2, "train"), (2, "val"), (3, "train")], "fold int, part string")
    assert [tuple(r) for r in forecasting.best_fold(rows).collect()] == [(2,)] and forecasting.of_best_fold(rows).count() == 2
    assert forecasting.best_fold(rows.where("part = 'train'")).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from larder.sources import scratch

    def session(master, folder=None):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": folder} if folder else {}, getCheckpointDir=lambda: None))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(session("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(session("local-cluster[2,1,1024]"))
    assert scratch.shared_dir(session("spark://host:7077", "file:///shared/")) == "file:///shared"


def test_stream_takes_files_once(spark, tmp_path):
    from larder.streaming.ingest import ingest_available, stream_raw_csv

    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    io.write_csv(spark.createDataFrame([("2020-01-01", "x")], "d string, v string"), source)
    for _ in range(2):
        ingest_available(stream_raw_csv(spark, source, ["d", "v"]), out, "d", mark).awaitTermination()
    assert spark.read.parquet(out).count() == 1


@pytest.mark.parametrize(("n", "step", "most"), [(0, 12, 10_000), (1, 12, 10_000), (137, 4, 5), (500, 12, 1), (900, 12, 10_000)])
def test_samples_have_their_exact_size(spark, monkeypatch, n, step, most):
    monkeypatch.setattr(samples, "STEP", step)
    monkeypatch.setattr(samples, "SORTED", most)
    keys = [f"k{i}" for i in range(500)] + ["k1", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    order = sorted(set(keys), key=lambda k: (int(hashlib.md5(f"7:{k or ''}".encode()).hexdigest()[:12], 16), k or ""))
    assert {r["k"] for r in samples.sample_keys(df, n, 7).collect()} == set(order[:n])
    assert samples.sample_keys(df.limit(0), n, 7).count() == 0
