"""The registered model queries: what they ask for, and a small run."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import encoding, forecasting
from larder.operators.features import CATEGORICAL, NUMERIC
from larder.plans import retail

SF = "/root/testdata/sf0.001"
SMALL = {"params": {"maxIter": 1, "maxDepth": 1}, "numeric": ("lag_1", "lag_7"), "categorical": ("store_id",)}
#: Folds for the few days of the smallest tables.
EARLY = ((1, 30, 31, 5000), (2, 60, 61, 5000))


@pytest.mark.parametrize("name", ["gbt_walk_forward", "gbt_forecasts", "gbt_importance"])
def test_registered_models_use_every_fold_horizon_and_feature(spark, monkeypatch, name):
    asked, folds = [], []

    class Stop(Exception):
        pass

    def pipeline(params, numeric, categorical):
        asked.append((dict(params), list(numeric), list(categorical)))
        raise Stop

    def train(df, params=None, horizons=forecasting.HORIZONS, numeric=tuple(NUMERIC), categorical=tuple(CATEGORICAL)):
        assert tuple(horizons) == tuple(range(1, 8))
        pipeline(params or {}, numeric, categorical)

    def evaluate(df, params=None, plan=forecasting.FOLDS, horizons=forecasting.HORIZONS, **columns):
        folds.append(plan)
        train(df, params, horizons, **columns)

    monkeypatch.setattr(forecasting, "train_horizons", train)
    monkeypatch.setattr(forecasting, "walk_forward_eval", evaluate)
    monkeypatch.setattr(retail.Retail, "feat_matrix", lambda self: spark.range(1))
    with pytest.raises(Stop):
        retail.BUILDERS[name](retail.Retail(spark, SF))
    assert asked == [({}, NUMERIC, CATEGORICAL)]
    assert folds == ([retail.FOLDS] if name == "gbt_walk_forward" else [])


def test_small_importance_lists_each_horizon(spark):
    rows = retail._importance(retail.Retail(spark, SF), horizons=(1, 2), **SMALL).collect()
    assert sorted((r["horizon"], r["feature"]) for r in rows) == [(h, f) for h in (1, 2) for f in ("lag_1", "lag_7", "store_id__code")]


def test_small_report_names_top_worst_and_ratio(spark):
    rows = retail._importance_report(retail.Retail(spark, SF), params={"maxIter": 2, "maxDepth": 2}, folds=EARLY, numeric=("lag_1", "lag_7", "day_of_week"), categorical=()).collect()
    assert retail._importance_report(retail.Retail(spark, SF), folds=((1, 1, 9000, 9001),)).count() == 0
    by = {k: [(r["feature"], r["value"]) for r in rows if r["scope"] == k] for k in ("global", "worst", "top_feature", "lag_vs_calendar")}
    assert len(by["global"]) == len(by["worst"]) == 3 and by["top_feature"] == by["global"][:1]
    effects = dict(by["global"])
    want = (effects["lag_1"] + effects["lag_7"]) / effects["day_of_week"] if effects["day_of_week"] else 0.0
    assert by["lag_vs_calendar"] == [(None, pytest.approx(want))]
    assert max(v for _, v in by["worst"]) >= max(v for _, v in by["global"])


def test_small_search_halves_and_marks_the_least_error(spark):
    rows = retail._tuned(retail.Retail(spark, SF), 5, (1, 2), {"maxDepth": 1}, EARLY, 2, numeric=("lag_1", "lag_7"), categorical=("store_id",)).collect()
    assert [r["trial"] for r in rows] == list(range(5)) and all('"maxDepth": 1' in r["settings"] for r in rows)
    assert sorted(r["rung"] for r in rows) == [0, 0, 0, 1, 1] and {r["trees"] for r in rows if r["rung"] == 1} == {2}
    final = [r for r in rows if r["rung"] == 1]
    assert [r["best"] for r in rows].count(True) == 1 and min(final, key=lambda r: (r["wape"], r["trial"]))["best"]


def test_search_without_rows_to_validate_on_has_no_best(spark):
    rows = retail._tuned(retail.Retail(spark, SF), 2, (1,), None, ((1, 1, 9000, 9001),), 1, numeric=("lag_1",), categorical=()).collect()
    assert len(rows) == 2 and not any(r["best"] for r in rows) and {r["wape"] for r in rows} == {None}


def wide(spark, products: int, days: int = 3):
    """A feature matrix of many products, NULLs among its categories."""
    rows = spark.range(products * days).selectExpr(f"'s' AS store_id", f"cast(id % {products} AS string) AS product_id", f"date_add(DATE'2020-01-01', cast(id / {products} AS int)) AS date", "cast(id % 7 AS double) AS lag_1", f"cast(id % {products} % 5 AS double) AS quantity_sold", "if(id % 3 = 0, NULL, 'r') AS region")
    return rows.withColumn("target", F.col("quantity_sold") + 1)


@pytest.mark.parametrize("products", [1000, 5000])
def test_any_number_of_categories_trains_and_predicts(spark, products):
    rows = wide(spark, products)
    models = forecasting.train_horizons(rows, {"maxIter": 1, "maxDepth": 2}, (1, 2), ("lag_1",), ("product_id", "region", "store_id"))
    assert set(models) == {1, 2} and models[1].features == ["lag_1", "product_id__code", "region__code", "store_id__code"]
    new = spark.createDataFrame([("s", "never seen", None, 1.0)], "store_id string, product_id string, region string, lag_1 double")
    got = forecasting.predict(models[1], rows.unionByName(new, allowMissingColumns=True))
    assert got.count() == 3 * products + 1 and got.where("forecast IS NULL OR forecast < 0").isEmpty()


def brute_codes(rows, column, weight=10.0):
    out = {}
    for r in rows:
        seen = [x for x in rows if x["date"] < r["date"] and x["q"] is not None]
        own = [x["q"] for x in seen if (x[column] or "") == (r[column] or "")]
        overall = sum(x["q"] for x in seen) / len(seen) if seen else 0.0
        out[r["date"], r[column]] = (sum(own) + weight * overall) / (len(own) + weight)
    return out


def test_codes_know_earlier_days_only(spark):
    rng = random.Random(5)
    rows = [{"date": datetime.date(2020, 1, 1 + rng.randint(0, 9)), "a": rng.choice(["x", "y", "z", "", None]), "b": rng.choice("pq"), "q": rng.choice([None, 0.0, 1.0, 5.0])} for _ in range(80)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "date date, a string, b string, q double")
    got = encoding.with_ordered_codes(df, ("a", "b"), "q").collect()
    assert len(got) == 80
    for c in "ab":
        want = brute_codes(rows, c)
        known = {(r["date"], r[c] or "") for r in rows if r["q"] is not None}
        for r in got:
            assert r[f"{c}__code"] == pytest.approx(want[r["date"], r[c]] if (r["date"], r[c] or "") in known else 0.0)
    late = encoding.fit_codes(df, ("a",), "q")
    q = [r["q"] for r in rows if r["q"] is not None]
    for r in late.table.collect():
        own = [x["q"] for x in rows if (x["a"] or "") == r["category"] and x["q"] is not None]
        assert r["code"] == pytest.approx((sum(own) + 10 * sum(q) / len(q)) / (len(own) + 10))
    assert late.unseen["a"] == pytest.approx(sum(q) / len(q))
    assert encoding.with_ordered_codes(df.limit(0), ("a",), "q").count() == 0


def test_small_walk_forward_and_forecasts(spark):
    rows = retail._gbt(retail.Retail(spark, SF), horizons=(1, 2), folds=EARLY, **SMALL).collect()
    assert (2, 1) in {(r["fold"], r["horizon"]) for r in rows} and all(r["n"] > 0 and r["wape"] >= 0 for r in rows)  # a horizon with too few rows has no model
    made = retail._forecasts(retail.Retail(spark, SF), horizons=(1, 2), **SMALL).collect()
    pairs = {(r["store_id"], r["product_id"]) for r in made}
    assert len(made) == 2 * len(pairs) and all(r["predicted_quantity"] >= 0 and (r["forecast_date"] - r["forecast_generated_date"]).days == r["horizon_day"] for r in made)


def test_permuting_the_telling_feature_hurts_most(spark):
    rows = spark.range(600).selectExpr("'s' AS store_id", "cast(id % 20 AS string) AS product_id", "date_add(DATE'2020-01-01', cast(id / 20 AS int)) AS date", "cast(id * 7 % 13 AS double) AS lag_1", "cast(id % 5 AS double) AS lag_7", "1.0D AS quantity_sold")
    rows = rows.withColumn("target", F.col("lag_1") * 3)
    model = forecasting.train_horizons(rows, {"maxIter": 3, "maxDepth": 4}, (1,), ("lag_1", "lag_7"), ())[1]
    found = forecasting.permutation_importance(model, rows, ["lag_7", "lag_1"]).collect()
    assert [r["feature"] for r in found] == ["lag_1", "lag_7"] and found[0]["wape_increase"] > 0.2 > abs(found[1]["wape_increase"])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_fits_move_no_rows_for_their_labels_and_codes_are_summed_once(spark):
    rows = wide(spark, 40, 9)
    built = forecasting.training_rows(rows, ("lag_1",), ("product_id", "region"), (1, 3, 7))
    for h in (1, 3, 7):
        assert exchanges(forecasting._labelled(built.rows, h)) == 0
        want = sorted(r["target_h"] for r in forecasting.horizon_dataset(rows, h).collect())
        assert sorted(r["__label"] for r in forecasting._labelled(built.rows, h).collect()) == want and len(want) == 40 * (10 - h)
    coded = encoding.with_ordered_codes(rows, ("product_id", "region", "store_id"), "quantity_sold")
    assert "Generate" not in coded._jdf.queryExecution().optimizedPlan().toString()


def test_matrix_is_built_once_for_an_evaluation(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(retail.Retail, "feat_matrix", lambda self: spark.range(5))
    monkeypatch.setattr(forecasting, "walk_forward_eval", lambda df, *a, **k: seen.append(df.inputFiles()) or spark.range(1))
    monkeypatch.setattr(forecasting, "tune", lambda df, *a, **k: seen.append(df.inputFiles()) or spark.range(1))
    retail._gbt(retail.Retail(spark, SF))
    retail._tuned(retail.Retail(spark, SF))
    assert len(seen) == 2 and all(seen)  # files of a written table, not a plan over the raw ones


def test_forecasts_of_all_models_equal_each_models_own(spark):
    rows = wide(spark, 20, 9).withColumn("target", F.when(F.col("date") < "2020-01-09", F.col("target")))
    models = forecasting.train_horizons(rows, {"maxIter": 2, "maxDepth": 2}, (1, 2), ("lag_1",), ("product_id",))
    made = forecasting.generate_forecasts(models, rows)
    got = {(r["product_id"], r["horizon_day"]): r["predicted_quantity"] for r in made.collect()}
    last = rows.where("target IS NULL")
    want = {(r["product_id"], h): round(r["forecast"], 4) for h, m in models.items() for r in forecasting.predict(m, last).collect()}
    assert got == pytest.approx(want) and len(got) == 40
    assert "__features" not in made.columns and made._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1  # the date alone: no codes a model
