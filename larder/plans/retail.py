"""The registered queries over the retail- and grocery-shaped tables, put together from the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import analyses as an
from larder.operators import features as ft
from larder.operators import forecasting as fc
from larder.operators import marts, monitoring, quality, reorder, risk
from larder.operators import staging as st
from larder.operators.encoding import code_name, fit_codes, with_ordered_codes
from larder.operators.rules import Observed, Rule, check_table
from larder.sources.fixtures import raw
from larder.sources.io import write_mart
from larder.sources.scratch import drop_written, fresh_path, written

#: Parameters of the queries.
AS_OF = "2025-01-01"
EVENT = ("1996-04-16", "1996-04-30")
FOLDS = ((1, 1200, 1201, 1260), (2, 1700, 1701, 1760))


class Retail:
    """The models over one folder of tables, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return raw(self.spark, self.sf_dir, name)

    def stg_products(self):
        return st.stg_products(self.raw("raw_products"))

    def stg_stores(self):
        return st.stg_stores(self.raw("raw_stores"), AS_OF)

    def stg_suppliers(self):
        return st.stg_suppliers(self.raw("raw_suppliers"))

    def stg_sales(self):
        return st.stg_sales(self.raw("raw_sales"))

    def stg_inventory(self):
        return st.stg_inventory(self.raw("raw_inventory"))

    def stg_shipments(self):
        return st.stg_shipments(self.raw("raw_shipments"), ["line_part", "line_supplier"])

    def dim_products(self):
        return marts.dim_products(self.stg_products(), self.stg_suppliers())

    def dim_stores(self):
        return marts.dim_stores(self.stg_stores())

    def dim_date(self):
        return marts.dim_date([(self.stg_sales(), "sale_date"), (self.stg_inventory(), "snapshot_date"), (self.stg_shipments(), "order_date")])

    def fct_daily_sales(self):
        return marts.fct_daily_sales(self.stg_sales(), self.dim_products(), self.stg_stores())

    def fct_inventory_snapshots(self):
        return marts.fct_inventory_snapshots(self.stg_inventory(), self.dim_products(), self.stg_stores())

    def mart_supplier_performance(self):
        return marts.mart_supplier_performance(self.stg_shipments(), self.stg_suppliers())

    def stg_train(self):
        return st.stg_train(self.raw("raw_train"), *EVENT)

    def stg_test(self):
        return st.stg_test(self.raw("raw_train"), *EVENT)

    def stg_holidays(self):
        return st.stg_holidays(self.raw("raw_holidays"))

    def stg_oil(self):
        return st.stg_oil(self.raw("raw_oil"))

    def stg_items(self):
        return st.stg_items(self.raw("raw_items"))

    def stg_grocery_stores(self):
        return st.stg_grocery_stores(self.raw("raw_grocery_stores"))

    def stg_transactions(self):
        return st.stg_transactions(self.raw("raw_transactions"))

    def mart_store_daily_sales(self):
        return marts.mart_store_daily_sales(self.stg_train(), self.stg_grocery_stores(), self.stg_transactions(), self.stg_holidays())

    def latest_inventory(self):
        return risk.latest_inventory(self.fct_inventory_snapshots())

    def avg_daily_demand(self):
        return risk.avg_daily_demand(self.fct_daily_sales())

    def stockout_risk(self):
        return risk.stockout_risk(self.latest_inventory(), self.avg_daily_demand(), self.dim_products(), self.mart_supplier_performance())

    def series(self):
        return ft.daily_series(self.fct_daily_sales())

    def feat_matrix(self):
        """The daily fact is read twice, by the series and for the region's demand, so what they need of it is written first."""
        sales = written(self.fct_daily_sales().select(*ft.DAILY), "daily-sales")
        return ft.build_features(sales, self.fct_inventory_snapshots(), self.dim_products(), self.mart_supplier_performance())

    def labelled(self):
        """Series with targets, for folds and baselines."""
        return ft.with_target(ft.min_history(self.series()))

    def folded(self):
        return fc.walk_forward_folds(self.labelled(), FOLDS)

    def supplier_terms(self):
        return self.dim_products().select("product_id", "supplier_id").join(self.mart_supplier_performance().select("supplier_id", "avg_actual_lead_time_days", "calculated_on_time_rate"), "supplier_id")

    def pair_latest_inventory(self):
        """The last snapshot of each pair, unknown and negative stock as none; the fixture's series end on different days."""
        rows = self.fct_inventory_snapshots().groupBy("store_id", "product_id").agg(F.max_by(F.struct("quantity_on_hand", "quantity_on_order"), "snapshot_date").alias("x"))
        known = {c: F.greatest(F.lit(0), F.coalesce(F.col(f"x.{c}"), F.lit(0))).alias(c) for c in ("quantity_on_hand", "quantity_on_order")}
        return rows.select("store_id", "product_id", *known.values())

    def reorder(self):
        """What baselines and deviations need are the last 14 labelled rows of each series and the open one after them."""
        rows = written(fc.last_rows(self.labelled(), 15), "last-rows")
        return reorder.reorder_recommendations(fc.baseline_forecasts(rows), self.pair_latest_inventory(), self.supplier_terms(), reorder.demand_std(rows), recommendation_date=AS_OF)


MODELS = "stg_products stg_stores stg_suppliers stg_sales stg_inventory stg_shipments dim_products dim_stores dim_date fct_daily_sales fct_inventory_snapshots mart_supplier_performance stg_train stg_test stg_holidays stg_oil stg_items stg_grocery_stores stg_transactions mart_store_daily_sales avg_daily_demand latest_inventory stockout_risk feat_matrix reorder".split()


def _on_mart(f: Callable[[DataFrame], DataFrame]) -> Callable[[Retail], DataFrame]:
    return lambda r: f(r.mart_store_daily_sales())


def _union(mart: DataFrame) -> DataFrame:
    """All nine analyses of one mart, which is built once."""
    return an.union_reports([f(mart) for f in (an.an_summary, an.an_top_stores, an.an_weekend, an.an_monthly, an.an_holiday, an.an_store_type, an.an_wage_days, an.an_event_period, an.an_returns)])


def _over_matrix(r: Retail, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f of the feature matrix, which is built once whatever f reads of it; f's result must not read it any more."""
    rows = written(r.feat_matrix(), "features")
    try:
        return f(rows)
    finally:
        drop_written(rows)


def _gbt(r: Retail, params: Mapping | None = None, folds: Sequence = FOLDS, horizons: Sequence[int] = fc.HORIZONS, **columns) -> DataFrame:
    """The walk-forward evaluation of the boosted model on every fold and horizon; small settings are for tests."""
    return _over_matrix(r, lambda rows: fc.walk_forward_eval(rows, params, folds, horizons, **columns))


def _forecasts(r: Retail, params: Mapping | None = None, horizons: Sequence[int] = fc.HORIZONS, **columns) -> DataFrame:
    rows = written(r.feat_matrix(), "features")
    return fc.generate_forecasts(fc.train_horizons(rows, params, horizons, **columns), rows)


def _importance(r: Retail, params: Mapping | None = None, horizons: Sequence[int] = fc.HORIZONS, **columns) -> DataFrame:
    """(horizon, feature, importance) of every feature in each horizon's model."""
    rows, out = written(r.feat_matrix(), "features"), None
    for h, model in fc.train_horizons(rows, params, horizons, **columns).items():
        part = fc.feature_importance(model, rows, len(model.features)).select(F.lit(h).alias("horizon"), "feature", "importance")
        out = part if out is None else out.unionByName(part)
    return out


def _importance_report(r: Retail, params: Mapping | None = None, folds: Sequence = FOLDS, **columns) -> DataFrame:
    """The report on the first horizon's model, fitted on the best fold's training rows; no row if no fold has rows to validate on."""

    def best_train(rows: DataFrame) -> DataFrame:
        folded = fc.of_best_fold(fc.walk_forward_folds(rows, folds))
        return written(folded.where("part = 'train'").drop("fold", "part"), "best-fold")

    train = _over_matrix(r, best_train)
    if train.isEmpty():
        return r.spark.createDataFrame([], "scope string, feature string, value double")
    (model,) = fc.train_horizons(train, params, (1,), **columns).values()
    return fc.importance_report(model, train, **({"features": columns["numeric"]} if "numeric" in columns else {}))


#: Settings that tune() draws from.
SPACE = {"maxDepth": (2, 3, 4, 5), "stepSize": (0.05, 0.1, 0.2), "minInstancesPerNode": (1, 5, 20), "subsamplingRate": (0.5, 0.8, 1.0), "featureSubsetStrategy": ("0.5", "0.8", "all")}


def _tuned(r: Retail, trials: int = 24, horizons: Sequence[int] = fc.HORIZONS, fixed: Mapping | None = None, folds: Sequence = FOLDS, trees: int = 20, **columns) -> DataFrame:
    """A search over 24 draws; the finalists are fitted with the final fit's trees on every fold and horizon."""
    space = {**SPACE, **{k: (v,) for k, v in (fixed or {}).items()}}
    return _over_matrix(r, lambda rows: fc.tune(rows, space, trials, folds, horizons, trees=trees, **columns))


def _codes(r: Retail) -> DataFrame:
    """The ordered codes of every labelled row."""
    columns = ("store_id", "product_id", "region")
    return with_ordered_codes(r.labelled(), columns).select("date", "store_id", "product_id", *map(code_name, columns))


def _final_codes(r: Retail) -> DataFrame:
    return fit_codes(r.labelled(), ("store_id", "product_id", "region")).table


#: The rule set of shipments, but for the parents of their keys.
SHIPMENT_RULES = (
    Rule("not_null", ("shipment_id",)), Rule("not_null", ("received_date",), "warn"), Rule("not_null", ("supplier_id",)),
    Rule("accepted_range", ("quantity_ordered",), low=1, high=40), Rule("date_range", ("order_date",), "warn", low="1996-01-01", high="2000-12-31"), Rule("condition", ("fill_rate",), sql="fill_rate <= 1"),
    Rule("accepted_values", ("store_id",), "warn", values=tuple(map(str, range(20)))),
)


def _shipment_rules(r: Retail) -> list[Rule]:
    keys = [Rule("unique", ("shipment_id",)), Rule("unique_combination", ("store_id", "product_id", "order_date"), "warn")]
    parents = [Rule("relationships", ("supplier_id",), "warn", parent=r.stg_suppliers().where("supplier_id <> '3'"), parent_col="supplier_id"), Rule("relationships", ("store_id",), parent=r.stg_stores(), parent_col="store_id")]
    return [*SHIPMENT_RULES, *keys, *parents]


def _observed(r: Retail) -> DataFrame:
    """The row rules of shipments, counted while they are written."""
    seen = Observed(r.stg_shipments(), SHIPMENT_RULES, "stg_shipments")
    write_mart(seen.df, fresh_path(r.spark, "observed"))
    return seen.results()


def _daily_bias(r: Retail) -> DataFrame:
    rows = fc.baselines(r.folded()).where("baseline = 'naive'")
    return fc.forecast_metrics(rows, ["date"]).select("date", "bias")


def _wape_alarm(r: Retail) -> DataFrame:
    rows = fc.baselines(r.folded())
    return monitoring.wape_alarm(fc.forecast_metrics(rows.where("baseline = 'naive'"), ["date"]), fc.forecast_metrics(rows.where("baseline = 'rolling_mean'"), ["date"]), 1.2)


def _val_with_seasonal(r: Retail) -> tuple[DataFrame, DataFrame]:
    folded = r.folded().withColumn("has_discount", (F.coalesce(F.col("discount_amount"), F.lit(0)) > 0).cast("int"))
    folded = fc.of_best_fold(folded)
    train, val = folded.where("part = 'train'"), folded.where("part = 'val'")
    return train, val.join(fc.baseline_values(train).select("store_id", "product_id", F.col("seasonal_naive").alias("forecast")), ["store_id", "product_id"])


def _segments(r: Retail) -> DataFrame:
    train, scored = _val_with_seasonal(r)
    return fc.segment_errors(scored, fc.demand_levels(train))


def _deploy_gate(r: Retail) -> DataFrame:
    rows = fc.baselines(r.folded())
    of = {n: fc.forecast_metrics(rows.where(F.col("baseline") == n), ["fold"]) for n in ("rolling_mean", "seasonal_naive")}
    return fc.forecast_value_added(of["rolling_mean"], of["seasonal_naive"], ["fold"])


def _ks(r: Retail) -> DataFrame:
    rows = ft.with_lags(r.series(), (7,))
    return monitoring.ks_distance(rows.where("date < DATE'1998-06-01'"), rows.where("date >= DATE'1998-06-01'"), "lag_7")


def _features(columns: str, *steps: Callable[[DataFrame], DataFrame]) -> Callable[[Retail], DataFrame]:
    def build(r: Retail) -> DataFrame:
        rows = ft.min_history(r.series())
        for s in steps:
            rows = s(rows)
        return rows.select("date", "store_id", "product_id", *columns.split())

    return build


BUILDERS: dict[str, Callable[[Retail], DataFrame]] = {
    **{name: (lambda r, name=name: getattr(r, name)()) for name in MODELS},
    "an_summary": _on_mart(an.an_summary), "an_top_stores": _on_mart(an.an_top_stores), "an_weekend": _on_mart(an.an_weekend), "an_monthly": _on_mart(an.an_monthly), "an_holiday": _on_mart(an.an_holiday),
    "an_store_type": _on_mart(an.an_store_type), "an_wage_days": _on_mart(an.an_wage_days), "an_event_period": _on_mart(an.an_event_period), "an_returns": _on_mart(an.an_returns),
    "r_summary": _on_mart(an.r_summary), "r_top_stores": _on_mart(an.r_top_stores), "r_weekend": _on_mart(an.r_weekend),
    "an_union": _on_mart(lambda m: _union(written(m, "mart"))),
    "recs_by_tier": lambda r: reorder.sort_by_tier(r.reorder()), "quadrant_list": lambda r: risk.list_quadrants(risk.supplier_quadrants(r.mart_supplier_performance())),
    "series_of_region": lambda r: ft.restrict_keys(ft.min_history(r.series()), r.stg_stores().where("region = 'EUROPE'").select("store_id")).select("date", "store_id", "product_id", "quantity_sold"),
    "horizon_rows": lambda r: fc.horizon_dataset(r.labelled(), 3).select("date", "store_id", "product_id", "target", "target_h"),
    "features_filled": lambda r: ft.fill_features(r.feat_matrix()).select("date", "store_id", "product_id", *ft.NUMERIC),
    "clean_names": lambda r: st.clean_names(r.raw("raw_stores").toDF(" Store ID", "STORE-Name", "Region", "Store.Type", "Sq Footage", "Opened Date")),
    "dq_rules": lambda r: check_table(r.stg_shipments(), _shipment_rules(r), "stg_shipments"), "dq_observed": _observed,
    "dq_not_null": lambda r: quality.not_null(r.stg_shipments(), ["shipment_id", "received_date", "supplier_id"], "stg_shipments"),
    "dq_unique": lambda r: quality.unique(r.raw("raw_shipments"), "shipment_id", "raw_shipments", "warn"),
    "dq_unique_combo": lambda r: quality.unique_combination(r.raw("raw_train"), ["date", "store_nbr", "item_nbr"], "raw_train"),
    "dq_accepted_values": lambda r: quality.accepted_values(r.raw("raw_products"), "is_active", ["True", "False", "true", "false"], "raw_products"),
    "dq_relationships": lambda r: quality.relationships(r.stg_products(), "supplier_id", r.stg_suppliers(), "supplier_id", "stg_products"),
    "dq_range": lambda r: quality.accepted_range(r.stg_inventory(), "quantity_on_hand", 0, 50, "stg_inventory"),
    "dq_date_range": lambda r: quality.date_range(r.stg_sales(), "sale_date", "1996-01-01", "2000-12-31", "stg_sales"),
    "dq_availability": lambda r: quality.availability({"stg_sales": r.stg_sales(), "stg_stores": r.stg_stores(), "stg_empty": r.stg_sales().where("false"), "stg_absent": None}),
    "dq_pk": lambda r: quality.pk_check(r.raw("raw_shipments"), ["shipment_id", "received_date"], "raw_shipments"),
    "dq_coverage": lambda r: quality.coverage_audit({"sales": (r.stg_sales(), "sale_date"), "inventory": (r.stg_inventory(), "snapshot_date"), "transactions": (r.stg_transactions(), "date")}),
    "dq_missing_days": lambda r: quality.missing_days({"sales": (r.stg_sales(), "sale_date"), "transactions": (r.stg_transactions(), "date")}),
    "dq_partition_dates": lambda r: quality.partition_dates({"sales": r.stg_sales().select(F.col("sale_date").alias("dt")), "transactions": r.stg_transactions().select(F.col("date").alias("dt"))}),
    "dq_freshness": lambda r: quality.freshness(r.stg_sales(), "sale_date", "2001-10-01", 30),
    "dq_profile": lambda r: quality.column_profile(r.stg_sales(), ["store_id", "quantity_sold", "discount_amount"]),
    "dq_defects": lambda r: quality.defect_summary(r.raw("raw_sales"), r.raw("raw_inventory"), r.raw("raw_stores"), r.raw("raw_shipments")),
    "risk_summary": lambda r: risk.risk_summary(r.stockout_risk()), "top_risk": lambda r: risk.top_risk(r.stockout_risk()), "supplier_quadrants": lambda r: risk.supplier_quadrants(r.mart_supplier_performance()),
    "feat_lags": _features("lag_1 lag_7 lag_14 lag_28 target", ft.with_lags, ft.with_target),
    "feat_rolling": _features(" ".join(f"roll_{s}_{w}" for w in (7, 14, 28) for s in ("mean", "std", "min", "max")), ft.with_rolling),
    "feat_ewm": _features("ewm_mean_7 ewm_mean_14", ft.with_ewm),
    "feat_trend": _features("demand_trend_14d", ft.with_trend),
    "feat_promo": _features("has_discount discount_pct price_vs_30d_avg days_since_period_start", ft.with_price_ratio, ft.with_promo),
    "feat_inventory": lambda r: ft.stockout_frequency(r.fct_inventory_snapshots()).select("snapshot_date", "store_id", "product_id", "quantity_on_hand", "stockout_freq_14d"),
    "feat_region": _features("region region_avg_demand_7d", ft.with_lags, ft.region_features),
    "wf_folds": lambda r: fc.fold_counts(r.folded()), "baselines": lambda r: fc.baselines(r.folded()), "forecast_metrics": lambda r: fc.forecast_metrics(fc.baselines(r.folded()), ["fold", "baseline"]),
    "segment_errors": _segments, "deploy_gate": _deploy_gate, "best_fold": lambda r: fc.best_fold(r.folded()),
    "gbt_walk_forward": _gbt, "gbt_forecasts": _forecasts, "gbt_importance": _importance, "gbt_importance_report": _importance_report, "gbt_tune": _tuned, "feat_codes": _codes, "codes_table": _final_codes,
    "run_metadata": lambda r: fc.run_metadata(r.labelled(), model_version="rolling_mean_7"),
    "demand_std": lambda r: reorder.demand_std(r.labelled()), "tier_counts": lambda r: reorder.tier_counts(r.reorder()), "top_recs": lambda r: reorder.top_recs(r.reorder()),
    "ks_drift": _ks, "bias_drift": lambda r: monitoring.bias_drift(_daily_bias(r)), "wape_alarm": _wape_alarm, "missing_pairs": lambda r: monitoring.missing_pairs(r.stg_inventory(), "snapshot_date"),
    "eda_describe": lambda r: an.describe_by(r.fct_daily_sales(), "category", "total_quantity_sold"), "eda_histogram": lambda r: an.histogram(r.fct_daily_sales(), "total_quantity_sold", 50), "eda_histogram_log": lambda r: an.histogram(r.fct_daily_sales(), "total_quantity_sold", 30, "category", True),
    "eda_pivot": lambda r: an.pivot_metric(fc.forecast_metrics(fc.baselines(r.folded()), ["fold", "baseline"]), "fold", "baseline", "wape", ["naive", "rolling_mean", "seasonal_naive"]),
    "eda_stockout_rate": lambda r: an.stats_by(r.fct_inventory_snapshots().withColumn("out", F.coalesce(F.col("is_out_of_stock"), F.lit(False)).cast("int")), ["category"], "out", ("mean", "count")),
    "eda_discount": lambda r: an.stats_by(r.fct_daily_sales().withColumn("has_discount", F.coalesce((F.col("total_discount_amount") > 0).cast("int"), F.lit(0))), ["has_discount"], "total_quantity_sold", ("mean", "median", "count")),
    "eda_weekend": lambda r: an.stats_by(r.fct_daily_sales(), ["is_weekend"], "total_quantity_sold"), "eda_dow": lambda r: an.stats_by(r.fct_daily_sales(), ["category", "day_of_week"], "total_quantity_sold", ("mean", "count")),
    "eda_distinct": lambda r: an.distinct_count(r.stg_sales(), ["store_id", "product_id"]), "eda_duplicates": lambda r: an.duplicate_keys(r.raw("raw_shipments").select("shipment_id"), ["shipment_id"]), "eda_values": lambda r: an.value_counts(r.stg_stores(), "store_size_category"), "eda_rolling": lambda r: an.daily_total_rolling(r.fct_daily_sales()),
}


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, doubles to 6 places: the form in which results are compared."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("decimal") or kind in ("double", "float"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)  # no negative zero
        out.append(c.alias(name))
    return df.select(*out)


def queries(builders: dict[str, Callable[[Retail], DataFrame]] = BUILDERS) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, build=build: _plain(build(Retail(spark, sf_dir)))) for name, build in builders.items()}


