"""Demand features per store and product.  Series are indexed by observation: frames count rows, gaps are not filled.

All windows share the key (store, product), so a series is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.scalars import at_least, clipped

SERIES = ("store_id", "product_id")
EWM_BLOCK = 1000

# The names of the features.
NUMERIC = [
    "lag_1", "lag_7", "lag_14", "lag_28",
    *[f"roll_{s}_{w}" for w in (7, 14, 28) for s in ("mean", "std", "min", "max")],
    "ewm_mean_7", "ewm_mean_14", "demand_trend_14d", "has_discount", "discount_pct", "price_vs_30d_avg", "days_since_period_start", "day_of_week", "month_of_year", "is_weekend",
    "quantity_on_hand", "quantity_on_order", "reorder_point", "needs_reorder", "stockout_freq_14d", "days_of_stock_remaining",
    "avg_actual_lead_time_days", "calculated_on_time_rate", "avg_fill_rate", "region_avg_demand_7d",
]
CATEGORICAL = ["store_id", "product_id", "region", "store_type", "category"]
#: Columns of a daily sales fact that daily_series() reads.
DAILY = ["sale_date", *SERIES, "region", "store_type", "category", "is_weekend", "day_of_week", "total_quantity_sold", "avg_unit_price", "total_discount_amount", "total_net_amount"]
#: Columns of an inventory snapshot that with_snapshot() reads.
SNAPSHOT = ["snapshot_date", *SERIES, "quantity_on_hand", "quantity_on_order", "reorder_point", "needs_reorder", "is_out_of_stock"]


def series(order: str = "date", *more: str):
    return Window.partitionBy(*SERIES, *more).orderBy(order)


def min_history(df: DataFrame, n: int = 30) -> DataFrame:
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*SERIES))).where(F.col("__n") >= n).drop("__n")


def with_lags(df: DataFrame, ks: Sequence[int] = (1, 7, 14, 28), col: str = "quantity_sold") -> DataFrame:
    return df.withColumns({f"lag_{k}": F.lag(col, k).over(series()) for k in ks})


def with_rolling(df: DataFrame, ws: Sequence[int] = (7, 14, 28), col: str = "quantity_sold") -> DataFrame:
    """Mean, deviation, least and greatest of the w rows before; NULL until half of them are there, a deviation 0 then."""
    columns = {}
    for w in ws:
        frame = series().rowsBetween(-w, -1)
        enough = F.count(col).over(frame) >= max(1, w // 2)
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            columns[f"roll_{name}_{w}"] = F.when(enough, f(col).over(frame))
        columns[f"roll_std_{w}"] = F.coalesce(columns[f"roll_std_{w}"], F.lit(0.0))
    return df.withColumns(columns)


def with_ewm(df: DataFrame, spans: Sequence[int] = (7, 14), col: str = "quantity_sold", least: int = 3) -> DataFrame:
    """Exponentially weighted means of the rows before, weights adjusted to sum 1; NULL before `least` rows.

    A weighted sum of all earlier rows is a prefix sum of q * r^-k, scaled back by r^(k-1).  To keep r^-k finite, k counts
    within blocks of EWM_BLOCK rows, and a block takes over the closing sum of the one before; older ones have faded.
    """
    i = (F.row_number().over(series()) - 1).cast("int")
    df = df.withColumn("__i", i).withColumns({"__block": F.floor(F.col("__i") / EWM_BLOCK), "__k": F.col("__i") % EWM_BLOCK})
    block = series("date", "__block")
    before = block.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*SERIES, "__block")
    for span in spans:
        alpha = 2.0 / (span + 1)
        r = F.lit(1 - alpha)
        scaled = F.col(col) * F.pow(r, -F.col("__k"))
        df = df.withColumns({"__own": F.coalesce(F.sum(scaled).over(before), F.lit(0.0)) * F.pow(r, F.col("__k") - 1), "__close": F.sum(scaled).over(whole) * F.pow(r, F.lit(EWM_BLOCK - 1))})
        carried = F.when(F.col("__k") == 0, F.lag("__close").over(series()))
        df = df.withColumn("__carried", carried).withColumn("__carry", F.coalesce(F.max("__carried").over(whole), F.lit(0.0)))
        total = F.col("__own") + F.col("__carry") * F.pow(r, F.col("__k"))
        df = df.withColumn(f"ewm_mean_{span}", F.when(F.col("__i") >= least, total * alpha / (1 - F.pow(r, F.col("__i")))))
    return df.drop("__i", "__block", "__k", "__own", "__close", "__carried", "__carry")


def with_trend(df: DataFrame, n: int = 14, least: int = 5, col: str = "quantity_sold") -> DataFrame:
    """Least-squares slope per row over the n rows before; NULL before `least` of them."""
    frame = series().rowsBetween(-n, -1)
    df = df.withColumn("__x", F.row_number().over(series()).cast("double"))
    return df.withColumn(f"demand_trend_{n}d", F.when(F.count(col).over(frame) >= least, F.regr_slope(F.col(col).cast("double"), F.col("__x")).over(frame))).drop("__x")


def with_price_ratio(df: DataFrame, n: int = 30, least: int = 7) -> DataFrame:
    frame = series().rowsBetween(-n, -1)
    price = F.col("unit_price").cast("double")
    usual = F.when(F.count("unit_price").over(frame) >= least, F.avg(price).over(frame))
    return df.withColumn("price_vs_30d_avg", F.coalesce(F.try_divide(price, usual), F.lit(1.0)))


def with_promo(df: DataFrame) -> DataFrame:
    share = F.try_divide(F.col("discount_amount").cast("double"), (F.col("unit_price") * F.col("quantity_sold")).cast("double"))
    return df.withColumns({"has_discount": F.coalesce((F.col("discount_amount") > 0).cast("int"), F.lit(0)), "discount_pct": clipped(F.coalesce(share, F.lit(0.0)), 0.0, 1.0), "days_since_period_start": F.day("date") - 1})


def with_target(df: DataFrame, col: str = "quantity_sold") -> DataFrame:
    """The next observation's demand; NULL in a series' last row."""
    return df.withColumn("target", F.lead(col).over(series()))


def horizon_label(df: DataFrame, h: int) -> DataFrame:
    """The target h - 1 rows on.  To be called on a split, so that labels do not look beyond it."""
    return df.withColumn("target_h", F.lead("target", h - 1).over(series()) if h > 1 else F.col("target"))


def daily_series(fact: DataFrame) -> DataFrame:
    """Columns of a daily sales fact under the names the features use."""
    return fact.select(
        F.col("sale_date").alias("date"), "store_id", "product_id", "region", "store_type", "category", "is_weekend", "day_of_week", F.month("sale_date").alias("month_of_year"), F.day("sale_date").alias("day_of_month"),
        F.col("total_quantity_sold").alias("quantity_sold"), F.col("avg_unit_price").alias("unit_price"), F.col("total_discount_amount").alias("discount_amount"), F.col("total_net_amount").alias("net_amount"),
    )


def demand_features(rows: DataFrame, least_history: int = 30) -> DataFrame:
    rows = min_history(rows, least_history)
    return with_target(with_promo(with_price_ratio(with_trend(with_ewm(with_rolling(with_lags(rows)))))))


def stockout_frequency(inventory: DataFrame, n: int = 14) -> DataFrame:
    w = Window.partitionBy(*SERIES).orderBy("snapshot_date").rowsBetween(1 - n, 0)
    return inventory.withColumn("stockout_freq_14d", F.avg(F.col("is_out_of_stock").cast("double")).over(w))


def with_snapshot(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """The same day's snapshot and the share of stock-outs.

    Joined before the windows: rows and snapshots are grouped by the same three keys, so only the windows move rows again.
    """
    inv = stockout_frequency(inventory).select(*SERIES, F.col("snapshot_date").alias("date"), "quantity_on_hand", "quantity_on_order", "reorder_point", F.col("needs_reorder").cast("int").alias("needs_reorder"), "stockout_freq_14d")
    return rows.join(inv, [*SERIES, "date"], "left")


def with_days_of_stock(features: DataFrame) -> DataFrame:
    """Days of stock at the week's mean demand."""
    return features.withColumn("days_of_stock_remaining", at_least(F.col("quantity_on_hand"), 0) / at_least(F.col("roll_mean_7"), 0.01))


def region_demand(lagged: DataFrame, n: int = 7) -> DataFrame:
    """(region, product_id, date, region_avg_demand_7d): the region's mean of yesterday's demand per product, averaged over n days of the region's rows."""
    daily = lagged.groupBy("region", "product_id", "date").agg(F.avg("lag_1").alias("__lag"))
    w = Window.partitionBy("region", "product_id").orderBy("date").rowsBetween(1 - n, 0)
    return daily.select("region", "product_id", "date", F.avg("__lag").over(w).alias(f"region_avg_demand_{n}d"))


def region_features(features: DataFrame, lagged: DataFrame | None = None) -> DataFrame:
    """features with their region's demand; lagged: the narrow series (region, keys, date, lag_1) that it is aggregated from."""
    return features.join(region_demand(features if lagged is None else lagged), ["region", "product_id", "date"], "left")


def colocated_region_features(features: DataFrame, lagged: DataFrame) -> DataFrame:
    """region_features() for rows that lie by store and product: the demand is dealt to the narrow series and joined by its keys.

    So only (keys, date, value) are shuffled and the wide rows stay where they are; one row a store, product and day is assumed.
    Rows without a region have no demand of one.
    """
    dealt = lagged.join(region_demand(lagged), ["region", "product_id", "date"], "left").drop("region", "lag_1", "quantity_sold")
    return features.join(dealt, [*SERIES, "date"], "left")


def supplier_features(features: DataFrame, products: DataFrame, suppliers: DataFrame) -> DataFrame:
    s = products.select("product_id", "supplier_id").join(suppliers.select("supplier_id", "avg_actual_lead_time_days", "calculated_on_time_rate", "avg_fill_rate"), "supplier_id", "left")
    return features.join(s.drop("supplier_id"), "product_id", "left")


def build_features(fact: DataFrame, inventory: DataFrame, products: DataFrame, suppliers: DataFrame, least_history: int = 30, colocated: bool = False) -> DataFrame:
    """The full matrix; rows of the first 28 observations of a series are trimmed, a NULL target marks the row to forecast from.

    colocated: fact and inventory are tables bucketed by SERIES, and the region's demand comes to them instead of the reverse.
    """
    rows = daily_series(fact)
    narrow = with_lags(min_history(rows.select(*SERIES, "date", "region", "quantity_sold"), least_history), (1,))
    features = with_days_of_stock(demand_features(with_snapshot(rows, inventory), least_history))
    regional = colocated_region_features if colocated else region_features
    return trim_warmup(supplier_features(regional(features, narrow), products, suppliers))


def trim_warmup(df: DataFrame) -> DataFrame:
    return df.where("lag_28 IS NOT NULL")


def fill_features(df: DataFrame) -> DataFrame:
    """Numeric features as doubles, NULL as 0."""
    have = [c for c in NUMERIC if c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in have})


def restrict_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, list(keys.columns), "left_semi")


