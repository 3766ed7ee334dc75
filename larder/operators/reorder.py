"""Reorder quantities from forecasts, stock, supplier figures and the deviation of demand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.scalars import effective_lead
from larder.operators.analyses import top_n
from larder.operators.features import SERIES
from larder.operators.forecasting import last_rows

SERVICE_Z = 1.65
TIERS = ("Critical", "High", "Medium", "Low")


def demand_std(features: DataFrame, n: int = 14) -> DataFrame:
    """Sample deviation of the last n labelled targets of each series."""
    return last_rows(features.where("target IS NOT NULL"), n).groupBy(*SERIES).agg(F.stddev_samp(F.col("target").cast("double")).alias("demand_std_14d"))


def reorder_inputs(forecasts: DataFrame, inventory: DataFrame, suppliers: DataFrame, deviations: DataFrame) -> DataFrame:
    """One row per series with an array of its forecasts; series without stock or supplier rows drop out."""
    by_h = forecasts.groupBy(*SERIES).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("horizon_day", "predicted_quantity")))).alias("f"), F.max("forecast_generated_date").alias("inference_date"))
    return by_h.join(inventory.select(*SERIES, "quantity_on_hand", "quantity_on_order"), list(SERIES)).join(suppliers, "product_id").join(deviations, list(SERIES), "left")


def reorder_recommendations(forecasts: DataFrame, inventory: DataFrame, suppliers: DataFrame, deviations: DataFrame, horizons: int = 7, recommendation_date: str | None = None) -> DataFrame:
    """Order quantities; suppliers: (product_id, supplier_id, avg_actual_lead_time_days, calculated_on_time_rate).

    recommendation_date: the day the recommendations are made for, stated by the caller; without it the inference date.
    Days beyond the last horizon count with the first day's forecast.  An unknown deviation is 0; with an unknown lead time
    or rate the row stays, with tier NULL and a reason.
    """
    rows = reorder_inputs(forecasts, inventory, suppliers, deviations)
    lead, rate = F.col("avg_actual_lead_time_days"), F.col("calculated_on_time_rate")
    first = F.element_at("f", F.lit(1))
    rows = rows.withColumns({"eff": effective_lead(lead, rate), "sigma": F.coalesce("demand_std_14d", F.lit(0.0)), "f1": first})
    rows = rows.withColumn("days", F.greatest(F.lit(1.0), F.bround("eff", 0)))
    ahead = [F.when(F.col("days") >= h, F.coalesce(F.element_at("f", F.lit(h)), F.col("f1"))).otherwise(0.0) for h in range(1, horizons + 1)]
    total = ahead[0]
    for a in ahead[1:]:
        total = total + a
    rows = rows.withColumn("over_lead", F.when(F.col("eff").isNotNull(), total + F.greatest(F.col("days") - horizons, F.lit(0.0)) * F.col("f1")))
    rows = rows.withColumn("safety", F.lit(SERVICE_Z) * F.col("sigma") * F.sqrt("eff")).withColumn("rop", F.col("over_lead") + F.col("safety"))
    out = rows.select(
        *SERIES, (F.lit(recommendation_date).cast("date") if recommendation_date else F.col("inference_date")).alias("recommendation_date"), "inference_date", F.col("quantity_on_hand").cast("double").alias("quantity_on_hand"), F.col("quantity_on_order").cast("double").alias("quantity_on_order"), F.bround("f1", 4).alias("daily_demand_forecast"),
        F.bround(F.col("quantity_on_hand") / F.greatest("f1", F.lit(0.01)), 2).alias("days_of_stock_remaining"), "supplier_id", F.bround(lead.cast("double"), 2).alias("avg_lead_time_days"), F.bround(rate.cast("double"), 4).alias("on_time_rate"), F.bround("eff", 2).alias("expected_lead_time_days"),
        F.bround("over_lead", 4).alias("forecast_demand_lead_time"), F.bround("sigma", 4).alias("demand_std_14d"), F.bround("safety", 4).alias("safety_stock"), F.bround("rop", 4).alias("reorder_point_ml"),
        F.bround(F.when(F.col("rop").isNotNull(), F.greatest(F.lit(0.0), F.col("rop") - F.col("quantity_on_hand") - F.col("quantity_on_order"))), 4).alias("recommended_order_qty"),
    )
    return out.withColumns({"risk_tier": risk_tier(), "reason": F.when(F.col("expected_lead_time_days").isNull(), "no supplier figures")})


def risk_tier() -> Column:
    """From the rounded columns of a recommendation."""
    hand = F.col("quantity_on_hand")
    tier = F.when(hand < F.col("safety_stock"), TIERS[0]).when(hand < F.col("reorder_point_ml"), TIERS[1]).when(F.col("days_of_stock_remaining") < F.col("expected_lead_time_days") * 1.5, TIERS[2]).otherwise(TIERS[3])
    return F.when(F.col("expected_lead_time_days").isNotNull(), tier)


def tier_rank(col: str = "risk_tier") -> Column:
    return F.coalesce(*[F.when(F.col(col) == t, F.lit(i)) for i, t in enumerate(TIERS)], F.lit(len(TIERS)))


def sort_by_tier(df: DataFrame) -> DataFrame:
    return df.orderBy(tier_rank(), "days_of_stock_remaining", *SERIES)


def top_recs(df: DataFrame, tiers: Sequence[str] = TIERS[:2], n: int = 10) -> DataFrame:
    return top_n(df.where(F.col("risk_tier").isin(*tiers)), [tier_rank().asc(), F.asc("days_of_stock_remaining"), *map(F.asc, SERIES)], n)


def tier_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("risk_tier").agg(F.count("*").alias("n"))


def with_fallback(recommendations: DataFrame, risk: DataFrame) -> DataFrame:
    """Pairs of the risk table without a recommendation, at the risk table's score, added to the recommendations."""
    rest = risk.join(recommendations.select(*SERIES), list(SERIES), "left_anti").select(*SERIES, "supplier_id", F.col("quantity_on_hand").cast("double").alias("quantity_on_hand"), F.col("days_of_stock_remaining"), F.lit("no forecast").alias("reason"))
    return recommendations.unionByName(rest, allowMissingColumns=True)
