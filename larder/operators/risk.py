"""Stock-out risk and supplier quadrants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.scalars import at_least, effective_lead
from larder.operators.analyses import medians, top_n
from larder.operators.ordering import with_rank
from larder.operators.staging import latest_rows, trailing_days


def avg_daily_demand(fact: DataFrame, days: int = 30) -> DataFrame:
    """Units per store and product over the trailing days, through `days` (the frame holds days + 1 dates)."""
    return trailing_days(fact, "sale_date", days).groupBy("store_id", "product_id").agg((F.sum("total_quantity_sold") / F.lit(float(days))).alias("avg_daily_demand"))


def latest_inventory(inventory: DataFrame) -> DataFrame:
    return latest_rows(inventory, "snapshot_date")


def stockout_risk(inventory: DataFrame, demand: DataFrame, products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Replenishment days less days of stock, for each row of the latest inventory; ranked, unknown scores last.

    Unknown quantities count as 0, so that a pair without a count ranks as out of stock.  No demand means infinitely many days of stock.  Ranks are found in ranges, so a snapshot of any size is never in one task.
    """
    rows = (
        inventory.select("store_id", "product_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("quantity_on_hand", "reorder_point", "quantity_on_order")], "is_out_of_stock", "needs_reorder")
        .join(demand, ["store_id", "product_id"], "left")
        .join(products.select("product_id", "product_name", "category", "supplier_id"), "product_id", "left")
        .join(suppliers.select("supplier_id", "supplier_name", "avg_actual_lead_time_days", "calculated_on_time_rate"), "supplier_id", "left")
    )
    rows = rows.withColumn("avg_daily_demand", F.coalesce("avg_daily_demand", F.lit(0.0)))
    stock = F.when(F.col("avg_daily_demand") > 0, at_least(F.col("quantity_on_hand"), 0) / F.col("avg_daily_demand")).otherwise(F.lit(float("inf")))
    rows = rows.withColumns({"days_of_stock_remaining": stock, "expected_replenishment_days": effective_lead(F.col("avg_actual_lead_time_days"), F.col("calculated_on_time_rate"))})
    rows = rows.withColumn("risk_score", F.col("expected_replenishment_days") - F.col("days_of_stock_remaining"))
    ranked = with_rank(rows, [F.desc_nulls_last("risk_score"), F.asc("store_id"), F.asc("product_id")], "risk_rank")
    return ranked.select(
        "risk_rank", "store_id", "product_id", "product_name", "category", "supplier_id", "supplier_name", "quantity_on_hand", "reorder_point", "quantity_on_order", "avg_daily_demand",
        "days_of_stock_remaining", "avg_actual_lead_time_days", "calculated_on_time_rate", "expected_replenishment_days", "risk_score", "is_out_of_stock", "needs_reorder",
    )


def risk_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n_scored"), F.count_if(F.col("quantity_on_hand") <= 0).alias("n_out_of_stock"), F.count_if(F.col("risk_score") > 0).alias("n_positive"))


def top_risk(scored: DataFrame, n: int = 25) -> DataFrame:
    return top_n(scored, [F.asc("risk_rank")], n)


def supplier_quadrants(suppliers: DataFrame) -> DataFrame:
    """Suppliers with both figures, by the medians of on-time and fill rate; the median itself counts as high."""
    rows = suppliers.where("calculated_on_time_rate IS NOT NULL AND avg_fill_rate IS NOT NULL")
    middle = medians(rows, ["calculated_on_time_rate", "avg_fill_rate"]).toDF("ot_median", "fill_median")
    prompt, full = F.col("calculated_on_time_rate") >= F.col("ot_median"), F.col("avg_fill_rate") >= F.col("fill_median")
    # The four labels.
    name = F.when(prompt & full, "Q1: Preferred").when(prompt, "Q2: Reliable but under-delivering").when(full, "Q3: Slow but complete").otherwise("Q4: Renegotiate or replace")
    return rows.join(F.broadcast(middle)).select("supplier_id", "supplier_name", "calculated_on_time_rate", "avg_fill_rate", "total_shipments", "late_shipments", name.alias("quadrant"))


def list_quadrants(quadrants: DataFrame) -> DataFrame:
    return quadrants.orderBy("quadrant", F.desc("calculated_on_time_rate"), "supplier_id")
