"""Dimensions, facts and marts of the retail and the grocery model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.scalars import at_least, fiscal_month, fiscal_year, iso_weekday, ratio, season
from larder.operators.staging import calendar_parts


def dim_products(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    s = suppliers.select("supplier_id", "supplier_name", "lead_time_category", "on_time_delivery_rate", "on_time_performance_tier", F.col("country").alias("supplier_country"))
    return products.join(s, "supplier_id", "left").select("product_id", "product_name", "category", "unit_cost", "unit_price", "unit_gross_margin", "unit_margin_pct", "is_active", "supplier_id", "supplier_name", "lead_time_category", "on_time_delivery_rate", "on_time_performance_tier", "supplier_country")


def dim_stores(stores: DataFrame) -> DataFrame:
    """Geography, format and size of each store."""
    return stores.select("store_id", "store_name", "region", "store_type", "store_size_category", "square_footage", "opened_date", "store_age_years")


def date_bounds(columns: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """(lo, hi): the least and greatest date over several tables; a table without dates does not count."""
    parts = [df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")) for df, c in columns]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def date_spine(bounds: DataFrame) -> DataFrame:
    return bounds.where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("date_day"))


def dim_date(columns: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    d = F.col("date_day")
    return date_spine(date_bounds(columns)).select(
        "date_day", F.year(d).alias("year"), F.month(d).alias("month"), F.day(d).alias("day"), iso_weekday(d).alias("day_of_week"), F.quarter(d).alias("quarter"), F.weekofyear(d).alias("week_of_year"),
        F.date_format(d, "EEEE").alias("day_name"), F.date_format(d, "MMMM").alias("month_name"), iso_weekday(d).isin(6, 7).alias("is_weekend"), season(F.month(d)).alias("season"), fiscal_year(d).alias("fiscal_year"), fiscal_month(d).alias("fiscal_month"),
    )


def enrich(fact: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """A fact with columns of its store and its product; dimensions are small, and Spark broadcasts them when their measured size allows."""
    return fact.join(stores, "store_id", "left").join(products, "product_id", "left")


def fct_daily_sales(sales: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """One row per day, store and product.  Only these three are grouping keys; date parts follow from the day.

    Gross leaves out rows without a discount, as sum(total + discount) does.
    """
    daily = sales.groupBy("sale_date", "store_id", "product_id").agg(
        F.countDistinct("sale_id").alias("transaction_count"), F.sum("quantity_sold").alias("total_quantity_sold"),
        F.sum(F.col("total_amount") + F.col("discount_amount")).alias("total_gross_amount"), F.sum("discount_amount").alias("total_discount_amount"), F.sum("total_amount").alias("total_net_amount"),
        F.avg(F.col("unit_price").cast("double")).alias("avg_unit_price"), F.avg("discount_rate").alias("avg_discount_rate"), F.min("unit_price").alias("min_unit_price"), F.max("unit_price").alias("max_unit_price"),
    )
    cost = F.col("total_quantity_sold") * F.col("unit_cost")
    rows = enrich(daily, stores.select("store_id", "store_name", "region", "store_type", "store_size_category"), products.select("product_id", "product_name", "category", "unit_cost", "supplier_name"))
    rows = rows.withColumn("total_cost", cost).withColumn("total_profit", F.col("total_net_amount") - F.col("total_cost"))
    return rows.select(
        "sale_date", "store_id", "product_id", *calendar_parts(F.col("sale_date")), "transaction_count", "total_quantity_sold", "total_gross_amount", "total_discount_amount", "total_net_amount",
        "avg_unit_price", "avg_discount_rate", "min_unit_price", "max_unit_price", "store_name", "region", "store_type", "store_size_category", "product_name", "category", "unit_cost", "supplier_name",
        "total_cost", "total_profit", ratio(F.col("total_profit"), F.col("total_net_amount")).alias("profit_margin"),
    )


def fct_inventory_snapshots(inventory: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    rows = enrich(inventory, stores.select("store_id", "store_name", "region", "store_type"), products.select("product_id", "product_name", "category", "unit_cost", "unit_price"))
    clipped = at_least(F.col("quantity_on_hand"), 0)
    return rows.select(
        "snapshot_date", "store_id", "product_id", "store_name", "region", "store_type", "product_name", "category", "unit_cost", "unit_price", "quantity_on_hand", clipped.alias("quantity_on_hand_clipped"), "quantity_on_order",
        "total_available_quantity", "reorder_point", "days_since_restock", (F.col("quantity_on_hand") * F.col("unit_cost")).alias("inventory_value_at_cost"), (clipped * F.col("unit_cost")).alias("inventory_value_at_cost_clipped"), "is_out_of_stock", "needs_reorder", "is_slow_moving",
    )


def mart_supplier_performance(shipments: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Delivery figures per supplier; suppliers without shipments keep NULL figures.  Shipment ids are unique after staging, so plain counts do."""
    m = shipments.groupBy("supplier_id").agg(
        F.count("shipment_id").alias("total_shipments"), F.count_if("is_late").alias("late_shipments"), F.count_if("is_partial_shipment").alias("partial_shipments"), F.count_if("is_delayed").alias("delayed_shipments"),
        F.avg("actual_lead_time_days").alias("avg_actual_lead_time_days"), F.avg("expected_lead_time_days").alias("avg_expected_lead_time_days"), F.avg("days_late").alias("avg_days_late"), F.avg("fill_rate").alias("avg_fill_rate"),
        ratio(F.count_if(~F.col("is_late")), F.count("*")).alias("calculated_on_time_rate"),
        F.sum("quantity_ordered").alias("total_quantity_ordered"), F.sum("quantity_received").alias("total_quantity_received"), F.sum("quantity_variance").alias("total_quantity_variance"),
    )
    rate = F.col("on_time_delivery_rate").cast("double")
    rows = attach_metrics(suppliers.select("supplier_id", "supplier_name", "country", "lead_time_category", "on_time_performance_tier", "on_time_delivery_rate"), m, "supplier_id")
    return rows.withColumns({"master_on_time_rate": rate, "on_time_rate_variance": F.col("calculated_on_time_rate") - rate}).drop("on_time_delivery_rate")


def attach_metrics(dim: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    return dim.join(metrics, key, "left")


def store_transactions(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("date", "store_nbr").agg(F.sum("transactions").alias("transactions_count"))


def holiday_flags(holidays: DataFrame, locales: Sequence[str] = ("National", "Regional")) -> DataFrame:
    rows = holidays.where(F.col("is_actual_holiday") & F.col("holiday_locale").isin(*locales))
    return rows.groupBy(F.col("holiday_date").alias("date")).agg(F.bool_or("is_actual_holiday").alias("is_holiday"))


def enrich_store_day(daily: DataFrame, stores: DataFrame, transactions: DataFrame, holidays: DataFrame) -> DataFrame:
    return daily.join(stores, "store_nbr", "left").join(transactions, ["date", "store_nbr"], "left").join(holidays, "date", "left")


def mart_store_daily_sales(train: DataFrame, stores: DataFrame, transactions: DataFrame, holidays: DataFrame) -> DataFrame:
    """One row per day and store; holidays count for every store."""
    u, promoted = F.col("unit_sales"), F.col("onpromotion")
    measures = {
        "total_units_sold": u, "returned_units": F.when(F.col("is_return"), F.abs(u)).otherwise(0.0), "sold_units": F.when(F.col("is_return"), 0.0).otherwise(u),
        "promo_units": F.when(promoted, u).otherwise(0.0), "nonpromo_units": F.when(promoted, 0.0).otherwise(u),
    }
    flags = [F.bool_or(c).alias(c) for c in ("is_wage_day", "is_event_period")]
    # A row an item first: both counts of distinct items are then plain counts, and no row is multiplied for them.
    items = train.groupBy("date", "store_nbr", "item_nbr").agg(F.count("*").alias("lines"), *[F.sum(c).alias(n) for n, c in measures.items()], F.count_if("onpromotion").alias("promoted"), *flags)
    daily = items.groupBy("date", "store_nbr").agg(
        F.count("item_nbr").alias("unique_item_types_sold"), F.sum("lines").alias("line_items"), *[F.sum(n).alias(n) for n in measures],
        F.sum("promoted").alias("items_on_promo"), F.count_if(F.col("item_nbr").isNotNull() & (F.col("promoted") > 0)).alias("distinct_items_on_promo"), *flags,
    )
    d = F.col("date")
    rows = enrich_store_day(daily, stores, store_transactions(transactions), holiday_flags(holidays))
    return rows.select(
        d.alias("saledate"), "store_nbr", "city", "state", "store_type", "store_cluster", "unique_item_types_sold", "line_items", "total_units_sold", "returned_units", "sold_units", F.coalesce("transactions_count", F.lit(0)).alias("transactions_count"),
        "promo_units", "nonpromo_units", "items_on_promo", "distinct_items_on_promo", F.year(d).alias("year"), F.month(d).alias("month"), F.day(d).alias("day"), (F.dayofweek(d) - 1).alias("day_of_week"), "is_wage_day", "is_event_period",
        F.date_format(d, "EEEE").alias("day_name"), F.coalesce("is_holiday", F.lit(False)).alias("is_holiday"),
    )
