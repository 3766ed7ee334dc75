"""Staging: typed, cleaned rows from all-text raw tables.  Every function is a lazy projection or filter."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.scalars import day, flag, iso_weekday, money, number, ratio, sunday_weekday, text


def clean_names(df: DataFrame) -> DataFrame:
    """Column names in snake case; repeated ones get a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = re.sub(r"[^0-9a-z]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", c).lower()).strip("_") or "x"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def stg_products(raw: DataFrame) -> DataFrame:
    rows = raw.withColumns({"cost": money("unit_cost"), "price": money("unit_price")})
    margin = F.col("price") - F.col("cost")
    return rows.select("product_id", "product_name", "category", F.col("cost").alias("unit_cost"), F.col("price").alias("unit_price"), margin.alias("unit_gross_margin"), ratio(margin, F.col("price")).alias("unit_margin_pct"), "supplier_id", flag("is_active").alias("is_active"))


def stg_stores(raw: DataFrame, as_of: str) -> DataFrame:
    """as_of: the day at which a store's age counts, in whole years."""
    opened = day("opened_date")
    size = F.when(F.col("store_type") == "Superstore", "Large").when(F.col("store_type") == "Standard", "Medium").when(F.col("store_type") == "Express", "Small").otherwise("Unknown")
    age = F.floor(F.months_between(F.lit(as_of).cast("date"), opened) / 12).cast("int")
    return raw.select("store_id", "store_name", F.coalesce(text("region"), F.lit("Unknown")).alias("region"), "store_type", number("sq_footage", "int").alias("square_footage"), opened.alias("opened_date"), size.alias("store_size_category"), age.alias("store_age_years"))


def stg_suppliers(raw: DataFrame) -> DataFrame:
    rows = raw.withColumns({"days": number("lead_time_days", "int"), "rate": number("on_time_rate", "decimal(5,3)")})
    speed = F.when(F.col("days") <= 7, "Fast").when(F.col("days") <= 14, "Standard").otherwise("Slow")
    tier = F.when(F.col("rate") >= 0.95, "Excellent").when(F.col("rate") >= 0.85, "Good").when(F.col("rate") >= 0.75, "Fair").otherwise("Poor")
    return rows.select("supplier_id", "supplier_name", "country", F.col("days").alias("lead_time_days"), F.col("rate").alias("on_time_delivery_rate"), speed.alias("lead_time_category"), tier.alias("on_time_performance_tier"))


def stg_sales(raw: DataFrame) -> DataFrame:
    """Sales with a date, store, product and a positive quantity."""
    rows = raw.withColumns({"sale_date": day("sale_date"), "quantity_sold": number("quantity_sold", "int"), "unit_price": money("unit_price"), "discount_amount": money("discount_amount"), "total_amount": money("total_amount")})
    rows = rows.where("sale_date IS NOT NULL AND store_id IS NOT NULL AND product_id IS NOT NULL AND quantity_sold > 0")
    d, discount = F.col("sale_date"), F.coalesce("discount_amount", F.lit(0))
    return rows.select(
        "sale_id", "sale_date", "store_id", "product_id", "quantity_sold", "unit_price", "discount_amount", "total_amount",
        ratio(discount, F.coalesce("total_amount", F.lit(0)) + discount).alias("discount_rate"),
        *calendar_parts(d),
    )


def calendar_parts(d: Column) -> list[Column]:
    return [F.year(d).alias("sale_year"), F.month(d).alias("sale_month"), F.day(d).alias("sale_day"), iso_weekday(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), iso_weekday(d).isin(6, 7).alias("is_weekend")]


def stg_inventory(raw: DataFrame) -> DataFrame:
    rows = raw.withColumns({"snapshot_date": day("snapshot_date"), "quantity_on_hand": number("quantity_on_hand", "int"), "quantity_on_order": number("quantity_on_order", "int"), "reorder_point": number("reorder_point", "int"), "last_restock_date": day("last_restock_date")})
    rows = rows.where("snapshot_date IS NOT NULL AND store_id IS NOT NULL AND product_id IS NOT NULL")
    on_hand, age = F.coalesce("quantity_on_hand", F.lit(0)), F.datediff("snapshot_date", "last_restock_date")
    return rows.select(
        "snapshot_date", "store_id", "product_id", "quantity_on_hand", "quantity_on_order", "reorder_point", "last_restock_date",
        (on_hand + F.coalesce("quantity_on_order", F.lit(0))).alias("total_available_quantity"), age.alias("days_since_restock"),
        (on_hand == 0).alias("is_out_of_stock"), (on_hand <= F.coalesce("reorder_point", F.lit(0))).alias("needs_reorder"), F.coalesce(age > 60, F.lit(False)).alias("is_slow_moving"), F.col("dt").alias("partition_date"),
    )


def stg_shipments(raw: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Typed shipments, the latest row of each id; `ties` are raw columns that complete the order."""
    rows = raw.where("shipment_id IS NOT NULL AND order_date IS NOT NULL").withColumns({**{c: day(c) for c in ("order_date", "expected_date", "received_date")}, **{c: number(c, "int") for c in ("quantity_ordered", "quantity_received")}})
    rows = dedup_latest(rows, ["shipment_id"], ["received_date", "expected_date", "order_date", "quantity_received", *ties])
    got, asked = F.col("quantity_received"), F.col("quantity_ordered")
    return rows.select(
        "shipment_id", "order_date", "expected_date", "received_date", "store_id", "product_id", "supplier_id", "quantity_ordered", "quantity_received",
        F.datediff("received_date", "order_date").alias("actual_lead_time_days"), F.datediff("expected_date", "order_date").alias("expected_lead_time_days"), F.datediff("received_date", "expected_date").alias("days_late"),
        (got - asked).alias("quantity_variance"), ratio(got, asked).alias("fill_rate"), flag("is_late").alias("is_late"),
        F.coalesce(F.col("received_date") > F.col("expected_date"), F.lit(False)).alias("is_delayed"), F.coalesce(got < asked, F.lit(False)).alias("is_partial_shipment"),
    )


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by `order`, NULLs last.

    An aggregation, not a window: partial maxima are taken before the shuffle, so a key with many copies stays cheap.
    """
    # Structs compare field by field with NULL lowest, which is NULLS LAST under the greatest.
    rest = [c for c in df.columns if c not in (*keys, *order)]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__best"))
    return best.select(*[F.col(c) if c in keys else F.col("__best")[c].alias(c) for c in df.columns])


def with_change(df: DataFrame, col: str, order: str, into: str, fill_first: bool = False) -> DataFrame:
    """The difference to the row before in `order`; for small series tables (the window has one partition)."""
    change = F.col(col) - F.lag(col).over(Window.orderBy(order))
    return df.withColumn(into, F.coalesce(change, F.lit(0.0)) if fill_first else change)


def _grocery_days(raw: DataFrame, event_from: str, event_to: str) -> DataFrame:
    rows = raw.withColumns({"id": number("id", "bigint"), "date": day("date"), "store_nbr": number("store_nbr", "int"), "item_nbr": number("item_nbr", "int"), "onpromotion": flag("onpromotion")})
    d = F.col("date")
    return rows.withColumns({"year": F.year(d), "month": F.month(d), "day": F.day(d), "day_of_week": sunday_weekday(d), "is_event_period": d.between(F.lit(event_from).cast("date"), F.lit(event_to).cast("date")), "is_wage_day": (F.day(d) == 15) | (d == F.last_day(d))})


_DAY_COLUMNS = ["year", "month", "day", "day_of_week", "is_event_period", "is_wage_day"]


def stg_train(raw: DataFrame, event_from: str, event_to: str) -> DataFrame:
    rows = _grocery_days(raw.withColumn("unit_sales", number("unit_sales", "double")), event_from, event_to)
    rows = rows.where("date IS NOT NULL AND store_nbr IS NOT NULL AND unit_sales IS NOT NULL AND item_nbr IS NOT NULL")
    return rows.select("id", "date", "store_nbr", "item_nbr", "unit_sales", (F.col("unit_sales") < 0).alias("is_return"), "onpromotion", *_DAY_COLUMNS)


def stg_test(raw: DataFrame, event_from: str, event_to: str) -> DataFrame:
    rows = _grocery_days(raw, event_from, event_to).where("date IS NOT NULL AND store_nbr IS NOT NULL AND item_nbr IS NOT NULL")
    return rows.select("id", "date", "store_nbr", "item_nbr", "onpromotion", *_DAY_COLUMNS)


def stg_holidays(raw: DataFrame) -> DataFrame:
    actual = F.col("type").isin("Holiday", "Additional", "Bridge") & ~flag("transferred")
    return raw.where("date IS NOT NULL").select(day("date").alias("holiday_date"), F.col("type").alias("holiday_type"), F.col("locale").alias("holiday_locale"), "locale_name", F.col("description").alias("holiday_description"), flag("transferred").alias("holiday_transferred"), F.coalesce(actual, F.lit(False)).alias("is_actual_holiday"))


def stg_oil(raw: DataFrame, fill_first: bool = False) -> DataFrame:
    rows = raw.where("date IS NOT NULL").select(day("date").alias("date"), number("dcoilwtico", "double").alias("oil_price"))
    return with_change(rows, "oil_price", "date", "oil_price_change", fill_first)


def stg_items(raw: DataFrame) -> DataFrame:
    return raw.select(number("item_nbr", "int").alias("item_nbr"), "family", number("class", "int").alias("class"), flag("perishable").alias("perishable")).where("item_nbr IS NOT NULL")


def stg_grocery_stores(raw: DataFrame) -> DataFrame:
    return raw.select(number("store_nbr", "int").alias("store_nbr"), "city", "state", F.col("type").alias("store_type"), number("cluster", "int").alias("store_cluster")).where("store_nbr IS NOT NULL")


def stg_transactions(raw: DataFrame) -> DataFrame:
    return raw.select(day("date").alias("date"), number("store_nbr", "int").alias("store_nbr"), number("transactions", "int").alias("transactions")).where("date IS NOT NULL AND store_nbr IS NOT NULL AND transactions IS NOT NULL")


def latest_rows(df: DataFrame, date_col: str) -> DataFrame:
    """Rows of the latest date."""
    last = df.agg(F.max(date_col).alias("__last"))
    return df.join(F.broadcast(last), F.col(date_col) == F.col("__last")).drop("__last")


def trailing_days(df: DataFrame, date_col: str, days: int) -> DataFrame:
    """Rows from `days` days before the latest date on (days + 1 dates)."""
    last = df.agg(F.date_sub(F.max(date_col), days).alias("__from"))
    return df.join(F.broadcast(last), F.col(date_col) >= F.col("__from")).drop("__from")


def tag(df: DataFrame, name: str, column: str = "analysis_type") -> DataFrame:
    return df.select(F.lit(name).alias(column), "*")
