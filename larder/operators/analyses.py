"""The store-day analyses, the explorative statistics and their top-k and union forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.scalars import bucket_of, ratio
from larder.operators.ordering import quantile_columns
from larder.operators.staging import tag


def an_summary(mart: DataFrame) -> DataFrame:
    """One row; days are summed up first, so that counts of distinct days are plain counts."""
    hol, wage, event = F.col("is_holiday"), F.col("is_wage_day"), F.col("is_event_period")
    kinds = {"holiday_days": hol, "wage_days": wage, "event_days": event, "holiday_wage_days": hol & wage}
    sums = {"total_units_sold": "total_units_sold", "total_returned_units": "returned_units", "total_transactions": "transactions_count"}
    days = mart.groupBy("saledate").agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.count("total_units_sold").alias("n"), *[F.bool_or(c).alias(n) for n, c in kinds.items()])
    rows = days.agg(
        F.count("saledate").alias("total_days"), *[F.sum(n).alias(n) for n in sums], *[F.count_if(F.col(n) & F.col("saledate").isNotNull()).alias(n) for n in kinds],
        F.try_divide(F.sum("total_units_sold"), F.sum("n")).alias("avg_daily_units"),
    )
    stores = mart.where("store_nbr IS NOT NULL").select("store_nbr").distinct().agg(F.count("*").alias("total_stores"))
    columns = ["total_days", "total_stores", "total_units_sold", "total_returned_units", "total_transactions", *kinds, "avg_daily_units"]
    return tag(rows.join(F.broadcast(stores)).select(*columns), "summary")  # a row each


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows; Spark keeps n rows per task and merges them."""
    return df.orderBy(*order).limit(n)


def an_top_stores(mart: DataFrame, n: int = 10) -> DataFrame:
    rows = mart.groupBy("store_nbr", "city", "store_type").agg(F.sum("total_units_sold").alias("total_units"), F.avg("total_units_sold").alias("avg_daily_units"), F.countDistinct("saledate").alias("days_operated"))
    return tag(top_n(rows, [F.desc("total_units"), F.asc("store_nbr")], n), "top_stores")


def split_by_flag(mart: DataFrame, flag: Column, yes: str, no: str, count_days: bool, name: str) -> DataFrame:
    aggs = [F.sum("total_units_sold").alias("total_units"), F.avg("total_units_sold").alias("avg_daily_units")]
    aggs = ([F.countDistinct("saledate").alias("days")] if count_days else []) + aggs
    return tag(mart.groupBy(F.when(flag, yes).otherwise(no).alias("day_kind")).agg(*aggs), name)


def an_weekend(mart: DataFrame) -> DataFrame:
    return split_by_flag(mart, F.col("day_of_week").isin(0, 6), "Weekend", "Weekday", True, "weekend")


def an_holiday(mart: DataFrame) -> DataFrame:
    return split_by_flag(mart, F.col("is_holiday"), "Holiday", "Non-Holiday", True, "holiday")


def an_wage_days(mart: DataFrame) -> DataFrame:
    return split_by_flag(mart, F.col("is_wage_day"), "Wage Day", "Other Day", False, "wage_days")


def an_event_period(mart: DataFrame) -> DataFrame:
    return split_by_flag(mart, F.col("is_event_period"), "Event Period", "Other Period", True, "event_period")


def an_monthly(mart: DataFrame) -> DataFrame:
    rows = mart.groupBy("year", "month").agg(F.min(F.date_format("saledate", "MMM")).alias("month_name"), F.sum("total_units_sold").alias("total_units"), F.avg("total_units_sold").alias("avg_daily_units"))
    return tag(rows, "monthly")


def an_store_type(mart: DataFrame) -> DataFrame:
    return tag(mart.groupBy("store_type").agg(F.countDistinct("store_nbr").alias("stores"), F.sum("total_units_sold").alias("total_units"), F.avg("total_units_sold").alias("avg_daily_units")), "store_type")


def an_returns(mart: DataFrame, n: int = 10) -> DataFrame:
    rows = mart.where("returned_units > 0").groupBy("store_nbr", "city").agg(F.sum("returned_units").alias("total_returns"), F.count("*").alias("days_with_returns"))
    return tag(top_n(rows, [F.desc("total_returns"), F.asc("store_nbr")], n), "returns")


def r_summary(mart: DataFrame) -> DataFrame:
    """The flag columns count store-days, not days."""
    total = F.sum("total_units_sold")
    return mart.agg(F.countDistinct("saledate").alias("total_days"), F.countDistinct("store_nbr").alias("total_stores"), total.alias("total_units"), ratio(total, F.countDistinct("saledate")).alias("units_per_day"), F.count_if("is_holiday").alias("holiday_store_days"), F.count_if("is_wage_day").alias("wage_store_days"), F.count_if("is_event_period").alias("event_store_days"))


def r_top_stores(mart: DataFrame, n: int = 10) -> DataFrame:
    rows = mart.groupBy("store_nbr").agg(F.sum("total_units_sold").alias("total_units"), F.count("*").alias("days_operated"))
    return top_n(rows.withColumn("units_per_day", ratio(F.col("total_units"), F.col("days_operated"))), [F.desc("total_units"), F.asc("store_nbr")], n)


def r_weekend(mart: DataFrame) -> DataFrame:
    rows = mart.groupBy(F.when(F.col("day_of_week").isin(0, 6), "Weekend").otherwise("Weekday").alias("day_kind")).agg(F.sum("total_units_sold").alias("total_units"), F.count("*").alias("store_days"))
    return rows.withColumn("units_per_store_day", ratio(F.col("total_units"), F.col("store_days")))


def union_reports(reports: Sequence[DataFrame]) -> DataFrame:
    """One table of several tagged analyses; columns that one lacks are NULL there."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def _with_quantiles(stats: DataFrame, df: DataFrame, keys: Sequence[str], named: dict[str, tuple[str, float]]) -> DataFrame:
    """Statistics by key with exact quantiles beside them; NULL keys meet."""
    own = quantile_columns(df, named, keys).withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = stats.join(own, on, "left") if keys else stats.join(F.broadcast(own))  # one row where there is no key
    return joined.drop(*[f"__{k}" for k in keys])


def describe_by(df: DataFrame, key: str, col: str) -> DataFrame:
    c = F.col(col).cast("double")
    stats = df.groupBy(key).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"))
    found = _with_quantiles(stats, df, [key], {"p25": (col, 0.25), "p50": (col, 0.5), "p75": (col, 0.75)})
    return found.select(key, "n", "mean", "std", "least", "p25", "p50", "p75", "most")


def stats_by(df: DataFrame, keys: Sequence[str], col: str, aggs: Sequence[str] = ("mean", "median", "std")) -> DataFrame:
    c = F.col(col).cast("double")
    known = {"mean": F.avg(c), "std": F.stddev_samp(c), "count": F.count(c), "sum": F.sum(c)}
    stats = df.groupBy(*keys).agg(*[known[a].alias(a) for a in aggs if a in known])
    return (_with_quantiles(stats, df, keys, {"median": (col, 0.5)}) if "median" in aggs else stats).select(*keys, *aggs)


def medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row, a median a column; NULL where a column has no value."""
    return quantile_columns(df, {c: (c, 0.5) for c in cols})


def histogram(df: DataFrame, col: str, bins: int = 50, by: str | None = None, log: bool = False) -> DataFrame:
    """(by, bin, n) over equal-width bins between the least and the greatest value; log: of ln(1 + x)."""
    x = F.log1p(F.col(col).cast("double")) if log else F.col(col).cast("double")
    keys = [by] if by else []
    rows = df.select(*keys, x.alias("x")).where("x IS NOT NULL")
    bounds = rows.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    # A NULL key is a group like others.
    joined = rows.join(bounds.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by"))) if by else rows.join(F.broadcast(bounds))
    return joined.groupBy(*keys, bucket_of(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))


def pivot_metric(df: DataFrame, row: str, col: str, val: str, values: Sequence | None = None) -> DataFrame:
    """Rows by `row`, a column for each of `values` (named by the caller, so that no job has to find them)."""
    return df.groupBy(row).pivot(col, list(values) if values else None).agg(F.sum(val))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def distinct_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.countDistinct(F.struct(*keys)).alias("distinct_keys"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def daily_total_rolling(fact: DataFrame, n: int = 7) -> DataFrame:
    """Company totals by day with an n-day rolling mean, NULL until n days are there.  One row a day reaches the window."""
    daily = fact.groupBy("sale_date").agg(F.sum("total_quantity_sold").alias("units"))
    w = Window.orderBy("sale_date").rowsBetween(1 - n, 0)
    return daily.select("sale_date", "units", F.when(F.count("*").over(w) >= n, F.avg("units").over(w)).alias("rolling_mean"))
