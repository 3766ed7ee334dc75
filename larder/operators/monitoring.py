"""Drift and coverage alarms for a running forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.features import SERIES


def wape_alarm(model: DataFrame, baseline: DataFrame, factor: float = 2.0) -> DataFrame:
    """By date: alert where the model's WAPE exceeds factor times the baseline's."""
    rows = model.select("date", F.col("wape").alias("model_wape")).join(baseline.select("date", F.col("wape").alias("baseline_wape")), "date")
    return rows.withColumn("alert", F.coalesce(F.col("model_wape") > factor * F.col("baseline_wape"), F.lit(False)))


def bias_drift(daily: DataFrame, limit: float = 0.5, days: int = 7) -> DataFrame:
    """(date, bias, alert): alert once |bias| has exceeded the limit in each of the last `days` rows.  One row a day reaches the window."""
    w = Window.orderBy("date").rowsBetween(1 - days, 0)
    high = (F.abs("bias") > limit).cast("int")
    return daily.select("date", "bias", ((F.sum(high).over(w) == days) & (F.count("*").over(w) == days)).alias("alert"))


def ks_distance(a: DataFrame, b: DataFrame, col: str, limit: float = 0.2) -> DataFrame:
    """(column, ks, alert): the greatest gap between the two samples' cumulative shares.

    Counts per distinct value come first; running totals then need one row a value, in order: values are dealt to ranges,
    ranges are summed, and each range starts from the totals of those before it.
    """
    x = F.col(col).cast("double")
    rows = a.select(x.alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(x.alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where("x IS NOT NULL")
    counts = rows.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ranges = counts.agg(F.percentile_approx("x", [i / 64 for i in range(1, 64)], 1000).alias("edges"))
    dealt = counts.join(F.broadcast(ranges)).select("x", "a", "b", F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("range"))
    sums = dealt.groupBy("range").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sums.select("range", F.coalesce(F.sum("ra").over(before), F.lit(0)).alias("sa"), F.coalesce(F.sum("rb").over(before), F.lit(0)).alias("sb"), F.sum("ra").over(whole).alias("na"), F.sum("rb").over(whole).alias("nb"))  # 64 rows
    run = Window.partitionBy("range").orderBy("x")
    gaps = dealt.join(F.broadcast(starts), "range").select(F.abs(F.try_divide(F.col("sa") + F.sum("a").over(run), "na") - F.try_divide(F.col("sb") + F.sum("b").over(run), "nb")).alias("gap"))
    return gaps.agg(F.max("gap").alias("ks")).select(F.lit(col).alias("column"), "ks", F.coalesce(F.col("ks") > limit, F.lit(False)).alias("alert"))


def missing_pairs(df: DataFrame, date_col: str, limit: float = 0.05) -> DataFrame:
    """(date, n_before, n_missing, alert): series of the date before that a date lacks.  Dates are those that occur."""
    pairs = df.select(F.col(date_col).alias("date"), *SERIES).distinct()
    dates = pairs.select("date").distinct().select("date", F.lead("date").over(Window.orderBy("date")).alias("next")).where("next IS NOT NULL")  # a row a date
    asked = pairs.join(dates, "date").select(F.col("next").alias("date"), *SERIES)
    lost = asked.join(pairs.withColumn("there", F.lit(1)), ["date", *SERIES], "left")
    return lost.groupBy("date").agg(F.count("*").alias("n_before"), F.count_if(F.col("there").isNull()).alias("n_missing")).withColumn("alert", F.col("n_missing") > limit * F.col("n_before"))
