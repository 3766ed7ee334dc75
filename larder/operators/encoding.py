"""Ordered target encoding: categories of any number as one figure each.

A training row's category becomes the mean demand that was seen for it on earlier days, drawn to the overall mean of those
days while it is rare.  No row's own label, nor any later one, enters its code.  Days are summed first, so a category with a
third of all rows is one row a day in the windows.  Rows to predict get the means over the whole training part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.sources.scratch import written

#: Rows of the overall mean that each category starts with.
WEIGHT = 10.0


def code_name(column: str) -> str:
    return f"{column}__code"


def _text(column: str) -> Column:
    """A category as text; NULL is a category of its own, the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def daily_sums(df: DataFrame, columns: Sequence[str], value: str, date_col: str = "date") -> DataFrame:
    """(column, category, day, total, n): the values of each category and day; all columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _text(c).alias("category")) for c in columns])
    rows = df.select(F.col(date_col).alias("day"), F.col(value).cast("double").alias("v"), pairs.alias("pairs")).where("v IS NOT NULL")
    return rows.select("day", "v", F.inline("pairs")).groupBy("column", "category", "day").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def _code(total: Column, n: Column, all_total: Column, all_n: Column, weight: float) -> Column:
    """The mean of a category with `weight` rows of the overall mean; 0 before anything has been seen."""
    none = F.lit(0.0)
    overall = F.coalesce(F.try_divide(all_total, all_n), none)
    return (F.coalesce(total, none) + F.lit(weight) * overall) / (F.coalesce(n, F.lit(0)) + F.lit(weight))


def ordered_codes(sums: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """(column, category, day, code): what each category's rows of a day get, from the days before."""
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    own, every = before.partitionBy("column", "category"), before.partitionBy("column")
    days = sums.groupBy("column", "day").agg(F.sum("total").alias("t"), F.sum("n").alias("m"))  # a row a day and column
    days = days.select("column", "day", F.sum("t").over(every).alias("t"), F.sum("m").over(every).alias("m"))
    rows = sums.select("column", "category", "day", F.sum("total").over(own).alias("total"), F.sum("n").over(own).alias("n"))
    return rows.join(days, ["column", "day"]).select("column", "category", "day", _code(F.col("total"), F.col("n"), F.col("t"), F.col("m"), weight).alias("code"))


def with_ordered_codes(df: DataFrame, columns: Sequence[str], value: str = "quantity_sold", date_col: str = "date", weight: float = WEIGHT) -> DataFrame:
    """df with a code for each column; a row whose value is unknown on a day without others of its category gets 0.

    The codes, a row a category and day, are written first: each column joins its own of them, and df is summed once for all.
    """
    codes = written(ordered_codes(daily_sums(df, columns, value, date_col), weight), "ordered-codes")
    for c in columns:
        own = codes.where(F.col("column") == c).select(F.col("category").alias("__category"), F.col("day").alias("__day"), F.col("code").alias(code_name(c)))
        df = df.join(own, (_text(c) == F.col("__category")) & (F.col(date_col) == F.col("__day")), "left").drop("__category", "__day")
    return df.fillna(0.0, [code_name(c) for c in columns])


@dataclass
class TargetCodes:
    """The fitted table (column, category, code), and each column's code of a category that it does not hold."""

    columns: tuple[str, ...]
    table: DataFrame
    unseen: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            own = self.table.where(F.col("column") == c).select(F.col("category").alias("__category"), F.col("code").alias(code_name(c)))
            df = df.join(own, _text(c) == F.col("__category"), "left").drop("__category")
        return df.fillna({code_name(c): self.unseen.get(c, 0.0) for c in self.columns}) if self.columns else df


def fit_codes(df: DataFrame, columns: Sequence[str], value: str = "quantity_sold", weight: float = WEIGHT) -> TargetCodes:
    """Codes for rows to predict, from all rows of df.  The table has a row a category and lies in the shared folder."""
    if not columns:
        return TargetCodes((), df.limit(0), {})
    sums = daily_sums(df.withColumn("__one", F.lit(0)), columns, value, "__one")
    overall = sums.groupBy("column").agg(F.sum("total").alias("t"), F.sum("n").alias("m"))
    rows = sums.join(F.broadcast(overall), "column")  # a row a column
    table = written(rows.select("column", "category", _code(F.col("total"), F.col("n"), F.col("t"), F.col("m"), weight).alias("code")), "codes")
    return TargetCodes(tuple(columns), table, {r["column"]: r["t"] / r["m"] for r in overall.collect()})
