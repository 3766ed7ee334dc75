"""Column expressions the operators share: text cleaning, safe arithmetic, calendar logic, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as true in text.
TRUE_TEXTS = ("true", "t", "1", "yes")


def text(col: str) -> Column:
    """The trimmed text, NULL when blank."""
    return F.nullif(F.trim(F.col(col)), F.lit(""))


def number(col: str, kind: str) -> Column:
    """A cleaned text as a number, NULL where it is none."""
    return text(col).try_cast(kind)


def money(col: str) -> Column:
    return number(col, "decimal(10,2)")


def day(col: str) -> Column:
    """A cleaned text as a date; '.' counts as blank."""
    return F.nullif(text(col), F.lit(".")).try_cast("date")


def flag(col: str) -> Column:
    return F.coalesce(F.lower(F.col(col).cast("string")).isin(*TRUE_TEXTS), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; NULL when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def at_least(x: Column, low) -> Column:
    """greatest(x, low), but NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def clipped(x: Column, low, high) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def iso_weekday(d: Column) -> Column:
    """1 (Monday) to 7."""
    return F.weekday(d) + 1


def sunday_weekday(d: Column) -> Column:
    """0 (Sunday) to 6."""
    return F.dayofweek(d) - 1


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").otherwise("Fall")


def fiscal_year(d: Column) -> Column:
    """Fiscal years begin in April."""
    return F.year(d) - F.when(F.month(d) >= 4, 0).otherwise(1)


def fiscal_month(d: Column) -> Column:
    return (F.month(d) + 8) % 12 + 1


def effective_lead(lead: Column, rate: Column) -> Column:
    """Lead time, longer for suppliers that are seldom on time."""
    return lead / at_least(rate, 0.01)


def right_closed(x: Column, edges: Sequence, labels: Sequence[str]) -> Column:
    """The label of (edge[i-1], edge[i]] that x lies in; len(labels) = len(edges) + 1; NULL stays NULL."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(x <= edge, label)
    return out.otherwise(labels[-1])


def bucket_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The equal-width bin, 0 to bins - 1; the highest value falls in the last."""
    width = (high - low) / F.lit(bins)
    return F.when(x.isNotNull(), F.when(width > 0, F.least(F.floor((x - low) / width), F.lit(bins - 1))).otherwise(F.lit(0))).cast("int")
