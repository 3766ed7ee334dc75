"""Data-quality rules.  Each returns (check, table, column, severity, n_failed, status) rows; status is pass, warn or error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.marts import date_spine
from larder.sources.scratch import written


def _result(df: DataFrame, check: str, table: str, column: str | Column, severity: str, failed: Column | str) -> DataFrame:
    n = F.coalesce(F.col(failed) if isinstance(failed, str) else failed, F.lit(0)).cast("bigint")
    status = F.when(n == 0, "pass").otherwise(severity)
    return df.select(F.lit(check).alias("check"), F.lit(table).alias("table"), (F.lit(column) if isinstance(column, str) else column).alias("column"), F.lit(severity).alias("severity"), n.alias("n_failed"), status.alias("status"))


def not_null(df: DataFrame, cols: Sequence[str], table: str = "", severity: str = "error") -> DataFrame:
    """All columns in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in cols])).alias("x"))
    return _result(rows, "not_null", table, F.col("x.c"), severity, F.col("x.n"))


def unique(df: DataFrame, col: str, table: str = "", severity: str = "error") -> DataFrame:
    """Values found more than once; NULLs do not count."""
    repeated = df.where(F.col(col).isNotNull()).groupBy(col).count().where("count > 1")
    return _result(repeated.agg(F.count("*").alias("n")), "unique", table, col, severity, "n")


def unique_combination(df: DataFrame, cols: Sequence[str], table: str = "", severity: str = "error") -> DataFrame:
    repeated = df.groupBy(*cols).count().where("count > 1")
    return _result(repeated.agg(F.count("*").alias("n")), "unique_combination", table, ",".join(cols), severity, "n")


def accepted_values(df: DataFrame, col: str, values: Sequence, table: str = "", severity: str = "error") -> DataFrame:
    return _result(df.agg(F.count_if(~F.col(col).isin(*values)).alias("n")), "accepted_values", table, col, severity, "n")


def relationships(child: DataFrame, col: str, parent: DataFrame, parent_col: str, table: str = "", severity: str = "error") -> DataFrame:
    """Rows whose non-null key has no parent."""
    return _result(orphans(child.where(F.col(col).isNotNull()), parent, col, parent_col).agg(F.count("*").alias("n")), "relationships", table, col, severity, "n")


def orphans(child: DataFrame, parent: DataFrame, col: str, parent_col: str) -> DataFrame:
    keys = parent.select(F.col(parent_col).alias("__key")).distinct()
    return child.join(keys, F.col(col) == F.col("__key"), "left_anti")


def accepted_range(df: DataFrame, col: str, low=None, high=None, table: str = "", severity: str = "error") -> DataFrame:
    """NULL passes; both ends belong to the range."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(col) < F.lit(low))
    if high is not None:
        bad = bad | (F.col(col) > F.lit(high))
    return _result(df.agg(F.count_if(bad).alias("n")), "accepted_range", table, col, severity, "n")


def date_range(df: DataFrame, col: str, low: str, high: str, table: str = "", severity: str = "error") -> DataFrame:
    d = F.col(col)
    return _result(df.agg(F.count_if((d < F.lit(low).cast("date")) | (d > F.lit(high).cast("date"))).alias("n")), "date_range", table, col, severity, "n")


def pk_check(df: DataFrame, pk: Sequence[str], table: str = "") -> DataFrame:
    """Whether a key has NULLs, and whether it repeats; of tables of any size."""
    return not_null(df, pk, table).unionByName(unique_combination(df, pk, table))


def availability(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """(table, n_rows, status): missing, empty or ok."""
    parts = []
    some = next(d for d in tables.values() if d is not None)
    for name, df in tables.items():
        counted = some.limit(0).agg(F.lit(None).cast("bigint").alias("n_rows")) if df is None else df.agg(F.count("*").alias("n_rows"))
        parts.append(counted.select(F.lit(name).alias("table"), "n_rows", F.when(F.col("n_rows").isNull(), "missing").when(F.col("n_rows") == 0, "empty").otherwise("ok").alias("status")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_items(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.join(actual, list(expected.columns), "left_anti")


def partition_dates(tables: Mapping[str, DataFrame], col: str = "dt") -> DataFrame:
    """(dt, n_tables): in how many tables each date is present."""
    parts = [df.select(F.col(col).alias("dt")).distinct() for df in tables.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("dt").agg(F.count("*").alias("n_tables"))


def coverage_audit(tables: Mapping[str, tuple[DataFrame, str]], start: str | None = None, end: str | None = None) -> DataFrame:
    """(table, first_date, last_date, n_dates, n_missing): dates each table has, against all days that any table spans."""
    parts = [df.select(F.lit(name).alias("table"), F.col(c).alias("date_day")).where("date_day IS NOT NULL").distinct() for name, (df, c) in tables.items()]
    held = parts[0]
    for p in parts[1:]:
        held = held.unionByName(p)
    lo = F.coalesce(F.lit(start).cast("date"), F.min("date_day"))
    hi = F.coalesce(F.lit(end).cast("date"), F.max("date_day"))
    spine = date_spine(held.agg(lo.alias("lo"), hi.alias("hi")))
    names = held.sparkSession.createDataFrame([(n,) for n in tables], "table string")
    wanted = spine.join(F.broadcast(names))
    rows = wanted.join(held.withColumn("present", F.lit(1)), ["table", "date_day"], "left")
    have = F.when(F.col("present") == 1, F.col("date_day"))
    return rows.groupBy("table").agg(F.min(have).alias("first_date"), F.max(have).alias("last_date"), F.count("present").alias("n_dates"), F.count_if(F.col("present").isNull()).alias("n_missing"))


def coverage_of_dates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, first_date, last_date, n_dates, n_missing, n_rows) of tables given by the (date_day, rows) of their folders; rows are not scanned."""
    audit = coverage_audit({name: (df, "date_day") for name, df in tables.items()})
    parts = [df.agg(F.lit(name).alias("table"), F.sum("rows").alias("n_rows")) for name, df in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return audit.join(F.broadcast(rows), "table")  # one row a table


def missing_days(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(date_day, table) that a table lacks between the first and the last day of any."""
    parts = [df.select(F.lit(name).alias("table"), F.col(c).alias("date_day")).where("date_day IS NOT NULL").distinct() for name, (df, c) in tables.items()]
    held = parts[0]
    for p in parts[1:]:
        held = held.unionByName(p)
    names = held.sparkSession.createDataFrame([(n,) for n in tables], "table string")
    spine = date_spine(held.agg(F.min("date_day").alias("lo"), F.max("date_day").alias("hi")))
    return missing_items(spine.join(F.broadcast(names)).select("table", "date_day"), held)


def freshness(df: DataFrame, col: str, as_of: str, days: int = 2) -> DataFrame:
    d, to = F.col(col), F.lit(as_of).cast("date")
    rows = df.agg(F.max(d).alias("last_date"), F.count_if((d > F.date_sub(to, days)) & (d <= to)).alias("n_recent"))
    return rows.withColumn("status", F.when(F.col("n_recent") > 0, "pass").otherwise("error"))


def require_fresh(df: DataFrame, col: str, as_of: str, days: int = 2) -> DataFrame:
    """df, unless it has no row of the last days: then an error."""
    if freshness(df, col, as_of, days).first()["n_recent"] == 0:
        raise ValueError(f"no rows of the {days} days up to {as_of}")
    return df


#: Values that the sketch of frequent ones tracks, and the share of all rows by which its counts may be off (a bound of the sketch).
TRACKED, SKETCH_ERROR = 10_000, 3.5 / 16_384


def column_profile(df: DataFrame, cols: Sequence[str], k: int = 10, bins: int = 10) -> DataFrame:
    """(column, null_fraction, avg_width, n_distinct, common_values, bounds): the k most frequent values with frequencies, and equi-depth bounds of numeric columns.

    One pass over the table builds mergeable sketches of all columns (distinct values, quantiles, frequent values), a second
    one counts the frequent candidates exactly.  Columns whose candidates are not proven to be the most frequent ones, by the
    sketch's error bound, are counted in full, all of them in one pass; so the values and frequencies are exact.
    """
    text = {c: F.col(c).cast("string") for c in cols}
    m = 4 * k
    sketches = []
    for i, c in enumerate(cols):
        x = text[c].try_cast("double")
        sketches += [
            F.count_if(F.col(c).isNull()).alias(f"nulls{i}"), F.avg(F.length(text[c])).alias(f"width{i}"), F.approx_count_distinct(c).alias(f"distinct{i}"),
            F.when(F.count(x) > 0, F.kll_sketch_agg_double(x)).alias(f"kll{i}"), F.expr(f"approx_top_k(CAST(`{c}` AS STRING), {m}, {TRACKED})").alias(f"top{i}"),
        ]
    one = written(df.agg(F.count("*").alias("n"), *sketches), "sketches")
    ranks = F.array(*[F.lit(j / bins) for j in range(bins + 1)])
    items = [F.filter(F.col(f"top{i}"), lambda t: t["item"].isNotNull()) for i in range(len(cols))]
    listed = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("place"), F.col(f"nulls{i}").alias("nulls"), F.col(f"width{i}").alias("avg_width"), F.col(f"distinct{i}").alias("n_distinct"), F.col(f"kll{i}").alias("kll"), items[i].alias("top")) for i, c in enumerate(cols)]))
    stats = one.select("n", listed)
    wanted = stats.select("column", F.inline("top")).select("column", F.col("item").alias("value"))  # 4 k a column
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), text[c].alias("value")) for c in cols]))
    counted = written(df.select(pairs).join(F.broadcast(wanted), ["column", "value"]).groupBy("column", "value").count(), "recounted")
    # A value outside the candidates has at most the least candidate's estimate, and the error, unless all values are candidates.
    floor = stats.select("column", F.when(F.size("top") < m, F.lit(0.0)).otherwise(F.array_min(F.transform("top", lambda t: t["count"])) + F.col("n") * SKETCH_ERROR).alias("floor"), (F.col("n_distinct") < F.lit(m // 2)).alias("few"))
    place = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    kth = counted.withColumn("at", F.row_number().over(place)).where(F.col("at") <= k).groupBy("column").agg(F.min("count").alias("kth"), F.count("*").alias("found"))
    proof = floor.join(kth, "column", "left").where("(few AND floor = 0) OR (found = " + str(k) + " AND kth > floor)").select("column")
    proven = {r["column"] for r in proof.collect()}
    rest = [c for c in cols if c not in proven]
    if rest:
        others = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), text[c].alias("value")) for c in rest]))
        whole = df.select(others).where("value IS NOT NULL").groupBy("column", "value").count()
        counted = counted.where(F.col("column").isin(*proven)).unionByName(whole)
    top = counted.withColumn("at", F.row_number().over(place)).where(F.col("at") <= k)
    top = top.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("at", "value", "count"))).alias("top"))
    joined = stats.drop("top").join(top, "column", "left")
    common = F.transform(F.coalesce("top", F.array().cast(top.schema["top"].dataType)), lambda t: F.struct(t["value"].alias("value"), (t["count"] / F.col("n")).alias("frequency")))
    return joined.select("column", F.try_divide("nulls", "n").alias("null_fraction"), "avg_width", "n_distinct", common.alias("common_values"), F.when(F.col("kll").isNotNull(), F.kll_sketch_get_quantile_double("kll", ranks)).alias("bounds"))


def defect_summary(sales: DataFrame, inventory: DataFrame, stores: DataFrame, shipments: DataFrame) -> DataFrame:
    """Counts of the known defects in raw tables, one row each."""
    from larder.functions.scalars import number, text

    def row(df: DataFrame, name: str, bad: Column) -> DataFrame:
        return df.agg(F.lit(name).alias("defect"), bad.cast("bigint").alias("n"), F.count("*").alias("n_rows"))

    return (
        row(sales, "null_discount", F.count_if(text("discount_amount").isNull()))
        .unionByName(row(inventory, "negative_on_hand", F.count_if(number("quantity_on_hand", "int") < 0)))
        .unionByName(row(stores, "null_region", F.count_if(text("region").isNull())))
        .unionByName(row(shipments, "repeated_shipment", F.count("shipment_id") - F.countDistinct("shipment_id")))
    )
