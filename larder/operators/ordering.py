"""Ranks and exact quantiles of tables that no single task could hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.scalars import bucket_of
from larder.sources.scratch import written

#: Rows of a quantile's bracket that are sorted, and bins of a histogram.
BRACKET, BINS = 10_000, 512


def with_rank(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """df with each row's place in the order, from 1.  The order should be total: equal rows are told apart arbitrarily.

    Spark deals the rows to ranges of the order by a sample, as many as their bytes ask for; each range is sorted by itself,
    and starts after the rows of the ranges before it.  Only a count a range is added up in one place.
    """
    spark = df.sparkSession
    ranged = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged")
    starts, at = [], 0
    for r in ranged.groupBy("__range").count().orderBy("__range").collect():  # a row a range
        starts.append((r["__range"], at))
        at += r["count"]
    offsets = spark.createDataFrame(starts, "__range int, __start bigint")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "__range").withColumn(name, (own + F.col("__start")).cast("int")).drop("__range", "__start")


def quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, q, value): exact quantiles of numeric columns, interpolated between neighbours; NULLs and values that are not finite do not count.

    The order statistics that a quantile lies between are bracketed: histograms of all groups' brackets, one job a round,
    put each in a narrower one, until a bracket is one value or holds BRACKET rows at most; these are sorted.  So no task
    keeps more than BRACKET values of a group, however many it has.  A group without a value has no row; a NULL key is a
    group of its own.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], pairs.alias("pairs")).select(*keys, F.inline("pairs")).where("x IS NOT NULL AND abs(x) < double('infinity')")
    rows = written(rows, "values")
    group = [*keys, "column"]
    bounds = rows.groupBy(*group).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    wanted = F.explode(F.array(*map(F.lit, qs)))
    place = F.col("q") * (F.col("n") - 1)
    # k: the place, within the bracket, of the lower order statistic; the upper one is the next value or the same.
    targets = bounds.withColumn("q", wanted).withColumns({"low": F.floor(place), "part": place - F.floor(place)})
    targets = targets.withColumn("side", F.explode(F.when(F.col("part") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    targets = targets.select(*group, "q", "part", "side", (F.col("low") + F.col("side")).alias("k"), "lo", "hi", "n")
    targets = written(targets, "targets")
    found = []
    while True:
        done = (F.col("lo") == F.col("hi")) | (F.col("n") <= BRACKET)
        found.append(targets.where(done))
        open_targets = targets.where(~done)
        if open_targets.isEmpty():
            break
        targets = written(_narrowed(rows, open_targets, group), "targets")
    state = found[0]
    for f in found[1:]:
        state = state.unionByName(f)
    single = state.where("lo = hi").select(*group, "q", "part", "side", F.col("lo").alias("v"))
    held = _within(rows, state.where("lo < hi"), group)
    at = F.row_number().over(Window.partitionBy(*group, "q", "side").orderBy("x")) - 1  # BRACKET rows at most
    picked = held.withColumn("at", at).where("at = k").select(*group, "q", "part", "side", F.col("x").alias("v"))
    value = F.max(F.when(F.col("side") == 0, F.col("v"))) * (1 - F.col("part")) + F.coalesce(F.max(F.when(F.col("side") == 1, F.col("v"))) * F.col("part"), F.lit(0.0))
    out = single.unionByName(picked).groupBy(*group, "q", "part").agg(value.alias("value"))
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "column", "q", "value")


def _within(rows: DataFrame, targets: DataFrame, group: Sequence[str]) -> DataFrame:
    """The values in each target's bracket; groups are matched NULL-safe, and Spark broadcasts the targets where they are few."""
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = rows.alias("r").join(targets.alias("t"), on & F.col("r.x").between(F.col("t.lo"), F.col("t.hi")))
    return joined.select("t.*", "r.x")


def _narrowed(rows: DataFrame, targets: DataFrame, group: Sequence[str]) -> DataFrame:
    """Each target's bracket narrowed to the least and the greatest value of the bin that its place falls into."""
    each = [*group, "q", "part", "side", "k"]
    held = _within(rows, targets, group)
    binned = held.groupBy(*each, bucket_of(F.col("x"), F.col("lo"), F.col("hi"), BINS).alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    before = Window.partitionBy(*each).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
    placed = binned.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = placed.where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("n")))
    return inside.select(*group, "q", "part", "side", (F.col("k") - F.col("before")).alias("k"), "lo", "hi", "n")


def quantile_columns(df: DataFrame, named: dict[str, tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """(by, a column for each name): quantile q of column c for name -> (c, q)."""
    cols, qs = sorted({c for c, _ in named.values()}), sorted({q for _, q in named.values()})
    rows = quantiles(df, cols, qs, by)
    return rows.groupBy(*by).agg(*[F.max(F.when((F.col("column") == c) & (F.col("q") == q), F.col("value"))).alias(n) for n, (c, q) in named.items()])
