"""Audit of filters that remove overlapping sets of documents.

Each document is reduced to the set of filters that it fails.  Counting these sets gives what every coalition of filters
removes; what a filter removes at a step of an order is the difference of two coalitions, and its share over all orders is
the Shapley value, found as the exact solution of the kernel-weighted least squares problem under the efficiency constraint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Characters between words.
SPACES = " \t\n\v\f\r"


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """x with matrix * x = right, by elimination in rationals."""
    rows, n = [[*a, *b] for a, b in zip(matrix, right, strict=True)], len(matrix)
    for k in range(n):
        at = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[at] = rows[at], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k], strict=True)]
    return [row[n:] for row in rows]


def kernel_weights(n: int) -> list[list[Fraction]]:
    """For each of n filters, the weight of every coalition's value (by bit mask) in its Shapley value.

    Minimises sum k(S) (v(S) - sum of x_i over S)^2 with k(S) = (n - 1) / (C(n, s) s (n - s)), subject to the x_i adding up
    to the value of all; the normal equations with the constraint's multiplier are solved for every v at once, as they are
    linear in it.
    """
    full = (1 << n) - 1
    inner = {mask: Fraction(n - 1, comb(n, s) * s * (n - s)) for mask in range(1, full) for s in [mask.bit_count()]}
    matrix = [[sum((k for mask, k in inner.items() if mask >> i & 1 and mask >> j & 1), Fraction()) for j in range(n)] + [Fraction(1)] for i in range(n)]
    right = [[inner[mask] if mask in inner and mask >> i & 1 else Fraction() for mask in range(full + 1)] for i in range(n)]
    matrix.append([Fraction(1)] * n + [Fraction()])
    right.append([Fraction(int(mask == full)) for mask in range(full + 1)])
    return solve(matrix, right)[:n]


def text_failures(text: Column, *, least_words: int = 100, least_distinct: int = 80, most_upper: int = 10, marks: str = "#$%&*|") -> dict[str, Column]:
    """Filters A to D as conditions that a text fails: too few words, too few distinct words (per cent), too many capital letters (per cent), a mark."""
    words = F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", F.lit("")))
    return {
        "A": n < least_words,
        "B": F.lit(100) * distinct < F.lit(least_distinct) * n,
        "C": F.lit(100) * upper > F.lit(most_upper) * F.char_length(text),
        "D": F.char_length(F.translate(text, marks, "")) < F.char_length(text),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column], *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters that they fail: filter k as bit k, and the filter of repeated texts as the last one.

    `failures` are conditions on the text in the column `text`.  A document fails the last filter if a smaller id has the same
    text.  Equal rows are counted before they are grouped, and the first of each group of equal texts is found by its id, so
    no group of copies is gathered anywhere.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures.values())), F.lit(0))
    rows = rows.select("id", "part", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), mask.alias("mask"))
    counted = written(rows.groupBy("id", "part", "h1", "h2", "mask").agg(F.count("*").alias("n")), "masks")
    first = counted.groupBy("h1", "h2").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = counted.join(first, ["h1", "h2", "id"], "left").join(known, "id", "left")
    late = F.when(F.col("first").isNull() & F.col("id").isNotNull(), 1 << len(failures)).otherwise(0)
    sums = {c: F.sum(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")}
    return marked.groupBy("part", (F.col("mask") + late).alias("mask")).agg(F.sum("n").alias("n"), *sums.values())


def interactions(counts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order of the filters.

    counts: failure_counts(), a row a part and mask.  Each part becomes one row with what every coalition of filters removes.
    """
    n, orders = len(filters), factorial(len(filters))
    full = (1 << n) - 1
    coalition = counts.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(full))))
    caught = F.col("mask").bitwiseAND(F.col("s")) != 0
    sums = [F.sum(F.when(caught, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    only = F.sum(F.when(F.col("mask") == F.col("s"), F.col("n")).otherwise(0)).alias("only")
    removals = coalition.groupBy("part", "s").agg(*sums, only, F.sum("n").alias("every"))
    parts = removals.groupBy("part").agg(F.max("every").alias("every"), F.sort_array(F.collect_list(F.struct("s", "n", "good", "toxic", "only"))).alias("v"))  # 2^n entries
    weights = [[w * orders for w in row] for row in kernel_weights(n)]
    assert all(w.denominator == 1 for row in weights for w in row)
    exact = F.array(*[F.array(*[F.lit(int(w)).cast("bigint") for w in row]) for row in weights])
    shares = F.transform(exact, lambda w: F.aggregate(F.zip_with(w, F.col("v.n"), lambda x, y: x * y), F.lit(0).cast("bigint"), lambda x, y: x + y))
    steps = [F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(filters.index(f)).alias("filter"), F.lit(sum(1 << filters.index(g) for g in order[:k])).alias("before")) for order in permutations(filters) for k, f in enumerate(order)]
    rows = parts.withColumn("shares", shares).select("*", F.inline(F.array(*steps)))
    bit = F.expr("shiftleft(1, filter)")
    rows = rows.select("part", "filter_order", "step", "every", F.get("shares", F.col("filter")).alias("shapley"), F.get("v", F.col("before")).alias("x"), F.get("v", F.col("before").bitwiseOR(bit)).alias("y"), F.get("v", bit).alias("own"))
    removed = F.col("y.n") - F.col("x.n")
    return rows.select(
        "part", "filter_order", "step", (F.col("every") - F.col("y.n")).alias("kept"), removed.alias("removed"), (F.col("own.n") - removed).alias("redundant"), F.col("own.only").alias("unique_fails"),
        (F.col("y.good") - F.col("x.good")).alias("good_lost"), (F.col("y.toxic") - F.col("x.toxic")).alias("toxic_lost"), "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The interactions of filters A to E, per part, over whole texts.

    Null texts are empty (they fail A; of several, all but the first fail E); null parts are the empty part.  Of rows with
    equal texts those with the least id pass E, also where that id repeats; a null id is smaller than none, and greater than
    none: such rows pass E.  An id counts as good or toxic if any of its labels says so; ids without a label are neither.
    Very long texts are handled like others; an empty table gives no row; other columns are not read.
    """
    failures = text_failures(F.col("text"))
    return interactions(failure_counts(docs, labels, failures, id_col=id_col, text_col=text_col, part_col=part_col), [*failures, "E"])
