"""Rule sets: all rules of a table in two passes over it, or the row rules for free while the table is written.

Rules that look at one row each are counted in one aggregation.  Rules on keys (uniqueness, parents) share one grouping by
rule and key, whose groups are counted before they are shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

RESULT = "check string, table string, column string, severity string, n_failed bigint, status string"


@dataclass(frozen=True)
class Rule:
    """check: not_null, accepted_values (values), accepted_range or date_range (low, high, either may be None), condition (sql
    that each row should fulfil, NULL counts as fulfilled), unique, unique_combination, or relationships (parent, parent_col)."""

    check: str
    columns: tuple[str, ...]
    severity: str = "error"
    values: tuple = ()
    low: object = None
    high: object = None
    sql: str = ""
    parent: DataFrame | None = None
    parent_col: str = ""

    @property
    def name(self) -> str:
        return ",".join(self.columns)

    @property
    def on_keys(self) -> bool:
        return self.check in ("unique", "unique_combination", "relationships")

    def failed(self) -> Column:
        """Whether a row fails."""
        c = F.col(self.columns[0])
        if self.check == "not_null":
            return c.isNull()
        if self.check == "accepted_values":
            return ~c.isin(*self.values)
        if self.check in ("accepted_range", "date_range"):
            kind = "date" if self.check == "date_range" else None
            bounds = [(op, F.lit(v).cast(kind) if kind else F.lit(v)) for op, v in (("<", self.low), (">", self.high)) if v is not None]
            return functools.reduce(lambda x, y: x | y, [(c < v) if op == "<" else (c > v) for op, v in bounds], F.lit(False))
        if self.check == "condition":
            return ~F.expr(self.sql)
        raise ValueError(f"no rule {self.check}")

    def key(self) -> Column:
        """A row's key as text, exact and with NULLs told from others; NULL where the rule does not look at the row."""
        text = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(self.columns)]))
        return text if self.check == "unique_combination" else F.when(F.col(self.columns[0]).isNotNull(), text)

    def parents(self) -> DataFrame:
        return self.parent.where(F.col(self.parent_col).isNotNull()).select(F.to_json(F.struct(F.col(self.parent_col).cast("string").alias("k0"))).alias("key")).distinct()


def _rows(rules: Sequence[Rule], counts: DataFrame, table: str) -> DataFrame:
    """Result rows from (i, n): how many rows or keys fail rule i; rules without a row there have none."""
    listed = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r.check).alias("check"), F.lit(table).alias("table"), F.lit(r.name).alias("column"), F.lit(r.severity).alias("severity")) for i, r in enumerate(rules)]))
    every = counts.sparkSession.range(1).select(listed)
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return every.join(counts, "i", "left").select("check", "table", "column", "severity", n.alias("n_failed"), F.when(n == 0, "pass").otherwise(F.col("severity")).alias("status"))


def check_table(df: DataFrame, rules: Sequence[Rule], table: str = "") -> DataFrame:
    """(check, table, column, severity, n_failed, status), a row a rule.

    unique and unique_combination count keys that are found more than once (NULL is no key for the first), relationships
    counts rows whose key has no parent, the others rows that fail.  An empty table passes.
    """
    parts = []
    single = [(i, r) for i, r in enumerate(rules) if not r.on_keys]
    if single:
        counts = df.agg(*[F.count_if(r.failed()).alias(f"n{i}") for i, r in single])
        parts.append(counts.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"n{i}").alias("n")) for i, _ in single]))))
    keyed = [(i, r) for i, r in enumerate(rules) if r.on_keys]
    if keyed:
        keys = df.select(F.array(*[F.struct(F.lit(i).alias("i"), r.key().alias("key")) for i, r in keyed]).alias("keys")).select(F.inline("keys")).where("key IS NOT NULL")
        groups = keys.groupBy("i", "key").agg(F.count("*").alias("held"))
        parents = [r.parents().select(F.lit(i).alias("i"), "key", F.lit(True).alias("known")) for i, r in keyed if r.check == "relationships"]
        if parents:
            groups = groups.join(functools.reduce(DataFrame.unionByName, parents), ["i", "key"], "left")
        else:
            groups = groups.withColumn("known", F.lit(None).cast("boolean"))
        orphans = F.col("i").isin(*[i for i, r in keyed if r.check == "relationships"])
        n = F.sum(F.when(orphans, F.when(F.col("known").isNull(), F.col("held")).otherwise(0)).otherwise((F.col("held") > 1).cast("int")))
        parts.append(groups.groupBy("i").agg(n.alias("n")))
    return _rows(rules, functools.reduce(DataFrame.unionByName, parts), table)


class Observed:
    """Row rules that are counted while a table is written: use df instead of the table, then results() after the action."""

    def __init__(self, df: DataFrame, rules: Sequence[Rule], table: str = ""):
        if keyed := [r.name for r in rules if r.on_keys]:
            raise ValueError(f"rules on keys need a pass of their own: {keyed}")
        self.rules, self.table, self._observation = list(rules), table, Observation()
        self.df = df.observe(self._observation, *[F.count_if(r.failed()).alias(f"n{i}") for i, r in enumerate(rules)])

    def results(self) -> DataFrame:
        counted = self._observation.get
        rows = [(r.check, self.table, r.name, r.severity, n, r.severity if n else "pass") for i, r in enumerate(self.rules) for n in [counted[f"n{i}"]]]
        return self.df.sparkSession.createDataFrame(rows, RESULT)
