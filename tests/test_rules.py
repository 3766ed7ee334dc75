"""Rule sets against the rules one by one, and the profile against pandas."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import quality
from larder.operators.rules import Observed, Rule, check_table

RULES = [
    Rule("not_null", ("a",)), Rule("not_null", ("b",), "warn"), Rule("accepted_values", ("b",), values=("x", "y")), Rule("accepted_range", ("n",), low=0, high=5), Rule("accepted_range", ("n",), low=2), Rule("accepted_range", ("n",)),
    Rule("date_range", ("d",), low="2020-01-02", high="2020-01-05"), Rule("condition", ("n",), sql="n % 2 = 0"),
]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "k1", "k2", f"k{i}"]), rng.choice(["x", "y", "z", None, ""]), rng.choice([None, *range(-2, 8)]), rng.choice([None, "2020-01-01", "2020-01-03", "2020-02-01"])) for i in range(60)]
    return spark.createDataFrame(rows, "a string, b string, n int, d string").withColumn("d", F.col("d").cast("date")).withColumns({"key": F.lit(1), "i": F.lit(2), "held": F.lit(3)})


def one_by_one(t, parent):
    single = [
        quality.not_null(t, ["a"]), quality.not_null(t, ["b"], "", "warn"), quality.accepted_values(t, "b", ["x", "y"]), quality.accepted_range(t, "n", 0, 5), quality.accepted_range(t, "n", 2), quality.accepted_range(t, "n"),
        quality.date_range(t, "d", "2020-01-02", "2020-01-05"),
    ]
    keyed = [quality.unique(t, "a"), quality.unique(t, "n", "", "warn"), quality.unique_combination(t, ["a", "b"]), quality.relationships(t, "b", parent, "p")]
    return single, keyed


def test_all_rules_in_two_passes_equal_single_rules(spark, table):
    parent = spark.createDataFrame([("x",), ("x",), ("z",), (None,)], "p string")
    keys = [Rule("unique", ("a",)), Rule("unique", ("n",), "warn"), Rule("unique_combination", ("a", "b")), Rule("relationships", ("b",), parent=parent, parent_col="p")]
    odd = table.where("n % 2 <> 0").count()
    for t, n_odd in ((table, odd), (table.limit(0), 0)):
        single, keyed = one_by_one(t, parent)
        want = sorted(tuple(r) for df in single + keyed for r in df.collect()) + [("condition", "", "n", "error", n_odd, "error" if n_odd else "pass")]
        found = check_table(t, RULES + keys)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    scans = check_table(spark.range(10).withColumn("x", F.col("id") % 3), [Rule("not_null", ("x",)), Rule("unique", ("x",)), Rule("unique", ("id",)), Rule("not_null", ("id",))])
    assert scans._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Range (0, 10") == 2


def test_row_rules_are_counted_while_a_table_is_written(spark, table, tmp_path):
    seen = Observed(table, RULES, "t")
    seen.df.write.parquet(str(tmp_path / "t"))
    assert sorted(map(tuple, seen.results().collect())) == sorted(map(tuple, check_table(table, RULES, "t").collect()))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 60
    with pytest.raises(ValueError, match="pass of their own"):
        Observed(table, [Rule("unique", ("a",))])


def test_profile_is_exact_for_flat_and_skewed_columns(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), str(rng.randint(0, 400)), f"u{i}", None, float(min(rng.expovariate(0.1), 80) // 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "few string, many string, own string, none string, num double")
    got = {r["column"]: r for r in quality.column_profile(df, df.columns, 5).collect()}
    pd = df.toPandas()
    for c in df.columns:
        held = [str(x) for x in pd[c] if x is not None]
        counts = sorted(((v, held.count(v)) for v in set(held)), key=lambda x: (-x[1], x[0]))[:5] if c != "own" else [(v, 1) for v in sorted(held)[:5]]
        assert [(x["value"], round(x["frequency"] * 3000)) for x in got[c]["common_values"]] == counts, c
        assert got[c]["null_fraction"] == pytest.approx(1 - len(held) / 3000)
    assert got["none"]["bounds"] is None and got["few"]["bounds"] is None and got["num"]["bounds"] == sorted(got["num"]["bounds"])
    assert quality.column_profile(df.limit(0), ["few"]).first()["common_values"] == []
