"""Tables bucketed by store and product, and what is not shuffled above them."""

import re

import pytest

from larder.operators import features as ft
from larder.plans import retail, sinks
from larder.sources import io

SF = "/root/testdata/sf0.001"


@pytest.fixture
def colocated(spark):
    """A session that joins what lies by fewer keys than it is joined by, without broadcasts, as large tables are."""
    during = {**sinks.COLOCATED, "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in during}
    for k, v in during.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return [m.group(0) for m in re.finditer(r"Exchange hashpartitioning\([^)]*\)", plan(df))]


def test_windows_and_snapshots_do_not_move_the_facts(colocated):
    facts, kept = sinks.bucketed_facts(retail.Retail(colocated, SF))
    rows = ft.with_snapshot(ft.daily_series(facts["sales"]), facts["inventory"])
    features = ft.demand_features(rows)
    assert exchanges(features) == [] and plan(features).count("Bucketed: true") == 2
    assert features.count() > 0
    for name, path in kept:
        io.drop_table(colocated, name, path)
        assert not colocated.catalog.tableExists(name)


def test_bucketed_facts_hold_what_features_read(colocated):
    r = retail.Retail(colocated, SF)
    facts, kept = sinks.bucketed_facts(r)
    assert "transaction_count" not in facts["sales"].columns  # a count of distinct sales, which no feature reads
    for fact, whole, columns in (("sales", r.fct_daily_sales(), ft.DAILY), ("inventory", r.fct_inventory_snapshots(), ft.SNAPSHOT)):
        assert sorted(facts[fact].columns) == sorted(columns)
        assert sorted(map(str, facts[fact].select(*columns).collect())) == sorted(map(str, whole.select(*columns).collect()))
    for name, path in kept:
        io.drop_table(colocated, name, path)


def test_only_the_narrow_series_moves_for_the_regions_demand(colocated):
    facts, kept = sinks.bucketed_facts(retail.Retail(colocated, SF))
    rows = ft.daily_series(facts["sales"])
    narrow = ft.with_lags(ft.min_history(rows.select(*ft.SERIES, "date", "region", "quantity_sold")), (1,))
    wide = ft.with_lags(ft.min_history(rows))
    by_series = [e for e in exchanges(ft.colocated_region_features(wide, narrow)) if e.startswith("Exchange hashpartitioning(store_id")]
    assert len(by_series) == 1  # the dealt demand; the wide rows are not shuffled
    same = ["date", *ft.SERIES, "region_avg_demand_7d"]
    a, b = (sorted(map(tuple, f(wide, narrow).select(*same).collect())) for f in (ft.region_features, ft.colocated_region_features))
    assert a == b and len(a) > 0
    for name, path in kept:
        io.drop_table(colocated, name, path)


def test_null_keys_repeated_rows_and_empty_tables(colocated, tmp_path):
    rows = colocated.createDataFrame([("a", 1, 2), (None, 1, 3), (None, None, 4), ("a", 1, 2)], "s string, p int, v int")
    for n, df in enumerate((rows, rows.where("false"))):
        path = str(tmp_path / f"t{n}")
        back = io.write_bucketed(df, f"larder_odd_{n}", ["s", "p"], ["v"], 3, path)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect())) and back.columns == df.columns
        assert exchanges(back.groupBy("s", "p").count()) == []
        io.drop_table(colocated, f"larder_odd_{n}", path)
        assert not (tmp_path / f"t{n}").exists()


def test_matrix_reads_the_raw_lines_once_a_source(spark):
    made = retail.Retail(spark, SF).feat_matrix()
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") == 2  # snapshots and shipments; sales are written before
    assert not made.isEmpty()
