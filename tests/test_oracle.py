"""Registered retail queries against their SQL in another engine, on the smallest tables."""

import datetime
import math

import duckdb
import pandas as pd
import pytest

from larder.plans import oracle, retail, sinks
from larder.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"
#: A query of each family; bench and the driver run them all.
NAMES = ["stg_products", "stg_sales", "stg_shipments", "dim_date", "fct_daily_sales", "mart_supplier_performance", "mart_store_daily_sales", "an_summary", "an_monthly", "dq_not_null", "dq_coverage", "supplier_quadrants", "feat_rolling", "feat_ewm", "feat_trend", "reorder", "missing_pairs", "eda_describe", "stockout_risk", "feat_matrix", "features_filled", "horizon_rows", "series_of_region", "segment_errors", "best_fold", "an_union", "quadrant_list", "clean_names", "eda_stockout_rate", "eda_discount", "feat_codes", "codes_table", "dq_rules", "dq_observed", *sinks.BUILDERS]
QUERIES = {**retail.queries(), **retail.queries(sinks.BUILDERS)}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "none"
    if isinstance(v, (pd.Timestamp, datetime.date)):
        return str(v)[:10]
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return "none" if math.isnan(v) else f"{float(v):.5f}"
    except TypeError:
        return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(oracle.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None)) for df in (got, want)]
    assert rows[0] == rows[1]


def test_every_query_but_models_has_sql():
    without = set(QUERIES) - set(oracle.oracle_sql())
    assert without == {"dq_profile", "gbt_walk_forward", "gbt_forecasts", "gbt_importance", "gbt_importance_report", "gbt_tune"}


def test_profile_equals_pandas(spark):
    rows = retail.Retail(spark, SF).stg_sales().toPandas()
    for r in retail.queries()["dq_profile"](spark, SF).collect():
        own = rows[r["column"]]
        held = own.dropna()
        text = held.map(str)
        counts = sorted(text.value_counts().items(), key=lambda x: (-x[1], x[0]))[:10]
        assert r["null_fraction"] == pytest.approx(own.isna().mean(), abs=1e-6) and r["avg_width"] == pytest.approx(text.map(len).mean(), abs=1e-6)
        assert abs(r["n_distinct"] - held.nunique()) <= 0.1 * held.nunique() + 1
        assert [(x["value"], round(x["frequency"], 6)) for x in r["common_values"]] == [(v, round(n / len(own), 6)) for v, n in counts]
        if r["bounds"]:
            ordered = sorted(map(float, held))
            assert all(ordered[max(0, int(len(ordered) * (k - 0.3) / 10))] <= b <= ordered[min(len(ordered) - 1, int(len(ordered) * (k + 0.3) / 10))] for k, b in enumerate(r["bounds"]))


def test_unknown_counts_rank_as_out_of_stock(spark):
    rows = QUERIES["stockout_risk"](spark, SF).collect()
    assert all(r["quantity_on_hand"] is not None for r in rows)
    raw = retail.Retail(spark, SF).raw("raw_inventory").where("trim(quantity_on_hand) = ''")
    assert raw.count() > 0
