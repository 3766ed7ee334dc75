"""Registered round trips through the sources and sinks: each writes given tables to the shared folder and returns what a reader finds there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import features as ft
from larder.operators import quality
from larder.plans.retail import Retail
from larder.sources import io, jdbc, manifest, samples
from larder.sources.scratch import drop_written, fresh_path, written

#: Days of the round trips.
FROM, TO, SPLIT, UNLISTED = "1996-03-01", "1996-08-31", "1998-06-01", "2031-01-01"


def raw_csv(r: Retail) -> DataFrame:
    rows, path = r.raw("raw_sales"), fresh_path(r.spark, "csv")
    io.write_csv(rows, path)
    return io.read_raw_csv(r.spark, path, rows.columns)


def text_table(r: Retail) -> DataFrame:
    rows, path = r.raw("raw_products"), fresh_path(r.spark, "text")
    io.write_csv(rows, path)
    return io.read_text_table(r.spark, path)


def fact_days(r: Retail) -> DataFrame:
    """Folders of a year's part, read with bounds that prune them; a CSV does not tell empty text from none, so both come as empty."""
    rows, path = r.raw("raw_inventory"), fresh_path(r.spark, "fact")
    io.write_csv(rows, path, ["dt"])
    found = io.read_fact(r.spark, path, [c for c in rows.columns if c != "dt"], FROM, TO)
    return found.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in found.columns])


def mart(r: Retail) -> DataFrame:
    path = fresh_path(r.spark, "mart")
    io.write_mart(r.fct_daily_sales().where("false"), path)
    io.write_mart(r.fct_daily_sales(), path)
    return io.read_mart(r.spark, path, ["sale_date", "store_id", "product_id", "total_quantity_sold"])


def dim(r: Retail) -> DataFrame:
    path = fresh_path(r.spark, "dim")
    io.write_dim(r.dim_stores(), path)
    return io.read_mart(r.spark, path, ["store_id", "store_name"])


def ingest(r: Retail) -> DataFrame:
    """An ingest of the first dates, another of all, which adds the rest only, and one that adds nothing: dates and rows.

    The sales are staged once for all three.
    """
    rows, path = written(r.stg_sales(), "staged-sales"), fresh_path(r.spark, "ingest")
    for part in (rows.where(F.col("sale_date") < SPLIT), rows, rows):
        manifest.ingest_new_partitions(part, path, "sale_date")
    drop_written(rows)
    return manifest.read_ingested(r.spark, path).groupBy("dt").agg(F.count("*").alias("n"))


def verified(r: Retail) -> DataFrame:
    """Every published date against its entry; one folder without an entry is there as well."""
    rows, path = r.stg_transactions(), fresh_path(r.spark, "verify")
    manifest.ingest_new_partitions(rows, path, "date")
    io.write_mart(rows.limit(3), f"{path}/dt={UNLISTED}")
    return manifest.verify_ingested(r.spark, path)


def coverage(r: Retail) -> DataFrame:
    """Coverage of three dated folders from their manifests: no data file is read."""
    roots = {}
    for name, rows, col in (("sales", r.stg_sales(), "sale_date"), ("inventory", r.stg_inventory(), "snapshot_date"), ("transactions", r.stg_transactions(), "date")):
        roots[name] = fresh_path(r.spark, f"coverage-{name}")
        manifest.ingest_new_partitions(rows, roots[name], col)
    return quality.coverage_of_dates({name: manifest.published_dates(r.spark, root) for name, root in roots.items()})


def database(r: Retail) -> DataFrame:
    """A table of an embedded database in the session's JVM (so for sessions on one machine), written twice and read back in ranges."""
    url, table = f"jdbc:derby:memory:{fresh_path(r.spark, 'db').rpartition('larder-')[2]};create=true", "items"
    for rows in (r.stg_items().limit(5), r.stg_items()):
        jdbc.write_jdbc(rows, url, table, rename="RENAME TABLE {0} TO {1}")
    return jdbc.read_jdbc(r.spark, url, table, column='"item_nbr"', rows_a_part=500)


def ingest_all(r: Retail) -> DataFrame:
    return io.ingest_all(r.spark, {"sales": (r.stg_sales(), "sale_date"), "wrong": (r.stg_sales(), "no_such_column")}, {"stores": r.stg_stores()}, fresh_path(r.spark, "all")).select("table", F.substring_index("status", ":", 1).alias("status"), "n")


def dated(r: Retail) -> DataFrame:
    """Two dates, one of them written again."""
    rows, path = r.stg_stores().select("store_id"), fresh_path(r.spark, "dated")
    for dt, df in (("2025-01-01", rows), ("2025-01-02", rows), ("2025-01-01", rows.where("store_id = '3'"))):
        io.write_dated(df, path, dt)
    return r.spark.read.parquet(path).select("store_id", F.col("dt").cast("string").alias("dt"))


def report(r: Retail) -> DataFrame:
    path = fresh_path(r.spark, "report")
    io.write_report(r.stg_stores().select("store_id", "store_name", "region"), path)
    return r.spark.read.schema("store_id string, store_name string, region string").json(path)


def table(r: Retail) -> DataFrame:
    path = fresh_path(r.spark, "table")
    name = "larder_" + path.rpartition("larder-")[2].replace("-", "_")
    io.write_table(r.stg_items(), name, path)
    return io.read_table(r.spark, name)


#: A join by store, product and date may use tables that lie by store and product.
COLOCATED = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def bucketed_facts(r: Retail) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """The daily facts, with the columns that features are made of, as tables bucketed by store and product, and (name, path) of each, for io.drop_table().

    Other columns are not worked out: the number of distinct sales alone would shuffle every sale twice.
    """
    tables, kept = {}, []
    for fact, df, day in (("sales", r.fct_daily_sales().select(*ft.DAILY), "sale_date"), ("inventory", r.fct_inventory_snapshots().select(*ft.SNAPSHOT), "snapshot_date")):
        path = fresh_path(r.spark, fact)
        name = "larder_" + path.rpartition("larder-")[2].replace("-", "_")
        tables[fact] = io.write_bucketed(df, name, ft.SERIES, [day], path=path)
        kept.append((name, path))
    return tables, kept


def bucketed_matrix(r: Retail) -> DataFrame:
    """The feature matrix over bucketed facts, saved; the facts' rows are not shuffled for windows, snapshots or the region's demand."""
    facts, kept = bucketed_facts(r)
    rows = ft.build_features(facts["sales"], facts["inventory"], written(r.dim_products(), "products"), r.mart_supplier_performance(), colocated=True)
    rows = written(rows, "matrix", settings=COLOCATED)
    for name, path in kept:
        io.drop_table(r.spark, name, path)
    return rows


def sampled_stores(r: Retail) -> DataFrame:
    """Days and units of the stores in an exact third, counted in two facts that keep the same stores."""
    kept = samples.sample_by_key({"sales": r.fct_daily_sales(), "inventory": r.fct_inventory_snapshots()}, r.stg_stores(), "store_id", 1 / 3)
    sales = kept["sales"].groupBy("store_id").agg(F.count("*").alias("n_sales"), F.sum("total_quantity_sold").alias("units"))
    return sales.join(kept["inventory"].groupBy("store_id").agg(F.count("*").alias("n_inventory")), "store_id", "full")


def sampled_items(r: Retail) -> DataFrame:
    """Exactly 100 items."""
    return samples.sample_keys(r.stg_items().select("item_nbr"), 100)


def sampled_rows(r: Retail) -> DataFrame:
    """A twentieth of the sales, each row by its own hash."""
    return samples.bernoulli_sample(r.stg_sales(), 0.05, "sale_id").select("sale_id", "store_id", "quantity_sold")


BUILDERS: dict[str, Callable[[Retail], DataFrame]] = {"io_raw_csv": raw_csv, "io_text_table": text_table, "io_fact_days": fact_days, "io_mart": mart, "io_dim": dim, "io_ingest": ingest, "io_ingest_all": ingest_all, "io_dated": dated, "io_report": report, "io_table": table, "io_verify": verified, "dq_coverage_folders": coverage, "io_jdbc": database, "sample_by_key": sampled_stores, "sample_exact": sampled_items, "sample_bernoulli": sampled_rows, "feat_matrix_bucketed": bucketed_matrix}

def _hash(key: str) -> str:
    return f"('0x' || substr(md5('42:' || {key}), 1, 12))::BIGINT"


#: The same over the helper models of the oracle.
SQL = {
    "io_raw_csv": "SELECT * FROM raw_sales",
    "io_text_table": "SELECT * FROM raw_products",
    "io_fact_days": f"SELECT coalesce(COLUMNS(*), '') FROM raw_inventory WHERE dt BETWEEN '{FROM}' AND '{TO}'",
    "io_mart": "SELECT sale_date, store_id, product_id, total_quantity_sold FROM fct_daily_sales",
    "io_dim": "SELECT store_id, store_name FROM dim_stores",
    "io_ingest": "SELECT sale_date::VARCHAR AS dt, count(*) AS n FROM stg_sales GROUP BY 1",
    "io_ingest_all": "SELECT 'sales' AS \"table\", 'written' AS status, count(DISTINCT sale_date) AS n FROM stg_sales UNION ALL SELECT 'wrong', 'failed', 0 UNION ALL SELECT 'stores', 'written', count(*) FROM stg_stores",
    "io_dated": "SELECT store_id, '2025-01-02' AS dt FROM stg_stores UNION ALL SELECT store_id, '2025-01-01' FROM stg_stores WHERE store_id = '3'",
    "io_report": "SELECT store_id, store_name, region FROM stg_stores",
    "io_table": "SELECT * FROM stg_items",
    "feat_matrix_bucketed": "SELECT * FROM feat_matrix",
    "io_jdbc": "SELECT * FROM stg_items",
    "sample_by_key": f"""SELECT store_id, n_sales, units, n_inventory FROM (SELECT store_id, count(*) AS n_sales, sum(total_quantity_sold)::BIGINT AS units FROM fct_daily_sales GROUP BY 1)
      FULL JOIN (SELECT store_id, count(*) AS n_inventory FROM fct_inventory_snapshots GROUP BY 1) USING (store_id)
      WHERE store_id IN (SELECT store_id FROM stg_stores ORDER BY {_hash('store_id')}, store_id LIMIT (SELECT ceil(count(*) / 3)::BIGINT FROM stg_stores))""",
    "sample_exact": f"SELECT item_nbr FROM stg_items ORDER BY {_hash('item_nbr::VARCHAR')}, item_nbr::VARCHAR LIMIT 100",
    "sample_bernoulli": f"SELECT sale_id, store_id, quantity_sold FROM stg_sales WHERE {_hash('sale_id')} < {int(0.05 * (1 << 48))}",
    "io_verify": f"SELECT date::VARCHAR AS dt, count(*) AS rows, count(*) AS n_found, 'ok' AS status FROM stg_transactions GROUP BY 1 UNION ALL SELECT '{UNLISTED}', NULL, 3, 'unlisted'",
    "dq_coverage_folders": """SELECT t AS "table", min(d) AS first_date, max(d) AS last_date, count(DISTINCT d) AS n_dates, date_diff('day', (SELECT min(d) FROM folder_dates), (SELECT max(d) FROM folder_dates)) + 1 - count(DISTINCT d) AS n_missing, count(*) AS n_rows
      FROM folder_dates GROUP BY t""",
    "folder_dates": "SELECT 'sales' AS t, sale_date AS d FROM stg_sales UNION ALL SELECT 'inventory', snapshot_date FROM stg_inventory UNION ALL SELECT 'transactions', date FROM stg_transactions",
}
