"""Retail- and grocery-shaped raw tables, all text at the edge, derived from the star-schema tables.

Each text below is plain SQL that Spark and other engines read alike; {names in braces} are the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

RAW = {
    "raw_sales": """
SELECT cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) AS sale_id, cast(cast(l_shipdate AS date) AS string) AS sale_date,
       cast(s_nationkey AS string) AS store_id, p_brand AS product_id, cast(cast(l_quantity AS int) AS string) AS quantity_sold,
       cast(cast(p_retailprice AS decimal(10,2)) AS string) AS unit_price,
       cast(nullif(cast(cast(l_extendedprice AS decimal(12,2)) * cast(l_discount AS decimal(4,2)) AS decimal(12,2)), 0) AS string) AS discount_amount,
       cast(cast(cast(l_extendedprice AS decimal(12,2)) * (1 - cast(l_discount AS decimal(4,2))) AS decimal(12,2)) AS string) AS total_amount
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey""",
    "raw_stores": """
SELECT cast(n_nationkey AS string) AS store_id, n_name AS store_name, CASE WHEN n_nationkey = 7 THEN '  ' ELSE r_name END AS region,
       CASE n_nationkey % 4 WHEN 0 THEN 'Superstore' WHEN 1 THEN 'Standard' WHEN 2 THEN 'Express' ELSE 'Outlet' END AS store_type,
       cast(5000 + 1000 * n_nationkey AS string) AS sq_footage, cast(date '2010-03-15' + 97 * n_nationkey AS string) AS opened_date
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "raw_products": """
SELECT p_brand AS product_id, min(p_name) AS product_name, min(p_type) AS category, max(p_type) AS sub_category,
       cast(cast(max(cast(p_retailprice AS decimal(10,2))) * cast(0.6 AS decimal(2,1)) AS decimal(12,3)) AS string) AS unit_cost,
       ' ' || cast(max(cast(p_retailprice AS decimal(10,2))) AS string) AS unit_price, cast(cast(substr(p_brand, 7) AS int) % 17 AS string) AS supplier_id,
       CASE cast(substr(p_brand, 7) AS int) % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'false' ELSE 'yes' END AS is_active
FROM {part} GROUP BY p_brand""",
    "raw_suppliers": """
SELECT cast(s_suppkey AS string) AS supplier_id, s_name AS supplier_name, cast(3 + s_suppkey % 19 AS string) AS lead_time_days,
       cast(cast(50 + s_suppkey % 50 AS decimal(5,2)) / 100 AS string) AS on_time_rate, n_name AS country
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "raw_shipments": """
SELECT cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) AS shipment_id, cast(cast(l_shipdate AS date) AS string) AS order_date,
       cast(cast(l_shipdate AS date) + cast(7 + l_suppkey % 14 AS int) AS string) AS expected_date,
       CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN NULL
            ELSE cast(cast(l_shipdate AS date) + cast(7 + l_suppkey % 14 + CASE WHEN l_returnflag = 'R' THEN 1 + l_linenumber % 7 ELSE 0 END AS int) AS string) END AS received_date,
       cast(s_nationkey AS string) AS store_id, p_brand AS product_id, cast(l_suppkey % 17 AS string) AS supplier_id, cast(cast(l_quantity AS int) AS string) AS quantity_ordered,
       cast(cast(l_quantity AS int) - CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 1 ELSE 0 END AS string) AS quantity_received,
       CASE WHEN l_returnflag = 'R' THEN 'True' ELSE 'false' END AS is_late, cast(l_partkey AS string) AS line_part, cast(l_suppkey AS string) AS line_supplier
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey""",
    "raw_inventory": """
SELECT cast(d AS string) AS snapshot_date, store_id, product_id, CASE WHEN q % 31 = 0 THEN '' ELSE cast((7 * q + 3 * extract(day FROM d)) % 60 - 3 AS string) END AS quantity_on_hand,
       CASE WHEN (q + extract(day FROM d)) % 5 = 0 THEN '30' ELSE '0' END AS quantity_on_order, ' ' || cast(10 + q % 20 AS string) AS reorder_point,
       CASE WHEN q % 13 = 0 THEN '.' WHEN q % 17 = 0 THEN '' ELSE cast(d - cast(q % 90 AS int) AS string) END AS last_restock_date, cast(d AS string) AS dt
FROM (SELECT cast(l_shipdate AS date) AS d, cast(s_nationkey AS string) AS store_id, p_brand AS product_id, cast(sum(l_quantity) AS int) AS q
      FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey GROUP BY cast(l_shipdate AS date), s_nationkey, p_brand) x""",
    "raw_train": """
SELECT cast(l_orderkey AS string) AS id, cast(cast(l_shipdate AS date) AS string) AS date, cast(s_nationkey AS string) AS store_nbr, cast(l_partkey AS string) AS item_nbr,
       cast(cast(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS decimal(8,1)) AS string) AS unit_sales,
       CASE WHEN l_discount > 0.05 THEN 'True' WHEN l_discount < 0.01 THEN NULL ELSE 'False' END AS onpromotion
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "raw_grocery_stores": """
SELECT cast(n_nationkey AS string) AS store_nbr, n_name AS city, r_name AS state, CASE n_nationkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END AS type,
       cast(n_nationkey % 17 AS string) AS cluster
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "raw_items": """
SELECT cast(p_partkey AS string) AS item_nbr, p_type AS family, cast(p_size AS string) AS class, cast(p_size % 2 AS string) AS perishable FROM {part}""",
    "raw_transactions": """
SELECT cast(cast(o_orderdate AS date) AS string) AS date, cast(c_nationkey AS string) AS store_nbr, cast(count(*) AS string) AS transactions
FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY cast(o_orderdate AS date), c_nationkey""",
    "raw_holidays": """
SELECT cast(d AS string) AS date, CASE extract(day FROM d) WHEN 1 THEN 'Holiday' WHEN 11 THEN 'Event' ELSE 'Bridge' END AS type,
       CASE extract(month FROM d) % 3 WHEN 0 THEN 'Local' WHEN 1 THEN 'National' ELSE 'Regional' END AS locale, 'all' AS locale_name, 'day' AS description,
       CASE WHEN extract(month FROM d) = 5 THEN 'True' ELSE 'False' END AS transferred
FROM (SELECT DISTINCT cast(o_orderdate AS date) AS d FROM {orders}) x WHERE extract(day FROM d) IN (1, 11, 24)""",
    "raw_oil": """
SELECT cast(d AS string) AS date, CASE WHEN extract(day FROM d) = 31 THEN NULL ELSE cast(cast(40 + cast(n AS decimal(9,2)) / 4 AS decimal(9,2)) AS string) END AS dcoilwtico
FROM (SELECT cast(o_orderdate AS date) AS d, count(*) AS n FROM {orders} GROUP BY cast(o_orderdate AS date)) x""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the raw tables as a DataFrame over the given Parquet tables."""
    text = RAW[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})


def raw_sql(name: str) -> str:
    """The same as SQL text over tables of their own names."""
    return RAW[name].format(**{t: t for t in TABLES})
