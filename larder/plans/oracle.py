"""The retail queries as plain SQL for an independent engine (DuckDB dialect), each a chain of common table expressions."""

from __future__ import annotations

import re

from larder.operators.features import NUMERIC
from larder.plans.retail import AS_OF, EVENT, FOLDS
from larder.plans.sinks import SQL as SINK_SQL
from larder.sources.fixtures import RAW, raw_sql


def _num(col: str, kind: str) -> str:
    return f"try_cast(nullif(trim({col}), '') AS {kind})"


def _day(col: str) -> str:
    return f"try_cast(nullif(nullif(trim({col}), ''), '.') AS date)"


def _true(col: str) -> str:
    return f"coalesce(lower({col}) IN ('true', 't', '1', 'yes'), false)"


def _div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


_EVENT = f"d BETWEEN DATE '{EVENT[0]}' AND DATE '{EVENT[1]}'"
_DAY_PARTS = f"year(d) AS year, month(d) AS month, day(d) AS day, dayofweek(d) AS day_of_week, {_EVENT} AS is_event_period, (day(d) = 15 OR d = last_day(d)) AS is_wage_day"
_S = "PARTITION BY store_id, product_id ORDER BY date"


def _rolling() -> str:
    out = []
    for w in (7, 14, 28):
        o = f"OVER ({_S} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        gate = f"count(q) {o} >= {w // 2}"
        out += [f"CASE WHEN {gate} THEN avg(q) {o} END AS roll_mean_{w}", f"coalesce(CASE WHEN {gate} THEN stddev_samp(q) {o} END, 0) AS roll_std_{w}", f"CASE WHEN {gate} THEN min(q) {o} END AS roll_min_{w}", f"CASE WHEN {gate} THEN max(q) {o} END AS roll_max_{w}"]
    return ", ".join(out)


def _ewm(span: int, depth: int) -> str:
    r = 1 - 2 / (span + 1)
    window = f"OVER ({_S} ROWS BETWEEN {depth} PRECEDING AND 1 PRECEDING)"
    up = f"list_sum(list_transform(list(q) {window}, lambda v, i: v * power({r!r}, least(i0, {depth}) - i)))"
    return f"CASE WHEN i0 >= 3 THEN {up} * {2 / (span + 1)!r} / (1 - power({r!r}, i0)) END AS ewm_mean_{span}"


_METRICS = "sum(abs(target - forecast)) / nullif(sum(abs(target)), 0) AS wape, sqrt(avg((target - forecast) * (target - forecast))) AS rmse, avg(forecast - target) AS bias, count(*) AS n"
_FOLD_ROWS = " UNION ALL ".join(f"SELECT {f} AS fold, {t} AS te, {a} AS va, {b} AS vb" for f, t, a, b in FOLDS)
_DOW = "CASE WHEN day_of_week IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END"


def _split(flag: str, yes: str, no: str, days: bool, name: str) -> str:
    count = "count(DISTINCT saledate) AS days, " if days else ""
    return f"SELECT '{name}' AS analysis_type, CASE WHEN {flag} THEN '{yes}' ELSE '{no}' END AS day_kind, {count}sum(total_units_sold) AS total_units, avg(total_units_sold) AS avg_daily_units FROM mart_store_daily_sales GROUP BY 2"


def _rule(check: str, table: str, column: str, severity: str, count: str) -> str:
    return f"SELECT '{check}' AS \"check\", '{table}' AS \"table\", '{column}' AS \"column\", '{severity}' AS severity, n AS n_failed, CASE WHEN n = 0 THEN 'pass' ELSE '{severity}' END AS status FROM ({count}) x"


#: The rule set of shipments: what fails.
_SHIPMENT_ROWS = [
    ("not_null", "shipment_id", "error", "shipment_id IS NULL"), ("not_null", "received_date", "warn", "received_date IS NULL"), ("not_null", "supplier_id", "error", "supplier_id IS NULL"),
    ("accepted_range", "quantity_ordered", "error", "quantity_ordered NOT BETWEEN 1 AND 40"), ("date_range", "order_date", "warn", "order_date NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"), ("condition", "fill_rate", "error", "fill_rate > 1"),
    ("accepted_values", "store_id", "warn", "store_id::INT NOT BETWEEN 0 AND 19"),
]
_SHIPMENT_KEYS = [
    ("unique", "shipment_id", "error", "SELECT count(*) AS n FROM (SELECT shipment_id FROM stg_shipments WHERE shipment_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"),
    ("unique_combination", "store_id,product_id,order_date", "warn", "SELECT count(*) AS n FROM (SELECT 1 FROM stg_shipments GROUP BY store_id, product_id, order_date HAVING count(*) > 1)"),
    ("relationships", "supplier_id", "warn", "SELECT count(*) AS n FROM stg_shipments WHERE supplier_id IS NOT NULL AND supplier_id NOT IN (SELECT supplier_id FROM stg_suppliers WHERE supplier_id <> '3')"),
    ("relationships", "store_id", "error", "SELECT count(*) AS n FROM stg_shipments WHERE store_id IS NOT NULL AND store_id NOT IN (SELECT store_id FROM stg_stores)"),
]

#: Models by name; a model's text names those it reads, and they become its common table expressions.
SQL: dict[str, str] = {
    **{name: raw_sql(name) for name in RAW},
    "stg_products": f"SELECT product_id, product_name, category, c AS unit_cost, p AS unit_price, p - c AS unit_gross_margin, {_div('p - c', 'p')} AS unit_margin_pct, supplier_id, {_true('is_active')} AS is_active FROM (SELECT *, {_num('unit_cost', 'DECIMAL(10,2)')} AS c, {_num('unit_price', 'DECIMAL(10,2)')} AS p FROM raw_products)",
    "stg_stores": f"SELECT store_id, store_name, coalesce(nullif(trim(region), ''), 'Unknown') AS region, store_type, {_num('sq_footage', 'INTEGER')} AS square_footage, {_day('opened_date')} AS opened_date, CASE store_type WHEN 'Superstore' THEN 'Large' WHEN 'Standard' THEN 'Medium' WHEN 'Express' THEN 'Small' ELSE 'Unknown' END AS store_size_category, date_sub('year', {_day('opened_date')}, DATE '{AS_OF}') AS store_age_years FROM raw_stores",
    "stg_suppliers": f"SELECT supplier_id, supplier_name, country, d AS lead_time_days, r AS on_time_delivery_rate, CASE WHEN d <= 7 THEN 'Fast' WHEN d <= 14 THEN 'Standard' ELSE 'Slow' END AS lead_time_category, CASE WHEN r >= 0.95 THEN 'Excellent' WHEN r >= 0.85 THEN 'Good' WHEN r >= 0.75 THEN 'Fair' ELSE 'Poor' END AS on_time_performance_tier FROM (SELECT *, {_num('lead_time_days', 'INTEGER')} AS d, {_num('on_time_rate', 'DECIMAL(5,3)')} AS r FROM raw_suppliers)",
    "stg_sales": f"""SELECT sale_id, d AS sale_date, store_id, product_id, q AS quantity_sold, p AS unit_price, di AS discount_amount, t AS total_amount, {_div('coalesce(di, 0)', 'coalesce(t, 0) + coalesce(di, 0)')} AS discount_rate,
      year(d) AS sale_year, month(d) AS sale_month, day(d) AS sale_day, isodow(d) AS day_of_week, dayname(d) AS day_name, isodow(d) IN (6, 7) AS is_weekend
      FROM (SELECT sale_id, store_id, product_id, {_day('sale_date')} AS d, {_num('quantity_sold', 'INTEGER')} AS q, {_num('unit_price', 'DECIMAL(10,2)')} AS p, {_num('discount_amount', 'DECIMAL(10,2)')} AS di, {_num('total_amount', 'DECIMAL(10,2)')} AS t FROM raw_sales)
      WHERE d IS NOT NULL AND store_id IS NOT NULL AND product_id IS NOT NULL AND q > 0""",
    "stg_inventory": f"""SELECT d AS snapshot_date, store_id, product_id, h AS quantity_on_hand, o AS quantity_on_order, rp AS reorder_point, lr AS last_restock_date, coalesce(h, 0) + coalesce(o, 0) AS total_available_quantity, date_diff('day', lr, d) AS days_since_restock,
      coalesce(h, 0) = 0 AS is_out_of_stock, coalesce(h, 0) <= coalesce(rp, 0) AS needs_reorder, coalesce(date_diff('day', lr, d) > 60, false) AS is_slow_moving, dt AS partition_date
      FROM (SELECT store_id, product_id, dt, {_day('snapshot_date')} AS d, {_num('quantity_on_hand', 'INTEGER')} AS h, {_num('quantity_on_order', 'INTEGER')} AS o, {_num('reorder_point', 'INTEGER')} AS rp, {_day('last_restock_date')} AS lr FROM raw_inventory)
      WHERE d IS NOT NULL AND store_id IS NOT NULL AND product_id IS NOT NULL""",
    "stg_shipments": f"""SELECT shipment_id, od AS order_date, ed AS expected_date, rd AS received_date, store_id, product_id, supplier_id, qo AS quantity_ordered, qr AS quantity_received, date_diff('day', od, rd) AS actual_lead_time_days, date_diff('day', od, ed) AS expected_lead_time_days,
      date_diff('day', ed, rd) AS days_late, qr - qo AS quantity_variance, {_div('qr', 'qo')} AS fill_rate, {_true('is_late')} AS is_late, coalesce(rd > ed, false) AS is_delayed, coalesce(qr < qo, false) AS is_partial_shipment
      FROM (SELECT *, {_day('order_date')} AS od, {_day('expected_date')} AS ed, {_day('received_date')} AS rd, {_num('quantity_ordered', 'INTEGER')} AS qo, {_num('quantity_received', 'INTEGER')} AS qr FROM raw_shipments WHERE shipment_id IS NOT NULL AND order_date IS NOT NULL)
      QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY rd DESC NULLS LAST, ed DESC NULLS LAST, od DESC NULLS LAST, qr DESC NULLS LAST, line_part DESC NULLS LAST, line_supplier DESC NULLS LAST, store_id DESC, product_id DESC, supplier_id DESC, quantity_ordered DESC, is_late DESC) = 1""",
    "dim_products": "SELECT product_id, product_name, category, unit_cost, unit_price, unit_gross_margin, unit_margin_pct, is_active, supplier_id, supplier_name, lead_time_category, on_time_delivery_rate, on_time_performance_tier, country AS supplier_country FROM stg_products LEFT JOIN stg_suppliers USING (supplier_id)",
    "dim_stores": "SELECT store_id, store_name, region, store_type, store_size_category, square_footage, opened_date, store_age_years FROM stg_stores",
    "dim_date": """SELECT d AS date_day, year(d) AS year, month(d) AS month, day(d) AS day, isodow(d) AS day_of_week, quarter(d) AS quarter, weekofyear(d) AS week_of_year, dayname(d) AS day_name, monthname(d) AS month_name, isodow(d) IN (6, 7) AS is_weekend,
      CASE WHEN month(d) IN (12, 1, 2) THEN 'Winter' WHEN month(d) <= 5 THEN 'Spring' WHEN month(d) <= 8 THEN 'Summer' ELSE 'Fall' END AS season, CASE WHEN month(d) >= 4 THEN year(d) ELSE year(d) - 1 END AS fiscal_year, CASE WHEN month(d) >= 4 THEN month(d) - 3 ELSE month(d) + 9 END AS fiscal_month
      FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d FROM (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT sale_date AS x FROM stg_sales UNION ALL SELECT snapshot_date FROM stg_inventory UNION ALL SELECT order_date FROM stg_shipments)))""",
    "fct_daily_sales": f"""SELECT f.*, store_name, region, store_type, store_size_category, product_name, category, unit_cost, supplier_name, total_quantity_sold * unit_cost AS total_cost, total_net_amount - total_quantity_sold * unit_cost AS total_profit, {_div('total_net_amount - total_quantity_sold * unit_cost', 'total_net_amount')} AS profit_margin
      FROM (SELECT sale_date, store_id, product_id, year(sale_date) AS sale_year, month(sale_date) AS sale_month, day(sale_date) AS sale_day, isodow(sale_date) AS day_of_week, dayname(sale_date) AS day_name, isodow(sale_date) IN (6, 7) AS is_weekend, count(DISTINCT sale_id) AS transaction_count, sum(quantity_sold)::BIGINT AS total_quantity_sold,
        sum(total_amount + discount_amount) AS total_gross_amount, sum(discount_amount) AS total_discount_amount, sum(total_amount) AS total_net_amount, avg(unit_price::DOUBLE) AS avg_unit_price, avg(discount_rate) AS avg_discount_rate, min(unit_price) AS min_unit_price, max(unit_price) AS max_unit_price FROM stg_sales GROUP BY sale_date, store_id, product_id) f
      LEFT JOIN stg_stores USING (store_id) LEFT JOIN (SELECT product_id, product_name, category, unit_cost, supplier_name FROM dim_products) p USING (product_id)""",
    "fct_inventory_snapshots": """SELECT snapshot_date, store_id, product_id, store_name, region, store_type, product_name, category, unit_cost, unit_price, quantity_on_hand, CASE WHEN quantity_on_hand < 0 THEN 0 ELSE quantity_on_hand END AS quantity_on_hand_clipped, quantity_on_order, total_available_quantity, reorder_point, days_since_restock,
      quantity_on_hand * unit_cost AS inventory_value_at_cost, CASE WHEN quantity_on_hand < 0 THEN 0 ELSE quantity_on_hand END * unit_cost AS inventory_value_at_cost_clipped, is_out_of_stock, needs_reorder, is_slow_moving
      FROM stg_inventory LEFT JOIN stg_stores USING (store_id) LEFT JOIN (SELECT product_id, product_name, category, unit_cost, unit_price FROM dim_products) p USING (product_id)""",
    "mart_supplier_performance": """SELECT supplier_id, supplier_name, country, lead_time_category, on_time_performance_tier, total_shipments, late_shipments, partial_shipments, delayed_shipments, avg_actual_lead_time_days, avg_expected_lead_time_days, avg_days_late, avg_fill_rate, calculated_on_time_rate,
      total_quantity_ordered, total_quantity_received, total_quantity_variance, on_time_delivery_rate::DOUBLE AS master_on_time_rate, calculated_on_time_rate - on_time_delivery_rate::DOUBLE AS on_time_rate_variance
      FROM stg_suppliers LEFT JOIN (SELECT supplier_id, count(DISTINCT shipment_id) AS total_shipments, count(DISTINCT shipment_id) FILTER (is_late) AS late_shipments, count(DISTINCT shipment_id) FILTER (is_partial_shipment) AS partial_shipments, count(DISTINCT shipment_id) FILTER (is_delayed) AS delayed_shipments,
        avg(actual_lead_time_days) AS avg_actual_lead_time_days, avg(expected_lead_time_days) AS avg_expected_lead_time_days, avg(days_late) AS avg_days_late, avg(fill_rate) AS avg_fill_rate, (count(*) FILTER (NOT is_late)) / count(*) AS calculated_on_time_rate, sum(quantity_ordered)::BIGINT AS total_quantity_ordered, sum(quantity_received)::BIGINT AS total_quantity_received, sum(quantity_variance)::BIGINT AS total_quantity_variance
        FROM stg_shipments GROUP BY supplier_id) m USING (supplier_id)""",
    "stg_train": f"SELECT id, d AS date, store_nbr, item_nbr, unit_sales, unit_sales < 0 AS is_return, onpromotion, {_DAY_PARTS} FROM (SELECT {_num('id', 'BIGINT')} AS id, {_day('date')} AS d, {_num('store_nbr', 'INTEGER')} AS store_nbr, {_num('item_nbr', 'INTEGER')} AS item_nbr, {_num('unit_sales', 'DOUBLE')} AS unit_sales, {_true('onpromotion')} AS onpromotion FROM raw_train) WHERE d IS NOT NULL AND store_nbr IS NOT NULL AND unit_sales IS NOT NULL AND item_nbr IS NOT NULL",
    "stg_test": f"SELECT id, d AS date, store_nbr, item_nbr, onpromotion, {_DAY_PARTS} FROM (SELECT {_num('id', 'BIGINT')} AS id, {_day('date')} AS d, {_num('store_nbr', 'INTEGER')} AS store_nbr, {_num('item_nbr', 'INTEGER')} AS item_nbr, {_true('onpromotion')} AS onpromotion FROM raw_train) WHERE d IS NOT NULL AND store_nbr IS NOT NULL AND item_nbr IS NOT NULL",
    "stg_holidays": f"SELECT {_day('date')} AS holiday_date, type AS holiday_type, locale AS holiday_locale, locale_name, description AS holiday_description, {_true('transferred')} AS holiday_transferred, coalesce(type IN ('Holiday', 'Additional', 'Bridge') AND NOT {_true('transferred')}, false) AS is_actual_holiday FROM raw_holidays WHERE date IS NOT NULL",
    "stg_oil": f"SELECT d AS date, p AS oil_price, p - lag(p) OVER (ORDER BY d) AS oil_price_change FROM (SELECT {_day('date')} AS d, {_num('dcoilwtico', 'DOUBLE')} AS p FROM raw_oil WHERE date IS NOT NULL)",
    "stg_items": f"SELECT * FROM (SELECT {_num('item_nbr', 'INTEGER')} AS item_nbr, family, {_num('class', 'INTEGER')} AS class, {_true('perishable')} AS perishable FROM raw_items) WHERE item_nbr IS NOT NULL",
    "stg_grocery_stores": f"SELECT * FROM (SELECT {_num('store_nbr', 'INTEGER')} AS store_nbr, city, state, type AS store_type, {_num('cluster', 'INTEGER')} AS store_cluster FROM raw_grocery_stores) WHERE store_nbr IS NOT NULL",
    "stg_transactions": f"SELECT * FROM (SELECT {_day('date')} AS date, {_num('store_nbr', 'INTEGER')} AS store_nbr, {_num('transactions', 'INTEGER')} AS transactions FROM raw_transactions) WHERE date IS NOT NULL AND store_nbr IS NOT NULL AND transactions IS NOT NULL",
    "mart_store_daily_sales": """SELECT date AS saledate, store_nbr, city, state, store_type, store_cluster, unique_item_types_sold, line_items, total_units_sold, returned_units, sold_units, coalesce(transactions_count, 0)::BIGINT AS transactions_count, promo_units, nonpromo_units, items_on_promo, distinct_items_on_promo,
      year(date) AS year, month(date) AS month, day(date) AS day, dayofweek(date) AS day_of_week, is_wage_day, is_event_period, dayname(date) AS day_name, coalesce(is_holiday, false) AS is_holiday
      FROM (SELECT date, store_nbr, count(DISTINCT item_nbr) AS unique_item_types_sold, count(*) AS line_items, sum(unit_sales) AS total_units_sold, sum(CASE WHEN is_return THEN abs(unit_sales) ELSE 0 END) AS returned_units, sum(CASE WHEN is_return THEN 0 ELSE unit_sales END) AS sold_units,
        sum(CASE WHEN onpromotion THEN unit_sales ELSE 0 END) AS promo_units, sum(CASE WHEN onpromotion THEN 0 ELSE unit_sales END) AS nonpromo_units, count(*) FILTER (onpromotion) AS items_on_promo, count(DISTINCT item_nbr) FILTER (onpromotion) AS distinct_items_on_promo, bool_or(is_wage_day) AS is_wage_day, bool_or(is_event_period) AS is_event_period FROM stg_train GROUP BY date, store_nbr)
      LEFT JOIN stg_grocery_stores USING (store_nbr) LEFT JOIN (SELECT date, store_nbr, sum(transactions) AS transactions_count FROM stg_transactions GROUP BY ALL) t USING (date, store_nbr)
      LEFT JOIN (SELECT holiday_date AS date, true AS is_holiday FROM stg_holidays WHERE is_actual_holiday AND holiday_locale IN ('National', 'Regional') GROUP BY 1) h USING (date)""",
    "an_summary": "SELECT 'summary' AS analysis_type, count(DISTINCT saledate) AS total_days, count(DISTINCT store_nbr) AS total_stores, sum(total_units_sold) AS total_units_sold, sum(returned_units) AS total_returned_units, sum(transactions_count)::BIGINT AS total_transactions, count(DISTINCT saledate) FILTER (is_holiday) AS holiday_days, count(DISTINCT saledate) FILTER (is_wage_day) AS wage_days, count(DISTINCT saledate) FILTER (is_event_period) AS event_days, count(DISTINCT saledate) FILTER (is_holiday AND is_wage_day) AS holiday_wage_days, avg(total_units_sold) AS avg_daily_units FROM mart_store_daily_sales",
    "an_top_stores": "SELECT 'top_stores' AS analysis_type, store_nbr, city, store_type, sum(total_units_sold) AS total_units, avg(total_units_sold) AS avg_daily_units, count(DISTINCT saledate) AS days_operated FROM mart_store_daily_sales GROUP BY ALL ORDER BY total_units DESC, store_nbr LIMIT 10",
    "an_weekend": _split("day_of_week IN (0, 6)", "Weekend", "Weekday", True, "weekend"),
    "an_holiday": _split("is_holiday", "Holiday", "Non-Holiday", True, "holiday"),
    "an_wage_days": _split("is_wage_day", "Wage Day", "Other Day", False, "wage_days"),
    "an_event_period": _split("is_event_period", "Event Period", "Other Period", True, "event_period"),
    "an_monthly": "SELECT 'monthly' AS analysis_type, year, month, min(strftime(saledate, '%b')) AS month_name, sum(total_units_sold) AS total_units, avg(total_units_sold) AS avg_daily_units FROM mart_store_daily_sales GROUP BY year, month",
    "an_store_type": "SELECT 'store_type' AS analysis_type, store_type, count(DISTINCT store_nbr) AS stores, sum(total_units_sold) AS total_units, avg(total_units_sold) AS avg_daily_units FROM mart_store_daily_sales GROUP BY store_type",
    "an_returns": "SELECT 'returns' AS analysis_type, store_nbr, city, sum(returned_units) AS total_returns, count(*) AS days_with_returns FROM mart_store_daily_sales WHERE returned_units > 0 GROUP BY store_nbr, city ORDER BY total_returns DESC, store_nbr LIMIT 10",
    "an_union": " UNION ALL BY NAME ".join(f"SELECT * FROM {n}" for n in ("an_summary", "an_top_stores", "an_weekend", "an_monthly", "an_holiday", "an_store_type", "an_wage_days", "an_event_period", "an_returns")),
    "r_summary": "SELECT count(DISTINCT saledate) AS total_days, count(DISTINCT store_nbr) AS total_stores, sum(total_units_sold) AS total_units, sum(total_units_sold) / count(DISTINCT saledate) AS units_per_day, count(*) FILTER (is_holiday) AS holiday_store_days, count(*) FILTER (is_wage_day) AS wage_store_days, count(*) FILTER (is_event_period) AS event_store_days FROM mart_store_daily_sales",
    "r_top_stores": "SELECT store_nbr, sum(total_units_sold) AS total_units, count(*) AS days_operated, sum(total_units_sold) / count(*) AS units_per_day FROM mart_store_daily_sales GROUP BY store_nbr ORDER BY total_units DESC, store_nbr LIMIT 10",
    "r_weekend": f"SELECT {_DOW} AS day_kind, sum(total_units_sold) AS total_units, count(*) AS store_days, sum(total_units_sold) / count(*) AS units_per_store_day FROM mart_store_daily_sales GROUP BY 1",
    "dq_observed": " UNION ALL ".join(_rule(check, "stg_shipments", column, severity, f"SELECT count(*) FILTER ({bad}) AS n FROM stg_shipments") for check, column, severity, bad in _SHIPMENT_ROWS),
    "dq_rules": " UNION ALL ".join(["SELECT * FROM dq_observed"] + [_rule(check, "stg_shipments", column, severity, count) for check, column, severity, count in _SHIPMENT_KEYS]),
    "dq_not_null": " UNION ALL ".join(_rule("not_null", "stg_shipments", c, "error", f"SELECT count(*) FILTER ({c} IS NULL) AS n FROM stg_shipments") for c in ("shipment_id", "received_date", "supplier_id")),
    "dq_unique": _rule("unique", "raw_shipments", "shipment_id", "warn", "SELECT count(*) AS n FROM (SELECT shipment_id FROM raw_shipments WHERE shipment_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"),
    "dq_unique_combo": _rule("unique_combination", "raw_train", "date,store_nbr,item_nbr", "error", "SELECT count(*) AS n FROM (SELECT 1 FROM raw_train GROUP BY date, store_nbr, item_nbr HAVING count(*) > 1)"),
    "dq_accepted_values": _rule("accepted_values", "raw_products", "is_active", "error", "SELECT count(*) FILTER (is_active NOT IN ('True', 'False', 'true', 'false')) AS n FROM raw_products"),
    "dq_relationships": _rule("relationships", "stg_products", "supplier_id", "error", "SELECT count(*) AS n FROM stg_products WHERE supplier_id IS NOT NULL AND supplier_id NOT IN (SELECT supplier_id FROM stg_suppliers)"),
    "dq_range": _rule("accepted_range", "stg_inventory", "quantity_on_hand", "error", "SELECT count(*) FILTER (quantity_on_hand < 0 OR quantity_on_hand > 50) AS n FROM stg_inventory"),
    "dq_date_range": _rule("date_range", "stg_sales", "sale_date", "error", "SELECT count(*) FILTER (sale_date < DATE '1996-01-01' OR sale_date > DATE '2000-12-31') AS n FROM stg_sales"),
    "dq_availability": "SELECT 'stg_sales' AS \"table\", count(*) AS n_rows, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END AS status FROM stg_sales UNION ALL SELECT 'stg_stores', count(*), CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END FROM stg_stores UNION ALL SELECT 'stg_empty', 0, 'empty' UNION ALL SELECT 'stg_absent', NULL, 'missing'",
    "dq_pk": " UNION ALL ".join(_rule("not_null", "raw_shipments", c, "error", f"SELECT count(*) FILTER ({c} IS NULL) AS n FROM raw_shipments") for c in ("shipment_id", "received_date")) + " UNION ALL " + _rule("unique_combination", "raw_shipments", "shipment_id,received_date", "error", "SELECT count(*) AS n FROM (SELECT 1 FROM raw_shipments GROUP BY shipment_id, received_date HAVING count(*) > 1)"),
    "held_dates": "SELECT DISTINCT 'sales' AS t, sale_date AS d FROM stg_sales UNION ALL SELECT DISTINCT 'inventory', snapshot_date FROM stg_inventory UNION ALL SELECT DISTINCT 'transactions', date FROM stg_transactions",
    "dq_coverage": "SELECT t AS \"table\", min(d) AS first_date, max(d) AS last_date, count(*) AS n_dates, (SELECT date_diff('day', min(d), max(d)) + 1 FROM held_dates) - count(*) AS n_missing FROM held_dates GROUP BY t",
    "dq_missing_days": "SELECT t AS \"table\", d AS date_day FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM held_dates WHERE t <> 'inventory') CROSS JOIN (SELECT unnest(['sales', 'transactions']) AS t) WHERE (t, d) NOT IN (SELECT (t, d) FROM held_dates)",
    "dq_partition_dates": "SELECT d AS dt, count(*) AS n_tables FROM held_dates WHERE t <> 'inventory' GROUP BY d",
    "dq_freshness": "SELECT max(sale_date) AS last_date, count(*) FILTER (sale_date > DATE '2001-09-01' AND sale_date <= DATE '2001-10-01') AS n_recent, CASE WHEN count(*) FILTER (sale_date > DATE '2001-09-01' AND sale_date <= DATE '2001-10-01') > 0 THEN 'pass' ELSE 'error' END AS status FROM stg_sales",
    "dq_defects": f"SELECT 'null_discount' AS defect, count(*) FILTER (nullif(trim(discount_amount), '') IS NULL) AS n, count(*) AS n_rows FROM raw_sales UNION ALL SELECT 'negative_on_hand', count(*) FILTER ({_num('quantity_on_hand', 'INTEGER')} < 0), count(*) FROM raw_inventory UNION ALL SELECT 'null_region', count(*) FILTER (nullif(trim(region), '') IS NULL), count(*) FROM raw_stores UNION ALL SELECT 'repeated_shipment', count(shipment_id) - count(DISTINCT shipment_id), count(*) FROM raw_shipments",
    "avg_daily_demand": "SELECT store_id, product_id, sum(total_quantity_sold) / 30.0 AS avg_daily_demand FROM fct_daily_sales WHERE sale_date >= (SELECT max(sale_date) FROM fct_daily_sales) - 30 GROUP BY ALL",
    "latest_inventory": "SELECT * FROM fct_inventory_snapshots WHERE snapshot_date = (SELECT max(snapshot_date) FROM fct_inventory_snapshots)",
    "stockout_risk": """SELECT row_number() OVER (ORDER BY risk_score DESC NULLS LAST, store_id, product_id)::INTEGER AS risk_rank, * FROM (SELECT *, expected_replenishment_days - days_of_stock_remaining AS risk_score FROM (
      SELECT i.store_id, i.product_id, i.product_name, i.category, p.supplier_id, s.supplier_name, quantity_on_hand, reorder_point, quantity_on_order, coalesce(d.avg_daily_demand, 0)::DOUBLE AS avg_daily_demand,
        CASE WHEN coalesce(d.avg_daily_demand, 0) > 0 THEN (CASE WHEN quantity_on_hand < 0 THEN 0 ELSE quantity_on_hand END) / d.avg_daily_demand::DOUBLE ELSE 'Infinity'::DOUBLE END AS days_of_stock_remaining,
        avg_actual_lead_time_days, calculated_on_time_rate, avg_actual_lead_time_days / CASE WHEN calculated_on_time_rate < 0.01 THEN 0.01 ELSE calculated_on_time_rate END AS expected_replenishment_days, is_out_of_stock, needs_reorder
      FROM (SELECT * REPLACE (coalesce(quantity_on_hand, 0) AS quantity_on_hand, coalesce(reorder_point, 0) AS reorder_point, coalesce(quantity_on_order, 0) AS quantity_on_order) FROM latest_inventory) i LEFT JOIN avg_daily_demand d ON i.store_id = d.store_id AND i.product_id = d.product_id LEFT JOIN dim_products p ON i.product_id = p.product_id LEFT JOIN mart_supplier_performance s ON p.supplier_id = s.supplier_id))""",
    "risk_summary": "SELECT count(*) AS n_scored, count(*) FILTER (quantity_on_hand <= 0) AS n_out_of_stock, count(*) FILTER (risk_score > 0) AS n_positive FROM stockout_risk",
    "top_risk": "SELECT * FROM stockout_risk WHERE risk_rank <= 25",
    "supplier_quadrants": """SELECT supplier_id, supplier_name, calculated_on_time_rate, avg_fill_rate, total_shipments, late_shipments, CASE WHEN a AND b THEN 'Q1: Preferred' WHEN a THEN 'Q2: Reliable but under-delivering' WHEN b THEN 'Q3: Slow but complete' ELSE 'Q4: Renegotiate or replace' END AS quadrant
      FROM (SELECT *, calculated_on_time_rate >= median(calculated_on_time_rate) OVER () AS a, avg_fill_rate >= median(avg_fill_rate) OVER () AS b FROM mart_supplier_performance WHERE calculated_on_time_rate IS NOT NULL AND avg_fill_rate IS NOT NULL)""",
    "series": "SELECT sale_date AS date, store_id, product_id, region, store_type, category, is_weekend, day_of_week, total_quantity_sold AS q, avg_unit_price AS price, total_discount_amount AS disc, total_net_amount AS net FROM fct_daily_sales QUALIFY count(*) OVER (PARTITION BY store_id, product_id) >= 30",
    "feat_lags": "SELECT date, store_id, product_id, " + ", ".join(f"lag(q, {k}) OVER w AS lag_{k}" for k in (1, 7, 14, 28)) + f", lead(q) OVER w AS target FROM series WINDOW w AS ({_S})",
    "feat_rolling": f"SELECT date, store_id, product_id, {_rolling()} FROM series",
    "feat_ewm": f"SELECT date, store_id, product_id, {_ewm(7, 128)}, {_ewm(14, 256)} FROM (SELECT *, row_number() OVER ({_S}) - 1 AS i0 FROM series)",
    "feat_trend": f"SELECT date, store_id, product_id, CASE WHEN count(q) OVER w >= 5 THEN regr_slope(q, i) OVER w END AS demand_trend_14d FROM (SELECT *, row_number() OVER ({_S}) AS i FROM series) WINDOW w AS ({_S} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)",
    "feat_promo": f"SELECT date, store_id, product_id, coalesce((disc > 0)::INTEGER, 0) AS has_discount, least(greatest(coalesce({_div('disc', 'price * q')}, 0), 0), 1) AS discount_pct, coalesce(price / nullif(CASE WHEN count(price) OVER w >= 7 THEN avg(price) OVER w END, 0), 1) AS price_vs_30d_avg, day(date) - 1 AS days_since_period_start FROM series WINDOW w AS ({_S} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)",
    "feat_inventory": "SELECT snapshot_date, store_id, product_id, quantity_on_hand, avg(is_out_of_stock::INTEGER) OVER (PARTITION BY store_id, product_id ORDER BY snapshot_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS stockout_freq_14d FROM fct_inventory_snapshots",
    "feat_region": f"""SELECT s.date, s.store_id, s.product_id, s.region, region_avg_demand_7d FROM series s LEFT JOIN (SELECT region, product_id, date, avg(m) OVER (PARTITION BY region, product_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS region_avg_demand_7d
      FROM (SELECT region, product_id, date, avg(l) AS m FROM (SELECT *, lag(q) OVER ({_S}) AS l FROM series) GROUP BY region, product_id, date)) r ON s.region = r.region AND s.product_id = r.product_id AND s.date = r.date""",
    "feat_matrix": """SELECT s.date, s.store_id, s.product_id, s.region, s.store_type, s.category, s.is_weekend, s.day_of_week, month(s.date) AS month_of_year, day(s.date) AS day_of_month,
        q AS quantity_sold, price AS unit_price, disc AS discount_amount, net AS net_amount, l.* EXCLUDE (date, store_id, product_id), r.* EXCLUDE (date, store_id, product_id), e.* EXCLUDE (date, store_id, product_id),
        t.demand_trend_14d, p.* EXCLUDE (date, store_id, product_id), i.quantity_on_hand, i.quantity_on_order, i.reorder_point, i.needs_reorder::INTEGER AS needs_reorder, f.stockout_freq_14d,
        CASE WHEN i.quantity_on_hand IS NOT NULL AND r.roll_mean_7 IS NOT NULL THEN greatest(i.quantity_on_hand, 0) / greatest(r.roll_mean_7, 0.01) END AS days_of_stock_remaining,
        g.region_avg_demand_7d, m.avg_actual_lead_time_days, m.calculated_on_time_rate, m.avg_fill_rate
      FROM series s JOIN feat_lags l USING (date, store_id, product_id) JOIN feat_rolling r USING (date, store_id, product_id) JOIN feat_ewm e USING (date, store_id, product_id)
        JOIN feat_trend t USING (date, store_id, product_id) JOIN feat_promo p USING (date, store_id, product_id) JOIN feat_region g USING (date, store_id, product_id)
        LEFT JOIN fct_inventory_snapshots i ON i.snapshot_date = s.date AND i.store_id = s.store_id AND i.product_id = s.product_id
        LEFT JOIN feat_inventory f ON f.snapshot_date = s.date AND f.store_id = s.store_id AND f.product_id = s.product_id
        LEFT JOIN dim_products d ON d.product_id = s.product_id LEFT JOIN mart_supplier_performance m ON m.supplier_id = d.supplier_id
      WHERE l.lag_28 IS NOT NULL""",
    "features_filled": "SELECT date, store_id, product_id, " + ", ".join(f"coalesce({c}::DOUBLE, 0) AS {c}" for c in NUMERIC) + " FROM feat_matrix",
    "horizon_rows": f"SELECT date, store_id, product_id, target, target_h FROM (SELECT *, lead(target, 2) OVER ({_S}) AS target_h FROM labelled WHERE target IS NOT NULL) WHERE target_h IS NOT NULL",
    "series_of_region": "SELECT date, store_id, product_id, q AS quantity_sold FROM series WHERE store_id IN (SELECT store_id FROM stg_stores WHERE region = 'EUROPE')",
    "recs_by_tier": "SELECT * FROM reorder",
    "quadrant_list": "SELECT * FROM supplier_quadrants",
    "clean_names": "SELECT store_id, store_name, region, store_type, sq_footage, opened_date FROM raw_stores",
    "eda_stockout_rate": "SELECT category, avg(coalesce(is_out_of_stock, false)::INTEGER) AS mean, count(*) AS count FROM fct_inventory_snapshots GROUP BY category",
    "eda_discount": "SELECT coalesce((total_discount_amount > 0)::INTEGER, 0) AS has_discount, avg(total_quantity_sold) AS mean, median(total_quantity_sold) AS median, count(*) AS count FROM fct_daily_sales GROUP BY 1",
    "labelled": f"SELECT *, lead(q) OVER ({_S}) AS target FROM series",
    "code_values": "SELECT 'store_id' AS c, store_id AS g, date, q::DOUBLE AS v FROM labelled UNION ALL SELECT 'product_id', product_id, date, q FROM labelled UNION ALL SELECT 'region', coalesce(region, ''), date, q FROM labelled",
    "code_days": "SELECT c, g, date, sum(v) AS t, count(v) AS n FROM code_values WHERE v IS NOT NULL GROUP BY ALL",
    "code_all": "SELECT c, date, sum(sum(t)) OVER w AS all_t, sum(sum(n)) OVER w AS all_n FROM code_days GROUP BY c, date WINDOW w AS (PARTITION BY c ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "code_rows": """SELECT c, g, date, (coalesce(own_t, 0) + 10 * coalesce(all_t / all_n, 0)) / (coalesce(own_n, 0) + 10) AS code
      FROM (SELECT *, sum(t) OVER w AS own_t, sum(n) OVER w AS own_n FROM code_days WINDOW w AS (PARTITION BY c, g ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) JOIN code_all USING (c, date)""",
    "feat_codes": """SELECT l.date, store_id, product_id, x.code AS store_id__code, y.code AS product_id__code, z.code AS region__code FROM labelled l
      JOIN code_rows x ON x.c = 'store_id' AND x.g = store_id AND x.date = l.date JOIN code_rows y ON y.c = 'product_id' AND y.g = product_id AND y.date = l.date
      JOIN code_rows z ON z.c = 'region' AND z.g = coalesce(region, '') AND z.date = l.date""",
    "codes_table": """SELECT c AS "column", g AS category, (sum(t) + 10 * (SELECT sum(v) / count(v) FROM code_values WHERE c = 'region')) / (sum(n) + 10) AS code FROM code_days GROUP BY c, g""",
    "folded": f"SELECT * FROM (SELECT *, CASE WHEN day <= te THEN 'train' WHEN day BETWEEN va AND vb THEN 'val' END AS part FROM (SELECT *, date_diff('day', min(date) OVER (), date) + 1 AS day FROM labelled WHERE target IS NOT NULL) CROSS JOIN ({_FOLD_ROWS})) WHERE part IS NOT NULL",
    "wf_folds": "SELECT fold, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'val') AS n_val FROM folded GROUP BY fold",
    "base_values": "SELECT fold, store_id, product_id, max(target) FILTER (k = 1) AS naive, coalesce(max(target) FILTER (k = 7), avg(target)) AS seasonal_naive, avg(target) AS rolling_mean FROM (SELECT *, row_number() OVER (PARTITION BY fold, store_id, product_id ORDER BY date DESC) AS k FROM folded WHERE part = 'train') WHERE k <= 7 GROUP BY ALL",
    "baselines": "SELECT fold, store_id, product_id, date, baseline, target, forecast FROM (SELECT fold, store_id, product_id, date, target, naive::DOUBLE AS naive, seasonal_naive::DOUBLE AS seasonal_naive, rolling_mean::DOUBLE AS rolling_mean FROM folded JOIN base_values USING (fold, store_id, product_id) WHERE part = 'val') UNPIVOT (forecast FOR baseline IN (naive, seasonal_naive, rolling_mean))",
    "forecast_metrics": f"SELECT fold, baseline, {_METRICS} FROM baselines GROUP BY ALL",
    "segment_errors": f"""SELECT x.s AS segment, x.v AS value, {_METRICS} FROM (SELECT target, forecast, unnest([{{'s': 'category', 'v': category}}, {{'s': 'store_type', 'v': store_type}}, {{'s': 'day_of_week', 'v': day_of_week::VARCHAR}}, {{'s': 'has_discount', 'v': has_discount::VARCHAR}}, {{'s': 'demand_level', 'v': lvl}}]) AS x FROM (SELECT target, seasonal_naive AS forecast, category, store_type, day_of_week, (coalesce(disc, 0) > 0)::INTEGER AS has_discount, CASE WHEN target <= (SELECT quantile_cont(target, 0.5) FROM folded JOIN best_fold USING (fold) WHERE part = 'train') THEN 'low' WHEN target <= (SELECT quantile_cont(target, 0.75) FROM folded JOIN best_fold USING (fold) WHERE part = 'train') THEN 'medium' ELSE 'high' END AS lvl
            FROM folded JOIN base_values USING (fold, store_id, product_id) JOIN best_fold USING (fold) WHERE part = 'val')) GROUP BY x.s, x.v""",
    "best_fold": "SELECT max(fold) AS fold FROM folded WHERE part = 'val' HAVING count(*) > 0",
    "deploy_gate": "SELECT a.fold, a.wape AS model_wape, b.wape AS baseline_wape, a.wape / nullif(b.wape, 0) AS fva, coalesce(a.wape / nullif(b.wape, 0) < 1, false) AS deploy FROM forecast_metrics a JOIN forecast_metrics b ON a.fold = b.fold AND a.baseline = 'rolling_mean' AND b.baseline = 'seasonal_naive'",
    "run_metadata": "SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows, count(target) AS n_labelled, count(DISTINCT (store_id, product_id)) AS n_series, 'rolling_mean_7' AS model_version FROM labelled",
    "demand_std": "SELECT store_id, product_id, stddev_samp(target) AS demand_std_14d FROM (SELECT * FROM labelled WHERE target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) <= 14) GROUP BY ALL",
    "pair_forecast": "SELECT store_id, product_id, round(greatest(avg(target), 0), 4) AS f, max(made) AS made FROM (SELECT *, (SELECT max(date) FROM labelled WHERE target IS NULL) AS made FROM labelled WHERE target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) <= 7) GROUP BY ALL",
    "reorder": f"""SELECT *, CASE WHEN expected_lead_time_days IS NULL THEN NULL WHEN quantity_on_hand < safety_stock THEN 'Critical' WHEN quantity_on_hand < reorder_point_ml THEN 'High' WHEN days_of_stock_remaining < expected_lead_time_days * 1.5 THEN 'Medium' ELSE 'Low' END AS risk_tier, CASE WHEN expected_lead_time_days IS NULL THEN 'no supplier figures' END AS reason
      FROM (SELECT store_id, product_id, DATE '{AS_OF}' AS recommendation_date, made AS inference_date, h::DOUBLE AS quantity_on_hand, o::DOUBLE AS quantity_on_order, round_even(f, 4) AS daily_demand_forecast, round_even(h / greatest(f, 0.01), 2) AS days_of_stock_remaining, supplier_id, round_even(lead, 2) AS avg_lead_time_days, round_even(rate, 4) AS on_time_rate, round_even(eff, 2) AS expected_lead_time_days,
        round_even(days * f, 4) AS forecast_demand_lead_time, round_even(sigma, 4) AS demand_std_14d, round_even(1.65 * sigma * sqrt(eff), 4) AS safety_stock, round_even(days * f + 1.65 * sigma * sqrt(eff), 4) AS reorder_point_ml, round_even(greatest(0, days * f + 1.65 * sigma * sqrt(eff) - h - o), 4) AS recommended_order_qty
      FROM (SELECT *, greatest(1, round_even(eff, 0)) AS days FROM (SELECT pf.*, inv.h, inv.o, p.supplier_id, avg_actual_lead_time_days AS lead, calculated_on_time_rate AS rate, avg_actual_lead_time_days / CASE WHEN calculated_on_time_rate < 0.01 THEN 0.01 ELSE calculated_on_time_rate END AS eff, coalesce(demand_std_14d, 0) AS sigma
        FROM pair_forecast pf JOIN (SELECT store_id, product_id, arg_max(greatest(0, coalesce(quantity_on_hand, 0)), snapshot_date) AS h, arg_max(greatest(0, coalesce(quantity_on_order, 0)), snapshot_date) AS o FROM fct_inventory_snapshots GROUP BY ALL) inv USING (store_id, product_id) JOIN dim_products p USING (product_id) JOIN mart_supplier_performance s ON p.supplier_id = s.supplier_id LEFT JOIN demand_std USING (store_id, product_id))))""",
    "tier_counts": "SELECT risk_tier, count(*) AS n FROM reorder GROUP BY 1",
    "top_recs": "SELECT * FROM reorder WHERE risk_tier IN ('Critical', 'High') ORDER BY CASE risk_tier WHEN 'Critical' THEN 0 ELSE 1 END, days_of_stock_remaining, store_id, product_id LIMIT 10",
    "day_metrics": f"SELECT date, baseline, {_METRICS} FROM baselines GROUP BY ALL",
    "bias_drift": "SELECT date, bias, (sum((abs(bias) > 0.5)::INTEGER) OVER w = 7 AND count(*) OVER w = 7) AS alert FROM day_metrics WHERE baseline = 'naive' WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
    "wape_alarm": "SELECT date, a.wape AS model_wape, b.wape AS baseline_wape, coalesce(a.wape > 1.2 * b.wape, false) AS alert FROM (SELECT * FROM day_metrics WHERE baseline = 'naive') a JOIN (SELECT * FROM day_metrics WHERE baseline = 'rolling_mean') b USING (date)",
    "ks_drift": f"""SELECT 'lag_7' AS "column", max(abs(ca / na - cb / nb)) AS ks, max(abs(ca / na - cb / nb)) > 0.2 AS alert FROM (SELECT sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb
      FROM (SELECT x, count(*) FILTER (date < DATE '1998-06-01') AS a, count(*) FILTER (date >= DATE '1998-06-01') AS b FROM (SELECT sale_date AS date, lag(total_quantity_sold, 7) OVER (PARTITION BY store_id, product_id ORDER BY sale_date) AS x FROM fct_daily_sales) WHERE x IS NOT NULL GROUP BY x) WINDOW o AS (ORDER BY x))""",
    "missing_pairs": """SELECT n AS date, count(*) AS n_before, count(*) FILTER (b.store_id IS NULL) AS n_missing, count(*) FILTER (b.store_id IS NULL) > 0.05 * count(*) AS alert FROM (SELECT DISTINCT snapshot_date AS d, store_id, product_id FROM stg_inventory) a
      JOIN (SELECT d, lead(d) OVER (ORDER BY d) AS n FROM (SELECT DISTINCT snapshot_date AS d FROM stg_inventory)) x USING (d) LEFT JOIN (SELECT DISTINCT snapshot_date AS d, store_id, product_id FROM stg_inventory) b ON b.d = x.n AND b.store_id = a.store_id AND b.product_id = a.product_id WHERE n IS NOT NULL GROUP BY n""",
    "eda_describe": "SELECT category, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS least, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, max(v) AS most FROM (SELECT category, total_quantity_sold::DOUBLE AS v FROM fct_daily_sales) GROUP BY category",
    "eda_histogram": "SELECT least(floor((v - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, count(*) AS n FROM (SELECT total_quantity_sold::DOUBLE AS v, min(total_quantity_sold) OVER () AS lo, max(total_quantity_sold) OVER () AS hi FROM fct_daily_sales) GROUP BY 1",
    "eda_histogram_log": "SELECT category, least(floor((v - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin, count(*) AS n FROM (SELECT category, ln(1 + total_quantity_sold) AS v, min(ln(1 + total_quantity_sold)) OVER (PARTITION BY category) AS lo, max(ln(1 + total_quantity_sold)) OVER (PARTITION BY category) AS hi FROM fct_daily_sales) GROUP BY ALL",
    "eda_pivot": "SELECT fold, sum(wape) FILTER (baseline = 'naive') AS naive, sum(wape) FILTER (baseline = 'rolling_mean') AS rolling_mean, sum(wape) FILTER (baseline = 'seasonal_naive') AS seasonal_naive FROM forecast_metrics GROUP BY fold",
    "eda_weekend": "SELECT is_weekend, avg(total_quantity_sold) AS mean, median(total_quantity_sold) AS median, stddev_samp(total_quantity_sold) AS std FROM fct_daily_sales GROUP BY 1",
    "eda_dow": "SELECT category, day_of_week, avg(total_quantity_sold) AS mean, count(*) AS count FROM fct_daily_sales GROUP BY ALL",
    "eda_distinct": "SELECT count(*) AS rows, count(DISTINCT (store_id, product_id)) AS distinct_keys FROM stg_sales",
    "eda_duplicates": "SELECT shipment_id, count(*) AS n FROM raw_shipments GROUP BY 1 HAVING count(*) > 1",
    "eda_values": "SELECT store_size_category, count(*) AS n FROM stg_stores GROUP BY 1",
    "eda_rolling": "SELECT sale_date, units, CASE WHEN count(*) OVER w >= 7 THEN avg(units) OVER w END AS rolling_mean FROM (SELECT sale_date, sum(total_quantity_sold)::BIGINT AS units FROM fct_daily_sales GROUP BY 1) WINDOW w AS (ORDER BY sale_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
}

#: The columns of each result that are decimals or doubles.
ROUNDED: dict[str, str] = {
    "stg_products": "unit_cost unit_price unit_gross_margin unit_margin_pct",
    "stg_suppliers": "on_time_delivery_rate",
    "stg_sales": "unit_price discount_amount total_amount discount_rate",
    "stg_shipments": "fill_rate",
    "dim_products": "unit_cost unit_price unit_gross_margin unit_margin_pct on_time_delivery_rate",
    "fct_daily_sales": "total_gross_amount total_discount_amount total_net_amount avg_unit_price avg_discount_rate min_unit_price max_unit_price unit_cost total_cost total_profit profit_margin",
    "fct_inventory_snapshots": "unit_cost unit_price inventory_value_at_cost inventory_value_at_cost_clipped",
    "mart_supplier_performance": "avg_actual_lead_time_days avg_expected_lead_time_days avg_days_late avg_fill_rate calculated_on_time_rate master_on_time_rate on_time_rate_variance",
    "stg_train": "unit_sales",
    "stg_oil": "oil_price oil_price_change",
    "mart_store_daily_sales": "total_units_sold returned_units sold_units promo_units nonpromo_units",
    "an_summary": "total_units_sold total_returned_units avg_daily_units",
    "an_top_stores": "total_units avg_daily_units",
    "an_weekend": "total_units avg_daily_units",
    "an_holiday": "total_units avg_daily_units",
    "an_wage_days": "total_units avg_daily_units",
    "an_event_period": "total_units avg_daily_units",
    "an_monthly": "total_units avg_daily_units",
    "an_store_type": "total_units avg_daily_units",
    "an_returns": "total_returns",
    "an_union": "total_units avg_daily_units",
    "r_summary": "total_units units_per_day",
    "r_top_stores": "total_units units_per_day",
    "r_weekend": "total_units units_per_store_day",
    "avg_daily_demand": "avg_daily_demand",
    "latest_inventory": "unit_cost unit_price inventory_value_at_cost inventory_value_at_cost_clipped",
    "stockout_risk": "avg_daily_demand days_of_stock_remaining avg_actual_lead_time_days calculated_on_time_rate expected_replenishment_days risk_score",
    "top_risk": "avg_daily_demand days_of_stock_remaining avg_actual_lead_time_days calculated_on_time_rate expected_replenishment_days risk_score",
    "supplier_quadrants": "calculated_on_time_rate avg_fill_rate",
    "feat_rolling": "roll_mean_7 roll_std_7 roll_mean_14 roll_std_14 roll_mean_28 roll_std_28",
    "feat_ewm": "ewm_mean_7 ewm_mean_14",
    "feat_trend": "demand_trend_14d",
    "feat_codes": "store_id__code product_id__code region__code",
    "codes_table": "code",
    "feat_promo": "discount_pct price_vs_30d_avg",
    "feat_inventory": "stockout_freq_14d",
    "feat_region": "region_avg_demand_7d",
    "feat_matrix": "unit_price discount_amount net_amount roll_mean_7 roll_std_7 roll_mean_14 roll_std_14 roll_mean_28 roll_std_28 ewm_mean_7 ewm_mean_14 demand_trend_14d discount_pct price_vs_30d_avg stockout_freq_14d days_of_stock_remaining region_avg_demand_7d avg_actual_lead_time_days calculated_on_time_rate avg_fill_rate",
    "features_filled": " ".join(NUMERIC),
    "recs_by_tier": "quantity_on_hand quantity_on_order daily_demand_forecast days_of_stock_remaining avg_lead_time_days on_time_rate expected_lead_time_days forecast_demand_lead_time demand_std_14d safety_stock reorder_point_ml recommended_order_qty",
    "quadrant_list": "calculated_on_time_rate avg_fill_rate",
    "eda_stockout_rate": "mean",
    "eda_discount": "mean median",
    "baselines": "forecast",
    "forecast_metrics": "wape rmse bias",
    "segment_errors": "wape rmse bias",
    "deploy_gate": "model_wape baseline_wape fva",
    "demand_std": "demand_std_14d",
    "reorder": "quantity_on_hand quantity_on_order daily_demand_forecast days_of_stock_remaining avg_lead_time_days on_time_rate expected_lead_time_days forecast_demand_lead_time demand_std_14d safety_stock reorder_point_ml recommended_order_qty",
    "top_recs": "quantity_on_hand quantity_on_order daily_demand_forecast days_of_stock_remaining avg_lead_time_days on_time_rate expected_lead_time_days forecast_demand_lead_time demand_std_14d safety_stock reorder_point_ml recommended_order_qty",
    "bias_drift": "bias",
    "wape_alarm": "model_wape baseline_wape",
    "ks_drift": "ks",
    "eda_describe": "mean std least p25 p50 p75 most",
    "eda_pivot": "naive rolling_mean seasonal_naive",
    "eda_weekend": "mean median std",
    "eda_dow": "mean",
    "eda_rolling": "rolling_mean",
}

#: Helper models that are no queries themselves.
_HELPERS = {*RAW, "folder_dates", "code_values", "code_days", "code_all", "code_rows", "held_dates", "series", "labelled", "folded", "base_values", "pair_forecast", "day_metrics"}


SQL |= SINK_SQL
ROUNDED["feat_matrix_bucketed"] = ROUNDED["feat_matrix"]


def _needs(name: str, seen: dict[str, None]) -> None:
    for other in re.findall(r"[a-z_0-9]+", SQL[name]):
        if other in SQL and other != name and other not in seen:
            _needs(other, seen)
            seen[other] = None


def oracle_sql() -> dict[str, str]:
    """A statement for each query; doubles and decimals come as doubles with 6 places, as in the queries."""
    out = {}
    for name in SQL:
        if name in _HELPERS:
            continue
        seen: dict[str, None] = {}
        _needs(name, seen)
        parts = ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in [*seen, name])
        rounded = ", ".join(f"round({c}::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for c in ROUNDED.get(name, "").split())
        out[name] = f"WITH {parts}\nSELECT *{f' REPLACE ({rounded})' if rounded else ''} FROM {name}"
    return out
