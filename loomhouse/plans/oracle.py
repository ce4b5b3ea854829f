"""DuckDB SQL for the warehouse queries: tables as common table expressions, each query with those that it needs."""

from __future__ import annotations

import re


def ratio(num: str, den: str, digits: int, times: int = 1) -> str:
    """Half away from zero on whole numbers, as ``functions.rounded``."""
    unit = f"{10**-digits:.{digits}f}::DECIMAL({digits + 1},{digits})"
    return f"CASE WHEN ({den}) > 0 THEN ((sign({num}) * ((({2 * times * 10**digits}::HUGEINT * abs({num})) + ({den})) // (2 * ({den}))))::DECIMAL(20,0) * {unit})::DECIMAL(18,{digits}) END"


def cents(x: str) -> str:
    return f"(({x}) * 100)::HUGEINT"


def digest(*columns: str) -> str:
    return f"md5(concat_ws('|', {', '.join(columns)}))"


REV = "sum(net_revenue)"
AT = "o.customer_id = c.customer_id AND o.order_date >= c.valid_from AND (o.order_date {op} c.valid_to OR c.valid_to IS NULL)"
STRICT, WITHIN = AT.format(op="<"), AT.format(op="<=")

TABLES = {
    "raw_orders": """SELECT l_orderkey AS order_id, l_orderkey * 1000 + nth AS line_id, o_orderdate::DATE AS order_date, o_custkey AS customer_id, l_partkey AS product_id, l_quantity::INT AS quantity,
        ((round(l_extendedprice * 100)::BIGINT // l_quantity::BIGINT)::DECIMAL(16,0) * 0.01)::DECIMAL(18,2) AS unit_price, l_returnflag = 'R' AS is_refunded
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS nth FROM lineitem)
        JOIN orders ON l_orderkey = o_orderkey""",
    "raw_customers": """SELECT c_custkey AS customer_id, r_name AS region, n_name AS country, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE c_custkey IN (SELECT customer_id FROM raw_orders)""",
    "raw_products": """SELECT p_partkey AS product_id, 'Product_' || p_partkey AS product_name, p_type AS category, p_brand AS subcategory, p_retailprice::DECIMAL(18,2) AS cost_price
        FROM part WHERE p_partkey IN (SELECT product_id FROM raw_orders)""",
    "dim_date": """SELECT strftime(d, '%Y%m%d')::INT AS date_key, d AS date, year(d)::INT AS year, quarter(d)::INT AS quarter, month(d)::INT AS month, day(d)::INT AS day, dayofweek(d)::INT AS day_of_week, dayofweek(d) IN (0, 6) AS is_weekend
        FROM (SELECT DISTINCT order_date AS d FROM raw_orders)""",
    "dim_customer": "SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, * FROM raw_customers",
    "dim_product": "SELECT row_number() OVER (ORDER BY product_id) AS product_key, product_id, product_name AS name, category, subcategory, cost_price FROM raw_products",
    "fct_orders": """SELECT order_id, line_id, strftime(order_date, '%Y%m%d')::INT AS date_key, customer_key, product_key, quantity, unit_price, (quantity * unit_price)::DECIMAL(18,2) AS gross_revenue, is_refunded,
        (CASE WHEN is_refunded THEN 0 ELSE quantity * unit_price END)::DECIMAL(18,2) AS net_revenue, order_date, r.customer_id
        FROM raw_orders r JOIN dim_customer c ON r.customer_id = c.customer_id JOIN dim_product p ON r.product_id = p.product_id""",
    "star": """SELECT f.*, p.product_id, p.name AS product_name, p.category, p.subcategory, p.cost_price, c.region, c.country, c.segment, d.date, d.year, d.quarter, d.month, d.is_weekend
        FROM fct_orders f JOIN dim_product p ON f.product_key = p.product_key JOIN dim_customer c ON f.customer_key = c.customer_key JOIN dim_date d ON f.date_key = d.date_key""",
    "wide_orders": """SELECT order_id, date, year AS order_year, quarter AS order_quarter, month AS order_month, is_weekend, customer_id, region, country, segment, product_id, product_name, category, subcategory, cost_price,
        quantity, unit_price, gross_revenue, is_refunded, net_revenue FROM star""",
    "initial_scd2": "SELECT customer_key, customer_id, region, country, segment, DATE '1995-01-01' AS valid_from, NULL::DATE AS valid_to, TRUE AS is_current FROM dim_customer",
    "faulty": """SELECT customer_key, customer_id, valid_from, CASE customer_id % 10 WHEN 1 THEN DATE '1996-06-30' WHEN 2 THEN DATE '1995-12-31' WHEN 3 THEN DATE '1997-12-31' WHEN 4 THEN DATE '1994-12-31' END AS valid_to,
        customer_id % 10 NOT IN (1, 2, 3, 4, 6) AS is_current FROM initial_scd2
        UNION ALL SELECT customer_key + 1000000, customer_id, CASE customer_id % 10 WHEN 1 THEN DATE '1996-06-30' WHEN 2 THEN DATE '1995-01-01' WHEN 3 THEN DATE '1996-01-01' ELSE DATE '1998-01-01' END,
        CASE customer_id % 10 WHEN 3 THEN DATE '1996-12-31' END, customer_id % 10 <> 3 FROM initial_scd2 WHERE customer_id % 10 IN (1, 2, 3, 5)""",
    "seen": "SELECT customer_id, min(order_date) AS first_day, max(order_date) AS last_day FROM fct_orders GROUP BY customer_id",
    "feed": """SELECT customer_id * 2 + 1 AS seq, customer_id, NULL::VARCHAR AS region, '' AS country, 'TIER_1' AS segment, (first_day + INTERVAL 1 DAY)::DATE AS change_date FROM seen WHERE customer_id % 10 = 0
        UNION ALL SELECT customer_id * 2 + 2, customer_id, 'NEW_REGION', NULL, '', (last_day + INTERVAL 1 DAY)::DATE FROM seen WHERE customer_id % 10 = 0
        UNION ALL SELECT customer_id * 2 + 1, customer_id, region, '', segment, DATE '1996-01-01' FROM dim_customer WHERE customer_id = 5""",
    "chain": f"""SELECT *, lag(h) OVER (PARTITION BY customer_id ORDER BY seq) AS before FROM (SELECT *, {digest('region', 'country', 'segment')} AS h FROM (
        SELECT customer_id, seq, customer_key, valid_from, last_value(region IGNORE NULLS) OVER q AS region, last_value(country IGNORE NULLS) OVER q AS country, last_value(segment IGNORE NULLS) OVER q AS segment
        FROM (SELECT customer_id, 0 AS seq, customer_key, region, country, segment, valid_from FROM initial_scd2
              UNION ALL SELECT customer_id, seq, NULL, nullif(region, ''), nullif(country, ''), nullif(segment, ''), change_date FROM feed WHERE customer_id IN (SELECT customer_id FROM initial_scd2))
        WINDOW q AS (PARTITION BY customer_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))""",
    "accepted": "SELECT *, lead(valid_from) OVER (PARTITION BY customer_id ORDER BY seq) AS following FROM chain WHERE before IS NULL OR h <> before",
    "dim_customer_scd2": """SELECT CASE WHEN seq = 0 THEN customer_key ELSE (SELECT max(customer_key) FROM initial_scd2) + row_number() OVER (PARTITION BY seq > 0 ORDER BY seq) END AS customer_key,
        customer_id, region, country, segment, valid_from, (following - INTERVAL 1 DAY)::DATE AS valid_to, following IS NULL AS is_current FROM accepted""",
    "versions": "SELECT customer_id, count(*) AS version_count FROM dim_customer_scd2 GROUP BY customer_id",
    "promotions": """SELECT customer_id, ['PROMO_A', 'PROMO_B', 'PROMO_C'][i + 1] AS promo_code, [0.10, 0.15, 0.20][i + 1]::DECIMAL(3,2) AS discount_pct,
        DATE '1997-01-01' + ((customer_id * 37 + i * 101) % 300)::INT AS promo_start, DATE '1997-01-01' + ((customer_id * 37 + i * 101) % 300)::INT + 90 AS promo_end
        FROM (SELECT customer_id, unnest(range(CASE WHEN customer_key % 20 < 10 THEN 0 WHEN customer_key % 20 < 16 THEN 1 WHEN customer_key % 20 < 19 THEN 2 ELSE 3 END)) AS i FROM dim_customer)""",
    "broken": "SELECT o.* FROM fct_orders o LEFT JOIN promotions p ON o.customer_id = p.customer_id",
    "latest": "SELECT customer_id, arg_max(promo_code, (promo_start, promo_code)) AS promo_code FROM promotions GROUP BY customer_id",
    "running": """SELECT o.line_id, o.net_revenue, arg_max(p.promo_code, (p.promo_start, p.promo_code)) AS promo_code
        FROM fct_orders o LEFT JOIN promotions p ON o.customer_id = p.customer_id AND o.order_date >= p.promo_start AND o.order_date < p.promo_end GROUP BY o.line_id, o.net_revenue""",
    "promo_counts": "SELECT customer_id, count(*) AS promo_count FROM promotions GROUP BY customer_id",
    "customer_baseline": "SELECT customer_id, region, country, segment FROM dim_customer_scd2 WHERE is_current",
    "change_log": """SELECT rn // 13 AS change_id, customer_id, (2 + (customer_id * 31 + 7) % 29)::INT AS night_number, ['North', 'South', 'East', 'West'][customer_id % 4 + 1] AS new_region,
        ['Finland', 'Sweden', 'Norway'][customer_id % 3 + 1] AS new_country, CASE WHEN customer_id % 10 < 6 THEN 'Consumer' WHEN customer_id % 10 < 9 THEN 'Business' ELSE 'Enterprise' END AS new_segment
        FROM (SELECT customer_id, row_number() OVER (ORDER BY customer_id) AS rn FROM customer_baseline) WHERE rn % 13 = 0""",
    "nights": "SELECT unnest(range(1, 31))::INT AS night_number",
    "states": """SELECT n.night_number, b.customer_id, coalesce(l.new_region, b.region) AS region, coalesce(l.new_country, b.country) AS country, coalesce(l.new_segment, b.segment) AS segment
        FROM customer_baseline b CROSS JOIN nights n LEFT JOIN change_log l ON l.customer_id = b.customer_id AND l.night_number <= n.night_number""",
    "periodic_snapshots": "SELECT * FROM states WHERE night_number <> 12",
    "base": "SELECT customer_id, region, country, segment FROM periodic_snapshots WHERE night_number = 1",
    "deltas": f"""SELECT night_number, customer_id, region, country, segment FROM (
        SELECT *, lag({digest('region', 'country', 'segment')}) OVER (PARTITION BY customer_id ORDER BY night_number) AS before FROM periodic_snapshots) WHERE before <> {digest('region', 'country', 'segment')}""",
    "sizes": "SELECT night_number, count(*) AS n FROM deltas GROUP BY night_number",
    "runs": """SELECT night_number AS job_id, night_number, 'periodic' AS snapshot_type, CASE WHEN night_number = 12 THEN 0 ELSE (SELECT count(*) FROM customer_baseline) END AS rows_processed, NULL::INT AS checkpoint_night FROM nights
        UNION ALL SELECT night_number + 29, night_number, 'incremental', CASE WHEN night_number = 12 THEN 0 ELSE coalesce(n, 0) END, CASE WHEN night_number = 12 THEN 11 ELSE night_number END
        FROM nights LEFT JOIN sizes USING (night_number) WHERE night_number > 1""",
    "jobs": """SELECT job_id::INT AS job_id, night_number, snapshot_type, CASE WHEN night_number = 12 THEN 'failed' ELSE 'success' END AS status, rows_processed::BIGINT AS rows_processed, checkpoint_night::INT AS checkpoint_night,
        TIMESTAMP '2024-01-01 02:00:00' + to_days(night_number - 1) AS started_at,
        TIMESTAMP '2024-01-01 02:00:00' + to_days(night_number - 1) + to_seconds(CASE WHEN night_number = 12 THEN 5 ELSE 30 + rows_processed // 50 END) AS finished_at FROM runs""",
    "increments": "SELECT night_number, status, rows_processed, checkpoint_night FROM jobs WHERE snapshot_type = 'incremental'",
    "changed": f"""SELECT a.customer_id, a.region, a.country, a.segment FROM (SELECT * FROM states WHERE night_number = 20) a JOIN (SELECT * FROM states WHERE night_number = 11) b USING (customer_id)
        WHERE {digest('a.region', 'a.country', 'a.segment')} <> {digest('b.region', 'b.country', 'b.segment')}""",
    "came": "SELECT * FROM states WHERE night_number = 20 AND customer_id % 7 <> 0",
    "went": "SELECT * FROM states WHERE night_number = 11 AND customer_id % 5 <> 0",
    "storage": "SELECT (SELECT count(*) FROM periodic_snapshots) AS periodic_rows, (SELECT count(*) FROM base) + (SELECT count(*) FROM deltas) AS incremental_rows",
    "mismatch": """SELECT count(*) FILTER (p.region <> s.region) AS region_mismatches, count(*) FILTER (p.region <> s.region OR p.country <> s.country OR p.segment <> s.segment) AS mismatches
        FROM periodic_snapshots p JOIN states s USING (customer_id, night_number) WHERE night_number = 20""",
    "twice": "SELECT count(*) AS n FROM (SELECT 1 FROM deltas GROUP BY customer_id, night_number HAVING count(*) > 1)",
    "naive": "SELECT count(*) AS delta_rows FROM (SELECT customer_id FROM base EXCEPT SELECT customer_id FROM deltas WHERE night_number = 12)",
}


def _counts(tables: dict[str, str], name: str = "table_name") -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS {name}, count(*) AS row_count FROM {t}" for k, t in tables.items())


def _integrity(t: str) -> str:
    far = "DATE '9999-12-31'"
    return f"""SELECT 'duplicate_current' AS check_name, count(*) AS violations FROM (SELECT 1 FROM {t} WHERE is_current GROUP BY customer_id HAVING count(*) > 1)
        UNION ALL SELECT 'open_not_current', count(*) FROM {t} WHERE valid_to IS NULL AND NOT is_current
        UNION ALL SELECT 'overlapping_ranges', count(*) FROM {t} a JOIN {t} b ON a.customer_id = b.customer_id AND a.customer_key <> b.customer_key
            AND b.valid_from BETWEEN a.valid_from + INTERVAL 1 DAY AND a.valid_to
        UNION ALL SELECT 'shared_days', count(*) FROM {t} a JOIN {t} b ON a.customer_id = b.customer_id AND a.customer_key < b.customer_key
            AND greatest(a.valid_from, b.valid_from) <= least(coalesce(a.valid_to, {far}), coalesce(b.valid_to, {far}))
            AND a.valid_from <= coalesce(b.valid_to, {far}) AND b.valid_from <= coalesce(a.valid_to, {far})
        UNION ALL SELECT 'inverted_ranges', count(*) FROM {t} WHERE valid_to < valid_from"""


def _summary(t: str, more: str = "") -> str:
    return f"SELECT count(*) AS total_rows, count(DISTINCT customer_id) AS distinct_customers, count(*) FILTER (is_current) AS current_records, count(*) FILTER (valid_to IS NULL) AS open_records{more} FROM {t}"


def _b(n: int, rows: str, year: str) -> str:
    return {
        1: f"SELECT category, {REV} AS revenue FROM {rows} WHERE {year} = 1997 GROUP BY category",
        2: f"SELECT region, category, date_trunc('month', date)::DATE AS m, {REV} AS revenue, count(DISTINCT customer_id) AS distinct_customers FROM {rows} WHERE NOT is_refunded GROUP BY ALL",
        3: f"SELECT product_name, {REV} AS revenue FROM {rows} WHERE segment = 'BUILDING' AND subcategory = 'Brand#1' GROUP BY product_name ORDER BY revenue DESC, product_name LIMIT 20",
        4: f"SELECT region, segment, category, {REV} AS revenue, {REV}::DOUBLE / count(*) AS avg_revenue FROM {rows} GROUP BY ALL",
    }[n]


def _case(column: str, values: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {otherwise} END"


BRAND = _case("category", {"ECONOMY": "TechCorp", "STANDARD": "HomeStyle", "PROMO": "SportMax"}, "'FashionCo'")
LIFETIME = _case("segment", {"BUILDING": "High Value", "MACHINERY": "Medium Value"}, "'Standard'")
TIER = _case("segment", {"AUTOMOBILE": "Bronze", "MACHINERY": "Silver", "BUILDING": "Gold"}, "NULL::VARCHAR")
HASHED = "('0x' || substr(md5(concat_ws('|', customer_id::VARCHAR, region, country, segment)), 1, 8))::BIGINT"
T1 = "SELECT o.order_id, o.line_id, o.order_date, o.net_revenue, c.region AS region_at_order, c.country AS country_at_order, c.segment AS segment_at_order FROM fct_orders o JOIN dim_customer_scd2 c ON {on} ORDER BY o.line_id LIMIT 20"
T2 = "SELECT c.region AS region_at_order, d.year, sum(o.net_revenue) AS net_revenue, count(DISTINCT o.order_id) AS order_count FROM fct_orders o JOIN dim_customer_scd2 c ON {on} JOIN dim_date d ON o.date_key = d.date_key GROUP BY ALL"
T3 = f"SELECT o.order_id, o.line_id, o.order_date, o.net_revenue, c.segment AS segment_at_order, c.valid_from, c.valid_to FROM fct_orders o JOIN dim_customer_scd2 c ON {STRICT} WHERE o.customer_id = 10"
FRESH = """SELECT {day}::INT AS day, max(finished_at) AS latest, max(finished_at) >= TIMESTAMP '2024-01-01 06:00:00' + to_days({day} - 1) - INTERVAL 1 DAY AS passed
        FROM jobs WHERE status = 'success' AND snapshot_type = 'periodic' AND night_number <= {day}"""
V4 = "max(n) AS max_delta, sum(n)::DOUBLE / count(*) AS avg_delta, greatest(sum(n)::DOUBLE / count(*) * 5, 10.0::DOUBLE) AS threshold"

QUERIES = {
    **{q: f"SELECT * FROM {t}" for q, t in {"g1_raw_orders": "raw_orders", "g2_raw_customers": "raw_customers", "g3_raw_products": "raw_products", "m1_dim_date": "dim_date", "m2_dim_customer": "dim_customer", "m3_dim_product": "dim_product", "w2_wide_orders": "wide_orders", "s1_initial_load": "initial_scd2", "s7_feed": "feed", "s11_history": "dim_customer_scd2", "i1_promotions": "promotions", "n1_customer_baseline": "customer_baseline", "n2_change_log": "change_log", "n3_true_states": "states", "n4_job_history": "jobs", "n5_periodic_snapshots": "periodic_snapshots", "n6_base_snapshot": "base", "n7_incremental_deltas": "deltas"}.items()},
    "g4_generation_checks": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) - count({k}) AS null_keys FROM {t}" for t, k in (("raw_orders", "order_id"), ("raw_customers", "customer_id"), ("raw_products", "product_id"))),
    "m4_fct_orders": "SELECT order_id, date_key, customer_key, product_key, quantity, unit_price, gross_revenue, is_refunded, net_revenue FROM fct_orders",
    "m5_build_checks": _counts({t: t for t in ("raw_orders", "dim_date", "dim_customer", "dim_product", "fct_orders")}, "check_name").replace("row_count", "value")
    + "".join(f" UNION ALL SELECT 'orphan_{k}', count(*) FROM fct_orders WHERE {k} NOT IN (SELECT {k} FROM {d})" for d, k in (("dim_date", "date_key"), ("dim_customer", "customer_key"), ("dim_product", "product_key"))),
    "a1_category_quarter": f"SELECT category, year, quarter, count(DISTINCT order_id) AS order_count, {REV} AS net_revenue, ({ratio(cents(REV), 'count(*)', 0)} * 0.01)::DECIMAL(18,2) AS avg_order_revenue FROM star GROUP BY ALL".replace("1.::DECIMAL", "1::DECIMAL"),
    "a2_top_customers": f"SELECT customer_id, region, segment, count(DISTINCT order_id) AS order_count, {REV} AS net_revenue FROM star WHERE year = 1997 GROUP BY ALL ORDER BY net_revenue DESC, customer_id LIMIT 10",
    "a3_weekend_share": f"SELECT region, day_type, order_count, net_revenue, {ratio(cents('net_revenue'), cents('whole'), 1, 100)} AS pct_of_region_revenue FROM (SELECT *, sum(net_revenue) OVER (PARTITION BY region) AS whole FROM (SELECT region, if(is_weekend, 'Weekend', 'Weekday') AS day_type, count(DISTINCT order_id) AS order_count, {REV} AS net_revenue FROM star GROUP BY ALL))",
    "a4_monthly_growth": f"SELECT *, (revenue - previous_month_revenue)::DOUBLE / nullif(previous_month_revenue::DOUBLE, 0) * 100 AS revenue_growth_pct FROM (SELECT *, lag(revenue) OVER (PARTITION BY category ORDER BY year, month) AS previous_month_revenue FROM (SELECT category, year, month, {REV} AS revenue FROM star GROUP BY ALL))",
    "a5_refunds": f"SELECT *, {ratio(cents('refund_value'), cents('gross_revenue'), 2, 100)} AS refund_rate_pct FROM (SELECT category, sum(gross_revenue) AS gross_revenue, {REV} AS net_revenue, (sum(gross_revenue) - {REV})::DECIMAL(38,2) AS refund_value FROM star GROUP BY category)",
    "a6_margins": f"SELECT *, {ratio(cents('net_revenue - total_cost'), cents('net_revenue'), 1, 100)} AS margin_pct FROM (SELECT category, subcategory, {REV} AS net_revenue, sum((quantity * cost_price)::DECIMAL(18,2)) AS total_cost FROM star GROUP BY ALL)",
    "w3_reconciliation": _counts({t: t for t in ("fct_orders", "wide_orders", "dim_date", "dim_customer", "dim_product")}),
    "w4_attribute_bytes": """SELECT 'wide_orders' AS table_name, count(*) AS row_count, sum(length(region) + length(country) + length(segment) + length(category) + length(subcategory))::BIGINT AS dim_attribute_bytes FROM wide_orders
        UNION ALL SELECT 'dim_customer', count(*), sum(length(region) + length(country) + length(segment))::BIGINT FROM dim_customer
        UNION ALL SELECT 'dim_product', count(*), sum(length(category) + length(subcategory))::BIGINT FROM dim_product UNION ALL SELECT 'fct_orders', count(*), NULL FROM fct_orders""",
    **{f"b{n}_wide": _b(n, "wide_orders", "order_year") for n in (1, 2, 3, 4)},
    **{f"b{n}_narrow": _b(n, "star", "year") for n in (1, 2, 3, 4)},
    "e1_brand": f"SELECT {BRAND} AS brand, category, count(*) AS row_count, {REV} AS revenue FROM wide_orders GROUP BY ALL",
    "e1_dim_product": f"SELECT *, {BRAND} AS brand FROM dim_product",
    "e2_lifetime_segment": f"SELECT {LIFETIME} AS customer_lifetime_segment, segment, count(*) AS row_count FROM wide_orders GROUP BY ALL",
    "e3_tier": f"SELECT customer_key, customer_id, region, country, {TIER} AS customer_tier FROM dim_customer",
    "e3_wide_tier": f"SELECT {TIER} AS customer_tier, count(*) AS row_count FROM wide_orders GROUP BY ALL",
    "e4_propagation": f"SELECT *, {ratio('wide_rows_touched', 'narrow_rows_touched', 1)} AS propagation_multiplier FROM (SELECT change_number::INT AS change_number, description, narrow_rows_touched, (SELECT count(*) FROM wide_orders) AS wide_rows_touched FROM (SELECT 1 AS change_number, 'Add product brand' AS description, count(*) AS narrow_rows_touched FROM dim_product UNION ALL SELECT 2, 'Add customer_lifetime_segment', count(*) FROM dim_customer UNION ALL SELECT 3, 'Replace segment with customer_tier', count(*) FROM dim_customer))",
    "s0_enriched_fact": "SELECT * EXCLUDE (line_id) FROM fct_orders",
    "s2_current": "SELECT * FROM dim_customer_scd2 WHERE is_current",
    "s3_integrity_initial": _integrity("initial_scd2"),
    "s5_integrity": _integrity("dim_customer_scd2"),
    "s5_integrity_of_faulty": _integrity("faulty"),
    "s6_load_summary": _summary("initial_scd2"),
    "s8_change_detection": f"""SELECT seq, customer_id, change_date, a AS current_hash, b AS incoming_hash, if(a <> b, 'CHANGE DETECTED', 'no change') AS status FROM (
        SELECT f.seq, f.customer_id, f.change_date, {digest('c.region', 'c.country', 'c.segment')} AS a, {digest("coalesce(nullif(f.region, ''), c.region)", "coalesce(nullif(f.country, ''), c.country)", "coalesce(nullif(f.segment, ''), c.segment)")} AS b
        FROM feed f JOIN initial_scd2 c USING (customer_id))""",
    "s9_unmatched_feed": "SELECT count(*) AS violations FROM feed WHERE customer_id NOT IN (SELECT customer_id FROM initial_scd2)",
    "s9_unmatched_of_feed": "SELECT seq, customer_id + 10000000 AS customer_id FROM feed WHERE customer_id % 20 = 0",
    "s9_point_lookup": "SELECT customer_id, region, country, segment FROM dim_customer_scd2 WHERE is_current AND customer_id = 10",
    "s10_next_key": "SELECT max(customer_key) + 1 AS next_customer_key FROM dim_customer_scd2",
    "s13_change_summary": _summary("dim_customer_scd2", ", (SELECT max(version_count) FROM versions) AS max_versions"),
    "s13_versions_of_changed": "SELECT * FROM versions WHERE customer_id IN (SELECT customer_id FROM feed)",
    "t1_at_order": T1.format(on=STRICT),
    "t1_at_order_inclusive": T1.format(on=WITHIN),
    "t1_coverage": f"SELECT 'all' AS form, count(*) AS row_count FROM fct_orders UNION ALL SELECT 'strict', count(*) FROM fct_orders o JOIN dim_customer_scd2 c ON {STRICT} UNION ALL SELECT 'inclusive', count(*) FROM fct_orders o JOIN dim_customer_scd2 c ON {WITHIN} UNION ALL SELECT 'unbounded', count(*) FROM fct_orders o JOIN dim_customer_scd2 c USING (customer_id)",
    "t2_region_year": T2.format(on=STRICT),
    "t2_region_year_inclusive": T2.format(on=WITHIN),
    "t3_one_customer": T3,
    "t3_one_customer_first": f"{T3} ORDER BY o.order_date, o.line_id LIMIT 15",
    "t4_unbounded": "SELECT c.region, sum(o.net_revenue) AS inflated_revenue, count(*) AS row_count FROM fct_orders o JOIN dim_customer_scd2 c USING (customer_id) GROUP BY c.region",
    "t5_inflation": f"""SELECT *, {ratio(cents('inflated_revenue'), cents('correct_revenue'), 2)} AS inflation_factor FROM (
        SELECT customer_id, correct_row_count, correct_revenue, inflated_row_count, inflated_revenue, version_count AS scd2_versions
        FROM (SELECT o.customer_id, count(*) AS correct_row_count, sum(o.net_revenue) AS correct_revenue FROM fct_orders o JOIN dim_customer_scd2 c ON {STRICT} GROUP BY o.customer_id)
        JOIN (SELECT customer_id, count(*) AS inflated_row_count, sum(o.net_revenue) AS inflated_revenue FROM fct_orders o JOIN dim_customer_scd2 c USING (customer_id) GROUP BY customer_id) USING (customer_id)
        JOIN versions USING (customer_id) WHERE customer_id IN (SELECT customer_id FROM feed))""",
    "t6_segment_year": f"SELECT d.year, sum(o.net_revenue) AS net_revenue, count(DISTINCT o.order_id) AS order_count FROM fct_orders o JOIN dim_customer_scd2 c ON {STRICT} JOIN dim_date d ON o.date_key = d.date_key WHERE c.segment = 'BUILDING' AND d.year = 1996 GROUP BY d.year",
    "t7_journey": f"SELECT c.customer_id, c.segment, c.region, c.valid_from, c.valid_to, c.is_current, coalesce(sum(o.net_revenue), 0)::DECIMAL(38,2) AS revenue_during_period, count(o.order_id) AS orders_during_period FROM dim_customer_scd2 c LEFT JOIN fct_orders o ON {STRICT} WHERE c.customer_id IN (SELECT customer_id FROM versions WHERE version_count > 1) GROUP BY ALL",
    "t8_current_by_segment": "SELECT segment, region, count(*) AS customer_count FROM dim_customer_scd2 WHERE is_current GROUP BY ALL",
    "t9_health": f"SELECT *, {ratio('total_rows', 'distinct_customers', 4)} AS avg_versions_per_customer FROM (" + _summary("dim_customer_scd2", ", (SELECT max(version_count) FROM versions) AS max_versions_single_customer, count(*) FILTER (is_current AND valid_to IS NOT NULL) AS is_current_but_has_valid_to") + ")",
    "t10_many_versions": "SELECT * FROM versions WHERE version_count > 1",
    "t10_histories": "SELECT * FROM dim_customer_scd2 WHERE customer_id IN (SELECT customer_id FROM feed)",
    "i2_distribution": "SELECT promo_count, count(*) AS customer_count FROM promo_counts GROUP BY promo_count",
    "i2_coverage": "SELECT a AS total_customers, b AS with_promo, a - b AS without_promo FROM (SELECT (SELECT count(*) FROM dim_customer) AS a, (SELECT count(*) FROM promo_counts) AS b)",
    "i3_broken_revenue": f"SELECT {REV} AS total_revenue FROM broken",
    "i4_row_counts": _counts({"baseline": "fct_orders", "joined": "broken"}, "stage"),
    "i5_affected_customers": "SELECT promo_count, count(*) AS customer_count, promo_count > 1 AS inflates FROM promo_counts GROUP BY promo_count",
    "i6_inflation": f"SELECT *, {ratio(cents('inflation_amount'), cents('correct_revenue'), 2, 100)} AS inflation_pct FROM (SELECT *, inflated_row_count - correct_row_count AS phantom_rows, (inflated_revenue - correct_revenue)::DECIMAL(38,2) AS inflation_amount FROM (SELECT count(*) AS correct_row_count, {REV} AS correct_revenue FROM fct_orders), (SELECT count(*) AS inflated_row_count, {REV} AS inflated_revenue FROM broken))",
    "i7_worst_customers": f"SELECT *, {ratio(cents('inflated_revenue'), cents('correct_revenue'), 2)} AS inflation_factor FROM (SELECT customer_id, count(*) AS correct_rows, {REV} AS correct_revenue FROM fct_orders GROUP BY customer_id) JOIN (SELECT * FROM promo_counts WHERE promo_count >= 2) USING (customer_id) JOIN (SELECT customer_id, count(*) AS inflated_rows, {REV} AS inflated_revenue FROM broken GROUP BY customer_id) USING (customer_id) ORDER BY inflation_factor DESC NULLS LAST, customer_id LIMIT 10",
    "f1_latest": f"SELECT {REV} AS total_revenue FROM fct_orders LEFT JOIN latest USING (customer_id)",
    "f1_attribution": f"SELECT promo_code, count(*) AS row_count, {REV} AS total_revenue FROM fct_orders LEFT JOIN latest USING (customer_id) GROUP BY promo_code",
    "f2_summarised": f"SELECT {REV} AS total_revenue, sum(promo_count)::DOUBLE / count(promo_count) AS line_weighted_avg_promos FROM fct_orders LEFT JOIN promo_counts USING (customer_id)",
    "f3_running": f"SELECT {REV} AS total_revenue FROM running",
    "f3_attribution": f"SELECT promo_code, count(*) AS row_count, {REV} AS total_revenue FROM running GROUP BY promo_code",
    "f4_baseline": f"SELECT {REV} AS total_revenue FROM fct_orders",
    "f5_verification": f"SELECT form, total_revenue, abs(total_revenue - b) < 0.01 AS matches, {ratio(cents('total_revenue - b'), cents('b'), 2, 100)} AS inflation_pct FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS form, {REV} AS total_revenue FROM {t}" for k, t in {"baseline": "fct_orders", "broken": "broken", "latest": "fct_orders LEFT JOIN latest USING (customer_id)", "summarised": "fct_orders LEFT JOIN promo_counts USING (customer_id)", "running": "running"}.items()) + f"), (SELECT {REV} AS b FROM fct_orders)",
    "f6_row_guard": "SELECT join_name, base_rows, joined_rows, joined_rows = base_rows AS passed FROM (SELECT 'broken' AS join_name, count(*) AS joined_rows FROM broken UNION ALL SELECT 'latest', count(*) FROM fct_orders LEFT JOIN latest USING (customer_id) UNION ALL SELECT 'running', count(*) FROM running), (SELECT count(*) AS base_rows FROM fct_orders)",
    "n8_tracking_state": "SELECT customer_id, region, country, segment FROM states WHERE night_number = 30",
    "n9_checkpoint_advance": "SELECT night_number, status, checkpoint_night FROM increments",
    **{q: "SELECT *, periodic_rows::DOUBLE / incremental_rows AS storage_ratio FROM storage" for q in ("n10_storage", "d2_storage")},
    "c1_storage_rows": _counts({"periodic": "periodic_snapshots", "incremental_base": "base", "incremental_deltas": "deltas"}),
    "c2_gaps": "SELECT night_number, max(if(status = 'success' AND snapshot_type = 'periodic', 1, 0))::INT AS periodic_success, max(if(status = 'success' AND snapshot_type = 'incremental', 1, 0))::INT AS incremental_success FROM nights LEFT JOIN jobs USING (night_number) GROUP BY night_number HAVING periodic_success = 0 OR incremental_success = 0",
    "c2b_gaps_anti": "SELECT night_number FROM nights WHERE night_number NOT IN (SELECT night_number FROM jobs WHERE status = 'success')",
    "c3a_exact_night": "SELECT count(*) AS rows_returned FROM periodic_snapshots WHERE night_number = 12",
    "c3b_fallback": "SELECT night_number AS reconstructed_as_of_night, customer_id, region, country, segment FROM periodic_snapshots WHERE night_number = 11",
    "c3c_replay": "SELECT customer_id, region, country, segment FROM states WHERE night_number = 11",
    "c4_naive_delta": "SELECT delta_rows FROM naive",
    "c5_defensive_delta": "SELECT count(*) AS delta_rows FROM deltas WHERE night_number = 13",
    "c6_verification": "SELECT * FROM mismatch",
    "c7_health": "SELECT (SELECT max(checkpoint_night) FROM increments WHERE status = 'success') AS checkpoint_night, periodic_rows::DOUBLE / incremental_rows AS storage_ratio, periodic_rows::DOUBLE / incremental_rows > 5 AS storage_healthy, mismatches, n AS duplicate_deltas FROM storage, mismatch, twice",
    "k1_around_failure": "SELECT job_id, snapshot_type, night_number, status, rows_processed, checkpoint_night FROM jobs WHERE night_number BETWEEN 9 AND 14",
    "k2_first_successes": "SELECT * FROM increments WHERE status = 'success' ORDER BY night_number LIMIT 10",
    "k3_checkpoint_at_failure": "SELECT * FROM increments WHERE night_number IN (11, 12, 13)",
    "k4_checkpoints": "SELECT * FROM increments",
    "k5_safe_checkpoint": "SELECT max(checkpoint_night) AS safe_checkpoint_to_use FROM increments WHERE status = 'success' AND checkpoint_night <= 12",
    "r0_changed_rows": "SELECT * FROM changed",
    "r0_all_changes": """SELECT customer_id, 'insert' AS change_type, region, country, segment FROM came WHERE customer_id NOT IN (SELECT customer_id FROM went)
        UNION ALL SELECT customer_id, 'delete', region, country, segment FROM went WHERE customer_id NOT IN (SELECT customer_id FROM came)
        UNION ALL SELECT a.customer_id, 'update', a.region, a.country, a.segment FROM came a JOIN went b USING (customer_id) WHERE (a.region, a.country, a.segment) IS DISTINCT FROM (b.region, b.country, b.segment)""",
    "r1_append": "SELECT *, 20::INT AS night_number FROM changed",
    "r2_naive_retry": "SELECT count(*) AS duplicate_pairs FROM changed",
    "r3_idempotent_retry": " UNION ALL ".join(f"SELECT 'run_{n}' AS attempt, count(*) AS row_count FROM changed" for n in (1, 2, 3)),
    "v1_delta_bound": "SELECT *, max_delta * 20 < customers AS passed FROM (SELECT max(n) AS max_delta FROM sizes), (SELECT count(*) AS customers FROM customer_baseline)",
    "v2_duplicates": "SELECT 'incremental_deltas' AS table_name, n AS violations, n = 0 AS passed FROM twice UNION ALL SELECT 'retry_deltas', count(*), count(*) = 0 FROM changed",
    "v3_checksum": f"SELECT independent, official, independent = official AS passed FROM (SELECT sum({HASHED})::BIGINT AS independent FROM states WHERE night_number = 20), (SELECT sum({HASHED})::BIGINT AS official FROM periodic_snapshots WHERE night_number = 20)",
    "v4_anomaly": f"SELECT *, max_delta < threshold AS passed, max_delta < avg_delta * 5 AS passed_without_floor FROM (SELECT {V4} FROM sizes)",
    "v5_naive_flagged": f"SELECT delta_rows, threshold, delta_rows < threshold AS passed FROM naive, (SELECT {V4} FROM sizes)",
    "v6_freshness": " UNION ALL ".join(FRESH.format(day=d) for d in (30, 12)),
    "v0_checks": f"""SELECT 'delta bound' AS label, if(max(n) * 20 < (SELECT count(*) FROM customer_baseline), 'PASS', 'FAIL') AS status, max(n)::VARCHAR AS detail FROM sizes
        UNION ALL SELECT 'checksum of a night', if(a = b, 'PASS', 'FAIL'), b::VARCHAR FROM (SELECT sum({HASHED})::BIGINT AS a FROM states WHERE night_number = 20), (SELECT sum({HASHED})::BIGINT AS b FROM periodic_snapshots WHERE night_number = 20)
        UNION ALL SELECT 'anomaly', if(max_delta < threshold, 'PASS', 'FAIL'), max_delta::VARCHAR FROM (SELECT {V4} FROM sizes)
        UNION ALL SELECT 'naive delta', if(delta_rows < threshold, 'PASS', 'FAIL'), delta_rows::VARCHAR FROM naive, (SELECT {V4} FROM sizes)
        UNION ALL SELECT 'fresh on the last day', if(passed, 'PASS', 'FAIL'), strftime(latest, '%Y-%m-%d') FROM ({FRESH.format(day=30)})
        UNION ALL SELECT 'fresh on the failed day', if(passed, 'PASS', 'FAIL'), strftime(latest, '%Y-%m-%d') FROM ({FRESH.format(day=12)})
        UNION ALL SELECT 'duplicates in deltas', if(n = 0, 'PASS', 'FAIL'), n || ' duplicates' FROM twice
        UNION ALL SELECT 'duplicates after a naive retry', if(count(*) = 0, 'PASS', 'FAIL'), count(*) || ' duplicates' FROM changed
        UNION ALL SELECT 'duplicates in an absent table', 'SKIP', 'no such table'
        UNION ALL SELECT 'history ' || check_name, if(violations = 0, 'PASS', 'FAIL'), violations || ' violations' FROM ({_integrity("dim_customer_scd2")})""",
    "d1_status": "SELECT max(checkpoint_night) AS current_checkpoint, count(*) FILTER (status = 'success') AS successful_jobs, count(*) FILTER (status = 'failed') AS failed_jobs FROM jobs",
    "d3_latest_activity": "SELECT night_number AS latest_snapshot, n AS rows_changed FROM sizes WHERE night_number = (SELECT max(night_number) FROM sizes)",
    "d4_warnings": "SELECT night_number, snapshot_type, status FROM jobs WHERE status = 'failed'",
    "d5_health": "SELECT *, if(failed_jobs = 0 AND duplicate_rows = 0, 'HEALTHY', 'ATTENTION REQUIRED') AS status FROM (SELECT count(*) AS failed_jobs FROM jobs WHERE status = 'failed'), (SELECT count(*) AS duplicate_rows FROM (SELECT 1 FROM periodic_snapshots GROUP BY customer_id, night_number HAVING count(*) > 1)), (SELECT max(night_number) AS latest_snapshot FROM periodic_snapshots)",
}


#: Columns that are exact decimals inside; queries give them as doubles, converted once at the end, as engines hand decimals over differently.
DECIMALS = {
    "g1_raw_orders": "unit_price",
    "g3_raw_products": "cost_price",
    "m3_dim_product": "cost_price",
    "w2_wide_orders": "cost_price unit_price gross_revenue net_revenue",
    "m4_fct_orders": "unit_price gross_revenue net_revenue",
    "a1_category_quarter": "net_revenue avg_order_revenue",
    "a2_top_customers": "net_revenue",
    "a3_weekend_share": "net_revenue pct_of_region_revenue",
    "a4_monthly_growth": "revenue previous_month_revenue",
    "a5_refunds": "gross_revenue net_revenue refund_value refund_rate_pct",
    "a6_margins": "net_revenue total_cost margin_pct",
    "b1_wide": "revenue",
    "b1_narrow": "revenue",
    "b2_wide": "revenue",
    "b2_narrow": "revenue",
    "b3_wide": "revenue",
    "b3_narrow": "revenue",
    "b4_wide": "revenue",
    "b4_narrow": "revenue",
    "e1_brand": "revenue",
    "e1_dim_product": "cost_price",
    "e4_propagation": "propagation_multiplier",
    "i1_promotions": "discount_pct",
    "s0_enriched_fact": "unit_price gross_revenue net_revenue",
    "t1_at_order": "net_revenue",
    "t1_at_order_inclusive": "net_revenue",
    "t2_region_year": "net_revenue",
    "t2_region_year_inclusive": "net_revenue",
    "t3_one_customer": "net_revenue",
    "t3_one_customer_first": "net_revenue",
    "t4_unbounded": "inflated_revenue",
    "t5_inflation": "correct_revenue inflated_revenue inflation_factor",
    "t6_segment_year": "net_revenue",
    "t7_journey": "revenue_during_period",
    "t9_health": "avg_versions_per_customer",
    "i3_broken_revenue": "total_revenue",
    "i6_inflation": "correct_revenue inflated_revenue inflation_amount inflation_pct",
    "i7_worst_customers": "correct_revenue inflated_revenue inflation_factor",
    "f1_latest": "total_revenue",
    "f1_attribution": "total_revenue",
    "f2_summarised": "total_revenue",
    "f3_running": "total_revenue",
    "f3_attribution": "total_revenue",
    "f4_baseline": "total_revenue",
    "f5_verification": "total_revenue inflation_pct",
}


def _needed(sql: str, found: list[str]) -> list[str]:
    for t in TABLES:
        if t not in found and re.search(rf"\b(FROM|JOIN|,)\s+{t}\b", sql):
            _needed(TABLES[t], found)
            found.append(t)
    return found


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in QUERIES.items():
        tables = _needed(sql, [])
        if name in DECIMALS:
            sql = f"SELECT * REPLACE ({', '.join(f'{c}::DOUBLE AS {c}' for c in DECIMALS[name].split())}) FROM ({sql})"
        out[name] = "WITH " + ",\n".join(f"{t} AS ({TABLES[t]})" for t in tables) + "\n" + sql
    return out
