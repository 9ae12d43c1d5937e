"""SQL with the same results as the registered queries, for DuckDB on the raw tables."""

from __future__ import annotations

# Views of the retail tables on the raw tables.
PARTS = {
    "transactions": """
SELECT l_orderkey AS basket_num, o_custkey AS hshd_num, CAST(o_orderdate AS DATE) AS purchase_date,
  l_partkey AS product_num, CAST(l_extendedprice AS DECIMAL(12,2)) AS spend, CAST(l_quantity AS INT) AS units,
  r_name AS store_region, CAST(weekofyear(CAST(o_orderdate AS DATE)) AS INT) AS week_num,
  CAST(year(o_orderdate) AS INT) AS year
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "households": """
SELECT c_custkey AS hshd_num, CASE WHEN c_acctbal >= 5000 THEN 'Y' ELSE 'N' END AS loyalty_flag,
  CASE c_custkey % 6 WHEN 0 THEN '19-24' WHEN 1 THEN '25-34' WHEN 2 THEN '35-44' WHEN 3 THEN '45-54'
    WHEN 4 THEN '55-64' ELSE '65+' END AS age_range,
  CASE c_custkey % 3 WHEN 0 THEN 'Married' WHEN 1 THEN 'Single' ELSE 'null' END AS marital_status,
  CASE WHEN c_acctbal < 0 THEN 'UNDER 35K' WHEN c_acctbal < 3500 THEN '35-49K'
    WHEN c_acctbal < 7000 THEN '50-74K' ELSE '75-99K' END AS income_range,
  CASE WHEN c_nationkey % 2 = 0 THEN 'Homeowner' ELSE 'Renter' END AS homeowner_desc,
  c_mktsegment AS hshd_composition, CAST(c_custkey % 5 + 1 AS INT) AS hshd_size,
  CAST(c_custkey % 4 AS INT) AS children
FROM customer""",
    "products": """
SELECT p_partkey AS product_num, p_type AS department, p_brand AS commodity,
  CASE WHEN p_size <= 25 THEN 'PRIVATE' ELSE 'NATIONAL' END AS brand_type,
  CASE WHEN p_partkey % 5 = 0 THEN 'Y' ELSE 'N' END AS natural_organic_flag
FROM part""",
    "known_households": """
SELECT * REPLACE (nullif(marital_status, 'null') AS marital_status) FROM households""",
    "raw_text": """
SELECT c_custkey AS hshd_num, '  ' || c_name || ' ' AS name,
  CASE c_custkey % 7 WHEN 0 THEN ' NULL  ' WHEN 1 THEN 'Null' WHEN 2 THEN NULL WHEN 3 THEN '   '
    ELSE ' ' || chr(9) || c_mktsegment || '  ' END AS segment
FROM customer""",
    "number_text": """
SELECT c_custkey AS hshd_num, CASE c_custkey % 8
    WHEN 0 THEN '  ' || CAST(c_custkey AS VARCHAR) || ' '
    WHEN 1 THEN CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR)
    WHEN 2 THEN 'null'
    WHEN 3 THEN CAST(c_custkey AS VARCHAR) || '+'
    WHEN 4 THEN '-' || CAST(c_custkey AS VARCHAR) || '.0'
    WHEN 5 THEN 'inf'
    WHEN 6 THEN CAST(c_custkey AS VARCHAR) || 'd' END AS value
FROM customer""",
    "number_values": """
SELECT hshd_num, CASE WHEN regexp_full_match(trim(value), '[+-]?[0-9]+(\\.[0-9]+)?')
    THEN CAST(trim(value) AS DECIMAL(18,2)) END AS number
FROM number_text""",
    "checked_lines": """
SELECT *, basket_num % 19 = 0 AS wide_units,
  CASE WHEN basket_num % 13 = 0 THEN 'purchase_date missing or unreadable'
    WHEN basket_num % 11 = 0 THEN 'product_num missing or unreadable'
    WHEN basket_num % 19 = 0 THEN 'units out of range' END AS reject_reason
FROM transactions""",
    "cut": """
SELECT MAX(purchase_date) AS latest_date, CAST(MAX(purchase_date) - INTERVAL 90 DAY AS DATE) AS cutoff_date
FROM transactions""",
    "training": "SELECT t.* FROM transactions t, cut WHERE purchase_date <= cutoff_date",
    "evaluation": "SELECT t.* FROM transactions t, cut WHERE purchase_date > cutoff_date",
    "regions": """
SELECT hshd_num, store_region FROM (
  SELECT hshd_num, store_region, ROW_NUMBER() OVER (PARTITION BY hshd_num ORDER BY COUNT(*) DESC, store_region) AS place
  FROM training GROUP BY hshd_num, store_region) ranked
WHERE place = 1""",
    "totals": """
SELECT hshd_num, MAX(purchase_date) AS last_purchase_date, MIN(purchase_date) AS first_purchase_date,
  COUNT(DISTINCT basket_num) AS purchase_count, CAST(SUM(spend) AS DECIMAL(38,2)) AS total_spend,
  CAST(SUM(units) AS BIGINT) AS total_units, COUNT(DISTINCT product_num) AS unique_products,
  CAST(datediff('day', MIN(purchase_date), MAX(purchase_date)) AS INT) AS tenure
FROM training GROUP BY hshd_num""",
    "features": """
SELECT hshd_num, last_purchase_date, first_purchase_date, purchase_count, total_spend, total_units,
  CAST(total_spend AS DOUBLE) / purchase_count AS avg_basket_value, unique_products, store_region, tenure,
  greatest(tenure, 1) AS tenure_safe,
  purchase_count / (greatest(tenure, 1) / 30e0) AS purchase_frequency,
  CAST(total_spend AS DOUBLE) / greatest(purchase_count, 1) AS spend_per_visit
FROM totals JOIN regions USING (hshd_num)""",
    "labels": """
SELECT hshd_num, CASE WHEN hshd_num IN (SELECT hshd_num FROM evaluation) THEN 0 ELSE 1 END AS churned
FROM (SELECT DISTINCT hshd_num FROM training) seen""",
    "churn": """
SELECT f.*, unique_products / CAST(greatest(total_units, 1) AS DOUBLE) AS product_diversity_ratio,
  h.* EXCLUDE (hshd_num), churned
FROM features f LEFT JOIN households h USING (hshd_num) JOIN labels USING (hshd_num)""",
    "department_spend": """
SELECT hshd_num, department, CAST(SUM(spend) AS DECIMAL(38,2)) AS category_spend
FROM training JOIN products USING (product_num) GROUP BY hshd_num, department""",
    "department_columns": """
SELECT hshd_num, {pivot}
FROM department_spend GROUP BY hshd_num""",
    "future": """
SELECT hshd_num, CAST(SUM(spend) AS DECIMAL(38,2)) AS future_spend FROM evaluation GROUP BY hshd_num""",
    "clv_base": """
SELECT f.*, CAST(datediff('day', last_purchase_date, cutoff_date) AS INT) AS recency,
  CAST(total_spend AS DOUBLE) / tenure_safe AS spend_per_day,
  unique_products / CAST(greatest(total_units, 1) AS DOUBLE) AS product_diversity,
  COALESCE(future_spend, 0) AS future_spend
FROM features f CROSS JOIN cut LEFT JOIN future USING (hshd_num)""",
    "clv": """
SELECT *, blended_monthly_spend * 12e0 AS clv_12_month FROM (
  SELECT b.*, p.* EXCLUDE (hshd_num), h.* EXCLUDE (hshd_num), CAST(future_spend AS DOUBLE) * 4e0 AS annual_clv,
    least(tenure_safe / 365e0, 1e0) * (CAST(total_spend AS DOUBLE) / (tenure_safe / 30e0))
      + (1e0 - least(tenure_safe / 365e0, 1e0)) * (CAST(future_spend AS DOUBLE) / 3e0) AS blended_monthly_spend
  FROM clv_base b LEFT JOIN department_columns p USING (hshd_num) LEFT JOIN households h USING (hshd_num)) blended""",
    "edges_of_tiers": """
SELECT quantile_cont(clv_12_month, 0.25) AS q1, quantile_cont(clv_12_month, 0.5) AS q2,
  quantile_cont(clv_12_month, 0.75) AS q3 FROM clv""",
    "tiers": """
SELECT hshd_num, clv_12_month,
  CASE WHEN clv_12_month <= q1 THEN 'Bronze' WHEN clv_12_month <= q2 THEN 'Silver'
    WHEN clv_12_month <= q3 THEN 'Gold' ELSE 'Platinum' END AS clv_tier,
  CASE WHEN clv_12_month <= q1 THEN 0 WHEN clv_12_month <= q2 THEN 1 WHEN clv_12_month <= q3 THEN 2 ELSE 3 END
    AS clv_tier_rank
FROM clv, edges_of_tiers""",
    "hashes": """
SELECT hshd_num, churned, ((hshd_num % 2147483648) * 2654435761) % 4294967296 AS h FROM labels""",
    "marked_features": """
SELECT f.*, CASE WHEN ROW_NUMBER() OVER (ORDER BY ((hshd_num % 2147483648) * 2654435761) % 4294967296, hshd_num)
  <= ceil(COUNT(*) OVER () / 4e0) THEN 1 ELSE 0 END AS is_test
FROM features f""",
    "judged": """
SELECT hshd_num, purchase_count, churned, CASE WHEN purchase_count < 10 THEN 1 ELSE 0 END AS prediction FROM churn""",
    "cells": """
SELECT CAST(COUNT(*) FILTER (WHERE churned = 0 AND prediction = 0) AS DOUBLE) AS n00,
  CAST(COUNT(*) FILTER (WHERE churned = 0 AND prediction = 1) AS DOUBLE) AS n01,
  CAST(COUNT(*) FILTER (WHERE churned = 1 AND prediction = 0) AS DOUBLE) AS n10,
  CAST(COUNT(*) FILTER (WHERE churned = 1 AND prediction = 1) AS DOUBLE) AS n11, COUNT(*) AS n
FROM judged""",
    "classes": """
SELECT *, 2e0 * p0 * r0 / (p0 + r0) AS f0, 2e0 * p1 * r1 / (p1 + r1) AS f1 FROM (
  SELECT *, n00 / (n00 + n10) AS p0, n00 / (n00 + n01) AS r0, n11 / (n11 + n01) AS p1, n11 / (n11 + n10) AS r1,
    n00 + n01 AS s0, n10 + n11 AS s1 FROM cells) shares""",
    "items": "SELECT DISTINCT hshd_num, basket_num, product_num FROM transactions",
    "pairs": """
SELECT a.product_num AS product1, b.product_num AS product2, COUNT(*) AS "count"
FROM items a JOIN items b ON a.hshd_num = b.hshd_num AND a.basket_num = b.basket_num
  AND CAST(a.product_num AS VARCHAR) < CAST(b.product_num AS VARCHAR)
GROUP BY 1, 2""",
    "top": """SELECT * FROM pairs ORDER BY "count" DESC, product1, product2 LIMIT 200""",
    "edges": """
SELECT product1 AS src, product2 AS dst, "count" FROM top
UNION ALL SELECT product2, product1, "count" FROM top""",
    "recs": """
SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY src ORDER BY "count" DESC, dst) AS INT) AS rank FROM edges""",
    "baskets": "SELECT CAST(COUNT(*) AS BIGINT) AS total_baskets FROM (SELECT DISTINCT hshd_num, basket_num FROM transactions) b",
    "stats": """
SELECT product_num AS product_id, CAST(SUM(spend) AS DOUBLE) / COUNT(spend) AS avg_spend,
  CAST(SUM(spend) AS DECIMAL(38,2)) AS total_spend, COUNT(basket_num) AS purchase_count,
  CAST(SUM(units) AS DOUBLE) / COUNT(units) AS avg_units, CAST(SUM(units) AS BIGINT) AS total_units,
  department, commodity, COUNT(basket_num) / CAST(any_value(total_baskets) AS DOUBLE) AS purchase_frequency
FROM transactions CROSS JOIN baskets LEFT JOIN products USING (product_num)
GROUP BY product_num, department, commodity""",
    "loyalty": """
SELECT product_num, CAST(COUNT(*) FILTER (WHERE loyalty_flag = 'Y') AS DOUBLE) / COUNT(*) AS loyalty_ratio
FROM transactions JOIN households USING (hshd_num) GROUP BY product_num""",
    "details": """
SELECT product_num, purchase_frequency AS frequency, p.department, p.commodity
FROM (SELECT product1 AS product_num FROM top UNION SELECT product2 FROM top) ids
LEFT JOIN stats ON product_num = product_id LEFT JOIN products p USING (product_num)""",
    "pair_frame": """
SELECT product1, product2, "count", {sides},
  a.purchase_frequency + b.purchase_frequency AS total_frequency,
  1e0 - abs(a.avg_spend - b.avg_spend) / (a.avg_spend + b.avg_spend + 0.001e0) AS price_similarity,
  CASE WHEN a.department = b.department THEN 1 ELSE 0 END AS same_department,
  CAST("count" AS DOUBLE) / (SELECT MAX("count") FROM pairs) AS normalized_count
FROM pairs LEFT JOIN stats a ON product1 = a.product_id LEFT JOIN stats b ON product2 = b.product_id""",
    "top_products": """
SELECT DISTINCT src AS product1_num, a.department AS product1_dept, a.commodity AS product1_comm,
  dst AS product2_num, b.department AS product2_dept, b.commodity AS product2_comm, "count" AS co_occurrence_count
FROM recs JOIN details a ON src = a.product_num JOIN details b ON dst = b.product_num WHERE rank <= 5""",
    "shared_numbers": """
SELECT hshd_num, basket_num % 5 AS basket_num, product_num FROM transactions WHERE basket_num % 29 <> 0""",
    "own_weights": """
SELECT hshd_num, basket_num, dst, CAST(SUM("count") AS DOUBLE) AS weight
FROM transactions JOIN recs ON product_num = src GROUP BY 1, 2, 3""",
    "weights": """
SELECT hshd_num, basket_num, dst, CAST(SUM("count") AS DOUBLE) AS weight
FROM shared_numbers JOIN recs ON product_num = src GROUP BY 1, 2, 3""",
    "new_weights": """
SELECT * FROM weights w WHERE NOT EXISTS
  (SELECT 1 FROM shared_numbers t WHERE t.hshd_num = w.hshd_num AND t.basket_num = w.basket_num AND t.product_num = w.dst)""",
}

# Fixed values of the test data: the departments, and the columns of product stats.
DEPARTMENTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
COMMODITIES = sorted(f"Brand#{n}" for n in range(1, 26))
STATS = ["avg_spend", "purchase_count", "avg_units", "total_units", "department", "commodity", "purchase_frequency"]
CORRELATED = [
    "purchase_count",
    "total_spend",
    "total_units",
    "avg_basket_value",
    "unique_products",
    "tenure",
    "spend_per_visit",
    "product_diversity_ratio",
    "hshd_size",
    "children",
]

PARTS["department_columns"] = PARTS["department_columns"].format(
    pivot=", ".join(
        f"CAST(COALESCE(SUM(category_spend) FILTER (WHERE department = '{d}'), 0) AS DECIMAL(38,2)) AS dept_{d.lower()}"
        for d in DEPARTMENTS
    )
)
PARTS["pair_frame"] = PARTS["pair_frame"].format(
    sides=", ".join(
        f"CAST({t}.total_spend AS DOUBLE) AS {p}_total_spend, " + ", ".join(f"{t}.{c} AS {p}_{c}" for c in STATS)
        for t, p in (("a", "p1"), ("b", "p2"))
    )
)


def _with(body: str) -> str:
    """`body` after the common table expressions it names, directly or through others."""
    needed, found = [], [body]
    while found:
        sql = found.pop()
        words = set("".join(c if c.isalnum() or c == "_" else " " for c in sql).split())
        for name in PARTS:
            if name in words and name not in needed:
                needed.append(name)
                found.append(PARTS[name])
    tables = ",\n".join(f"{name} AS ({PARTS[name].strip()})" for name in PARTS if name in needed)
    return f"WITH {tables}\n{body.strip()}" if tables else body.strip()


def _category(column: str, value: str, name: str) -> str:
    return f"CASE WHEN {column} = '{value}' THEN 1 ELSE 0 END AS \"{name}_{value}\""


def _profile() -> str:
    kinds = {
        "basket_num": "bigint",
        "hshd_num": "bigint",
        "purchase_date": "date",
        "product_num": "bigint",
        "spend": "decimal(12,2)",
        "units": "int",
        "store_region": "string",
        "week_num": "int",
        "year": "int",
    }
    return "\nUNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS position, '{c}' AS column_name, '{k}' AS data_type, COUNT({c}) AS non_null FROM transactions"
        for i, (c, k) in enumerate(kinds.items())
    )


def _nulls() -> str:
    names = [
        "hshd_num",
        "loyalty_flag",
        "age_range",
        "marital_status",
        "income_range",
        "homeowner_desc",
        "hshd_composition",
        "hshd_size",
        "children",
    ]
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, bool_or({c} IS NULL) AS has_null FROM known_households" for c in names
    )


def _correlations() -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr(CAST({c} AS DOUBLE), CAST(churned AS DOUBLE)), 6) + 0e0 AS correlation FROM churn"
        for c in CORRELATED
    )


def _pair_model_data() -> str:
    dropped = ["p1_department", "p1_commodity", "p2_department", "p2_commodity"]
    columns = []
    for column in ("p1_department", "p2_department", "p1_commodity", "p2_commodity"):
        values = DEPARTMENTS if column.endswith("department") else COMMODITIES
        columns += [_category(column, v, column) for v in values]
        columns.append(f"CASE WHEN {column} IS NULL THEN 1 ELSE 0 END AS {column}_nan")
    return f"SELECT * EXCLUDE ({', '.join(dropped)}), {', '.join(columns)} FROM pair_frame"


BODIES = {
    "scan_transactions": "SELECT * FROM transactions",
    "scan_households": "SELECT * FROM households",
    "scan_products": "SELECT * FROM products",
    "prefixed_products": """
SELECT product_num, department AS p1_department, commodity AS p1_commodity, brand_type AS p1_brand_type,
  natural_organic_flag AS p1_natural_organic_flag FROM products""",
    "renamed_products": "SELECT product_num, department AS dept, commodity AS comm FROM products",
    "aligned_households": """
SELECT hshd_num, CASE WHEN hshd_size > 3 THEN children ELSE 0 END AS children, hshd_size, CAST(0 AS INT) AS tenure
FROM households""",
    "department_names": """
SELECT product_num, 'dept_' || replace(lower(department || ' ' || commodity), ' ', '_') AS feature FROM products""",
    "transaction_profile": _profile(),
    "null_report": _nulls(),
    "table_row_counts": """
SELECT 'transactions' AS name, COUNT(*) AS rows FROM transactions
UNION ALL SELECT 'households', COUNT(*) FROM households UNION ALL SELECT 'products', COUNT(*) FROM products""",
    "product_json": """
SELECT '{"product_num":' || product_num || ',"department":"' || department || '","commodity":"' || commodity ||
  '","brand_type":"' || brand_type || '","natural_organic_flag":"' || natural_organic_flag || '"}' AS json FROM products""",
    "trimmed_text": """
SELECT hshd_num, trim(name) AS name, regexp_replace(segment, '^\\s+|\\s+$', '', 'g') AS segment FROM raw_text""",
    "right_trimmed_text": """
SELECT hshd_num, rtrim(name) AS name, regexp_replace(segment, '\\s+$', '') AS segment FROM raw_text""",
    "standard_nulls": """
SELECT hshd_num, trim(name) AS name, CASE WHEN segment IS NULL OR lower(trim(segment)) = 'null' THEN 'null'
  ELSE regexp_replace(segment, '^\\s+|\\s+$', '', 'g') END AS segment FROM raw_text""",
    "parsed_numbers": """
SELECT hshd_num, CASE WHEN number = trunc(number) THEN CAST(number AS INT) END AS int_or_null,
  CAST(trunc(COALESCE(number, 0)) AS INT) AS int_or_zero,
  CAST(COALESCE(number, 0) AS DECIMAL(12,2)) AS number_or_zero FROM number_values""",
    "parsed_dates": """
SELECT o_orderkey AS basket_num, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS purchase_date
FROM orders""",
    "loaded_lines": """
SELECT basket_num, hshd_num, purchase_date, product_num,
  CASE WHEN basket_num % 17 = 0 THEN CAST(0 AS DECIMAL(12,2)) ELSE spend END AS spend, units, store_region, week_num, year
FROM checked_lines WHERE reject_reason IS NULL""",
    "rejected_lines": """
SELECT reject_reason, COUNT(*) AS rows FROM checked_lines WHERE reject_reason IS NOT NULL GROUP BY reject_reason""",
    "ingest_counts": """
SELECT 'transactions' AS table_name, COUNT(*) AS input_rows, COUNT(*) FILTER (WHERE reject_reason IS NULL) AS good_rows,
  COUNT(*) FILTER (WHERE reject_reason IS NOT NULL) AS rejected_rows, 0 AS duplicate_rows FROM checked_lines""",
    "cleaned_extract": """
SELECT CAST(basket_num AS VARCHAR) AS BASKET_NUM, CAST(hshd_num AS VARCHAR) AS HSHD_NUM,
  CASE WHEN basket_num % 13 <> 0 THEN purchase_date END AS PURCHASE_,
  CASE WHEN basket_num % 11 = 0 THEN '?' ELSE CAST(product_num AS VARCHAR) END AS PRODUCT_NUM,
  CASE WHEN basket_num % 17 = 0 THEN 'n/a' ELSE CAST(spend AS VARCHAR) END AS SPEND,
  CASE WHEN basket_num % 19 = 0 THEN '99999999999' ELSE CAST(units AS VARCHAR) END AS UNITS,
  store_region AS STORE_R, week_num AS WEEK_NUM, year AS YEAR
FROM checked_lines""",
    "cleaning_steps": """
SELECT CAST(place AS INT) AS place, step, column_name, n AS rows,
  CASE WHEN column_name = 'PURCHASE_' AND place NOT IN (3, 4) THEN late ELSE 0 END AS nulls,
  CASE WHEN column_name = 'PURCHASE_' AND place IN (3, 4) THEN late ELSE 0 END AS null_words,
  CASE WHEN place > 1 THEN 0 WHEN column_name = 'PURCHASE_' THEN n - late ELSE n END AS padded
FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE basket_num % 13 = 0) AS late FROM checked_lines) counted,
(SELECT unnest(['BASKET_NUM', 'HSHD_NUM', 'PURCHASE_', 'PRODUCT_NUM', 'SPEND', 'UNITS', 'STORE_R', 'WEEK_NUM', 'YEAR'])
  AS column_name) named,
(SELECT unnest(range(6)) AS place,
  unnest(['raw', 'names cut', 'values cut', 'nulls named', 'ends cut', 'numbers and dates read']) AS step) steps""",
    "interrupted_load": """
SELECT phase, table_name, CASE WHEN phase = 'interrupted' THEN 0 ELSE n END AS rows
FROM (SELECT 'transactions' AS table_name, COUNT(*) AS n FROM transactions UNION ALL
  SELECT 'households', COUNT(*) FROM households UNION ALL SELECT 'products', COUNT(*) FROM products) counted,
(SELECT unnest(['interrupted', 'repeated', 'repeated again']) AS phase) phases""",
    "missing_file_refused": """
SELECT COUNT(*) AS rows_given, 'households,products' AS refused, 0::BIGINT AS rows_stored FROM transactions""",
    "ingested_transactions": "SELECT * FROM transactions",
    "ingested_households": "SELECT * FROM households",
    "ingested_products": "SELECT * FROM products",
    "household_lines": """
SELECT hshd_num, basket_num, purchase_date, product_num, department, commodity, spend, units, store_region, week_num, year
FROM transactions JOIN products USING (product_num) WHERE hshd_num = 10
ORDER BY hshd_num, basket_num, purchase_date, product_num""",
    "demographics_engagement": """
SELECT store_region, age_range, CAST(SUM(spend) AS DOUBLE) / COUNT(spend) AS avg_spend,
  CAST(SUM(units) AS DOUBLE) / COUNT(units) AS avg_units, store_region || ', ' || age_range AS label
FROM transactions JOIN households USING (hshd_num) GROUP BY store_region, age_range""",
    "spend_over_time": """
SELECT year, CAST(month(purchase_date) AS INT) AS month, CAST(SUM(spend) AS DECIMAL(38,2)) AS total_spend,
  CAST(year AS VARCHAR) || '-' || CAST(month(purchase_date) AS VARCHAR) AS label
FROM transactions GROUP BY year, month(purchase_date) ORDER BY 1, 2""",
    "top_commodities": """
SELECT commodity, COUNT(*) AS "count" FROM transactions JOIN products USING (product_num)
GROUP BY commodity ORDER BY "count" DESC, commodity LIMIT 5""",
    "seasonal_spend": """
SELECT CAST(month(purchase_date) AS INT) AS month, CAST(SUM(spend) AS DECIMAL(38,2)) AS total_spend,
  'Month ' || CAST(month(purchase_date) AS VARCHAR) AS label
FROM transactions GROUP BY month(purchase_date) ORDER BY 1""",
    "loyalty_mix": """
SELECT loyalty_flag, COUNT(*) AS "count", CASE WHEN loyalty_flag = 'Y' THEN 'Loyal' ELSE 'Non-Loyal' END AS label
FROM transactions JOIN households USING (hshd_num) GROUP BY loyalty_flag""",
    "commodity_units_spend": """
SELECT commodity, CAST(SUM(units) AS BIGINT) AS total_units, CAST(SUM(spend) AS DECIMAL(38,2)) AS total_spend
FROM transactions JOIN products USING (product_num) GROUP BY commodity ORDER BY total_spend DESC, commodity""",
    "enriched_lines": """
SELECT t.*, department, commodity, brand_type, natural_organic_flag
FROM transactions t LEFT JOIN products USING (product_num)""",
    "cutoff": "SELECT * FROM cut",
    "training_lines": "SELECT * FROM training",
    "evaluation_lines": "SELECT * FROM evaluation",
    "favourite_region": """
SELECT hshd_num, store_region FROM (
  SELECT hshd_num, store_region, ROW_NUMBER() OVER (PARTITION BY hshd_num ORDER BY COUNT(*) DESC, store_region) AS place
  FROM transactions GROUP BY hshd_num, store_region) ranked
WHERE place = 1""",
    "customer_features": "SELECT * FROM features",
    "bucketed_customer_features": "SELECT * FROM features",
    "training_lines_by_month": "SELECT * FROM training",
    "evaluation_lines_by_month": "SELECT * FROM evaluation",
    "loose_baskets": """
SELECT hshd_num, COUNT(DISTINCT CASE WHEN basket_num % 5 <> 0 THEN basket_num END) AS purchase_count,
  round(CAST(SUM(spend) AS DOUBLE) / (COUNT(DISTINCT CASE WHEN basket_num % 5 <> 0 THEN basket_num END)
    + COUNT(*) FILTER (WHERE basket_num % 5 = 0)), 6) AS avg_basket_value
FROM training GROUP BY hshd_num""",
    "merged_distinct_counts": """
SELECT COUNT(DISTINCT hshd_num) AS households, COUNT(*) AS lines, 0 AS baskets_off, 0 AS products_off FROM transactions""",
    "category_maps": """
SELECT hshd_num, 'dept_' || replace(lower(department), ' ', '_') AS feature, CAST(SUM(category_spend) AS DECIMAL(38,2)) AS spend
FROM department_spend GROUP BY hshd_num, feature""",
    "one_hot_entries": """
SELECT hshd_num, array_to_string(list_sort(list_filter([
    CASE WHEN marital_status IS NULL THEN 'marital_status_nan'
      WHEN marital_status <> (SELECT MIN(marital_status) FROM known_households) THEN 'marital_status_' || marital_status END,
    CASE WHEN hshd_composition <> (SELECT MIN(hshd_composition) FROM households) THEN 'hshd_composition_' || hshd_composition END],
  lambda e: e IS NOT NULL)), ',') AS entries
FROM known_households""",
    "roc_auc_binned": """
, score_ends AS (SELECT MIN(purchase_count) AS low, MAX(purchase_count) AS high FROM judged),
score_bins AS (SELECT least(floor((purchase_count - low) / CAST(high - low AS DOUBLE) * 8), 7) AS bin,
  SUM(churned) AS p, SUM(1 - churned) AS n FROM judged, score_ends GROUP BY bin),
running_bins AS (SELECT p, n, SUM(n) OVER (ORDER BY bin) - n AS below FROM score_bins)
SELECT round(CAST(SUM(p * (below + n / 2e0)) AS DOUBLE) / (SUM(p) * SUM(n)), 9) AS auc,
  round(CAST(SUM(p * n / 2e0) AS DOUBLE) / (SUM(p) * SUM(n)), 9) AS bound, true AS within
FROM running_bins""",
    "churned_households": """
SELECT hshd_num FROM training EXCEPT SELECT hshd_num FROM evaluation""",
    "retained_households": """
SELECT hshd_num FROM training INTERSECT SELECT hshd_num FROM evaluation""",
    "churn_label": "SELECT * FROM labels",
    "churn_features": "SELECT * FROM churn",
    "churn_rate": "SELECT CAST(SUM(churned) AS DOUBLE) / COUNT(*) AS churn_rate FROM labels",
    "category_spend": "SELECT * FROM department_spend",
    "category_pivot": "SELECT * FROM department_columns",
    "future_spend": "SELECT * FROM future",
    "clv_features": "SELECT * FROM clv",
    "clv_summary": """
SELECT round(AVG(clv_12_month), 4) + 0e0 AS mean_clv, round(median(clv_12_month), 4) + 0e0 AS median_clv,
  round(MAX(clv_12_month), 4) + 0e0 AS max_clv FROM clv""",
    "clv_quartiles": """
SELECT 0.25e0 AS probability, round(q1, 4) AS quantile FROM edges_of_tiers
UNION ALL SELECT 0.5e0, round(q2, 4) FROM edges_of_tiers UNION ALL SELECT 0.75e0, round(q3, 4) FROM edges_of_tiers""",
    "churn_correlations": _correlations(),
    "clv_histogram": """
, ends AS (SELECT MIN(clv_12_month) AS lo, MAX(clv_12_month) AS hi FROM clv),
frame AS (SELECT CAST(b AS INT) AS bin, lo + b * ((hi - lo) / 10e0) AS low,
    CASE WHEN b = 9 THEN hi ELSE lo + (b + 1) * ((hi - lo) / 10e0) END AS high
  FROM ends CROSS JOIN range(10) AS r(b))
SELECT bin, round(low, 4) AS low, round(high, 4) AS high,
  CAST(CAST(trunc(low) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(trunc(high) AS BIGINT) AS VARCHAR) AS label,
  COUNT(clv_12_month) AS "count"
FROM frame LEFT JOIN clv ON clv_12_month >= low AND (clv_12_month < high OR (bin = 9 AND clv_12_month <= high))
GROUP BY bin, low, high""",
    "clv_tiers": "SELECT * FROM tiers",
    "tier_summary": """
SELECT clv_tier, COUNT(*) AS households, round(AVG(clv_12_month), 4) + 0e0 AS avg_clv FROM tiers GROUP BY clv_tier""",
    "one_hot_households": """
SELECT hshd_num, hshd_size, CASE WHEN marital_status = 'Single' THEN 1 ELSE 0 END AS "marital_status_Single",
  CASE WHEN homeowner_desc = 'Renter' THEN 1 ELSE 0 END AS "homeowner_desc_Renter" FROM known_households""",
    "one_hot_with_missing": """
SELECT hshd_num, CASE WHEN marital_status = 'Married' THEN 1 ELSE 0 END AS "marital_status_Married",
  CASE WHEN marital_status = 'Single' THEN 1 ELSE 0 END AS "marital_status_Single",
  CASE WHEN marital_status IS NULL THEN 1 ELSE 0 END AS marital_status_nan FROM known_households""",
    "imputed_products": """
SELECT p_partkey AS product_num,
  round(CASE WHEN p_size <= 25 THEN CAST(p_size AS DOUBLE)
    ELSE (SELECT AVG(CAST(p_size AS DOUBLE)) FROM part WHERE p_size <= 25) END, 6) AS size,
  round(CASE WHEN p_size > 10 THEN p_retailprice
    ELSE (SELECT AVG(p_retailprice) FROM part WHERE p_size > 10) END, 6) AS price
FROM part""",
    "cleaned_ratios": """
SELECT hshd_num, CASE WHEN children = 3 THEN CAST(hshd_size AS DOUBLE) END AS ratio,
  CASE WHEN children = 3 THEN CAST(hshd_size AS DOUBLE) ELSE 0e0 END AS ratio_or_zero FROM households""",
    "household_split": """
SELECT hshd_num, CASE WHEN ROW_NUMBER() OVER (ORDER BY ((hshd_num % 2147483648) * 2654435761) % 4294967296, hshd_num)
  <= ceil(COUNT(*) OVER () / 4e0) THEN 1 ELSE 0 END AS is_test FROM households""",
    "stratified_split": """
SELECT hshd_num, churned, CASE WHEN ROW_NUMBER() OVER (PARTITION BY churned ORDER BY h, hshd_num)
  <= ceil(COUNT(*) OVER (PARTITION BY churned) / 4e0) THEN 1 ELSE 0 END AS is_test FROM hashes""",
    "standardized_features": """
, moments AS (SELECT AVG(CAST(total_spend AS DOUBLE)) AS ma, stddev_pop(CAST(total_spend AS DOUBLE)) AS sa,
  AVG(purchase_count) AS mb, stddev_pop(purchase_count) AS sb, AVG(tenure) AS mc, stddev_pop(tenure) AS sc
  FROM marked_features WHERE is_test = 0)
SELECT hshd_num, round((CAST(total_spend AS DOUBLE) - ma) / sa, 6) + 0e0 AS total_spend,
  round((purchase_count - mb) / sb, 6) + 0e0 AS purchase_count, round((tenure - mc) / sc, 6) + 0e0 AS tenure
FROM marked_features, moments""",
    "confusion_matrix": """
SELECT CAST(0 AS INT) AS label, CAST(0 AS INT) AS prediction, CAST(n00 AS BIGINT) AS "count" FROM cells
UNION ALL SELECT 0, 1, CAST(n01 AS BIGINT) FROM cells UNION ALL SELECT 1, 0, CAST(n10 AS BIGINT) FROM cells
UNION ALL SELECT 1, 1, CAST(n11 AS BIGINT) FROM cells""",
    "classification_report": """
SELECT '0' AS class, round(p0, 9) AS precision, round(r0, 9) AS recall, round(f0, 9) AS f1, CAST(s0 AS BIGINT) AS support FROM classes
UNION ALL SELECT '1', round(p1, 9), round(r1, 9), round(f1, 9), CAST(s1 AS BIGINT) FROM classes
UNION ALL SELECT 'accuracy', round((n00 + n11) / n, 9), round((n00 + n11) / n, 9), round((n00 + n11) / n, 9), n FROM classes
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2e0, 9), round((r0 + r1) / 2e0, 9), round((f0 + f1) / 2e0, 9), n FROM classes
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 9), round((r0 * s0 + r1 * s1) / n, 9),
  round((f0 * s0 + f1 * s1) / n, 9), n FROM classes""",
    "roc_auc": """
, scores AS (SELECT purchase_count AS s, SUM(churned) AS pos, SUM(1 - churned) AS neg FROM judged GROUP BY purchase_count),
running AS (SELECT pos, neg, SUM(neg) OVER (ORDER BY s) - neg AS below FROM scores)
SELECT round(CAST(SUM(pos * (below + neg / 2e0)) AS DOUBLE) / (CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)), 9) AS auc
FROM running""",
    "regression_metrics": """
SELECT round(round(AVG(e * e) * pow(10e0, 8 - floor(log10(AVG(e * e))))) / pow(10e0, 8 - floor(log10(AVG(e * e)))), 6) AS mse, round(sqrt(AVG(e * e)), 3) AS rmse, round(AVG(abs(e)), 3) AS mae,
  round(1e0 - AVG(e * e) / var_pop(clv_12_month), 6) AS r2
FROM (SELECT clv_12_month, clv_12_month - annual_clv AS e FROM clv) errors""",
    "multi_item_baskets": """
SELECT hshd_num, basket_num, COUNT(*) AS products FROM items GROUP BY hshd_num, basket_num HAVING COUNT(*) >= 2""",
    "basket_items": "SELECT * FROM items",
    "basket_count": "SELECT * FROM baskets",
    "basket_pairs": "SELECT * FROM pairs",
    "top_pairs": "SELECT * FROM top",
    "product_metadata": "SELECT DISTINCT product_num, department, commodity FROM products",
    "product_stats": "SELECT * FROM stats",
    "loyalty_ratio": "SELECT * FROM loyalty",
    "product_stats_with_loyalty": """
SELECT stats.*, loyalty_ratio FROM stats LEFT JOIN loyalty ON product_id = product_num""",
    "pair_features": "SELECT * FROM pair_frame",
    "pair_model_data": _pair_model_data(),
    "pair_lookup": """
SELECT product1, product2, normalized_count FROM pair_frame JOIN top USING (product1, product2)""",
    "top_pair_products": "SELECT product1 AS product_num FROM top UNION SELECT product2 FROM top",
    "pair_edges": "SELECT * FROM edges",
    "recommendations": """
SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY src ORDER BY "count" DESC, dst) AS INT) AS rank
FROM (SELECT product1 AS src, product2 AS dst, "count" FROM pairs
  UNION ALL SELECT product2, product1, "count" FROM pairs) all_edges""",
    "product_details": "SELECT * FROM details",
    "product_catalog": """
SELECT product_num AS id, department, commodity, department || ' – ' || commodity AS label FROM details""",
    "top_product_pairs": "SELECT * FROM top_products",
    "top_pair_labels": """
SELECT product1_dept || ' – ' || product1_comm || ' & ' || product2_dept || ' – ' || product2_comm AS pair,
  co_occurrence_count AS "count" FROM top_products""",
    "recommend": """
SELECT hshd_num, basket_num, dst AS product_num, COALESCE(department, 'Unknown') AS department,
  COALESCE(commodity, 'Unknown') AS commodity, weight / MAX(weight) OVER (PARTITION BY hshd_num, basket_num) AS score
FROM weights LEFT JOIN details ON dst = product_num""",
    "recommend_new_products": """
SELECT hshd_num, basket_num, dst AS product_num, COALESCE(department, 'Unknown') AS department,
  COALESCE(commodity, 'Unknown') AS commodity, weight / MAX(weight) OVER (PARTITION BY hshd_num, basket_num) AS score
FROM new_weights LEFT JOIN details ON dst = product_num""",
    "recommended_from_stored_tables": """
SELECT hshd_num, basket_num, dst AS product_num, COALESCE(department, 'Unknown') AS department,
  COALESCE(commodity, 'Unknown') AS commodity, weight / MAX(weight) OVER (PARTITION BY hshd_num, basket_num) AS score
FROM own_weights LEFT JOIN details ON dst = product_num""",
    "formatted_values": """
SELECT age_range, printf('$%.2f', SUM(hshd_size) / 4.0) AS amount,
  format('{:,.1f}', AVG(CASE WHEN loyalty_flag = 'Y' THEN 1.0 ELSE 0.0 END) * 100) || '%' AS share
FROM households GROUP BY age_range""",
    "strict_dates": "SELECT DISTINCT basket_num, purchase_date AS day FROM transactions",
    "pairs_of_no_lines": """
SELECT COUNT(*) AS pairs, COUNT(*) AS details, COUNT(*) AS recommended FROM transactions WHERE basket_num < 0""",
    "quoted_products": """
SELECT CAST(product_num AS VARCHAR) AS product_num, '" ' || department || ', "A"" ' AS department, commodity, brand_type,
  natural_organic_flag FROM products""",
    "repeated_load_counts": """
SELECT load, table_name, input_rows, good_rows, 0 AS rejected_rows, input_rows - good_rows AS duplicate_rows
FROM (SELECT 'transactions' AS table_name, COUNT(*) AS input_rows, COUNT(*) AS first_rows, COUNT(*) AS second_rows FROM transactions
  UNION ALL SELECT 'households', COUNT(*), COUNT(*), 0 FROM households
  UNION ALL SELECT 'products', 2 * COUNT(*), COUNT(DISTINCT CASE WHEN product_num % 5 = 0 THEN 0 ELSE product_num END), 0 FROM products) c
CROSS JOIN LATERAL (VALUES (1, first_rows), (2, second_rows)) AS l(load, good_rows)""",
    "churn_score_facts": """
SELECT COUNT(*) AS "rows", COUNT(DISTINCT hshd_num) AS households, 0 AS outside, CAST(SUM(churned) AS BIGINT) AS churned,
  0 AS wrong_class FROM churn""",
    "churn_risk_facts": "SELECT COUNT(DISTINCT hshd_num) AS households, 0 AS out_of_order FROM churn",
    "churn_test_facts": """
SELECT CAST(churned AS INT) AS label, CAST(ceil(COUNT(*) / 4e0) AS BIGINT) AS "rows" FROM churn GROUP BY churned""",
    "churn_skill_facts": """
, churn_scores AS (SELECT purchase_count AS s, SUM(churned) AS pos, SUM(1 - churned) AS neg FROM churn GROUP BY purchase_count),
running_scores AS (SELECT pos, neg, SUM(neg) OVER (ORDER BY s DESC) - neg AS below FROM churn_scores)
SELECT CAST(SUM(pos + neg) AS BIGINT) AS households,
  round(CAST(SUM(pos * (below + neg / 2e0)) AS DOUBLE) / (CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)), 9) AS column_auc,
  true AS better_than_purchases
FROM running_scores""",
    "clv_skill_facts": """SELECT CAST(ceil(COUNT(*) / 4e0) AS BIGINT) AS "rows", true AS explains_half FROM clv""",
    "pair_skill_facts": """SELECT COUNT(*) AS "rows", true AS better_than_mean FROM pair_frame""",
    "churn_importance_facts": "SELECT 1e0 AS total, 0 AS negative, 0 AS out_of_order, 0 AS repeated FROM transactions LIMIT 1",
    "clv_score_facts": """
SELECT COUNT(*) AS "rows", COUNT(DISTINCT hshd_num) AS households, 0 AS outside, 4 AS tiers,
  round(SUM(clv_12_month), 2) AS true_total FROM clv""",
    "clv_ranking_facts": "SELECT COUNT(DISTINCT hshd_num) AS households, 0 AS out_of_order FROM clv",
    "clv_importance_facts": "SELECT 1e0 AS total, 0 AS negative, 0 AS out_of_order, 0 AS repeated FROM transactions LIMIT 1",
    "pair_score_facts": """
SELECT COUNT(*) AS "rows", 0 AS missing, round(SUM(normalized_count), 6) AS true_total FROM pair_frame""",
    "pair_importance_facts": "SELECT 1e0 AS total, 0 AS negative, 0 AS out_of_order, 0 AS repeated FROM transactions LIMIT 1",
    "stored_model_facts": """SELECT COUNT(*) AS "rows", 0 AS different FROM churn""",
    "household_labels": """
SELECT hshd_num, CASE WHEN loyalty_flag = 'Y' THEN 'Loyal' ELSE 'Non-Loyal' END AS loyalty,
  homeowner_desc || ', ' || age_range AS segment FROM households""",
}


def _complete(body: str) -> str:
    """A body that starts with ', name AS (...)' goes on with the common table expressions."""
    text = body.strip()
    if not text.startswith(","):
        return _with(text)
    whole = _with(text[1:])
    head, tail = whole.rsplit(text[1:].strip(), 1)
    return f"{head.rstrip()},\n{text[1:].strip()}{tail}"


ORACLES = {name: _complete(body) for name, body in BODIES.items()}
