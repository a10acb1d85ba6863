"""Registered queries: contracts, keys, dimensions and panel suites."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import scalar
from shelfspark.operators import contracts
from shelfspark.operators.contracts import Contract, Field
from shelfspark.plans.catalog import W, add

SALES = Contract("sales_daily", ("date", "product_id", "store_id"), (
    Field("date", "date"), Field("product_id", "string"), Field("units", "bigint", low=0), Field("selling_price", "double", low=0.01, high=1500.0),
    Field("discount_percentage", "double", low=0, high=9.5), Field("store_id", "string", allowed=("AFRICA", "AMERICA", "ASIA", "EUROPE")), Field("loyalty_tier", "string")),
    {"price_order": "selling_price <= regular_price", "profit": "abs(gross_profit - (revenue - cost)) <= 0.05"})
BROKEN = (
    ("date", "type", "false"), ("date", "null", "date IS NULL"), ("product_id", "type", "false"), ("product_id", "null", "product_id IS NULL"), ("units", "type", "false"), ("units", "null", "units IS NULL"),
    ("units", "range", "units < 0"), ("selling_price", "type", "false"), ("selling_price", "null", "selling_price IS NULL"), ("selling_price", "range", "selling_price < 0.01 OR selling_price > 1500"),
    ("discount_percentage", "type", "false"), ("discount_percentage", "null", "discount_percentage IS NULL"), ("discount_percentage", "range", "discount_percentage < 0 OR discount_percentage > 9.5"),
    ("store_id", "type", "false"), ("store_id", "null", "store_id IS NULL"), ("store_id", "allowed", "store_id NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')"), ("loyalty_tier", "absent", "true"),
    ("price_order", "rule", "NOT selling_price <= regular_price"), ("profit", "rule", "NOT abs(gross_profit - (revenue - cost)) <= 0.05"))
add("q01_contract", lambda t: contracts.validate(t.sales, SALES),
    " UNION ALL ".join(f"SELECT 'sales_daily' AS table_name, '{c}' AS column_name, '{p}' AS problem, count(*) FILTER ({bad}) AS failing FROM sales_daily" for c, p, bad in BROKEN),
    plain="table_name column_name problem", whole="failing")
add("q02_primary_key", lambda t: contracts.primary_key(t("lineitem"), "lineitem", ["l_orderkey", "l_linenumber", "l_version"]),
    """SELECT 'lineitem' AS table_name, 'absent_columns' AS problem, any_value(1) AS failing FROM lineitem
       UNION ALL SELECT 'lineitem', 'null_component', count(*) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL) FROM lineitem
       UNION ALL SELECT 'lineitem', 'duplicate_rows', sum(n - 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""", plain="table_name problem", whole="failing")
DAYS = "(SELECT date, lag(date) OVER (ORDER BY date) AS after FROM (SELECT DISTINCT date FROM sales_daily WHERE product_id = 'Brand#11'))"
add("w26_contiguity", lambda t: contracts.gaps(t.sales.filter("product_id = 'Brand#11'").select("date").distinct()),
    f"SELECT date, date_diff('day', after, date) - 1 AS missing FROM {DAYS} WHERE date_diff('day', after, date) <> 1", plain="date", whole="missing")


def _dimensions(t):
    return contracts.dimensions(t("products"), t("stores"), scalar.calendar_of(scalar.days_of(t.sales)), t("relationships"))


ONE_ROW = "SELECT '{table}' AS table_name, '{rule}' AS rule, failing, failing = 0 AS passed FROM ({sql})"


def _stack(table: str, tests: dict[str, str]) -> str:
    return " UNION ALL ".join(ONE_ROW.format(table=table, rule=n, sql=s) for n, s in tests.items())


FESTIVAL = "date BETWEEN make_date(year(date)::BIGINT, 10, 9) AND make_date(year(date)::BIGINT, 10, 15) OR date BETWEEN make_date(year(date)::BIGINT, 12, 19) AND make_date(year(date)::BIGINT, 12, 25)"
SPAN = "(SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM sales_daily)"
add("q07_dimensions", _dimensions, _stack("dimensions", {
    "product_key": "SELECT count(*) - count(DISTINCT product_id) AS failing FROM products", "store_key": "SELECT count(*) - count(DISTINCT store_id) AS failing FROM stores",
    "calendar_gaps": f"SELECT count(*) FILTER (date_diff('day', l, date) <> 1) AS failing FROM (SELECT date, lag(date) OVER (ORDER BY date) AS l FROM {SPAN})",
    "no_festivals": f"SELECT (count(*) FILTER ({FESTIVAL}) = 0)::BIGINT AS failing FROM {SPAN}",
    "internal_columns": "SELECT count(*) FILTER (starts_with(name, '_')) AS failing FROM (SELECT unnest(['product_id', 'category', 'store_id', 'channel']) AS name FROM products LIMIT 1)",
    "substitute_sign": "SELECT count(*) AS failing FROM relationships WHERE relationship_type = 'substitute' AND cross_elasticity <= 0",
    "complement_sign": "SELECT count(*) AS failing FROM relationships WHERE relationship_type = 'complement' AND cross_elasticity >= 0"}),
    "sales_daily products stores relationships", plain="table_name rule passed", whole="failing")
add("q05_promotion_suite", lambda t: contracts.promotion_suite(t("promotions")), _stack("promotions", {
    "duplicate_id": "SELECT count(*) - count(DISTINCT promotion_id) AS failing FROM promotions", "few_types": "SELECT (count(DISTINCT promotion_type) < 3)::BIGINT AS failing FROM promotions"}),
    "promotions", plain="table_name rule passed", whole="failing")
add("q06_pricing_suite", lambda t: contracts.pricing_suite(t.sales, F.dayofmonth("date") == 1), _stack("pricing", {
    "price_not_positive": "SELECT count(*) AS failing FROM sales_daily WHERE selling_price <= 0",
    "static_products": "SELECT (avg(s::INT) >= 0.1)::BIGINT AS failing FROM (SELECT min(selling_price) = max(selling_price) AS s FROM sales_daily GROUP BY product_id)",
    "no_randomised_tests": "SELECT (count(*) FILTER (day(date) = 1) = 0)::BIGINT AS failing FROM sales_daily"}), plain="table_name rule passed", whole="failing")
add("q04_stockout_rate", lambda t: contracts.stockout_rate(t("inventory")),
    "SELECT rate, CASE WHEN rate > 0 AND rate < 0.35 THEN 'PASS' ELSE 'WARN' END AS status FROM (SELECT avg(stockout_flag::INT) AS rate FROM inventory)", "inventory", plain="status", doubles="rate")

BASE = """(SELECT sum(n - days) AS duplicates, sum(greatest(span + 1 - days, 0)) AS missing_days, sum((n < 180)::INT) AS short_history, sum((p > 0.95 * n)::INT) AS always_treated
  FROM (SELECT count(*) AS n, count(DISTINCT date) AS days, date_diff('day', min(date), max(date)) AS span, sum(promotion_flag::INT) AS p FROM sales_daily GROUP BY product_id, store_id))"""
ROWS = f"""(SELECT sum((units < 0)::INT) AS negative_units, avg((units = 0)::INT) AS zero_share, count(*) - count(units) AS missing_target, count(*) - count(units) AS missing_outcome, count(*) - count(promotion_flag) AS missing_treatment,
  count(*) FILTER (selling_price <= 0) AS price_not_positive, count(*) FILTER (ratio > 10 OR ratio < 0.1) AS price_jumps, count(*) FILTER (promotion_flag AND discount_percentage <= 0) AS flag_without_discount,
  avg(promotion_flag::INT) AS promoted_share, avg(stockout_flag::INT) AS stockout_share, avg((NOT promotion_flag AND discount_percentage >= 8)::INT) AS discount_without_flag, avg((NOT promotion_flag)::INT) AS control_share,
  abs(avg(stockout_flag::INT) FILTER (promotion_flag) - avg(stockout_flag::INT) FILTER (NOT promotion_flag)) AS censoring_gap
  FROM (SELECT *, selling_price / nullif(lag(selling_price) {W}, 0) AS ratio FROM sales_daily))"""
OVERLAP = """(SELECT count(*) FILTER (start_date <= last) AS overlapping_events FROM (SELECT *, max(end_date) OVER (PARTITION BY product_id, store_id ORDER BY start_date, end_date, promotion_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM promotions))"""


def _suite(limits: dict, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS measure, {n}::DOUBLE AS value, CASE WHEN {n} BETWEEN {low} AND {high} THEN 'PASS' ELSE '{bad}' END AS status FROM m" for n, (low, high, bad) in limits.items()).join(
        (f"WITH m AS (SELECT * FROM {source}) ", ""))


add("q09_forecast_suite", lambda t: contracts.forecast_suite(t.sales), _suite(contracts.FORECAST_LIMITS, f"{BASE}, {ROWS}"), plain="measure status", doubles="value")
add("q10_uplift_suite", lambda t: contracts.uplift_suite(t.sales, t("promotions")), _suite(contracts.UPLIFT_LIMITS, f"{BASE}, {ROWS}, {OVERLAP}"),
    "sales_daily promotions", plain="measure status", doubles="value")
