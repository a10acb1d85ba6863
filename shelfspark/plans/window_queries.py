"""Registered queries: scans, filters, scalar expressions and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import scalar
from shelfspark.operators import windows as win
from shelfspark.plans.catalog import PANEL, W, add, frame
from shelfspark.sources import tables as src


def pick(*names):
    return " ".join(names)


add("s05_fingerprint", lambda t: src.fingerprint(t.sales.select("product_id", "store_id", "units")),
    """SELECT count(*) AS rows, CAST(sum(('0x' || substr(md5(concat(length(product_id), ':', product_id, length(store_id), ':', store_id, length(units::VARCHAR), ':', units)), 1, 15))::HUGEINT) AS VARCHAR) AS digest FROM sales_daily""",
    plain="digest", whole="rows")
add("s06_manifest", lambda t: src.manifest({"sales_daily": t.sales, "products": t("products")}),
    """SELECT 'sales_daily' AS table_name, strftime(date, '%Y%m') AS part, count(*) AS rows FROM sales_daily GROUP BY ALL
       UNION ALL SELECT 'products', '', count(*) FROM products""", "sales_daily products", plain="table_name part", whole="rows")
add("s08_read_only_sql", lambda t: src.read_only(t.spark, "SELECT product_id, sum(units) AS units FROM sales_view GROUP BY product_id", {"sales_view": t.sales}, 1000),
    "SELECT product_id, sum(units) AS units FROM sales_daily GROUP BY product_id", plain="product_id", whole="units")
CONFIG = {"panel": "daily", "keys": ["product_id", "store_id"]}
add("s10_dataset_version", lambda t: t.sales.groupBy("store_id").agg(F.count(F.lit(1)).alias("rows"), F.max("date").alias("last")).withColumn("dataset_version", F.lit(src.dataset_version("1.0", CONFIG, "2001-01-01"))),
    """SELECT store_id, count(*) AS rows, max(date) AS last, concat('1.0+', substr(sha256('{"keys": ["product_id", "store_id"], "panel": "daily"}'), 1, 8), '@2001-01-01') AS dataset_version FROM sales_daily GROUP BY store_id""", plain="store_id last dataset_version", whole="rows")
add("f02_f04_typed_read", lambda t: src.read(t.spark, t.sf_dir, "sales_daily", columns=["date", "product_id", "store_id", "units"], among={"product_id": ["Brand#11", "Brand#12"], "store_id": []}, start="1996-01-01", end="1997-12-31"),
    "SELECT date, product_id, store_id, units FROM sales_daily WHERE product_id IN ('Brand#11', 'Brand#12') AND date BETWEEN '1996-01-01' AND '1997-12-31'", plain=PANEL, whole="units")
add("f05_overlap", lambda t: src.read(t.spark, t.sf_dir, "promotions", start="1997-03-01", end="1997-03-31"),
    "SELECT * FROM promotions WHERE end_date >= '1997-03-01' AND start_date <= '1997-03-31'", "promotions", plain="promotion_id start_date end_date", whole="duration_days", doubles="promotion_spend")
add("f06_pairs_either_side", lambda t: t("relationships").filter(F.col("product_a").isin("Brand#11") | F.col("product_b").isin("Brand#11")),
    "SELECT * FROM relationships WHERE product_a = 'Brand#11' OR product_b = 'Brand#11'", "relationships", plain="product_a product_b relationship_type", doubles="cross_elasticity")
add("f07_region_filter", lambda t: t.sales.join(t("stores").filter("region = 'R1'"), "store_id", "left_semi").groupBy("store_id").agg(F.sum("units").alias("units")),
    "SELECT store_id, sum(units) AS units FROM sales_daily WHERE store_id IN (SELECT store_id FROM stores WHERE region = 'R1') GROUP BY store_id", "sales_daily stores", plain="store_id", whole="units")
add("f09_as_of_observed", lambda t: src.as_of(t.sales, "sales_daily", "1997-06-30").groupBy("product_id").agg(F.max("date").alias("last"), F.count(F.lit(1)).alias("rows")),
    "SELECT product_id, max(date) AS last, count(*) AS rows FROM sales_daily WHERE date <= '1997-06-30' GROUP BY product_id", plain="product_id last", whole="rows")
add("f10_mask_actuals", lambda t: src.as_of(t("promotions"), "promotions", "1998-01-01"),
    """SELECT promotion_id, start_date, CASE WHEN start_date <= '1998-01-01' THEN promotion_units END AS promotion_units,
              CASE WHEN start_date <= '1998-01-01' THEN promotion_spend END AS promotion_spend FROM promotions""", "promotions", plain="promotion_id start_date", whole="promotion_units", doubles="promotion_spend")
add("f11_training_rows", lambda t: scalar.training_rows(t.sales),
    """SELECT count(*) AS total, count(*) FILTER (stockout_flag) AS stockout, count(*) FILTER (NOT stockout_flag AND promotion_flag) AS promoted,
              count(*) FILTER (NOT stockout_flag AND NOT promotion_flag AND units IS NULL) AS no_target,
              count(*) FILTER (NOT stockout_flag AND NOT promotion_flag AND units IS NOT NULL) AS kept FROM sales_daily""", whole="total stockout promoted no_target kept")
add("f13_censored_demand", lambda t: scalar.censored(t.sales),
    "SELECT date, product_id, store_id, CASE WHEN NOT stockout_flag THEN units END AS units, units AS units_uncensored FROM sales_daily", plain=PANEL, whole="units units_uncensored")
add("f16_warm_up", lambda t: win.demand_lags(t.sales.filter("date >= date'1996-01-01' - interval 400 days")).filter("date >= '1996-01-01'"),
    f"SELECT * FROM (SELECT *, lag(units, 28) {W} AS lag_28, lag(units, 364) {W} AS lag_364 FROM sales_daily WHERE date >= DATE '1996-01-01' - INTERVAL 400 DAY) x WHERE date >= '1996-01-01'", plain=PANEL, whole="lag_28 lag_364")
add("x01_date_parts", lambda t: scalar.date_parts(t.sales.select("date").distinct()),
    """SELECT DISTINCT date, isodow(date) - 1 AS day_of_week, weekofyear(date) AS week_of_year, month(date) AS month, quarter(date) AS quarter, year(date) AS year,
              isodow(date) >= 6 AS weekend, ((month(date) + 8) % 12) + 1 AS financial_month, ((month(date) + 8) % 12) // 3 + 1 AS financial_quarter,
              year(date) - CASE WHEN month(date) < 4 THEN 1 ELSE 0 END AS financial_year,
              sin(2 * pi() * (isodow(date) - 1) / 7) AS dow_sin, cos(2 * pi() * month(date) / 12) AS month_cos, sin(2 * pi() * dayofyear(date) / 365.25) AS doy_sin,
              cos(4 * pi() * dayofyear(date) / 365.25) AS season_cos_2 FROM sales_daily""",
    plain="date weekend", whole="day_of_week week_of_year month quarter year financial_month financial_quarter financial_year", doubles="dow_sin month_cos doy_sin season_cos_2")
add("x03_time_index", lambda t: scalar.time_index(t.sales).groupBy("product_id").agg(F.min("time_index").alias("first"), F.max("time_index").alias("last")),
    "SELECT product_id, min(date_diff('day', m, date)) AS first, max(date_diff('day', m, date)) AS last FROM sales_daily, (SELECT min(date) AS m FROM sales_daily) GROUP BY product_id", plain="product_id", whole="first last")
add("x05_calendar", lambda t: scalar.calendar_of(scalar.days_of(t.sales)),
    """SELECT date, isodow(date) - 1 AS day_of_week, isodow(date) >= 6 AS weekend_flag,
              (month(date), day(date)) IN ((1, 26), (8, 15), (10, 2), (12, 25)) AS holiday_flag,
              date BETWEEN make_date(year(date)::BIGINT, 10, 9) AND make_date(year(date)::BIGINT, 10, 15) OR date BETWEEN make_date(year(date)::BIGINT, 12, 19) AND make_date(year(date)::BIGINT, 12, 25) AS festival_flag,
              CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) <= 5 THEN 'summer' WHEN month(date) <= 9 THEN 'monsoon' ELSE 'autumn' END AS season
       FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM sales_daily)""", plain="date weekend_flag holiday_flag festival_flag season", whole="day_of_week")
add("w15_festival_proximity", lambda t: scalar.festival_proximity(scalar.calendar_of(scalar.days_of(t.sales))),
    """SELECT date, date_diff('day', date, min(CASE WHEN f THEN date END) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS days_to_festival,
              date_diff('day', max(CASE WHEN f THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), date) AS days_since_festival
       FROM (SELECT date, (month(date) = 10 AND day(date) BETWEEN 9 AND 15) OR (month(date) = 12 AND day(date) BETWEEN 19 AND 25) AS f
             FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM sales_daily))""", plain="date", whole="days_to_festival days_since_festival")
add("x06_log_columns", lambda t: scalar.logs(t.sales), "SELECT date, product_id, store_id, ln(units) AS log_units, ln(selling_price) AS log_price FROM sales_daily WHERE units > 0 AND selling_price > 0",
    plain=PANEL, doubles="log_units log_price")
add("x08_horizon_buckets", lambda t: t.sales.groupBy(scalar.bucket(F.col("units") % 90 + 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
    """SELECT CASE WHEN step <= 3 THEN '1-3' WHEN step <= 7 THEN '4-7' WHEN step <= 14 THEN '8-14' WHEN step <= 28 THEN '15-28' WHEN step <= 56 THEN '29-56' ELSE '57-90' END AS bucket, count(*) AS n
       FROM (SELECT units % 90 + 1 AS step FROM sales_daily) GROUP BY ALL""", plain="bucket", whole="n")
add("x09_depth_bands", lambda t: t.sales.withColumn("band", scalar.depth_band(F.col("discount_percentage"))).groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.avg("units").alias("mean_units")),
    """SELECT CASE WHEN discount_percentage <= 0 THEN 'none' WHEN discount_percentage <= 10 THEN '0-10' WHEN discount_percentage <= 20 THEN '10-20' WHEN discount_percentage <= 30 THEN '20-30' ELSE '30-100' END AS band,
              count(*) AS rows, avg(units) AS mean_units FROM sales_daily GROUP BY ALL""", plain="band", whole="rows", doubles="mean_units")
add("x10_neutral_promotions", lambda t: scalar.neutral(win.promotion_history(t.sales)).groupBy("product_id").agg(F.max(F.col("promotion_flag").cast("int")).alias("flags"), F.min("days_since_promotion").alias("days"), F.sum("discount_percentage").alias("discount")),
    "SELECT product_id, 0 AS flags, -1 AS days, 0.0 AS discount FROM sales_daily GROUP BY product_id", plain="product_id", whole="flags days", doubles="discount")
add("x13_curve_shapes", lambda t: scalar.curves(scalar.time_index(t.sales).select("date", "time_index").distinct()),
    """SELECT date, 1 + 0.2 * cos(2 * pi() * (dayofyear(date) - 180) / 365.25) AS seasonal, ln(1 + i / 365.0) AS trend, 1 - exp(-3 * least(i / 180.0, 1)) AS ramp, power(0.5, i / 90.0) AS decay
       FROM (SELECT DISTINCT date, date_diff('day', m, date) AS i FROM sales_daily, (SELECT min(date) AS m FROM sales_daily))""", plain="date", doubles="seasonal trend ramp decay")
LAGS = ", ".join(f"lag(units, {n}) {W} AS lag_{n}" for n in (1, 7, 14, 28, 56, 364))
add("w01_w02_lags", lambda t: win.demand_lags(t.sales), f"SELECT date, product_id, store_id, {LAGS} FROM sales_daily", plain=PANEL, whole="lag_1 lag_7 lag_14 lag_28 lag_56 lag_364")
ROLL = ", ".join(f"avg(units) {frame(n)} AS rolling_mean_{n}, stddev_samp(units) {frame(n)} AS rolling_std_{n}" for n in (7, 14, 28, 56))
add("w03_w04_rolling", lambda t: win.demand_rolling(t.sales), f"SELECT date, product_id, store_id, {ROLL} FROM sales_daily", plain=PANEL,
    doubles=" ".join(f"rolling_mean_{n} rolling_std_{n}" for n in (7, 14, 28, 56)))
add("w05_w10_price_features", lambda t: win.price_features(t.sales),
    f"""SELECT date, product_id, store_id, greatest((regular_price - selling_price) / nullif(regular_price, 0), 0) AS discount_depth,
           selling_price / nullif(lag(selling_price, 1) {W}, 0) - 1 AS price_change_1, selling_price / nullif(lag(selling_price, 7) {W}, 0) - 1 AS price_change_7,
           selling_price IS DISTINCT FROM lag(selling_price, 1) {W} AS price_changed, selling_price / nullif(avg(selling_price) {frame(28)}, 0) AS price_vs_28,
           avg(selling_price) OVER (PARTITION BY product_id, store_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS historical_price FROM sales_daily""",
    plain=PANEL + " price_changed", doubles="discount_depth price_change_1 price_change_7 price_vs_28 historical_price")
SINCE = ("date_diff('day', last_value(CASE WHEN {p} THEN date END IGNORE NULLS) OVER (PARTITION BY product_id, store_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), date)")
add("w06_w07_w14_promotion_history", lambda t: win.promotion_history(t.sales),
    f"""SELECT date, product_id, store_id, {SINCE.format(p='p')} AS days_since_promotion, sum(promotion_flag::INT) {frame(28)} AS promotions_28, sum(promotion_flag::INT) {frame(90)} AS promotions_90
        FROM (SELECT *, lag(promotion_flag, 1) {W} AS p FROM sales_daily)""", plain=PANEL, whole="days_since_promotion promotions_28 promotions_90")
add("w08_pct_change", lambda t: t.sales.withColumn("change_28", win.change("units", 28)),
    f"SELECT date, product_id, store_id, (units - lag(units, 28) {W}) / nullif(lag(units, 28) {W}, 0) AS change_28 FROM sales_daily", plain=PANEL, doubles="change_28")
add("w09_dynamics", lambda t: win.demand_dynamics(t.sales),
    f"""SELECT date, product_id, store_id, avg(units) {frame(7)} / nullif(avg(units) {frame(28)}, 0) AS momentum, stddev_samp(units) {frame(28)} / nullif(avg(units) {frame(28)}, 0) AS volatility,
           (avg(units) {frame(7)} - lag(units, 28) {W}) / nullif(lag(units, 28) {W}, 0) AS trend FROM sales_daily""", plain=PANEL, doubles="momentum volatility trend")
add("w11_price_index", lambda t: win.price_index(t.sales, t("products")),
    "SELECT date, product_id, store_id, selling_price / nullif(avg(selling_price) OVER (PARTITION BY date, category), 0) AS price_index FROM sales_daily JOIN products USING (product_id)", "sales_daily products", plain=PANEL, doubles="price_index")
add("g03_j26_w12_competitors", lambda t: win.competitor_features(t.sales, t("competitor_pricing")),
    f"""SELECT date, product_id, store_id, selling_price - rival_price AS price_gap, selling_price / nullif(rival_price, 0) AS price_ratio, selling_price < rival_low AS cheaper, rival_promotion,
           rival_price / nullif(lag(rival_price, 7) {W}, 0) - 1 AS rival_change_7
        FROM sales_daily JOIN (SELECT date, product_id, avg(competitor_effective_price) AS rival_price, min(competitor_effective_price) AS rival_low, bool_or(competitor_promotion_flag) AS rival_promotion
                               FROM competitor_pricing GROUP BY ALL) USING (date, product_id)""", "sales_daily competitor_pricing", plain=PANEL + " cheaper rival_promotion", doubles="price_gap price_ratio rival_change_7")
add("j04_w13_inventory", lambda t: win.inventory_features(t.sales, t("inventory")),
    f"""SELECT date, product_id, store_id, available, coalesce(s, false) AS stockout_yesterday, {SINCE.format(p='s')} AS days_since_stockout, sum(stockout_flag::INT) {frame(28)} AS stockouts_28,
           sum(stockout_flag::INT) {frame(90)} AS stockouts_90, available / nullif(avg(units) {frame(28)}, 0) AS cover, lag(closing_inventory, 1) {W} AS closing_lag_1
        FROM (SELECT s.*, i.opening_inventory + i.received_units AS available, i.closing_inventory, lag(s.stockout_flag, 1) OVER (PARTITION BY s.product_id, s.store_id ORDER BY s.date) AS s
              FROM sales_daily s JOIN inventory i ON s.date = i.date AND s.product_id = i.product_id AND s.store_id = i.store_id)""", "sales_daily inventory",
    plain=PANEL + " stockout_yesterday", whole="available days_since_stockout stockouts_28 stockouts_90 closing_lag_1", doubles="cover")
add("w16_trailing_covariates", lambda t: win.trailing_covariates(t.sales),
    f"""SELECT date, product_id, store_id, CASE WHEN count(units) {frame(28)} >= 14 THEN avg(units) {frame(28)} END AS demand_mean_28, CASE WHEN count(units) {frame(7)} >= 3 THEN avg(units) {frame(7)} END AS demand_mean_7,
           CASE WHEN count(units) {frame(28)} >= 14 THEN stddev_samp(units) {frame(28)} END AS demand_std_28, ln(1 + CASE WHEN count(units) {frame(28)} >= 14 THEN avg(units) {frame(28)} END) AS demand_level,
           selling_price / nullif(CASE WHEN count(units) {frame(56)} >= 14 THEN avg(selling_price) {frame(56)} END, 0) AS price_ratio_56,
           CASE WHEN count(units) {frame(90)} >= 21 THEN avg(promotion_flag::INT) {frame(90)} END AS promo_share_90 FROM sales_daily""",
    plain=PANEL, doubles="demand_mean_28 demand_mean_7 demand_std_28 demand_level price_ratio_56 promo_share_90")
add("w18_within", lambda t: win.within(scalar.logs(t.sales), ["log_units", "log_price"], ["product_id", "store_id"]),
    """SELECT date, product_id, store_id, u - avg(u) OVER (PARTITION BY product_id, date) AS w_log_units, p - avg(p) OVER (PARTITION BY product_id, date) AS w_log_price FROM (
         SELECT *, ln(units) - avg(ln(units)) OVER (PARTITION BY product_id, store_id) AS u, ln(selling_price) - avg(ln(selling_price)) OVER (PARTITION BY product_id, store_id) AS p
         FROM sales_daily WHERE units > 0 AND selling_price > 0)""", plain=PANEL, doubles="w_log_units w_log_price")
add("w20_last_rows", lambda t: win.last_rows(t.sales, F.to_date(F.lit("1999-12-31"))),
    "SELECT * FROM sales_daily WHERE date <= '1999-12-31' QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY date DESC) = 1", plain=PANEL, whole="units")
add("w21_origins", lambda t: win.origins(t.sales), "SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM sales_daily)) WHERE k % 7 = 1", plain="date")
add("w22_thin_origins", lambda t: win.thin(win.origins(t.sales), 28),
    """WITH RECURSIVE o AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM sales_daily)) WHERE k % 7 = 1),
       g(date) AS (SELECT min(date) FROM o UNION ALL SELECT (SELECT min(o.date) FROM o WHERE o.date >= g.date + 28) FROM g WHERE g.date IS NOT NULL)
       SELECT date FROM g WHERE date IS NOT NULL""", plain="date")
add("w24_price_jumps", lambda t: win.price_jumps(t.sales, 1.8).groupBy("product_id").agg(F.count(F.lit(1)).alias("jumps"), F.max("price_jump").alias("largest")),
    f"SELECT product_id, count(*) AS jumps, max(j) AS largest FROM (SELECT product_id, selling_price / lag(selling_price, 1) {W} AS j FROM sales_daily) WHERE j > 1.8 OR j < 1 / 1.8 GROUP BY product_id", plain="product_id", whole="jumps", doubles="largest")
add("w25_date_gaps", lambda t: win.date_gaps(t.sales), "SELECT product_id, store_id, greatest(date_diff('day', min(date), max(date)) + 1 - count(*), 0) AS missing FROM sales_daily GROUP BY ALL", plain="product_id store_id", whole="missing")
