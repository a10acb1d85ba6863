"""Registered queries: joins, aggregations, forecasts, quality jobs and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import scalar
from shelfspark.operators import checks, forecast, joins, metrics, sampling
from shelfspark.plans.catalog import PANEL, W, add, frame

EVENT_ROW = "s.date BETWEEN p.start_date AND p.end_date AND s.product_id = p.product_id AND s.store_id = p.store_id"
add("j01_j02_attributes", lambda t: joins.attributes(joins.attributes(t.sales, t("products"), "product_id"), t("stores"), "store_id"),
    "SELECT s.date, s.product_id, s.store_id, category, channel, region, base_price FROM sales_daily s LEFT JOIN products USING (product_id) LEFT JOIN stores USING (store_id)",
    "sales_daily products stores", plain=PANEL + " category channel region", doubles="base_price")
add("j03_calendar_join", lambda t: t.sales.join(scalar.calendar(t.spark, "1995-01-01", "2002-12-31"), "date", "left").groupBy("season", "holiday_flag").agg(F.sum("units").alias("units")),
    """SELECT CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) <= 5 THEN 'summer' WHEN month(date) <= 9 THEN 'monsoon' ELSE 'autumn' END AS season,
              (month(date), day(date)) IN ((1, 26), (8, 15), (10, 2), (12, 25)) AS holiday_flag, sum(units) AS units FROM sales_daily GROUP BY ALL""", plain="season holiday_flag", whole="units")
add("j05_j06_promotion_features", lambda t: joins.promotion_features(t.sales, t("promotions")),
    f"""SELECT s.date, s.product_id, s.store_id, p.promotion_id IS NOT NULL AS on_promotion, coalesce(p.discount_percentage, 0) AS event_discount, coalesce(p.duration_days, 0) AS duration_days,
               coalesce(date_diff('day', p.start_date, s.date), -1) AS days_into, coalesce(date_diff('day', s.date, p.end_date), -1) AS days_left
        FROM sales_daily s LEFT JOIN promotions p ON {EVENT_ROW}""", "sales_daily promotions", plain=PANEL + " on_promotion", whole="duration_days days_into days_left", doubles="event_discount")
add("j07_days_to_next", lambda t: joins.days_to_next(t.sales, t("promotions")),
    """SELECT s.date, s.product_id, s.store_id, date_diff('day', s.date, p.start_date) AS days_to_next_promotion
       FROM sales_daily s ASOF LEFT JOIN promotions p ON s.product_id = p.product_id AND s.store_id = p.store_id AND s.date <= p.start_date""", "sales_daily promotions", plain=PANEL, whole="days_to_next_promotion")
add("j08_washout", lambda t: joins.washout(t.sales, t("promotions")),
    """SELECT s.date, s.product_id, s.store_id, coalesce(date_diff('day', p.end_date, s.date) BETWEEN 1 AND 10, false) AS washout
       FROM sales_daily s ASOF LEFT JOIN promotions p ON s.product_id = p.product_id AND s.store_id = p.store_id AND s.date >= p.end_date""", "sales_daily promotions", plain=PANEL + " washout")
add("j09_days_to_nearest", lambda t: joins.days_to_nearest(t.sales, t("promotions")),
    """SELECT a.date, a.product_id, a.store_id, CASE WHEN ls IS NOT NULL AND (le IS NULL OR ls > le) THEN 0 WHEN le IS NOT NULL OR ns IS NOT NULL THEN greatest(least(date_diff('day', le, a.date), date_diff('day', a.date, ns)), 0) END AS nearest
       FROM (SELECT s.*, n.start_date AS ns FROM sales_daily s ASOF LEFT JOIN promotions n ON s.product_id = n.product_id AND s.store_id = n.store_id AND s.date <= n.start_date) a
       JOIN (SELECT s.date, s.product_id, s.store_id, e.end_date AS le FROM sales_daily s ASOF LEFT JOIN promotions e ON s.product_id = e.product_id AND s.store_id = e.store_id AND s.date >= e.end_date) b
         ON a.date = b.date AND a.product_id = b.product_id AND a.store_id = b.store_id
       JOIN (SELECT s.date, s.product_id, s.store_id, b.start_date AS ls FROM sales_daily s ASOF LEFT JOIN promotions b ON s.product_id = b.product_id AND s.store_id = b.store_id AND s.date >= b.start_date) c
         ON a.date = c.date AND a.product_id = c.product_id AND a.store_id = c.store_id""", "sales_daily promotions", plain=PANEL, whole="nearest")
PAIRS = """SELECT a.product_id AS product_a, b.product_id AS product_b, a.store_id, a.date, ln(a.units) AS ln_demand_a, ln(a.selling_price) AS ln_price_a, ln(b.selling_price) AS ln_price_b
           FROM sales_daily a JOIN relationships r ON r.product_a = a.product_id JOIN sales_daily b ON b.product_id = r.product_b AND b.store_id = a.store_id AND b.date = a.date WHERE a.units > 0"""
add("j10_cross_pairs", lambda t: joins.cross_pairs(t.sales, t("relationships")).groupBy("product_a", "product_b").agg(F.count(F.lit(1)).alias("n"), F.sum("ln_demand_a").alias("demand"), F.sum("ln_price_b").alias("price")),
    f"SELECT product_a, product_b, count(*) AS n, sum(ln_demand_a) AS demand, sum(ln_price_b) AS price FROM ({PAIRS}) x GROUP BY ALL", "sales_daily relationships", plain="product_a product_b", whole="n", doubles="demand price")
add("j11_u04_candidate_pairs", lambda t: joins.candidate_pairs(t("products"), t("relationships").filter("product_a < product_b")),
    """SELECT focal, other, tier, row_number() OVER (PARTITION BY focal ORDER BY tier, other) AS rank FROM (
         SELECT focal, other, min(tier) AS tier FROM (SELECT product_a AS focal, product_b AS other, 0 AS tier FROM relationships WHERE product_a < product_b
           UNION ALL SELECT a.product_id, b.product_id, 1 FROM products a JOIN products b ON a.category = b.category AND a.product_id <> b.product_id) GROUP BY ALL) QUALIFY rank <= 40""",
    "products relationships", plain="focal other", whole="tier rank")
add("j12_j14_b03_horizon", lambda t: joins.horizon(t.sales, _origins(t), [1, 7, 28]),
    """SELECT s.product_id, s.store_id, s.date AS origin_date, x.date AS target_date, k.step, s.units AS origin_units, x.units AS target_units
       FROM sales_daily s JOIN (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM sales_daily)) o ON o.date = s.date AND o.k % 7 = 1
       CROSS JOIN (VALUES (1), (7), (28)) k(step) JOIN sales_daily x ON x.product_id = s.product_id AND x.store_id = s.store_id AND x.date = s.date + k.step""",
    plain="product_id store_id origin_date target_date", whole="step origin_units target_units")
add("j15_seasonal_reference", lambda t: joins.seasonal_reference(t.sales),
    "SELECT s.date, s.product_id, s.store_id, p.units AS seasonal_units FROM sales_daily s LEFT JOIN sales_daily p ON p.product_id = s.product_id AND p.store_id = s.store_id AND p.date = s.date - 364", plain=PANEL, whole="seasonal_units")
add("j16_semi_join", lambda t: joins.keep_keys(t.sales, t("promotions").filter("duration_days >= 3")).groupBy("product_id", "store_id").agg(F.sum("units").alias("units")),
    "SELECT product_id, store_id, sum(units) AS units FROM sales_daily WHERE (product_id, store_id) IN (SELECT (product_id, store_id) FROM promotions WHERE duration_days >= 3) GROUP BY ALL", "sales_daily promotions", plain="product_id store_id", whole="units")
add("j17_contemporary_controls", lambda t: joins.contemporary_controls(t.sales, t("products"), t("stores")).groupBy("category", "region").agg(F.count(F.lit(1)).alias("n")),
    """WITH r AS (SELECT s.*, category, region FROM sales_daily s JOIN products USING (product_id) JOIN stores USING (store_id)), x AS (SELECT * FROM r WHERE promotion_flag)
       SELECT category, region, count(*) AS n FROM r WHERE (product_id, store_id) NOT IN (SELECT (product_id, store_id) FROM x) AND (category, region) IN (SELECT (category, region) FROM x)
         AND date BETWEEN (SELECT min(date) FROM x) AND (SELECT max(date) FROM x) GROUP BY ALL""", "sales_daily products stores", plain="category region", whole="n")
add("j18_first_day_spend", lambda t: joins.first_day_spend(t.sales, t("promotions")),
    "SELECT s.date, s.product_id, s.store_id, coalesce(p.promotion_spend, 0) AS promotion_spend FROM sales_daily s LEFT JOIN promotions p ON p.product_id = s.product_id AND p.store_id = s.store_id AND p.start_date = s.date", "sales_daily promotions", plain=PANEL, doubles="promotion_spend")
add("j19_orphans", lambda t: joins.orphans(t.sales, t("products").filter("product_status = 'Active'"), "product_id").groupBy("product_id").agg(F.count(F.lit(1)).alias("rows")),
    "SELECT product_id, count(*) AS rows FROM sales_daily WHERE product_id NOT IN (SELECT product_id FROM products WHERE product_status = 'Active') GROUP BY ALL", "sales_daily products", plain="product_id", whole="rows")
add("j24_j25_event_windows", lambda t: joins.event_windows(t.sales, t("promotions"), 14, 10).groupBy("promotion_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("units").alias("units")),
    "SELECT p.promotion_id, count(*) AS rows, sum(s.units) AS units FROM promotions p JOIN sales_daily s ON s.product_id = p.product_id AND s.store_id = p.store_id AND s.date BETWEEN p.start_date - 14 AND p.end_date + 10 GROUP BY ALL", "sales_daily promotions", plain="promotion_id", whole="rows units")


def _origins(t):
    from shelfspark.operators.windows import origins

    return origins(t.sales)


ROLL = "sum(units) AS units, sum(revenue) AS revenue, sum(cost) AS cost, sum(gross_profit) AS gross_profit, sum(promotion_flag::INT) AS promo_days, sum(stockout_flag::INT) AS stockout_days, count(*) AS days, avg(selling_price) AS price"
for unit in ("week", "month"):
    add(f"g01_{unit}ly_rollup", lambda t, u=unit: metrics.rollup(t.sales, u), f"SELECT date_trunc('{unit}', date)::DATE AS date, product_id, store_id, {ROLL} FROM sales_daily GROUP BY ALL", plain=PANEL,
        whole="units promo_days stockout_days days", doubles="revenue cost gross_profit price")
add("g02_merged_rollup", lambda t: metrics.merged(metrics.rollup(t.sales.filter("stockout_flag"), "month").unionByName(metrics.rollup(t.sales.filter("not stockout_flag"), "month"))),
    "SELECT date_trunc('month', date)::DATE AS date, product_id, store_id, sum(units) AS units, count(*) AS days, avg(selling_price) AS price FROM sales_daily GROUP BY ALL", plain=PANEL, whole="units days", doubles="price")
add("g05_listings", lambda t: t.sales.filter("date between '1997-01-01' and '1997-12-31'").groupBy("product_id", "store_id").agg(F.count(F.lit(1)).alias("observations"), F.sum("units").alias("units")),
    "SELECT product_id, store_id, count(*) AS observations, sum(units) AS units FROM sales_daily WHERE date BETWEEN '1997-01-01' AND '1997-12-31' GROUP BY ALL", plain="product_id store_id", whole="observations units")
add("g06_trade_cells", lambda t: t("promotions").join(t("stores").select("store_id", "region"), "store_id").groupBy("product_id", "region").agg(
        F.avg("promotion_spend").alias("mean_spend"), F.sum("promotion_spend").alias("total_spend"), F.stddev_samp("promotion_units").alias("sd_units"), F.count(F.lit(1)).alias("events")),
    "SELECT product_id, region, avg(promotion_spend) AS mean_spend, sum(promotion_spend) AS total_spend, stddev_samp(promotion_units) AS sd_units, count(*) AS events FROM promotions JOIN stores USING (store_id) GROUP BY ALL",
    "promotions stores", plain="product_id region", whole="events", doubles="mean_spend total_spend sd_units")
PRED = f"""(SELECT *, greatest(coalesce(0.4 * season + 0.6 * recent, recent, season, m), 0) AS predicted FROM (
  SELECT *, coalesce(avg(units) {frame(28)}, avg(units) {frame(14)}, avg(units) {frame(7)}) AS recent, lag(units, 364) {W} AS season, (SELECT avg(units) FROM sales_daily) AS m FROM sales_daily))"""
METRICS = """count(*) AS n, avg(abs(predicted - units)) AS mae, sqrt(avg((predicted - units) * (predicted - units))) AS rmse, sum(abs(predicted - units)) / nullif(sum(units), 0) AS wmape, avg(predicted - units) AS bias,
  sum(predicted - units) / nullif(sum(units), 0) AS bias_pct, avg(abs((predicted - units) / nullif(units, 0))) AS mape, sum(units) AS actual_total, sum(predicted) AS predicted_total"""
NUMBERS = "mae rmse wmape bias bias_pct mape actual_total predicted_total"
add("b07_seasonal_naive", lambda t: forecast.seasonal_naive(t.sales), f"SELECT date, product_id, store_id, predicted FROM {PRED}", plain=PANEL, doubles="predicted")
add("b08_horizon_naive", lambda t: forecast.horizon_naive(t.sales), f"SELECT date, product_id, store_id, coalesce(lag(units, 1) {W}, avg(units) {frame(7)}, avg(units) {frame(28)}) AS predicted FROM sales_daily", plain=PANEL, doubles="predicted")
add("b12_fallback", lambda t: forecast.with_fallback(t.sales.withColumn("model", F.when(F.col("units") % 3 == 0, F.col("units") * 1.1)), "model").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted").alias("total")),
    f"""SELECT CASE WHEN m IS NOT NULL THEN 'model' WHEN r28 IS NOT NULL THEN 'rolling_28' WHEN r7 IS NOT NULL THEN 'rolling_7' WHEN l1 IS NOT NULL THEN 'lag_1' ELSE 'zero' END AS reason, count(*) AS n, sum(coalesce(m, r28, r7, l1, 0)) AS total
        FROM (SELECT CASE WHEN units % 3 = 0 THEN units * 1.1::DOUBLE END AS m, avg(units) {frame(28)} AS r28, avg(units) {frame(7)} AS r7, lag(units, 1) {W} AS l1 FROM sales_daily) GROUP BY ALL""", plain="reason", whole="n", doubles="total")
add("b01_temporal_split", lambda t: forecast.split(t.sales).groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("start_date"), F.max("date").alias("end_date")),
    """SELECT CASE WHEN a < 120 THEN 'test' WHEN a < 210 THEN 'valid' WHEN a < 270 THEN 'calibration' ELSE 'train' END AS part, count(*) AS rows, min(date) AS start_date, max(date) AS end_date
       FROM (SELECT date, date_diff('day', date, (SELECT max(date) FROM sales_daily)) AS a FROM sales_daily) GROUP BY ALL""", plain="part start_date end_date", whole="rows")
add("b17_backtest", lambda t: forecast.folds(forecast.seasonal_naive(t.sales)).groupBy("fold").agg(*metrics.accuracy()),
    f"SELECT 4 - a // 90 AS fold, {METRICS} FROM (SELECT *, date_diff('day', date, (SELECT max(date) FROM sales_daily)) AS a FROM {PRED}) WHERE a < 360 GROUP BY ALL", whole="fold n", doubles=NUMBERS)
add("g08_accuracy", lambda t: forecast.seasonal_naive(t.sales).agg(*metrics.accuracy()), f"SELECT {METRICS} FROM {PRED}", whole="n", doubles=NUMBERS)
add("g09_segments", lambda t: metrics.by_segments(forecast.seasonal_naive(t.sales), ["product_id", "store_id", "promotion_flag"]),
    f"""SELECT segment, value, {METRICS} FROM (SELECT 'product_id' AS segment, product_id AS value, units, predicted FROM {PRED} UNION ALL SELECT 'store_id', store_id, units, predicted FROM {PRED}
        UNION ALL SELECT 'promotion_flag', promotion_flag::VARCHAR, units, predicted FROM {PRED}) GROUP BY ALL HAVING count(*) >= 30""", plain="segment value", whole="n", doubles=NUMBERS)
add("g11_hierarchy", lambda t: metrics.hierarchy(joins.attributes(joins.attributes(forecast.seasonal_naive(t.sales), t("products"), "product_id"), t("stores"), "store_id")),
    f"""WITH p AS (SELECT date, product_id, store_id, category, region, units, predicted FROM {PRED} JOIN products USING (product_id) JOIN stores USING (store_id)),
        l AS (SELECT 'product_idxstore_id' AS level, date, product_id AS a, store_id AS b, sum(units) AS units, sum(predicted) AS predicted FROM p GROUP BY ALL
              UNION ALL SELECT 'product_id', date, product_id, '', sum(units), sum(predicted) FROM p GROUP BY ALL UNION ALL SELECT 'store_id', date, store_id, '', sum(units), sum(predicted) FROM p GROUP BY ALL
              UNION ALL SELECT 'category', date, category, '', sum(units), sum(predicted) FROM p GROUP BY ALL UNION ALL SELECT 'region', date, region, '', sum(units), sum(predicted) FROM p GROUP BY ALL
              UNION ALL SELECT 'total', date, '', '', sum(units), sum(predicted) FROM p GROUP BY ALL)
        SELECT level, {METRICS} FROM l GROUP BY level""", "sales_daily products stores", plain="level", whole="n", doubles=NUMBERS)
add("g15_zero_profile", lambda t: metrics.zero_profile(t.sales), "SELECT count(*) AS n, avg((units = 0)::INT) AS zero_share, avg((units < 5)::INT) AS low_share, avg(units) AS mean, quantile_cont(units, 0.5) AS median FROM sales_daily", whole="n", doubles="zero_share low_share mean median")
add("g16_distribution", lambda t: metrics.distribution(forecast.seasonal_naive(t.sales), "predicted"),
    f"SELECT count(*) AS n, avg(predicted) AS mean, stddev_samp(predicted) AS std, quantile_cont(predicted, 0.1) AS p10, quantile_cont(predicted, 0.5) AS p50, quantile_cont(predicted, 0.9) AS p90, stddev_samp(predicted) / avg(predicted) AS cv FROM {PRED}", whole="n", doubles="mean std p10 p50 p90 cv")
add("g18_daily_totals", lambda t: forecast.seasonal_naive(t.sales).groupBy("date").agg(F.sum("predicted").alias("units"), F.sum(F.col("predicted") * F.col("regular_price")).alias("revenue")),
    f"SELECT date, sum(predicted) AS units, sum(predicted * regular_price) AS revenue FROM {PRED} GROUP BY date", plain="date", doubles="units revenue")
add("g19_cold_start", lambda t: forecast.cold_start(t.sales, t("products"), t("stores")),
    """SELECT category, channel, avg(units) AS mean_units, count(*) AS n, (SELECT avg(s.units) FROM sales_daily s JOIN f USING (product_id, store_id) WHERE date_diff('day', f0, date) >= 60) AS overall
       FROM sales_daily JOIN f USING (product_id, store_id) JOIN products USING (product_id) JOIN stores USING (store_id) WHERE date_diff('day', f0, date) >= 60 GROUP BY category, channel""".replace(
        " f USING", " (SELECT product_id, store_id, min(date) AS f0 FROM sales_daily GROUP BY ALL) f USING"), "sales_daily products stores", plain="category channel", whole="n", doubles="mean_units overall")
add("g21_economics", lambda t: metrics.economics(t.sales),
    """WITH r AS (SELECT s.*, bool_or(NOT promotion_flag) OVER (PARTITION BY product_id) AS plain FROM sales_daily s JOIN (SELECT product_id, max(date) AS edge FROM sales_daily GROUP BY ALL) USING (product_id) WHERE date > edge - 90)
       SELECT product_id, avg(selling_price) AS price, sum(units) / count(DISTINCT date) AS units_a_day, sum(cost) / sum(units) AS unit_cost FROM r WHERE NOT plain OR NOT promotion_flag GROUP BY product_id""", plain="product_id", doubles="price units_a_day unit_cost")
add("g22_missing", lambda t: metrics.missing(joins.seasonal_reference(t.sales).select("units", "seasonal_units", "revenue")),
    """SELECT column_name, null_rate, null_rate = 1 AS all_null FROM (SELECT unnest(['units', 'seasonal_units', 'revenue']) AS column_name, unnest([0.0, avg((p.units IS NULL)::INT), 0.0]) AS null_rate
       FROM sales_daily s LEFT JOIN sales_daily p ON p.product_id = s.product_id AND p.store_id = s.store_id AND p.date = s.date - 364)""", plain="column_name all_null", doubles="null_rate")
WEEKS = """(SELECT g.product_id, g.week, coalesce(units, 0) AS units FROM (SELECT product_id, unnest(generate_series(min(w), max(w), INTERVAL 7 DAY))::DATE AS week FROM (SELECT product_id, date_trunc('week', date)::DATE + 6 AS w FROM sales_daily) GROUP BY product_id) g
  LEFT JOIN (SELECT product_id, date_trunc('week', date)::DATE + 6 AS week, sum(units) AS units FROM sales_daily GROUP BY ALL) s ON s.product_id = g.product_id AND s.week = g.week)"""
add("g23_weekly_resample", lambda t: metrics.weekly(t.sales), f"SELECT * FROM {WEEKS}", plain="product_id week", whole="units")
add("b22_holt", lambda t: metrics.holt(metrics.weekly(t.sales)),
    f"""WITH RECURSIVE s AS (SELECT product_id, units::DOUBLE AS y, row_number() OVER (PARTITION BY product_id ORDER BY week) AS i FROM {WEEKS}),
        h(product_id, i, level, trend) AS (SELECT product_id, i, y, 0.0::DOUBLE FROM s WHERE i = 1
          UNION ALL SELECT s.product_id, s.i, 0.3 * y + 0.7 * (level + trend), 0.1 * (0.3 * y + 0.7 * (level + trend) - level) + 0.9 * trend FROM h JOIN s ON s.product_id = h.product_id AND s.i = h.i + 1)
        SELECT product_id, level, trend FROM h QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY i DESC) = 1""", plain="product_id", doubles="level trend")
CONF = f"""WITH r AS (SELECT store_id AS bucket, abs(units - predicted) / greatest(predicted, 1) AS r FROM {PRED}), k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY bucket) AS n FROM r),
  a AS (SELECT *, least(ceil((n + 1) * (1 - 0.1::DOUBLE)) / n, 1) * (n - 1) AS pos FROM k)
  SELECT bucket, n, min(r) + (max(r) - min(r)) * (max(pos) - floor(max(pos))) AS width FROM a WHERE n >= 100 AND (k = floor(pos) OR k = ceil(pos)) GROUP BY bucket, n"""
add("b13_b14_conformal", lambda t: metrics.conformal(forecast.seasonal_naive(t.sales), "store_id"), CONF, plain="bucket", whole="n", doubles="width")


def _bounds(t):
    p = forecast.seasonal_naive(t.sales)
    return metrics.intervals(p, metrics.conformal(p, "store_id"), "store_id")


add("b15_b16_coverage", lambda t: metrics.coverage(_bounds(t)),
    f"""SELECT count(*) AS n, avg((units BETWEEN lower AND upper)::INT) AS empirical, avg(upper - lower) AS mean_width, abs(avg((units BETWEEN lower AND upper)::INT) - 0.9) <= 0.05 AS calibrated
        FROM (SELECT units, greatest(predicted - width * greatest(predicted, 1), 0) AS lower, predicted + width * greatest(predicted, 1) AS upper FROM {PRED} p JOIN ({CONF}) c ON c.bucket = p.store_id)""", plain="calibrated", whole="n", doubles="empirical mean_width")
add("w23_naive_scale", lambda t: metrics.naive_scale(t.sales), f"SELECT avg(abs(units - p)) AS scale FROM (SELECT units, lag(units, 7) {W} AS p FROM sales_daily)", doubles="scale")
add("b21_psi", lambda t: metrics.psi(t.sales, "selling_price", F.col("date") < "1999-01-01"),
    """WITH e AS (SELECT quantile_cont(selling_price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM sales_daily WHERE date < '1999-01-01'),
       b AS (SELECT len(list_filter(q, lambda x: x < selling_price)) AS bin, sum((date < '1999-01-01')::INT) AS a, sum((date >= '1999-01-01')::INT) AS b FROM sales_daily, e GROUP BY ALL),
       s AS (SELECT sum((greatest(b / nb, 1e-6) - greatest(a / na, 1e-6)) * ln(greatest(b / nb, 1e-6) / greatest(a / na, 1e-6))) AS psi FROM b, (SELECT sum(a) AS na, sum(b) AS nb FROM b))
       SELECT 'selling_price' AS feature, psi, CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'minor' ELSE 'none' END AS severity FROM s""", plain="feature severity", doubles="psi")
add("k01_worst_products", lambda t: forecast.seasonal_naive(t.sales).groupBy("product_id").agg(*metrics.accuracy()).orderBy(F.col("wmape").desc(), "product_id").limit(15),
    f"SELECT product_id, {METRICS} FROM {PRED} GROUP BY product_id ORDER BY wmape DESC, product_id LIMIT 15", plain="product_id", whole="n", doubles="wmape mae")
add("k03_top_events", lambda t: t("promotions").filter("promotion_spend > 0").withColumn("rate", F.col("promotion_units") / F.col("promotion_spend")).orderBy(F.col("rate").desc(), "promotion_id").limit(500),
    "SELECT promotion_id, promotion_units / promotion_spend AS rate FROM promotions WHERE promotion_spend > 0 ORDER BY rate DESC, promotion_id LIMIT 500", "promotions", plain="promotion_id", doubles="rate")
RULES = {"negative_units": "units < 0", "price_not_positive": "selling_price <= 0", "discount_range": "NOT discount_percentage BETWEEN 0 AND 100", "price_over_regular": "selling_price > regular_price + 0.01",
         "revenue_mismatch": "abs(revenue - units * selling_price) > 0.05", "profit_mismatch": "abs(gross_profit - (revenue - cost)) > 0.05", "null_key": "date IS NULL OR product_id IS NULL OR store_id IS NULL"}


def _rule_sql(name, table, rules):
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, '{n}' AS \"check\", (SELECT count(*) FROM {table} WHERE {c}) AS failing, (SELECT count(*) FROM {table}) AS total, (SELECT count(*) FROM {table} WHERE {c}) = 0 AS passed" for n, c in rules.items())


CHECK = "table_name check passed"
add("q03_sales_checks", lambda t: checks.sales(t.sales).withColumnRenamed("check", "rule"), f'SELECT table_name, "check" AS rule, failing, total, passed FROM ({_rule_sql("sales_daily", "sales_daily", RULES)}) x', plain="table_name rule passed", whole="failing total")
STOCK = {"identity": "opening_inventory + received_units - sold_units <> closing_inventory", "negative_closing": "closing_inventory < 0", "oversold": "sold_units > opening_inventory + received_units"}
add("q04_inventory_checks", lambda t: checks.inventory(t("inventory")).withColumnRenamed("check", "rule"), f'SELECT table_name, "check" AS rule, failing, total, passed FROM ({_rule_sql("inventory", "inventory", STOCK)}) x', "inventory", plain="table_name rule passed", whole="failing total")
PROMO = {"inverted_dates": "start_date > end_date", "discount_range": "NOT (discount_percentage > 0 AND discount_percentage < 100)", "negative_spend": "promotion_spend < 0"}
add("q05_promotion_checks", lambda t: checks.promotions(t("promotions")).withColumnRenamed("check", "rule"), f'SELECT table_name, "check" AS rule, failing, total, passed FROM ({_rule_sql("promotions", "promotions", PROMO)}) x', "promotions", plain="table_name rule passed", whole="failing total")
add("q02_u02_duplicate_keys", lambda t: checks.duplicates(t("lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]).withColumnRenamed("check", "rule"),
    "SELECT 'lineitem' AS table_name, 'duplicate_key' AS rule, coalesce(sum(n), 0) AS failing, coalesce(sum(n), 0) = 0 AS passed FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)", plain="table_name rule passed", whole="failing")
add("q06_static_prices", lambda t: checks.static_prices(t.sales), "SELECT avg(s::INT) AS share, avg(s::INT) < 0.1 AS passed FROM (SELECT min(selling_price) = max(selling_price) AS s FROM sales_daily GROUP BY product_id)", plain="passed", doubles="share")
add("q08_summary", lambda t: checks.summary([checks.sales(t.sales), checks.inventory(t("inventory")), checks.promotions(t("promotions"))]),
    f"SELECT table_name, count(*) AS checks, sum(passed::INT) AS passed, sum(failing) AS failing FROM ({_rule_sql('sales_daily', 'sales_daily', RULES)} UNION ALL {_rule_sql('inventory', 'inventory', STOCK)} UNION ALL {_rule_sql('promotions', 'promotions', PROMO)}) x GROUP BY table_name",
    "sales_daily inventory promotions", plain="table_name", whole="checks passed failing")
add("q09_q10_g26_panel_suite", lambda t: checks.panel(t.sales),
    """SELECT sum(n) AS rows, count(*) AS series, sum(greatest(span + 1 - n, 0)) AS missing_days, sum(f) AS flag_without_discount, sum((p > 0.95 * n)::INT) AS always_treated, sum((n < 180)::INT) AS short_series,
              sum(z) / sum(n) AS zero_share, sum(p) / sum(n) AS promoted_share, sum(o) / sum(n) AS stockout_share
       FROM (SELECT count(*) AS n, date_diff('day', min(date), max(date)) AS span, sum((units = 0)::INT) AS z, sum(promotion_flag::INT) AS p, sum(stockout_flag::INT) AS o, sum((promotion_flag AND discount_percentage <= 0)::INT) AS f FROM sales_daily GROUP BY product_id, store_id)""",
    whole="rows series missing_days flag_without_discount always_treated short_series", doubles="zero_share promoted_share stockout_share")
add("q11_quarantine", lambda t: checks.quarantine(t.sales.withColumn("selling_price", F.when(F.col("units") % 17 == 0, 0.0).otherwise(F.col("selling_price")))).filter(F.size("reasons") > 0).select(*PANEL.split(), F.array_join("reasons", ",").alias("why")),
    """SELECT date, product_id, store_id, concat_ws(',', CASE WHEN p <= 0 THEN 'price' END, CASE WHEN abs(revenue - units * p) > 0.05 THEN 'reconciliation' END) AS why
       FROM (SELECT *, CASE WHEN units % 17 = 0 THEN 0.0 ELSE selling_price END AS p FROM sales_daily) WHERE p <= 0 OR abs(revenue - units * p) > 0.05""", plain=PANEL + " why")
MD5 = "md5(concat_ws('|', {}, '7'))"
add("p01_products_sample", lambda t: sampling.products(t("products"), 10), f"SELECT product_id FROM products ORDER BY CASE WHEN product_status = 'Active' THEN 0 ELSE 1 END, {MD5.format('product_id')}, product_id LIMIT 10", "products", plain="product_id")
add("p02_stratified_stores", lambda t: sampling.stratified(t("stores"), "store_id", "channel", 3),
    f"SELECT store_id, channel FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY {MD5.format('store_id')}, store_id) AS n FROM stores) ORDER BY n, {MD5.format('store_id')}, store_id LIMIT 3", "stores", plain="store_id channel")
add("p03_listings", lambda t: sampling.listings(t.sales, 20),
    f"SELECT * FROM (SELECT product_id, store_id, count(*) AS observations, sum(units) AS total_units FROM sales_daily GROUP BY ALL) ORDER BY {MD5.format('product_id, store_id')}, product_id, store_id LIMIT 20", plain="product_id store_id", whole="observations total_units")
add("w27_p05_series_sample", lambda t: sampling.series(t.sales, 3),
    f"""SELECT product_id, store_id, total_units, decile FROM (SELECT *, ntile(10) OVER (ORDER BY total_units, product_id, store_id) AS decile FROM (SELECT product_id, store_id, sum(units) AS total_units FROM sales_daily GROUP BY ALL))
        QUALIFY row_number() OVER (PARTITION BY decile ORDER BY {MD5.format('product_id, store_id')}, product_id, store_id) <= 3""", plain="product_id store_id", whole="total_units decile")
