"""Registered queries: smoothing at four levels with a hold-out, calibration of thinned origins and of
totals, adjacent windows, trade cells with returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import horizon, joins, metrics, sampling, smoothing, uplift
from shelfspark.operators.windows import KEYS
from shelfspark.plans.catalog import add
from shelfspark.plans.feature_queries import METRICS, NUMBERS, PLAIN_FORECAST
from shelfspark.plans.model_queries import QUALIFIED, SCORED, _impact_rows, _qualified
from shelfspark.sources import tables as src

# ---- smoothing at four levels ----


def _held(t):
    return smoothing.held_out(smoothing.level_weeks(joins.attributes(joins.attributes(t.sales, t("products"), "product_id"), t("stores"), "store_id")))


HELD = """
WITH RECURSIVE d AS (SELECT date_trunc('week', date)::DATE + 6 AS week, category, region, units FROM sales_daily JOIN products USING (product_id) JOIN stores USING (store_id)),
l AS (SELECT 'total' AS level, 'all' AS key, week, sum(units) AS units FROM d GROUP BY week UNION ALL SELECT 'region', region, week, sum(units) FROM d GROUP BY ALL
      UNION ALL SELECT 'category', category, week, sum(units) FROM d GROUP BY ALL UNION ALL SELECT 'category_region', concat_ws('|', category, region), week, sum(units) FROM d GROUP BY category, region, week),
g AS (SELECT level, key, unnest(generate_series(min(week), max(week), INTERVAL 7 DAY))::DATE AS week FROM l GROUP BY level, key),
w AS MATERIALIZED (SELECT g.level, g.key, week, coalesce(units, 0)::DOUBLE AS y, row_number() OVER (PARTITION BY g.level, g.key ORDER BY week) AS i, count(*) OVER (PARTITION BY g.level, g.key) AS n
                   FROM g LEFT JOIN l USING (level, key, week)),
f AS MATERIALIZED (SELECT level, key, any_value(n) AS n, any_value(n) - 12 >= 104 AS seasonal, list(y ORDER BY i) FILTER (i <= 52) AS ys FROM w WHERE n >= 38 GROUP BY ALL),
h(level, key, n, seasonal, i, lev, trend, queue) AS (
  SELECT level, key, n, seasonal, CASE WHEN seasonal THEN 52 ELSE 1 END::BIGINT, CASE WHEN seasonal THEN list_avg(ys) ELSE ys[1] END, 0.0::DOUBLE,
         CASE WHEN seasonal THEN list_transform(ys, lambda y: y - list_avg(ys)) ELSE [0.0::DOUBLE] END FROM f
  UNION ALL
  SELECT level, key, n, seasonal, i, new, 0.1 * (new - lev) + 0.9 * trend, list_append(queue[2:], CASE WHEN seasonal THEN 0.2 * (y - new) + 0.8 * queue[1] ELSE 0.0 END)
  FROM (SELECT h.*, w.i AS j, w.y, 0.3 * (w.y - queue[1]) + 0.7 * (lev + trend) AS new FROM h JOIN w ON w.level = h.level AND w.key = h.key AND w.i = h.i + 1 WHERE w.i <= h.n - 12) s(level, key, n, seasonal, was, lev, trend, queue, i, y, new)),
held AS (SELECT w.level, w.key, w.n AS weeks, seasonal, week, y AS units, greatest(lev + (w.i - h.i) * trend + CASE WHEN seasonal THEN queue[w.i - h.i] ELSE 0 END, 0) AS predicted
         FROM h JOIN w ON w.level = h.level AND w.key = h.key AND w.i > h.i WHERE h.i = h.n - 12)"""
TABLES = "sales_daily products stores"
add("b22_held_out_weeks", _held, f"{HELD} SELECT * FROM held", TABLES, plain="level key seasonal week", whole="weeks units", doubles="predicted")
add("b22_levels", lambda t: smoothing.report(_held(t)), f"{HELD} SELECT level, key, weeks, seasonal, {METRICS} FROM held GROUP BY level, key, weeks, seasonal", TABLES, plain="level key seasonal", whole="weeks n", doubles=NUMBERS)
add("b22_level_summary", lambda t: smoothing.by_level(_held(t)),
    f"""{HELD} SELECT level, count(*) AS fits, sum(seasonal::INT) AS with_season, avg(e) AS mean_wmape, max(e) AS worst_wmape
    FROM (SELECT level, key, seasonal, sum(abs(predicted - units)) / nullif(sum(units), 0) AS e FROM held GROUP BY ALL) GROUP BY level""", TABLES, plain="level", whole="fits with_season", doubles="mean_wmape worst_wmape")

# ---- calibration on thinned origins, applied to later ones ----

CUT, SPACING, FEW = "2000-10-01", 14, 100


def _calibrated(t):
    """The calibration of the origins before CUT and the forecasts of later ones, each written once."""
    rows = src.written(horizon.naive(horizon.dataset(t.sales)).select(*KEYS, "origin_date", "step", "bucket", "target_units", "predicted"))
    return src.written(horizon.calibration(rows.filter(F.col("origin_date") < CUT), SPACING, least=FEW)), rows.filter(F.col("origin_date") >= CUT)


def _bounded_totals(t):
    found, later = _calibrated(t)
    return horizon.bounded_totals(later, found)


def _coverage(t):
    found, later = _calibrated(t)
    rows = horizon.bounded(later.withColumn("units", F.col("target_units")), found).select("units", "lower", "upper")
    sums = horizon.bounded_totals(later, found).select("units", "lower", "upper")
    return metrics.coverage(rows).withColumn("of", F.lit("days")).unionByName(metrics.coverage(sums).withColumn("of", F.lit("totals")))


CALIBRATION = f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT product_id, store_id, origin_date, bucket, units, predicted FROM {PLAIN_FORECAST}),
o AS (SELECT DISTINCT origin_date AS date FROM p WHERE origin_date < '{CUT}' AND predicted IS NOT NULL AND units IS NOT NULL),
g(date) AS (SELECT min(date) FROM o UNION ALL SELECT (SELECT min(o.date) FROM o WHERE o.date >= g.date + {SPACING}) FROM g WHERE g.date IS NOT NULL),
k AS MATERIALIZED (SELECT * FROM p WHERE predicted IS NOT NULL AND units IS NOT NULL AND origin_date IN (SELECT date FROM g)),
e AS (SELECT bucket AS b, units, predicted FROM k UNION ALL SELECT 'all', units, predicted FROM k UNION ALL SELECT 'total', sum(units), sum(predicted) FROM k GROUP BY product_id, store_id, origin_date),
r AS (SELECT b, abs(units - predicted) / greatest(predicted, 1) AS r FROM e),
q AS (SELECT b, n, min(r) + (max(r) - min(r)) * (max(pos) - floor(max(pos))) AS width
      FROM (SELECT *, least(ceil((n + 1) * (1 - 0.1)) / n, 1.0) * (n - 1) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY b) AS n FROM r))
      WHERE i = floor(pos) OR i = ceil(pos) GROUP BY b, n),
c AS MATERIALIZED (SELECT q.b AS bucket, q.n, CASE WHEN q.n >= {FEW} THEN q.width WHEN q.b <> 'total' THEN a.width END AS width, q.n < {FEW} AND q.b <> 'total' AS pooled FROM q, q a WHERE a.b = 'all' AND q.b <> 'all'),
s AS (SELECT product_id, store_id, origin_date, sum(units) AS units, sum(predicted) AS predicted, count(*) AS steps FROM p WHERE origin_date >= '{CUT}' GROUP BY ALL)"""
COVERED = "count(units) AS n, avg((units BETWEEN lower AND upper)::INT) AS empirical, avg(upper - lower) AS mean_width, abs(avg((units BETWEEN lower AND upper)::INT) - 0.9) <= 0.05 AS calibrated"
add("b14_calibration", lambda t: _calibrated(t)[0], f"{CALIBRATION} SELECT * FROM c", plain="bucket pooled", whole="n", doubles="width")
add("b14_bounded_totals", _bounded_totals,
    f"""{CALIBRATION} SELECT product_id, store_id, origin_date, steps, units, predicted, CASE WHEN width IS NOT NULL THEN greatest(predicted - width * greatest(predicted, 1), 0) END AS lower, predicted + width * greatest(predicted, 1) AS upper
    FROM s LEFT JOIN c ON bucket = 'total'""", plain="product_id store_id origin_date", whole="steps units", doubles="predicted lower upper")


add("b14_later_coverage", _coverage,
    f"""{CALIBRATION}, x AS (SELECT 'days' AS of, units, predicted, width FROM p LEFT JOIN c USING (bucket) WHERE origin_date >= '{CUT}' UNION ALL SELECT 'totals', units, predicted, width FROM s LEFT JOIN c ON bucket = 'total'),
    y AS (SELECT *, CASE WHEN width IS NOT NULL THEN greatest(predicted - width * greatest(predicted, 1), 0) END AS lower, predicted + width * greatest(predicted, 1) AS upper FROM x) SELECT of, {COVERED} FROM (VALUES ('days'), ('totals')) v(of) LEFT JOIN y USING (of) GROUP BY of""",
    plain="of calibrated", whole="n", doubles="empirical mean_width")

# ---- adjacent windows, trade cells ----

add("p04_adjacent_windows", lambda t: sampling.adjacent(t.sales, 365, 28, "1998-03-31").select(*[F.col(c).cast("string").alias(c) for c in ("train_start", "train_end", "test_start", "test_end")], "enough"),
    """SELECT (e - 392)::VARCHAR AS train_start, (e - 28)::VARCHAR AS train_end, (e - 27)::VARCHAR AS test_start, e::VARCHAR AS test_end, e - 392 >= first AS enough
       FROM (SELECT least(max(date), DATE '1998-03-31') AS e, min(date) AS first FROM sales_daily)""", plain="train_start train_end test_start test_end enough")
add("g06_trade_returns", lambda t: uplift.trade_cells(uplift.impact(_impact_rows(t)).join(_qualified(t).select("promotion_id", "product_id", "store_id", "promotion_units"), "promotion_id"), t("products"), t("stores")),
    f"""WITH i AS (SELECT p.promotion_id, p.product_id, p.store_id, p.promotion_spend, sum(units - mu0) AS more, sum(units - mu0) / nullif(any_value(promotion_units) - sum(units - mu0), 0) AS uplift,
                      (sum(units - mu0) * (sum(revenue) / sum(units) - sum(cost) / sum(units)) - p.promotion_spend) / nullif(p.promotion_spend, 0) AS roi
               FROM {QUALIFIED} p JOIN {SCORED} s ON s.product_id = p.product_id AND s.store_id = p.store_id AND s.date BETWEEN p.start_date AND p.end_date
               GROUP BY p.promotion_id, p.product_id, p.store_id, p.promotion_spend)
        SELECT i.product_id, region, category, avg(roi) AS mean_roi, stddev_samp(roi) AS sd_roi, avg(uplift) AS mean_uplift, avg(promotion_spend) AS mean_spend, sum(promotion_spend) AS total_spend, count(*) AS events,
               any_value((base_price - unit_cost) / nullif(base_price, 0)) AS margin, 0 AS least_spend, 3 * avg(promotion_spend) AS most_spend
        FROM i JOIN stores USING (store_id) LEFT JOIN products r ON r.product_id = i.product_id GROUP BY i.product_id, region, category""",
    "sales_daily promotions products stores", plain="product_id region category", whole="events", doubles="mean_roi sd_roi mean_uplift mean_spend total_spend margin least_spend most_spend")
