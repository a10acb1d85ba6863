"""Registered queries: feature panel and sets, horizon data sets and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import scalar
from shelfspark.operators import features, forecast, horizon, metrics, models, windows
from shelfspark.operators.windows import KEYS
from shelfspark.plans.catalog import PANEL, W, add, frame
from shelfspark.sources import tables as src

ALL_TABLES = "sales_daily products stores promotions inventory competitor_pricing dated_products dated_stores"
NUMBERS, METRICS = "mae rmse wmape bias bias_pct", """count(*) AS n, avg(abs(predicted - units)) AS mae, sqrt(avg((predicted - units) ** 2)) AS rmse,
    sum(abs(predicted - units)) / nullif(sum(units), 0) AS wmape, avg(predicted - units) AS bias, sum(predicted - units) / nullif(sum(units), 0) AS bias_pct"""


def _panel(t):
    return features.panel(t.sales, t("dated_products"), t("dated_stores"), t("promotions"), t("inventory"), t("competitor_pricing"))


#: The same panel in SQL, column for column.
FEATURES = f"""(
SELECT s.*, p.category, st.channel,
       date_diff('day', p.launch_date, s.date) AS product_age_days, date_diff('day', p.launch_date, s.date) < 90 AS is_new_product,
       date_diff('day', st.opening_date, s.date) AS store_age_days,
       lag(units, 1) {W} AS lag_1, lag(units, 7) {W} AS lag_7, lag(units, 28) {W} AS lag_28,
       avg(units) {frame(7)} AS rolling_mean_7, avg(units) {frame(28)} AS rolling_mean_28,
       avg(units) {frame(7)} / nullif(avg(units) {frame(28)}, 0) AS momentum,
       greatest((regular_price - selling_price) / nullif(regular_price, 0), 0) AS discount_depth,
       (selling_price - lag(selling_price, 7) {W}) / nullif(lag(selling_price, 7) {W}, 0) AS price_change_7,
       selling_price / nullif(avg(selling_price) {frame(28)}, 0) AS price_vs_28,
       avg(selling_price) OVER (PARTITION BY product_id, store_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS historical_price,
       e.promotion_id IS NOT NULL AS on_promotion, coalesce(e.discount, 0) AS event_discount,
       coalesce(date_diff('day', e.start_date, s.date), -1) AS days_into, coalesce(date_diff('day', s.date, e.end_date), -1) AS days_left,
       CASE WHEN e.promotion_id IS NOT NULL THEN coalesce(e.promotion_spend / nullif(e.duration_days, 0), 0) ELSE 0 END AS promotion_intensity,
       i.opening_inventory + i.received_units AS available, coalesce(lag(s.stockout_flag, 1) {W}, false) AS stockout_yesterday,
       r.rival_price, selling_price - r.rival_price AS price_gap, selling_price / nullif(r.rival_price, 0) AS price_ratio,
       isodow(s.date) - 1 AS day_of_week, month(s.date) AS month, isodow(s.date) >= 6 AS weekend, ((month(s.date) + 8) % 12) // 3 + 1 AS financial_quarter
FROM sales_daily s JOIN dated_products p USING (product_id) JOIN dated_stores st USING (store_id)
LEFT JOIN (SELECT DISTINCT ON (product_id, store_id, date) * FROM (
             SELECT *, discount_percentage AS discount, unnest(generate_series(start_date, end_date, INTERVAL 1 DAY))::DATE AS date FROM promotions)
           ORDER BY product_id, store_id, date, discount DESC, promotion_id) e USING (product_id, store_id, date)
LEFT JOIN inventory i USING (date, product_id, store_id)
LEFT JOIN (SELECT date, product_id, avg(competitor_effective_price) AS rival_price FROM competitor_pricing GROUP BY ALL) r USING (date, product_id))"""
WHOLE = {"lag_1", "lag_7", "lag_28", "product_age_days", "store_age_days", "days_into", "days_left", "available", "day_of_week", "month", "financial_quarter"}
PLAIN = {"category", "channel", "is_new_product", "on_promotion", "stockout_yesterday", "weekend"}


def _kinds(columns) -> dict[str, str]:
    kind = {"plain": PLAIN, "whole": WHOLE}
    out = {k: " ".join(c for c in columns if c in names) for k, names in kind.items()}
    out["doubles"] = " ".join(c for c in columns if c not in PLAIN | WHOLE)
    out["plain"] = f"{PANEL} {out['plain']}".strip()
    return out


EVERY = [c for g in features.GROUPS.values() for c in g]
add("b25_feature_panel", _panel, f"SELECT * FROM {FEATURES}", ALL_TABLES, **_kinds(EVERY))
for name, columns in features.GROUPS.items():
    add(f"b26_{name}_set", lambda t, g=name: features.group_set(_panel(t), g), f"SELECT * FROM {FEATURES}", ALL_TABLES, **_kinds(columns))
TRAIN = [c for g in ("demand", "calendar") for c in features.GROUPS[g] if c != "momentum"]
kinds = _kinds(TRAIN)
add("b24_training_features", lambda t: features.training(_panel(t), ["demand", "calendar"], exclude=("momentum",)),
    f"SELECT *, units AS y FROM {FEATURES} WHERE units IS NOT NULL", ALL_TABLES, kinds["plain"], kinds["whole"] + " y", kinds["doubles"])
add("f12_column_families", lambda t: features.without(_panel(t), "target", "supply", "promotion").groupBy("category").agg(
        F.count(F.lit(1)).alias("rows"), *(F.avg(c).alias(c) for c in ("rolling_mean_28", "price_vs_28", "rival_price"))),
    f"SELECT category, count(*) AS rows, avg(rolling_mean_28) AS rolling_mean_28, avg(price_vs_28) AS price_vs_28, avg(rival_price) AS rival_price FROM {FEATURES} GROUP BY category",
    ALL_TABLES, plain="category", whole="rows", doubles="rolling_mean_28 price_vs_28 rival_price")


def _complete(t):
    rows = windows.demand_rolling(t.sales).withColumnsRenamed({"rolling_mean_28": "demand_mean_28", "rolling_std_28": "demand_std_28"})
    return features.complete(rows, F.col("promotion_flag")).groupBy("promotion_flag").agg(F.count(F.lit(1)).alias("rows"), F.avg("demand_mean_28").alias("mean"))


add("f17_complete_covariates", _complete,
    f"""SELECT promotion_flag, count(*) AS rows, avg(m) AS mean FROM (SELECT *, avg(units) {frame(28)} AS m, stddev_samp(units) {frame(28)} AS s FROM sales_daily)
        WHERE m IS NOT NULL AND s IS NOT NULL GROUP BY ALL""", plain="promotion_flag", whole="rows", doubles="mean")


def _guarded(t):
    names = [c for c in ("lag_1", "rolling_mean_28", "selling_price", "month", "units") if c not in features.AFTER_TREATMENT]
    rows = scalar.date_parts(windows.demand_rolling(windows.demand_lags(t.sales))).filter("promotion_flag")
    return rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in features.guarded(names)])).alias("x")).groupBy("x.name").agg(F.avg("x.v").alias("mean"))


add("f18_adjustment_set", _guarded,
    f"""WITH p AS (SELECT *, lag(units, 1) {W} AS lag_1, avg(units) {frame(28)} AS m, month(date) AS month FROM sales_daily)
        SELECT 'lag_1' AS name, avg(lag_1) AS mean FROM p WHERE promotion_flag UNION ALL SELECT 'rolling_mean_28', avg(m) FROM p WHERE promotion_flag
        UNION ALL SELECT 'month', avg(month) FROM p WHERE promotion_flag""", plain="name", doubles="mean")
add("b28_frozen_levels", lambda t: features.coded(t.sales.filter("date < '1996-01-01'"), features.levels(t.sales, ["store_id", "product_id"]), "store_id").groupBy("store_id", "store_id_code").agg(F.count(F.lit(1)).alias("rows")),
    """WITH c AS (SELECT store_id, row_number() OVER (ORDER BY store_id) - 1 AS store_id_code FROM (SELECT DISTINCT store_id FROM sales_daily))
       SELECT store_id, store_id_code, count(*) AS rows FROM sales_daily JOIN c USING (store_id) WHERE date < '1996-01-01' GROUP BY ALL""", plain="store_id", whole="store_id_code rows")


def _cached(t):
    root = src.shared_dir(t.spark)
    spec = {"table": "sales_daily", "path": t.sf_dir, "session": t.spark.sparkContext.applicationId, "groups": ["demand"], "version": 1}
    for _ in range(2):  # built once, then read
        out = features.cached(t.spark, root, spec, lambda: windows.demand_rolling(windows.demand_lags(t.sales)))
    return out


add("s09_cached_panel", _cached, f"SELECT date, product_id, store_id, lag(units, 7) {W} AS lag_7, avg(units) {frame(28)} AS rolling_mean_28 FROM sales_daily",
    plain=PANEL, whole="lag_7", doubles="rolling_mean_28")
add("j01_j02_ages", lambda t: features.ages(t.sales, t("dated_products"), t("dated_stores")),
    "SELECT s.*, date_diff('day', launch_date, date) AS product_age_days, date_diff('day', launch_date, date) < 90 AS is_new_product, date_diff('day', opening_date, date) AS store_age_days FROM sales_daily s JOIN dated_products USING (product_id) JOIN dated_stores USING (store_id)",
    "sales_daily products stores dated_products dated_stores", plain=PANEL + " is_new_product", whole="product_age_days store_age_days")
add("f14_origin_slice", lambda t: t.sales.filter(F.col("date").between("1996-01-01", "1996-12-31")).groupBy("store_id").agg(F.min("date").alias("date"), F.count(F.lit(1)).alias("rows")),
    "SELECT store_id, min(date) AS date, count(*) AS rows FROM sales_daily WHERE date BETWEEN '1996-01-01' AND '1996-12-31' GROUP BY store_id", plain="store_id date", whole="rows")

DIGIT = "(strpos('0123456789abcdef', substr(h, {}, 1)) - 1)"
STEPS = f"""(SELECT *, 1 + {horizon.BAND} * band + (16 * {DIGIT.format(1)} + {DIGIT.format(2)}) % (CASE WHEN band = {horizon.BANDS - 1} THEN {horizon.LAST - horizon.BAND * (horizon.BANDS - 1)} ELSE {horizon.BAND} END) AS step
  FROM (SELECT *, md5(concat_ws('|', product_id, store_id, CAST(origin_date AS VARCHAR), CAST(band AS VARCHAR))) AS h
        FROM (SELECT product_id, store_id, date AS origin_date, units AS origin_units, lag_1, m7, m28, unnest(range({horizon.BANDS})) AS band
              FROM (SELECT *, lag(units, 1) {W} AS lag_1, lag(units, 364) {W} AS lag_364, avg(units) {frame(7)} AS m7, avg(units) {frame(28)} AS m28, min(date) OVER () AS first FROM sales_daily)
              WHERE lag_364 IS NOT NULL AND date_diff('day', first, date) % 7 = 0)))"""
BUCKET = "CASE WHEN step <= 3 THEN '1-3' WHEN step <= 7 THEN '4-7' WHEN step <= 14 THEN '8-14' WHEN step <= 28 THEN '15-28' WHEN step <= 56 THEN '29-56' ELSE '57-90' END"
GRID = f"""(SELECT g.product_id, g.store_id, g.origin_date, g.step, {BUCKET} AS bucket, t.date AS target_date, t.units AS target_units, g.lag_1, g.m7, g.m28, p.units AS season,
                   coalesce(g.lag_1, g.m7, g.m28) AS plain, coalesce(g.m28, g.m7, g.lag_1) AS recent
            FROM {STEPS} g JOIN sales_daily t ON t.product_id = g.product_id AND t.store_id = g.store_id AND t.date = g.origin_date + CAST(g.step AS INTEGER) AND NOT t.stockout_flag
            LEFT JOIN sales_daily p ON p.product_id = g.product_id AND p.store_id = g.store_id AND p.date = t.date - 364)"""
PLAIN_FORECAST = f"(SELECT *, target_units AS units, plain AS predicted FROM {GRID})"
SEASONAL_FORECAST = f"(SELECT *, target_units AS units, coalesce(0.5 * season + 0.5 * recent, recent, season) AS predicted FROM {GRID})"
add("b03_horizon_dataset", lambda t: horizon.dataset(t.sales), f"SELECT * FROM {GRID}", plain="product_id store_id origin_date target_date bucket", whole="step target_units")
add("b04_target_side", lambda t: horizon.target_side(horizon.dataset(t.sales), scalar.calendar_of(scalar.days_of(t.sales)), t("promotions")),
    f"""SELECT g.product_id, g.store_id, origin_date, step, isodow(target_date) - 1 AS h_day_of_week, isodow(target_date) >= 6 AS h_weekend_flag,
              target_date BETWEEN make_date(year(target_date)::BIGINT, 10, 9) AND make_date(year(target_date)::BIGINT, 10, 15) OR target_date BETWEEN make_date(year(target_date)::BIGINT, 12, 19) AND make_date(year(target_date)::BIGINT, 12, 25) AS h_festival_flag,
              e.d IS NOT NULL AS h_on_promotion, coalesce(e.d, 0) AS h_discount
        FROM {GRID} g LEFT JOIN (SELECT product_id, store_id, day, max(discount_percentage) AS d FROM (SELECT *, unnest(generate_series(start_date, end_date, INTERVAL 1 DAY))::DATE AS day FROM promotions) GROUP BY ALL) e
          ON e.product_id = g.product_id AND e.store_id = g.store_id AND e.day = g.target_date""",
    "sales_daily promotions", plain="product_id store_id origin_date h_weekend_flag h_festival_flag h_on_promotion", whole="step h_day_of_week", doubles="h_discount")
add("b05_future_scaffold", lambda t: horizon.scaffold(t.sales, "1997-12-31", 30, "2100-01-01"),
    """SELECT product_id, store_id, origin_date, origin_units, step, origin_date + CAST(step AS INTEGER) AS target_date FROM (
         SELECT product_id, store_id, max(date) AS origin_date, arg_max(units, date) AS origin_units, unnest(range(1, 31)) AS step FROM sales_daily WHERE date <= '1997-12-31' GROUP BY product_id, store_id)""",
    plain="product_id store_id origin_date target_date", whole="origin_units step")
add("g10_horizon_buckets", lambda t: horizon.by_bucket(horizon.naive(horizon.dataset(t.sales))), f"SELECT bucket, {METRICS} FROM {PLAIN_FORECAST} GROUP BY bucket", plain="bucket", whole="n", doubles=NUMBERS)
add("b08_horizon_seasonal", lambda t: horizon.by_bucket(horizon.seasonal(horizon.dataset(t.sales), t.sales)),
    f"SELECT bucket, {METRICS} FROM {SEASONAL_FORECAST} WHERE predicted IS NOT NULL GROUP BY bucket", plain="bucket", whole="n", doubles=NUMBERS)
ORDER = "CASE bucket WHEN '1-3' THEN 1 WHEN '4-7' THEN 2 WHEN '8-14' THEN 3 WHEN '15-28' THEN 4 WHEN '29-56' THEN 5 ELSE 6 END"


def _added(t):
    rows = horizon.dataset(t.sales)
    return horizon.value_added(horizon.seasonal(rows, t.sales), horizon.naive(rows), metrics.naive_scale(t.sales))


add("b18_value_added_by_bucket", _added,
    f"""WITH g AS (SELECT *, coalesce(0.5 * season + 0.5 * recent, recent, season) AS predicted FROM {GRID}),
        s AS (SELECT avg(abs(units - past)) AS scale FROM (SELECT units, lag(units, 7) {W} AS past FROM sales_daily)),
        m AS (SELECT bucket, count(*) AS n, sum(abs(predicted - target_units)) / sum(target_units) AS wmape, sum(abs(plain - target_units)) / sum(target_units) AS benchmark, avg(abs(predicted - target_units)) AS mae FROM g GROUP BY bucket)
        SELECT bucket, n, wmape, benchmark, benchmark - wmape AS added, mae / scale AS mase, coalesce(wmape > lag(wmape) OVER (ORDER BY {ORDER}), false) AS grows FROM m, s""",
    plain="bucket grows", whole="n", doubles="wmape benchmark added mase")


def _ranked(by: str) -> str:
    r = "abs(units - predicted) / greatest(predicted, 1)"
    return f"""SELECT b, n, min(r) + (max(r) - min(r)) * (max(pos) - floor(max(pos))) AS width FROM (
        SELECT *, least(ceil((n + 1) * (1 - 0.1)) / n, 1.0) * (n - 1) AS pos FROM (
          SELECT {by} AS b, {r} AS r, row_number() OVER (PARTITION BY {by} ORDER BY {r}) - 1 AS k, count(*) OVER (PARTITION BY {by}) AS n FROM {PLAIN_FORECAST} WHERE predicted IS NOT NULL))
        WHERE k = floor(pos) OR k = ceil(pos) GROUP BY b, n"""


add("b14_pooled_widths", lambda t: horizon.widths(horizon.naive(horizon.dataset(t.sales)), least=200),
    f"""SELECT o.b AS bucket, o.n, CASE WHEN o.n >= 200 THEN o.width ELSE a.width END AS width, o.n < 200 AS pooled FROM ({_ranked('bucket')}) o, ({_ranked("'all'")}) a""",
    plain="bucket pooled", whole="n", doubles="width")
add("b14_totals", lambda t: horizon.totals(horizon.naive(horizon.dataset(t.sales))),
    f"SELECT product_id, store_id, origin_date, sum(units) AS units, sum(predicted) AS predicted, count(*) AS steps FROM {PLAIN_FORECAST} GROUP BY ALL",
    plain="product_id store_id origin_date", whole="units steps", doubles="predicted")
add("g12_worst_segments", lambda t: metrics.by_segments(forecast.seasonal_naive(t.sales), ["store_id", "product_id"]).orderBy(F.col("wmape").desc()),
    f"""WITH p AS (SELECT *, greatest(coalesce(0.4 * season + 0.6 * recent, recent, season, (SELECT avg(units) FROM sales_daily)), 0) AS predicted FROM (
          SELECT *, lag(units, 364) {W} AS season, coalesce(avg(units) {frame(28)}, avg(units) {frame(14)}, avg(units) {frame(7)}) AS recent FROM sales_daily))
        SELECT 'store_id' AS segment, store_id AS value, {METRICS} FROM p GROUP BY store_id HAVING count(*) >= 30
        UNION ALL SELECT 'product_id', product_id, {METRICS} FROM p GROUP BY product_id HAVING count(*) >= 30""", plain="segment value", whole="n", doubles=NUMBERS)
USED = ("lag_1", "rolling_mean_7", "rolling_mean_28")


def _importance(t):
    """Importance of a feature for a horizon: its correlation with the target, in size."""
    rows = horizon.dataset(t.sales)
    pairs = rows.select("bucket", "target_units", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in USED])).alias("f"))
    found = pairs.filter("f.v is not null").groupBy("bucket", "f.feature").agg(F.abs(F.corr("target_units", "f.v")).alias("importance"))
    return features.family_importance(found, F.when(F.col("feature").startswith("lag"), "last day").otherwise("recent level"))


add("g25_importance_by_family", _importance,
    f"""WITH c AS (SELECT bucket, 'last day' AS family, abs(corr(target_units, lag_1)) AS i FROM {GRID} GROUP BY bucket
          UNION ALL SELECT bucket, 'recent level', abs(corr(target_units, m7)) FROM {GRID} GROUP BY bucket UNION ALL SELECT bucket, 'recent level', abs(corr(target_units, m28)) FROM {GRID} GROUP BY bucket)
        SELECT family, bucket, sum(i) AS importance, sum(i) / sum(sum(i)) OVER (PARTITION BY bucket) AS share FROM c GROUP BY family, bucket""", plain="family bucket", doubles="importance share")


def _noise(t):
    mean = F.avg("units").over(windows.Window.partitionBy(*KEYS, F.month("date")))
    return t.sales.withColumn("predicted", mean).filter("predicted > 0").agg(*metrics.accuracy())


add("g27_noise_floor", _noise,
    f"SELECT {METRICS} FROM (SELECT *, avg(units) OVER (PARTITION BY product_id, store_id, month(date)) AS predicted FROM sales_daily) WHERE predicted > 0", whole="n", doubles=NUMBERS)
