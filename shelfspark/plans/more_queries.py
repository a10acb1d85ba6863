"""Registered queries: further evaluation, dataset, sampling and causal operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.functions import scalar
from shelfspark.operators import elasticity, forecast, joins, metrics, models, uplift, windows
from shelfspark.operators.windows import KEYS, by_date, safe, series
from shelfspark.plans.catalog import PANEL, W, add, frame
from shelfspark.plans.model_queries import CLEAN, QUALIFIED, ROLES, SCORED, _qualified, _scored
from shelfspark.plans.panel_queries import METRICS, NUMBERS, PRED
from shelfspark.sources import tables as src

add("c10_folds", lambda t: models.folds(t.sales).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("units").alias("units")),
    "SELECT ('0x' || substr(md5(concat_ws('|', product_id, store_id, '7')), 1, 8))::BIGINT % 5 AS fold, count(*) AS rows, sum(units) AS units FROM sales_daily GROUP BY ALL", whole="fold rows units")
add("w28_time_blocks", lambda t: models.time_blocks(t.sales).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("start_date"), F.max("date").alias("end_date")),
    """SELECT least((r * 5) // m, 4) AS fold, count(*) AS rows, min(date) AS start_date, max(date) AS end_date FROM sales_daily
       JOIN (SELECT date, r, max(r) OVER () AS m FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS r FROM (SELECT DISTINCT date FROM sales_daily))) USING (date) GROUP BY ALL""", plain="start_date end_date", whole="fold rows")
add("w29_auc", lambda t: models.auc(_scored(t), F.col("treated"), "e"),
    f"""SELECT sum(p * (coalesce(below, 0) + n / 2)) / (sum(p) * sum(n)) AS auc FROM (SELECT *, sum(n) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
        FROM (SELECT e, sum(treated::INT) AS p, sum((NOT treated)::INT) AS n FROM {SCORED} GROUP BY e))""", doubles="auc")


def _coherence(t):
    """Forecasts of all listings against one of the daily total as a single series."""
    total = t.sales.groupBy("date").agg(F.sum("units").alias("units")).withColumns({k: F.lit("all") for k in KEYS})
    return metrics.coherence(forecast.seasonal_naive(t.sales), forecast.seasonal_naive(total))


TOTAL = """(SELECT date, greatest(coalesce(0.4 * season + 0.6 * recent, recent, season, mean), 0) AS predicted FROM (
  SELECT date, lag(units, 364) OVER w AS season, coalesce(avg(units) OVER (ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), avg(units) OVER (ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)) AS recent, avg(units) OVER () AS mean
  FROM (SELECT date, sum(units) AS units FROM sales_daily GROUP BY date) WINDOW w AS (ORDER BY date)))"""
add("g13_coherence", _coherence,
    f"SELECT count(*) AS days, max(abs(u.p - o.predicted)) AS gap, max(abs(u.p - o.predicted) / nullif(abs(o.predicted), 0)) AS gap_pct FROM (SELECT date, sum(predicted) AS p FROM {PRED} GROUP BY date) u JOIN {TOTAL} o USING (date)",
    whole="days", doubles="gap gap_pct")
add("g14_revenue_impact", lambda t: forecast.seasonal_naive(t.sales).groupBy("store_id").agg(
        F.sum(F.col("units") * F.col("regular_price")).alias("actual"), F.sum(F.col("predicted") * F.col("regular_price")).alias("forecast"),
        safe(F.sum((F.col("predicted") - F.col("units")) * F.col("regular_price")), F.sum(F.col("units") * F.col("regular_price"))).alias("error_pct"), F.count("regular_price").alias("priced")),
    f"""SELECT store_id, sum(units * regular_price) AS actual, sum(predicted * regular_price) AS forecast, sum((predicted - units) * regular_price) / sum(units * regular_price) AS error_pct, count(regular_price) AS priced
        FROM {PRED} GROUP BY store_id""", plain="store_id", whole="priced", doubles="actual forecast error_pct")
add("g20_unit_economics", lambda t: t.sales.filter("promotion_flag").groupBy("product_id").agg((F.sum("revenue") / F.sum("units")).alias("price"), (F.sum("revenue") / F.sum("units") - F.sum("cost") / F.sum("units")).alias("margin")).withColumn("rate", safe(F.col("margin"), F.col("price"))),
    "SELECT product_id, sum(revenue) / sum(units) AS price, (sum(revenue) - sum(cost)) / sum(units) AS margin, (sum(revenue) - sum(cost)) / sum(revenue) AS rate FROM sales_daily WHERE promotion_flag GROUP BY product_id", plain="product_id", doubles="price margin rate")
add("g24_stability", lambda t: forecast.folds(forecast.seasonal_naive(t.sales)).groupBy("store_id", "fold").agg(*metrics.accuracy()).groupBy("store_id").agg(F.avg("wmape").alias("mean"), F.stddev_samp("wmape").alias("std"), F.count(F.lit(1)).alias("folds")).withColumn("stable", F.col("std") / F.col("mean") < 0.25),
    f"""SELECT store_id, avg(w) AS mean, stddev_samp(w) AS std, count(*) AS folds, stddev_samp(w) / avg(w) < 0.25 AS stable FROM (SELECT store_id, 4 - a // 90 AS fold, sum(abs(predicted - units)) / sum(units) AS w
        FROM (SELECT *, date_diff('day', date, (SELECT max(date) FROM sales_daily)) AS a FROM {PRED}) WHERE a < 360 GROUP BY ALL) GROUP BY store_id""", plain="store_id stable", whole="folds", doubles="mean std")
add("g28_spans", lambda t: t("promotions").groupBy("product_id").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date")), "SELECT product_id, min(start_date) AS start_date, max(end_date) AS end_date FROM promotions GROUP BY product_id", "promotions", plain="product_id start_date end_date")
add("g29_treatment_warnings", lambda t: joins.promotion_features(t.sales, t("promotions")).agg(
        F.sum((F.col("promotion_flag") & F.col("promotion_id").isNull()).cast("int")).alias("orphan_flags"), F.sum((F.col("promotion_flag") & (F.col("discount_percentage") <= 0)).cast("int")).alias("zero_depth"), F.count_distinct("promotion_id").alias("events")),
    """SELECT count(*) FILTER (s.promotion_flag AND p.promotion_id IS NULL) AS orphan_flags, count(*) FILTER (s.promotion_flag AND s.discount_percentage <= 0) AS zero_depth, count(DISTINCT p.promotion_id) AS events
       FROM sales_daily s LEFT JOIN promotions p ON p.product_id = s.product_id AND p.store_id = s.store_id AND s.date BETWEEN p.start_date AND p.end_date""", "sales_daily promotions", whole="orphan_flags zero_depth events")
add("k02_top_pairs", lambda t: t("relationships").filter("relationship_type <> 'unrelated'").orderBy(F.abs("cross_elasticity").desc(), "product_a", "product_b").limit(200),
    "SELECT product_a, product_b, cross_elasticity FROM relationships WHERE relationship_type <> 'unrelated' ORDER BY abs(cross_elasticity) DESC, product_a, product_b LIMIT 200", "relationships", plain="product_a product_b", doubles="cross_elasticity")


def _panel_sample(t):
    top = t.sales.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "product_id").limit(5)
    return t.sales.join(F.broadcast(top.select("product_id")), "product_id", "left_semi").groupBy("store_id").agg(F.count_distinct("product_id").alias("products"), F.count(F.lit(1)).alias("rows")).orderBy(F.col("products").desc(), "store_id").limit(3)


add("k05_panel_sample", _panel_sample, """SELECT store_id, count(DISTINCT product_id) AS products, count(*) AS rows FROM sales_daily WHERE product_id IN (SELECT product_id FROM sales_daily GROUP BY product_id ORDER BY count(*) DESC, product_id LIMIT 5)
    GROUP BY store_id ORDER BY products DESC, store_id LIMIT 3""", plain="store_id", whole="products rows")
add("k06_drift_table", lambda t: metrics.psi(t.sales, "selling_price", F.col("date") < "1999-01-01").unionByName(metrics.psi(t.sales, "units", F.col("date") < "1999-01-01")).orderBy(F.col("psi").desc()),
    None, plain="feature severity", doubles="psi")
add("u03_keep_first", lambda t: t("lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).filter("n = 1"),
    "SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1", "products", whole="l_orderkey l_partkey")
add("u05_top_up", lambda t: t.sales.select(*KEYS).distinct().join(t("promotions").select(*KEYS).distinct(), list(KEYS), "left_anti"),
    "SELECT DISTINCT product_id, store_id FROM sales_daily EXCEPT SELECT product_id, store_id FROM promotions", "sales_daily promotions", plain="product_id store_id")


def _randomised(t):
    """Rows from a product's first test day on (test days: the first of a month)."""
    tests = F.sum((F.dayofmonth("date") == 1).cast("int")).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    rows = elasticity.clean_panel(t.sales).withColumn("tests", tests)
    return elasticity.naive(rows.filter("tests >= 1")).filter("n >= 60")


add("w17_e06_randomised", _randomised,
    f"SELECT product_id, regr_slope(y, x) AS slope, count(*) AS n FROM (SELECT *, sum((day(date) = 1)::INT) OVER (PARTITION BY product_id, store_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS k FROM {CLEAN}) WHERE k >= 1 GROUP BY product_id HAVING count(*) >= 60", plain="product_id", whole="n", doubles="slope")
add("e09_instrument", lambda t: elasticity.clean_panel(t.sales).withColumn("log_cost", F.ln(F.col("cost") / F.col("units"))).groupBy("product_id").agg(F.corr("log_price", "log_cost").alias("corr")).withColumn("weak", F.abs("corr") < 0.05),
    f"SELECT product_id, corr(x, ln(cost / units)) AS corr, abs(corr(x, ln(cost / units))) < 0.05 AS weak FROM {CLEAN} GROUP BY product_id", plain="product_id weak", doubles="corr")
add("e12_promo_lift", lambda t: t.sales.withColumn("base", F.avg(F.when(~F.col("promotion_flag"), F.col("units"))).over(series())).withColumn("band", scalar.depth_band(F.col("discount_percentage"))).filter("promotion_flag").groupBy("band").agg(F.avg(safe(F.col("units"), F.col("base"))).alias("lift"), F.count(F.lit(1)).alias("n")),
    """SELECT CASE WHEN discount_percentage <= 0 THEN 'none' WHEN discount_percentage <= 10 THEN '0-10' WHEN discount_percentage <= 20 THEN '10-20' ELSE '20-30' END AS band, avg(units / nullif(base, 0)) AS lift, count(*) AS n
       FROM (SELECT *, avg(units) FILTER (NOT promotion_flag) OVER (PARTITION BY product_id, store_id) AS base FROM sales_daily) WHERE promotion_flag GROUP BY ALL""", plain="band", whole="n", doubles="lift")
add("j20_e13_elasticity_panel", lambda t: joins.attributes(elasticity.clean_panel(t.sales), t("products"), "product_id").withColumn("reason", F.when(F.lag("selling_price", 1).over(by_date()).isNull(), "first").when(F.col("selling_price") > F.lag("selling_price", 1).over(by_date()), "rise").otherwise("cut")),
    f"SELECT date, product_id, store_id, category, y AS log_units, x AS log_price, CASE WHEN l IS NULL THEN 'first' WHEN selling_price > l THEN 'rise' ELSE 'cut' END AS reason FROM (SELECT *, lag(selling_price) {W} AS l FROM {CLEAN}) c JOIN products USING (product_id)",
    "sales_daily products", plain=PANEL + " category reason", doubles="log_units log_price")


def _arrived(t):
    made = forecast.seasonal_naive(t.sales).filter("date between '1999-01-01' and '1999-12-31'").select(*KEYS, "date", "predicted")
    return made.join(t.sales.select(*KEYS, "date", "units"), [*KEYS, "date"]).groupBy("store_id").agg(*metrics.accuracy())


add("j22_forecast_vs_actual", _arrived, f"SELECT store_id, {METRICS} FROM {PRED} WHERE date BETWEEN '1999-01-01' AND '1999-12-31' GROUP BY store_id", plain="store_id", whole="n", doubles=NUMBERS)
add("j23_roles_scored", lambda t: forecast.seasonal_naive(t.sales).withColumn("role", F.when(F.col("stockout_flag"), "stockout").when(F.col("promotion_flag"), "promoted").otherwise("clean")).groupBy("role").agg(*metrics.accuracy()),
    f"SELECT CASE WHEN stockout_flag THEN 'stockout' WHEN promotion_flag THEN 'promoted' ELSE 'clean' END AS role, {METRICS} FROM {PRED} GROUP BY ALL", plain="role", whole="n", doubles=NUMBERS)
add("b02_embargo", lambda t: forecast.folds(t.sales).groupBy("fold").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date")).withColumn("train_end", F.date_sub("start_date", 91).cast("string")).withColumn("gap", F.datediff("start_date", F.col("train_end").cast("date"))),
    """SELECT fold, start_date, end_date, CAST(start_date - 91 AS VARCHAR) AS train_end, date_diff('day', CAST(start_date - 91 AS DATE), start_date) AS gap FROM (SELECT 4 - date_diff('day', date, (SELECT max(date) FROM sales_daily)) // 90 AS fold, min(date) AS start_date, max(date) AS end_date
       FROM sales_daily WHERE date_diff('day', date, (SELECT max(date) FROM sales_daily)) < 360 GROUP BY ALL)""", plain="start_date end_date train_end", whole="fold gap")
add("b06_uncensored_demand", lambda t: windows.demand_dynamics(windows.demand_lags(scalar.censored(t.sales))),
    f"SELECT date, product_id, store_id, lag(u, 1) {W} AS lag_1, avg(u) {frame(7)} / nullif(avg(u) {frame(28)}, 0) AS momentum FROM (SELECT *, CASE WHEN NOT stockout_flag THEN units END AS u FROM sales_daily)", plain=PANEL, whole="lag_1", doubles="momentum")
add("b18_value_added", lambda t: forecast.seasonal_naive(t.sales).agg(*metrics.accuracy()).select(F.col("wmape").alias("model")).crossJoin(forecast.horizon_naive(t.sales).agg(*metrics.accuracy()).select(F.col("wmape").alias("naive"))).withColumn("added", F.col("naive") - F.col("model")),
    f"""SELECT m AS model, n AS naive, n - m AS added FROM (SELECT sum(abs(predicted - units)) / sum(units) AS m FROM {PRED}),
        (SELECT sum(abs(p - units)) / sum(units) FILTER (p IS NOT NULL) AS n FROM (SELECT units, coalesce(lag(units, 1) {W}, avg(units) {frame(7)}, avg(units) {frame(28)}) AS p FROM sales_daily))""", doubles="model naive added")
add("x11_c29_periods", lambda t: joins.asof_dates(t.sales, t("promotions")).join(t.sales.select(*KEYS, "date", "promotion_flag"), [*KEYS, "date"]).withColumn("period", F.when(F.col("promotion_flag"), "treatment").when(F.datediff("date", "last_end").between(0, 14), "post").when(F.datediff("next_start", "date").between(0, 28), "pre").otherwise("baseline")).groupBy("period").agg(F.count(F.lit(1)).alias("n")),
    """SELECT CASE WHEN a.promotion_flag THEN 'treatment' WHEN date_diff('day', le, a.date) BETWEEN 0 AND 14 THEN 'post' WHEN date_diff('day', a.date, ns) BETWEEN 0 AND 28 THEN 'pre' ELSE 'baseline' END AS period, count(*) AS n
       FROM (SELECT s.*, n.start_date AS ns FROM sales_daily s ASOF LEFT JOIN promotions n ON s.product_id = n.product_id AND s.store_id = n.store_id AND s.date <= n.start_date) a
       JOIN (SELECT s.date, s.product_id, s.store_id, e.end_date AS le FROM sales_daily s ASOF LEFT JOIN promotions e ON s.product_id = e.product_id AND s.store_id = e.store_id AND s.date >= e.end_date) b USING (date, product_id, store_id) GROUP BY ALL""",
    "sales_daily promotions", plain="period", whole="n")
add("x12_segments", lambda t: _segments(t),
    f"""WITH e AS (SELECT product_id, avg(units - mu0) AS effect, stddev_samp(units - mu0) / sqrt(count(*)) AS error FROM {SCORED} WHERE treated GROUP BY product_id)
        SELECT product_id, effect, CASE WHEN abs(effect) < 1.96 * error THEN 'uncertain' WHEN effect < 0 THEN 'negative' WHEN effect >= (SELECT quantile_cont(effect, 0.66) FROM e) THEN 'high' ELSE 'low' END AS segment FROM e""", plain="product_id segment", doubles="effect")


def _segments(t):
    d = F.col("units") - F.col("mu0")
    e = _scored(t).filter("treated").groupBy("product_id").agg(F.avg(d).alias("effect"), (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("error"))
    edge = e.agg(F.percentile("effect", 0.66).alias("edge"))
    kind = F.when(F.abs("effect") < 1.96 * F.col("error"), "uncertain").when(F.col("effect") < 0, "negative").when(F.col("effect") >= F.col("edge"), "high").otherwise("low")
    return e.crossJoin(F.broadcast(edge)).withColumn("segment", kind)


add("x14_logit", lambda t: _scored(t).groupBy("product_id", "store_id").agg(F.max(scalar.logit(F.col("e"))).alias("logit")), f"SELECT product_id, store_id, max(ln(e / (1 - e))) AS logit FROM {SCORED} GROUP BY ALL", plain="product_id store_id", doubles="logit")
add("p04_windows", lambda t: t.sales.agg(F.max("date").alias("hi")).select(F.date_sub("hi", 179).alias("start_date"), F.date_sub("hi", 90).alias("end_date")),
    "SELECT max(date) - 179 AS start_date, max(date) - 90 AS end_date FROM sales_daily", plain="start_date end_date")
add("c18_baseline_counterfactual", lambda t: forecast.seasonal_naive(t.sales).filter("promotion_flag").agg(F.avg(F.col("units") - F.col("predicted") / 1.067).alias("effect"), F.count(F.lit(1)).alias("n")),
    f"SELECT avg(units - predicted / 1.067::DOUBLE) AS effect, count(*) AS n FROM {PRED} WHERE promotion_flag", whole="n", doubles="effect")


def _placebo(t):
    shifted = _qualified(t).withColumns({"start_date": F.date_sub("start_date", 30), "end_date": F.date_sub("end_date", 30)})
    rows = uplift.roles(t.sales.filter("not promotion_flag"), shifted)
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.avg("units").alias("mean_units"))


SHIFTED = f"(SELECT promotion_id, product_id, store_id, start_date - 30 AS start_date, end_date - 30 AS end_date FROM {QUALIFIED})"
add("c21_placebo", _placebo,
    f"SELECT role, count(*) AS n, avg(units) AS mean_units FROM {ROLES.replace(QUALIFIED, SHIFTED).replace('FROM sales_daily s ASOF', 'FROM (SELECT * FROM sales_daily WHERE NOT promotion_flag) s ASOF')} GROUP BY role", "sales_daily promotions", plain="role", whole="n", doubles="mean_units")


def _sweep(t):
    out, q = None, _qualified(t)
    for days in (0, 5, 10, 21):
        part = uplift.roles(t.sales, q, days).filter("role in ('treated', 'control')").groupBy().pivot("role", ["treated", "control"]).agg(F.avg("units")).select(F.lit(days).alias("washout"), (F.col("treated") - F.col("control")).alias("gap"))
        out = part if out is None else out.unionByName(part)
    return out


add("c22_sensitivity", _sweep, " UNION ALL ".join(
    f"SELECT {d} AS washout, avg(units) FILTER (role = 'treated') - avg(units) FILTER (role = 'control') AS gap FROM {ROLES.replace('BETWEEN 1 AND 10', f'BETWEEN 1 AND {d}')}" for d in (0, 5, 10, 21)), "sales_daily promotions", whole="washout", doubles="gap")
NUMERIC, CATEGORY = ["rolling_mean_7", "rolling_mean_28", "selling_price"], ["product_id", "store_id"]


def _model_rows(t):
    return forecast.split(src.written(windows.demand_rolling(t.sales).select(*KEYS, "date", "units", *[c for c in NUMERIC if c != "selling_price"], "selling_price")))


def _tested(t, kind):
    rows = _model_rows(t)
    return models.regression(rows.filter("part = 'train'"), rows.filter("part = 'test'"), "units", NUMERIC, CATEGORY, kind)


for kind in ("ridge", "poisson", "trees"):
    add(f"b09_b10_{kind}", lambda t, k=kind: _tested(t, k).agg(*metrics.accuracy()), None, whole="n", doubles=NUMBERS)
add("c05_c09_matching", lambda t: joins.nearest_score(models.propensity(windows.demand_rolling(t.sales).na.drop(subset=["rolling_mean_28"]), F.col("promotion_flag"), NUMERIC, ["store_id"]), F.col("promotion_flag"), "e", 0.05, "product_id").agg(
    F.count(F.lit(1)).alias("matched"), F.avg(F.col("units") - F.col("match.u")).alias("effect")), None, whole="matched", doubles="effect")
add("c11_c13_cross_fitted", lambda t: uplift.aipw(models.cross_fitted(windows.demand_rolling(t.sales).na.drop(subset=["rolling_mean_28"]), F.col("promotion_flag"), "units", NUMERIC, ["store_id"], 2), F.col("promotion_flag"), "units", "mu0", "e"), None, whole="clusters", doubles="att error")
add("b19_permutation", lambda t: models.permuted(forecast.seasonal_naive(t.sales), "predicted").agg(*metrics.accuracy()), None, whole="n", doubles="wmape")
