"""Registered queries: uplift panel, covariates, estimators, baselines and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import decide, elasticity, forecast, joins, metrics, models, uplift, windows
from shelfspark.operators.windows import KEYS, safe, series
from shelfspark.plans.catalog import PANEL, W, add, frame
from shelfspark.plans.model_queries import ECON, FE, QUALIFIED, ROLES, SCORED, SEGMENTS, WEIGHTED, _cells, _cross, _economics, _events, _impact_rows, _on_days, _qualified, _scored
from shelfspark.plans.panel_queries import METRICS, NUMBERS, PRED

TRAILING = f"""(SELECT date, product_id, store_id, lag(units, 1) {W} AS demand_lag_1, lag(units, 7) {W} AS demand_lag_7, avg(units) {frame(7)} AS demand_mean_7,
  avg(units) {frame(28)} AS demand_mean_28, avg(promotion_flag::INT) {frame(28)} AS promo_share_28 FROM sales_daily)"""
COVARIATES = f"""(SELECT r.*, CASE WHEN r.role = 'treated' THEN q.start_date ELSE r.date END AS anchor_date, t.demand_lag_1, t.demand_lag_7, t.demand_mean_7, t.demand_mean_28, t.promo_share_28,
  sin(2 * pi() * dayofyear(r.date) / 365.25) AS season_sin_1, cos(4 * pi() * dayofyear(r.date) / 365.25) AS season_cos_2
  FROM {ROLES} r LEFT JOIN {QUALIFIED} q ON q.promotion_id = r.promotion_id
  LEFT JOIN {TRAILING} t ON t.product_id = r.product_id AND t.store_id = r.store_id AND t.date = CASE WHEN r.role = 'treated' THEN q.start_date ELSE r.date END)"""


def _roles(t):
    return uplift.roles(t.sales, _qualified(t))


add("c04_j13_covariates", lambda t: uplift.covariates(_roles(t), _qualified(t)), f"SELECT * FROM {COVARIATES}", "sales_daily promotions",
    plain=PANEL + " role anchor_date", whole="demand_lag_1 demand_lag_7", doubles="demand_mean_7 demand_mean_28 promo_share_28 season_sin_1 season_cos_2")


def _uplift_panel(t):
    pairs = t("promotions").filter("duration_days >= 2").select(*KEYS)
    return uplift.panel(t.sales, pairs, t("products"), t("stores"), t("promotions"), "1997-01-01", "1998-06-30")


add("j27_uplift_panel", _uplift_panel,
    """SELECT s.date, s.product_id, s.store_id, s.units, category, region, coalesce(p.promotion_spend, 0) AS promotion_spend
       FROM sales_daily s LEFT JOIN products USING (product_id) LEFT JOIN stores USING (store_id)
       LEFT JOIN promotions p ON p.product_id = s.product_id AND p.store_id = s.store_id AND p.start_date = s.date
       WHERE s.date BETWEEN DATE '1997-01-01' - 120 AND '1998-06-30' AND (s.product_id, s.store_id) IN (SELECT (product_id, store_id) FROM promotions WHERE duration_days >= 2)""",
    "sales_daily products stores promotions", plain=PANEL + " category region", whole="units", doubles="promotion_spend")
add("j28_baseline_on_panel", lambda t: uplift.with_baseline(_uplift_panel(t), forecast.seasonal_naive(t.sales.filter("not promotion_flag"))),
    f"""WITH s AS (SELECT * FROM sales_daily WHERE NOT promotion_flag),
        b AS (SELECT date, product_id, store_id, greatest(coalesce(0.4 * season + 0.6 * recent, recent, season, m), 0) AS baseline FROM (
          SELECT *, coalesce(avg(units) {frame(28)}, avg(units) {frame(14)}, avg(units) {frame(7)}) AS recent, lag(units, 364) {W} AS season, (SELECT avg(units) FROM s) AS m FROM s))
        SELECT p.date, p.product_id, p.store_id, baseline FROM sales_daily p LEFT JOIN b USING (date, product_id, store_id)
        WHERE p.date BETWEEN DATE '1997-01-01' - 120 AND '1998-06-30' AND (p.product_id, p.store_id) IN (SELECT (product_id, store_id) FROM promotions WHERE duration_days >= 2)""",
    "sales_daily promotions", plain=PANEL, doubles="baseline")


def _pool(t):
    others = joins.contemporary_controls(t.sales, t("products"), t("stores"))
    return uplift.whole_pool(_roles(t), _qualified(t), others, controls=1, treated=1)


add("c03_whole_pool", lambda t: _pool(t).groupBy("control_origin").agg(F.count(F.lit(1)).alias("rows"), F.sum("units").alias("units")),
    f"""WITH a AS (SELECT s.*, category, region FROM sales_daily s JOIN products USING (product_id) JOIN stores USING (store_id)), tr AS (SELECT * FROM a WHERE promotion_flag)
        SELECT control_origin, count(*) AS rows, sum(units) AS units FROM (
          SELECT 'treated' AS control_origin, units FROM {ROLES} WHERE role = 'treated'
          UNION ALL SELECT 'within_series', units FROM {ROLES} r WHERE role = 'control' AND EXISTS (SELECT 1 FROM {QUALIFIED} q WHERE q.product_id = r.product_id AND q.store_id = r.store_id
            AND ((r.date > q.end_date AND r.date - q.end_date <= 45) OR (r.date < q.start_date AND q.start_date - r.date <= 45)))
          UNION ALL SELECT 'cross_sectional', units FROM a WHERE (product_id, store_id) NOT IN (SELECT (product_id, store_id) FROM tr) AND (category, region) IN (SELECT (category, region) FROM tr)
            AND date BETWEEN (SELECT min(date) FROM tr) AND (SELECT max(date) FROM tr)) GROUP BY ALL""",
    "sales_daily promotions products stores", plain="control_origin", whole="rows units")


def _pseudo(t):
    """Listing means stand for both outcome models and the listing's share for the propensity."""
    mu1 = F.avg(F.when(F.col("promotion_flag"), F.col("units"))).over(series())
    rows = _scored(t).withColumn("mu1", mu1).filter("mu1 is not null")
    return uplift.pseudo_outcome(rows, F.col("treated"), "units", "mu0", "mu1", "e")


RAW = f"""(SELECT *, mu1 - mu0 + treated::INT * (units - mu1) / e - (1 - treated::INT) * (units - mu0) / (1 - e) AS raw
  FROM (SELECT *, avg(CASE WHEN promotion_flag THEN units END) OVER (PARTITION BY product_id, store_id) AS mu1 FROM {SCORED}) WHERE mu1 IS NOT NULL)"""
PSEUDO = f"(SELECT *, least(greatest(raw, (SELECT quantile_cont(raw, 0.01) FROM {RAW})), (SELECT quantile_cont(raw, 0.99) FROM {RAW})) AS pseudo FROM {RAW})"
CATE = f"""(SELECT product_id, sum(treated::INT) AS n_treated, CASE WHEN sum(treated::INT) >= 30 THEN avg(pseudo) END AS cate,
  CASE WHEN sum(treated::INT) >= 30 THEN stddev_samp(pseudo) / sqrt(count(*)) END AS error FROM {PSEUDO} GROUP BY product_id)"""
add("c15_pseudo_outcome", lambda t: _pseudo(t).groupBy("store_id").agg(F.count(F.lit(1)).alias("n"), F.avg("pseudo").alias("mean"), F.min("pseudo").alias("least"), F.max("pseudo").alias("most")),
    f"SELECT store_id, count(*) AS n, avg(pseudo) AS mean, min(pseudo) AS least, max(pseudo) AS most FROM {PSEUDO} GROUP BY store_id", plain="store_id", whole="n", doubles="mean least most")


def _att(t):
    rows = _pseudo(t)
    return uplift.att_of(rows, uplift.segment_cate(rows, F.col("treated"), "product_id"), F.col("treated"), "product_id")


def _cate_trees(t):
    rows = _pseudo(t).na.drop(subset=["lag_1"])
    return models.regression(rows, rows.filter("treated"), "pseudo", ["lag_1", "selling_price", "mu0"], ["store_id"], "trees")


add("c15_att", _att,
    f"SELECT avg(cate) AS att, count(cate) AS n FROM {PSEUDO} JOIN {CATE} USING (product_id) WHERE treated", whole="n", doubles="att")
add("c15_cate_trees", lambda t: _cate_trees(t).agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("att")), None, whole="n", doubles="att")
add("c16_segment_cate", lambda t: uplift.segment_cate(_pseudo(t), F.col("treated"), "product_id"), f"SELECT * FROM {CATE}", plain="product_id", whole="n_treated", doubles="cate error")


def _plans(t):
    return t("promotions").groupBy("product_id").agg(F.max("duration_days").alias("days"), F.max("promotion_id").alias("promotion_id"))


add("c31_planned_promotions", lambda t: uplift.score_promotions(_plans(t), uplift.segment_cate(_pseudo(t), F.col("treated"), "product_id"), "product_id"),
    f"""SELECT promotion_id, product_id, days, cate * days AS uplift, (cate - 1.96 * error) * days AS low, (cate + 1.96 * error) * days AS high, cate IS NULL AS unknown
        FROM (SELECT product_id, max(duration_days) AS days, max(promotion_id) AS promotion_id FROM promotions GROUP BY product_id) LEFT JOIN {CATE} USING (product_id)""",
    "sales_daily promotions", plain="promotion_id product_id unknown", whole="days", doubles="uplift low high")
add("c30_selected_events", lambda t: uplift.select_events(_qualified(t), equal={"store_id": "ASIA"}, start="1997-01-01", end="1998-12-31"),
    f"SELECT promotion_id, start_date, end_date FROM {QUALIFIED} WHERE store_id = 'ASIA' AND start_date >= '1997-01-01' AND end_date <= '1998-12-31'", "sales_daily promotions", plain="promotion_id start_date end_date")


def _methods(t):
    w = uplift.att_weights(_scored(t), F.col("treated"), "e")
    none = F.lit(None).cast("double")
    rows = (uplift.aipw(_scored(t), F.col("treated"), "units", "mu0", "e").select(F.lit("aipw").alias("method"), "att", "error")
            .unionByName(uplift.ipw(w, F.col("treated"), "units", "weight").select(F.lit("ipw").alias("method"), "att", none.alias("error")))
            .unionByName(_scored(t).agg((F.avg(F.when(F.col("treated"), F.col("units"))) - F.avg(F.when(~F.col("treated"), F.col("units")))).alias("att")).select(F.lit("naive").alias("method"), "att", none.alias("error"))))
    return uplift.select_method(rows)


add("c27_method_choice", _methods,
    f"""WITH s AS (SELECT product_id, store_id, treated::INT AS t, treated::INT * (units - mu0) - (1 - treated::INT) * e / (1 - e) * (units - mu0) AS s FROM {SCORED}), a AS (SELECT sum(t) AS nt, sum(s) / sum(t) AS att FROM s),
        g AS (SELECT sum(s - t * att) AS g FROM s, a GROUP BY product_id, store_id)
        SELECT 'aipw' AS method, (SELECT att FROM a) AS att, sqrt(sum(g * g) * count(*) / (count(*) - 1)) / (SELECT nt FROM a) AS error, 1 AS rank, true AS selected FROM g
        UNION ALL SELECT 'ipw', sum(weight * units) FILTER (treated) / sum(weight) FILTER (treated) - sum(weight * units) FILTER (NOT treated) / sum(weight) FILTER (NOT treated), NULL, 2, false FROM {WEIGHTED}
        UNION ALL SELECT 'naive', avg(units) FILTER (treated) - avg(units) FILTER (NOT treated), NULL, NULL, false FROM {SCORED}""", plain="method selected", whole="rank", doubles="att error")


def _diagnostics(t):
    w = uplift.att_weights(_scored(t), F.col("treated"), "e")
    worst = uplift.balance(w, F.col("treated"), ["lag_1", "selling_price"], "weight").agg(F.max(F.abs("smd_after")).alias("worst_smd"))
    trimmed = w.agg(F.avg((~F.col("e").between(0.05, 0.95)).cast("double")).alias("trimmed"))
    rows = worst.crossJoin(F.broadcast(trimmed))  # one row each
    return uplift.verdicts(rows.select(F.lit("aipw").alias("method"), "worst_smd", "trimmed", F.lit(0.0).alias("placebo_ratio"), F.lit(0.0).alias("spread")))


BAL = " UNION ALL ".join(f"SELECT '{c}' AS name, treated AS t, weight AS w, {c}::DOUBLE AS v FROM {WEIGHTED} WHERE {c} IS NOT NULL" for c in ("lag_1", "selling_price"))
add("c28_verdict", _diagnostics,
    f"""WITH b AS (SELECT name, (sum(w * v) FILTER (t) / sum(w) FILTER (t) - sum(w * v) FILTER (NOT t) / sum(w) FILTER (NOT t)) / sqrt((var_samp(v) FILTER (t) + var_samp(v) FILTER (NOT t)) / 2) AS smd FROM ({BAL}) x GROUP BY name),
        d AS (SELECT (SELECT max(abs(smd)) FROM b) AS worst_smd, avg((NOT e BETWEEN 0.05 AND 0.95)::INT) AS trimmed FROM {WEIGHTED})
        SELECT 'aipw' AS method, worst_smd, trimmed, CASE (worst_smd > 0.1)::INT + (trimmed > 0.1)::INT WHEN 0 THEN 'sound' WHEN 1 THEN 'weak' ELSE 'not credible' END AS verdict FROM d""", plain="method verdict", doubles="worst_smd trimmed")
QINI = f"""(SELECT bucket, sum(nt) OVER w AS nt, sum(yt) OVER w - sum(yc) OVER w * sum(nt) OVER w / sum(nc) OVER w AS gain FROM (
  SELECT 10 - len(list_filter(q, lambda x: x <= selling_price)) AS bucket, sum(treated::INT) AS nt, sum((NOT treated)::INT) AS nc, sum(treated::INT * units) AS yt, sum((NOT treated)::INT * units) AS yc
  FROM {SCORED}, (SELECT quantile_cont(selling_price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM {SCORED}) GROUP BY ALL) WINDOW w AS (ORDER BY bucket))"""
add("c26_auuc", lambda t: uplift.auuc(uplift.qini(_scored(t), F.col("treated"), "selling_price", "units")),
    f"""WITH c AS (SELECT bucket, nt / max(nt) OVER () AS x, gain, arg_max(gain, bucket) OVER () AS last FROM {QINI})
        SELECT sum(a) AS area, sum(a) - any_value(last) / 2 AS auuc FROM (SELECT last, (x - coalesce(lag(x) OVER (ORDER BY bucket), 0)) * (gain + coalesce(lag(gain) OVER (ORDER BY bucket), 0)) / 2 AS a FROM c)""", doubles="area auuc")
add("w30_qini_curve", lambda t: uplift.qini_curve(_scored(t), F.col("treated"), "discount_percentage", "units"),
    f"""SELECT discount_percentage, sum(nt) OVER w AS nt, sum(nc) OVER w AS nc, sum(yt) OVER w - sum(yc) OVER w * sum(nt) OVER w / nullif(sum(nc) OVER w, 0) AS gain
        FROM (SELECT discount_percentage, sum(treated::INT) AS nt, sum((NOT treated)::INT) AS nc, sum(treated::INT * units) AS yt, sum((NOT treated)::INT * units) AS yc FROM {SCORED} GROUP BY ALL) WINDOW w AS (ORDER BY discount_percentage DESC)""",
    whole="nt nc", doubles="discount_percentage gain")


def _bounded(t):
    """Incremental units of events with bounds from the spread of the listing's unpromoted days."""
    sd = F.stddev_samp(F.when(~F.col("promotion_flag"), F.col("units"))).over(series())
    rows = joins.event_windows(_scored(t).withColumn("sd", sd), _qualified(t))
    sums = rows.groupBy("promotion_id").agg(F.sum(F.col("units") - F.col("mu0")).alias("units"), F.sqrt(F.sum(F.col("sd") * F.col("sd"))).alias("error"))
    return sums.select("promotion_id", "units", (F.col("units") - 1.96 * F.col("error")).alias("low"), (F.col("units") + 1.96 * F.col("error")).alias("high"))


add("c24_c25_bounds", _bounded,
    f"""SELECT promotion_id, u AS units, u - 1.96 * s AS low, u + 1.96 * s AS high FROM (SELECT p.promotion_id, sum(units - mu0) AS u, sqrt(sum(sd * sd)) AS s FROM {QUALIFIED} p
        JOIN (SELECT *, stddev_samp(CASE WHEN NOT promotion_flag THEN units END) OVER (PARTITION BY product_id, store_id) AS sd FROM {SCORED}) s
          ON s.product_id = p.product_id AND s.store_id = p.store_id AND s.date BETWEEN p.start_date AND p.end_date GROUP BY p.promotion_id)""",
    "sales_daily promotions", plain="promotion_id", doubles="units low high")

# baselines
add("g17_baseline_slice", lambda t: forecast.baseline_slice(metrics.intervals(forecast.seasonal_naive(t.sales), metrics.conformal(forecast.seasonal_naive(t.sales), "store_id"), "store_id"), ["store_id"]),
    f"""WITH p AS (SELECT *, abs(units - predicted) / greatest(predicted, 1) AS r FROM {PRED}),
        k AS (SELECT store_id, r, row_number() OVER (PARTITION BY store_id ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY store_id) AS n FROM p),
        a AS (SELECT *, least(ceil((n + 1) * (1 - 0.1)) / n, 1.0) * (n - 1) AS pos FROM k), w AS (SELECT store_id, min(r) + (max(r) - min(r)) * (max(pos) - floor(max(pos))) AS width FROM a WHERE (k = floor(pos) OR k = ceil(pos)) AND n >= 100 GROUP BY store_id)
        SELECT store_id, sum(units) AS units, sum(predicted) AS baseline, sum(units - predicted) AS gap, sum(units - predicted) / nullif(sum(predicted), 0) AS gap_pct, sum((units - predicted) * selling_price) AS revenue_gap,
               coalesce(sum(units) < sum(greatest(predicted - width * greatest(predicted, 1), 0)) OR sum(units) > sum(predicted + width * greatest(predicted, 1)), false) AS significant FROM p LEFT JOIN w USING (store_id) GROUP BY store_id""",
    plain="store_id significant", whole="units", doubles="baseline gap gap_pct revenue_gap")
add("b11_g19_baseline_table", lambda t: forecast.baseline_table(t.sales, t("products"), t("stores")),
    f"""WITH e AS (SELECT s.*, category, channel, date_diff('day', min(date) OVER (PARTITION BY product_id, store_id), date) AS age, avg(units) {frame(28)} AS r28 FROM sales_daily s JOIN products USING (product_id) JOIN stores USING (store_id)),
        c AS (SELECT category, channel, avg(units) AS mean FROM e WHERE age >= 60 GROUP BY ALL), o AS (SELECT avg(units) AS overall FROM e WHERE age >= 60)
        SELECT date, product_id, store_id, age < 60 AS cold, b AS baseline, units - b AS gap, (units - b) / nullif(b, 0) AS gap_pct, (units - b) * selling_price AS revenue_gap
        FROM (SELECT e.*, CASE WHEN age < 60 THEN coalesce(mean, overall) ELSE coalesce(r28, mean, overall) END AS b FROM e LEFT JOIN c USING (category, channel), o)""",
    "sales_daily products stores", plain=PANEL + " cold", doubles="baseline gap gap_pct revenue_gap")
NUMERIC, CATEGORY = ["rolling_mean_7", "rolling_mean_28", "selling_price"], ["product_id", "store_id"]
add("b27_fit_evaluate", lambda t: models.fit_evaluate(windows.demand_rolling(t.sales), NUMERIC, CATEGORY), None, plain="role", whole="n", doubles="wmape empirical")
add("b20_parameter_search", lambda t: models.search(windows.demand_rolling(t.sales), NUMERIC, CATEGORY, trials=3), None, plain="name kept", doubles="reg_param wmape")
add("b23_model_choice", lambda t: models.select_model(forecast.seasonal_naive(t.sales).agg(*metrics.accuracy()).select(F.lit("seasonal_naive").alias("model"), "wmape", F.lit(1.5).alias("stockout_lift"))
        .unionByName(forecast.horizon_naive(t.sales).agg(*metrics.accuracy()).select(F.lit("horizon_naive").alias("model"), "wmape", F.lit(1.1).alias("stockout_lift")))),
    f"SELECT 'seasonal_naive' AS model, sum(abs(predicted - units)) / sum(units) AS wmape FROM {PRED}", plain="model", doubles="wmape")

# decisions
add("g07_realised_spend", lambda t: decide.realised_spend(t.sales, t("promotions"), 500.0, 0.25),
    """SELECT promotion_id, sum(s.units) AS units, 500 + 0.25 * sum(s.units) AS spend FROM promotions p JOIN sales_daily s ON s.product_id = p.product_id AND s.store_id = p.store_id
       AND s.date BETWEEN p.start_date AND p.end_date GROUP BY promotion_id""", "sales_daily promotions", plain="promotion_id", whole="units", doubles="spend")


def _related(t):
    declared = t("relationships").select("product_a", "product_b", F.col("cross_elasticity").alias("other"), F.col("relationship_type").alias("kind"))
    return decide.cross_effects(declared, _economics(t))


EFFECTS = f"(SELECT product_a AS product_id, product_b AS related_id, r.cross_elasticity AS effect, units, price - unit_cost AS margin FROM relationships r JOIN {ECON} e ON e.product_id = r.product_b)"
add("j29_cross_effects", _related, f"SELECT * FROM {EFFECTS}", "sales_daily products relationships", plain="product_id related_id", doubles="effect units margin")
add("d01_cross_profit", lambda t: decide.with_cross(decide.price_grid(_economics(t)), _related(t)).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.max("cross_profit").alias("most"), F.min("cross_profit").alias("least")),
    f"""WITH g AS (SELECT product_id, -0.3 + 0.6 * i / 20.0 AS change FROM {ECON}, range(21) r(i)),
        x AS (SELECT g.product_id, change, coalesce(sum(f.units * (power(1 + change, effect) - 1) * margin), 0) AS cross_profit FROM g LEFT JOIN {EFFECTS} f USING (product_id) GROUP BY g.product_id, change)
        SELECT product_id, count(*) AS n, max(cross_profit) AS most, min(cross_profit) AS least FROM x GROUP BY product_id""", "sales_daily products relationships", plain="product_id", whole="n", doubles="most least")
add("d02_risk", lambda t: decide.assessed(decide.recommend(decide.price_grid(_economics(t)))).select("product_id", "risk", "at_edge"),
    f"""WITH g AS (SELECT *, (new_price - unit_cost) * new_units AS profit FROM (SELECT product_id, change, unit_cost, price * (1 + change) AS new_price, units * power(1 + change, elasticity) AS new_units FROM {ECON}, (SELECT -0.3 + 0.6 * i / 20.0 AS change FROM range(21) r(i)))
                   WHERE NOT (new_price < unit_cost OR (new_price - unit_cost) / nullif(new_price, 0) < 0.05)),
        b AS (SELECT p.product_id, coalesce(c, 0) AS c FROM (SELECT product_id FROM {ECON}) p LEFT JOIN (SELECT product_id, arg_max(change, profit) AS c FROM g GROUP BY product_id) USING (product_id))
        SELECT product_id, CASE WHEN abs(c) <= 0.05 THEN 'low' WHEN abs(c) <= 0.15 THEN 'medium' ELSE 'high' END AS risk, abs(c) >= 0.3 - 1e-9 AS at_edge FROM b""", plain="product_id risk at_edge")


def _ranged(t):
    e = _economics(t)
    return e.withColumns({"elasticity_low": F.col("elasticity") - 0.5, "elasticity_high": F.col("elasticity") + 0.5, "units_low": 0.9 * F.col("units"), "units_high": 1.1 * F.col("units"),
                          "elasticity_confidence": F.lit(0.4) + 0.01 * F.substring("product_id", 7, 2).cast("int"), "units_confidence": F.lit(0.55)})


add("d07_corner_range", lambda t: decide.corners(_ranged(t), -0.1),
    f"""WITH e AS (SELECT *, 0.4 + 0.01 * CAST(substr(product_id, 7, 2) AS INT) AS ec FROM {ECON}),
        c AS (SELECT e.product_id, u * power(0.9::DOUBLE, x) * (price * 0.9 - unit_cost) * 28 AS v FROM e, LATERAL (SELECT unnest([elasticity - 0.5, elasticity + 0.5]) AS x), LATERAL (SELECT unnest([0.9 * units, 1.1 * units]) AS u)),
        r AS (SELECT product_id, min(v) AS low, max(v) AS high FROM c GROUP BY product_id)
        SELECT product_id, units * power(0.9::DOUBLE, elasticity) * (price * 0.9 - unit_cost) * 28 AS profit, low, high, least(ec, 0.55) AS confidence,
               CASE WHEN low < units * (price - unit_cost) * 28 AND high > units * (price - unit_cost) * 28 THEN 'high' WHEN least(ec, 0.55) < 0.5 THEN 'medium' ELSE 'low' END AS risk FROM e JOIN r USING (product_id)""",
    plain="product_id risk", doubles="profit low high confidence")
BUDGET = 200_000.0


def _limits(t):
    floors = t("products").filter("product_status = 'Active'").select(F.col("product_id").alias("candidate_id"), F.lit(3_000.0).alias("least"))
    return decide.limits(decide.lines(decide.allocate(decide.segments(_cells(t)), BUDGET)), _cells(t).select("candidate_id", "reference_spend"), floors, BUDGET)


add("d05_limits", _limits,
    f"""WITH a AS (SELECT candidate_id, sum(spend) AS spend FROM (SELECT *, width * least(greatest(({BUDGET} - (sum(width) OVER (ORDER BY marginal DESC) - width)) / width, 0), 1) AS spend FROM {SEGMENTS}) GROUP BY candidate_id),
        r AS (SELECT product_id AS candidate_id, sum(promotion_spend) AS ref FROM promotions GROUP BY ALL), f AS (SELECT product_id AS candidate_id, 3000 AS least FROM products WHERE product_status = 'Active')
        SELECT candidate_id, spend, spend / nullif(ref, 0) AS vs_reference, spend >= 2 * ref - 1e-6 AS at_limit, coalesce(spend, 0) < least AS floor_missed, ref IS NULL AS unmatched, (SELECT sum(spend) FROM a) >= {BUDGET} - 1e-6 AS binding
        FROM a LEFT JOIN r USING (candidate_id) FULL JOIN f USING (candidate_id)""", "promotions products", plain="candidate_id at_limit floor_missed unmatched binding", doubles="spend vs_reference")
