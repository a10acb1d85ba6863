"""Registered queries: elasticities, uplift and decision tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import decide, elasticity, joins, metrics, uplift
from shelfspark.operators.windows import by_date, series
from shelfspark.plans.catalog import W, add

CLEAN = "(SELECT *, ln(units) AS y, ln(selling_price) AS x FROM sales_daily WHERE NOT promotion_flag AND NOT stockout_flag AND units > 0 AND selling_price > 0)"
add("e01_e02_naive_ols", lambda t: elasticity.naive(elasticity.clean_panel(t.sales)),
    f"SELECT product_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) AS n FROM {CLEAN} GROUP BY product_id", plain="product_id", whole="n", doubles="slope intercept r2")
add("e03_clustered_error", lambda t: elasticity.clustered_error(elasticity.clean_panel(t.sales)),
    f"""WITH f AS (SELECT product_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx, count(*) AS n FROM {CLEAN} GROUP BY ALL),
        g AS (SELECT product_id, store_id, sum((x - mx) * (y - a - b * x)) AS g, sum(((x - mx) * (y - a - b * x)) ** 2) AS g2, any_value(sxx) AS sxx, any_value(b) AS b, any_value(n) AS n FROM {CLEAN} JOIN f USING (product_id) GROUP BY ALL)
        SELECT product_id, any_value(b) AS slope, CASE WHEN count(*) > 1 THEN sqrt(sum(g * g) * count(*) / (count(*) - 1)) ELSE sqrt(sum(g2)) END / any_value(sxx) AS error, any_value(n) AS n FROM g GROUP BY product_id""", plain="product_id", whole="n", doubles="slope error")
FE = f"""SELECT product_id, sum(u * p) / nullif(sum(p * p), 0) AS slope, count(*) AS n FROM (SELECT product_id, u - avg(u) OVER (PARTITION BY product_id, date) AS u, p - avg(p) OVER (PARTITION BY product_id, date) AS p
  FROM (SELECT *, y - avg(y) OVER (PARTITION BY product_id, store_id) AS u, x - avg(x) OVER (PARTITION BY product_id, store_id) AS p FROM {CLEAN})) GROUP BY product_id"""
add("e04_fixed_effects", lambda t: elasticity.fixed_effects(elasticity.clean_panel(t.sales)), FE, plain="product_id", whole="n", doubles="slope")
add("e05_j21_two_stage", lambda t: elasticity.two_stage(elasticity.clean_panel(t.sales).withColumn("log_cost", F.ln(F.greatest(F.col("cost") / F.col("units"), F.lit(1e-6)))), "log_cost"),
    f"""WITH z AS (SELECT *, ln(greatest(cost / units, 1e-6)) AS z FROM {CLEAN}),
        s AS (SELECT product_id, covar_samp(y, z) / nullif(covar_samp(x, z), 0) AS slope, regr_slope(x, z) AS g, regr_intercept(x, z) AS c, avg(z) AS mz, regr_sxx(x, z) AS szz, count(*) AS n FROM z GROUP BY product_id),
        m AS (SELECT product_id, sum(((z - mz) * (x - c - g * z)) ** 2) AS meat FROM z JOIN s USING (product_id) GROUP BY product_id)
        SELECT product_id, slope, g * g * szz * szz / nullif(meat, 0) AS first_f, g * g * szz * szz / nullif(meat, 0) < 10 AS weak, n FROM s JOIN m USING (product_id)""", plain="product_id weak", whole="n", doubles="slope first_f")


def _choice(t):
    rows = elasticity.clean_panel(t.sales)
    return elasticity.choose(rows, elasticity.fixed_effects(rows).filter("n >= 1500"), elasticity.naive(rows.filter(F.dayofmonth("date") == 1)).filter("n >= 60"))


add("e07_selection", _choice,
    f"""SELECT product_id, CASE WHEN f.slope IS NOT NULL THEN 'panel_fe' WHEN r.slope IS NOT NULL THEN 'randomised' END AS method, coalesce(f.slope, r.slope) AS slope,
               CASE WHEN coalesce(f.slope, r.slope) IS NULL THEN 'no identified estimate' END AS reason
        FROM (SELECT DISTINCT product_id FROM {CLEAN}) n LEFT JOIN (SELECT * FROM ({FE}) WHERE n >= 1500) f USING (product_id)
        LEFT JOIN (SELECT product_id, regr_slope(y, x) AS slope FROM {CLEAN} WHERE day(date) = 1 GROUP BY product_id HAVING count(*) >= 60) r USING (product_id)""", plain="product_id method reason", doubles="slope")
add("e08_identification", lambda t: elasticity.identification(elasticity.clean_panel(t.sales)),
    f"SELECT product_id, count(*) < 60 AS few_rows, count(DISTINCT floor(selling_price * 10000 + 0.5)) < 5 AS few_prices, stddev_samp(x) < 0.02 AS little_variation FROM {CLEAN} GROUP BY product_id", plain="product_id few_rows few_prices little_variation")
CROSS = """WITH l AS (SELECT a.product_id AS pa, b.product_id AS pb, a.store_id, a.date, ln(a.units) AS y, ln(a.selling_price) AS p, ln(b.selling_price) AS q
             FROM sales_daily a JOIN relationships r ON r.product_a = a.product_id JOIN sales_daily b ON b.product_id = r.product_b AND b.store_id = a.store_id AND b.date = a.date WHERE a.units > 0),
  u AS (SELECT pa, pb, store_id, date, y - avg(y) OVER w AS y, p - avg(p) OVER w AS p, q - avg(q) OVER w AS q FROM l WINDOW w AS (PARTITION BY pa, pb, store_id)),
  d AS (SELECT pa, pb, y - avg(y) OVER w AS y, p - avg(p) OVER w AS p, q - avg(q) OVER w AS q FROM u WINDOW w AS (PARTITION BY pa, pb, date)),
  s AS (SELECT pa, pb, sum(p * p) AS pp, sum(q * q) AS qq, sum(p * q) AS pq, sum(p * y) AS py, sum(q * y) AS qy, count(*) AS n FROM d GROUP BY ALL),
  b AS (SELECT *, (qq * py - pq * qy) / nullif(pp * qq - pq * pq, 0) AS own, (pp * qy - pq * py) / nullif(pp * qq - pq * pq, 0) AS other, pp * qq - pq * pq AS det FROM s WHERE n >= 120),
  m AS (SELECT pa, pb, sum(((pp * q - pq * p) * (y - own * p - other * q)) ** 2) AS meat FROM d JOIN b USING (pa, pb) GROUP BY ALL)
  SELECT pa AS product_a, pb AS product_b, n, own, other, other * det / nullif(sqrt(meat), 0) AS t FROM b JOIN m USING (pa, pb)"""


def _cross(t):
    return elasticity.cross(joins.cross_pairs(t.sales, t("relationships")))


add("e10_e14_cross_pairs", _cross, CROSS, "sales_daily relationships", plain="product_a product_b", whole="n", doubles="own other t")
add("e11_w19_relationships", lambda t: elasticity.relationships(_cross(t)), None, plain="product_a product_b kind strength", whole="n", doubles="p_adjusted other")
QUALIFIED = "(SELECT * FROM promotions WHERE duration_days >= 2 AND discount_percentage / 100 >= 0.05)"


def _events(t):
    p = t("promotions").withColumns({"depth": F.col("discount_percentage") / 100, "duration": F.col("duration_days")})
    return uplift.qualify(p)


def _qualified(t):
    return _events(t).filter("reason = 'qualified'")


def _on_days(t):
    return joins.promotion_features(t.sales, t("promotions")).filter("promotion_id is not null")


add("g04_c01_events", lambda t: uplift.qualify(uplift.events(_on_days(t))),
    "SELECT promotion_id, product_id, store_id, start_date, end_date, discount_percentage / 100 AS depth, duration_days AS duration, CASE WHEN discount_percentage / 100 < 0.05 THEN 'shallow' WHEN duration_days < 2 THEN 'short' ELSE 'qualified' END AS reason FROM promotions",
    "promotions", plain="promotion_id product_id store_id start_date end_date reason", whole="duration", doubles="depth")
ROLES = f"""(SELECT s.date, s.product_id, s.store_id, s.units, s.stockout_flag, q.promotion_id, CASE WHEN q.promotion_id IS NOT NULL THEN 'treated' WHEN s.promotion_flag THEN 'excluded' WHEN coalesce(date_diff('day', s.le, s.date) BETWEEN 1 AND 10, false) THEN 'washout' ELSE 'control' END AS role
  FROM (SELECT s.*, p.end_date AS le FROM sales_daily s ASOF LEFT JOIN {QUALIFIED} p ON s.product_id = p.product_id AND s.store_id = p.store_id AND s.date >= p.end_date) s
  LEFT JOIN {QUALIFIED} q ON q.product_id = s.product_id AND q.store_id = s.store_id AND s.date BETWEEN q.start_date AND q.end_date)"""
add("c02_roles", lambda t: uplift.roles(t.sales, _qualified(t)), f"SELECT * FROM {ROLES}", "sales_daily promotions", plain="date product_id store_id role")
add("f15_drop_censored", lambda t: uplift.drop_censored(uplift.roles(t.sales, _qualified(t))), f"SELECT role, count(*) AS rows, sum(stockout_flag::INT) AS lost, avg(stockout_flag::INT) AS lost_share FROM {ROLES} GROUP BY role",
    "sales_daily promotions", plain="role", whole="rows lost", doubles="lost_share")
add("c03_u01_control_pool", lambda t: uplift.control_pool(uplift.roles(t.sales, _qualified(t)), _qualified(t)).groupBy("control_origin").agg(F.count(F.lit(1)).alias("rows"), F.sum("units").alias("units")),
    f"""SELECT control_origin, count(*) AS rows, sum(units) AS units FROM (SELECT 'treated' AS control_origin, units FROM {ROLES} WHERE role = 'treated'
        UNION ALL SELECT 'within_series', units FROM {ROLES} r WHERE role = 'control' AND EXISTS (SELECT 1 FROM {QUALIFIED} q WHERE q.product_id = r.product_id AND q.store_id = r.store_id
          AND ((r.date > q.end_date AND r.date - q.end_date <= 45) OR (r.date < q.start_date AND q.start_date - r.date <= 45)))) x GROUP BY ALL""", "sales_daily promotions", plain="control_origin", whole="rows units")


def _scored(t):
    """Rows with a simple propensity (share promoted of the listing, kept inside 0.02 .. 0.98)
    and the listing's unpromoted mean as outcome model."""
    p = F.avg(F.col("promotion_flag").cast("double")).over(series())
    mu = F.avg(F.when(~F.col("promotion_flag"), F.col("units"))).over(series())
    rows = t.sales.withColumns({"e": F.least(F.greatest(p, F.lit(0.02)), F.lit(0.98)), "mu0": mu, "treated": F.col("promotion_flag"), "lag_1": F.lag("units", 1).over(by_date())})
    return rows.filter("mu0 is not null")


SCORED = f"""(SELECT * FROM (SELECT *, promotion_flag AS treated, least(greatest(avg(promotion_flag::INT) OVER (PARTITION BY product_id, store_id), 0.02), 0.98) AS e,
  avg(CASE WHEN NOT promotion_flag THEN units END) OVER (PARTITION BY product_id, store_id) AS mu0, lag(units, 1) {W} AS lag_1 FROM sales_daily) WHERE mu0 IS NOT NULL)"""
WEIGHTED = f"(SELECT *, CASE WHEN treated THEN 1 ELSE least(e / (1 - e), (SELECT quantile_cont(e / (1 - e), 0.99) FROM {SCORED} WHERE NOT treated)) END AS weight FROM {SCORED})"


def _t():
    return F.col("treated")


add("c06_c07_weights", lambda t: uplift.att_weights(_scored(t), _t(), "e").groupBy("treated").agg(F.count(F.lit(1)).alias("rows"), uplift.effective_size("weight").alias("effective"), F.max("weight").alias("most")),
    f"SELECT treated, count(*) AS rows, sum(weight) * sum(weight) / sum(weight * weight) AS effective, max(weight) AS most FROM {WEIGHTED} GROUP BY treated", plain="treated", whole="rows", doubles="effective most")
BAL = " UNION ALL ".join(f"SELECT '{c}' AS name, treated AS t, weight AS w, {c}::DOUBLE AS v FROM {WEIGHTED} WHERE {c} IS NOT NULL" for c in ("lag_1", "selling_price", "mu0"))
add("c08_balance", lambda t: uplift.balance(uplift.att_weights(_scored(t), _t(), "e"), _t(), ["lag_1", "selling_price", "mu0"], "weight"),
    f"""SELECT name, (avg(v) FILTER (t) - avg(v) FILTER (NOT t)) / sqrt((var_samp(v) FILTER (t) + var_samp(v) FILTER (NOT t)) / 2) AS smd_before,
          (sum(w * v) FILTER (t) / sum(w) FILTER (t) - sum(w * v) FILTER (NOT t) / sum(w) FILTER (NOT t)) / sqrt((var_samp(v) FILTER (t) + var_samp(v) FILTER (NOT t)) / 2) AS smd_after FROM ({BAL}) x GROUP BY name""",
    plain="name", doubles="smd_before smd_after")
add("c12_ipw", lambda t: uplift.ipw(uplift.att_weights(_scored(t), _t(), "e"), _t(), "units", "weight"),
    f"SELECT sum(weight * units) FILTER (treated) / sum(weight) FILTER (treated) - sum(weight * units) FILTER (NOT treated) / sum(weight) FILTER (NOT treated) AS att, count(*) FILTER (treated) AS n_treated, count(*) FILTER (NOT treated) AS n_control FROM {WEIGHTED}",
    whole="n_treated n_control", doubles="att")
add("c13_c14_aipw", lambda t: uplift.aipw(_scored(t), _t(), "units", "mu0", "e"),
    f"""WITH s AS (SELECT product_id, store_id, treated::INT AS t, treated::INT * (units - mu0) - (1 - treated::INT) * e / (1 - e) * (units - mu0) AS s FROM {SCORED}), a AS (SELECT sum(t) AS nt, sum(s) / sum(t) AS att FROM s),
        g AS (SELECT sum(s - t * att) AS g FROM s, a GROUP BY product_id, store_id)
        SELECT (SELECT att FROM a) AS att, sqrt(sum(g * g) * count(*) / (count(*) - 1)) / (SELECT nt FROM a) AS error, count(*) AS clusters FROM g""", whole="clusters", doubles="att error")
add("c16_segment_effects", lambda t: _scored(t).filter(_t()).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("units") - F.col("mu0")).alias("effect"), (F.stddev_samp(F.col("units") - F.col("mu0")) / F.sqrt(F.count(F.lit(1)))).alias("error")),
    f"SELECT product_id, count(*) AS n, avg(units - mu0) AS effect, stddev_samp(units - mu0) / sqrt(count(*)) AS error FROM {SCORED} WHERE treated GROUP BY product_id", plain="product_id", whole="n", doubles="effect error")
add("c17_during_vs_before", lambda t: uplift.during_vs_before(joins.event_windows(t.sales, _qualified(t), 14).join(_qualified(t).select("promotion_id", "start_date"), "promotion_id")),
    f"""SELECT avg(d - b) AS effect, count(*) AS events FROM (SELECT avg(units) FILTER (s.date >= p.start_date) AS d, avg(units) FILTER (s.date < p.start_date) AS b
        FROM {QUALIFIED} p JOIN sales_daily s ON s.product_id = p.product_id AND s.store_id = p.store_id AND s.date BETWEEN p.start_date - 14 AND p.end_date GROUP BY p.promotion_id) WHERE d IS NOT NULL AND b IS NOT NULL""",
    "sales_daily promotions", whole="events", doubles="effect")
add("c19_differences", lambda t: uplift.differences(t.sales, F.substring("product_id", 7, 2).cast("int") % 3 != 0, F.col("date") >= "1996-01-01", "units"),
    """WITH c AS (SELECT CAST(substr(product_id, 7) AS INT) % 3 <> 0 AS t, date >= '1996-01-01' AS p, avg(units) AS m, var_samp(units) AS v, count(*) AS n FROM sales_daily GROUP BY ALL)
       SELECT sum(CASE WHEN t = p THEN m ELSE -m END) AS effect, sqrt(sum(v / n)) AS error, sum(n) AS n FROM c""", whole="n", doubles="effect error")
add("c20_parallel_trends", lambda t: uplift.parallel_trends(t.sales.filter("date < '1996-01-01'").withColumn("day", F.datediff("date", F.to_date(F.lit("1995-01-01")))), F.substring("product_id", 7, 2).cast("int") % 3 != 0, "day", "units"),
    """WITH a AS (SELECT CAST(substr(product_id, 7) AS INT) % 3 <> 0 AS t, units AS y, date_diff('day', DATE '1995-01-01', date) AS x FROM sales_daily WHERE date < '1996-01-01'),
       r AS (SELECT t, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS sse, count(*) AS n FROM a GROUP BY t)
       SELECT sum(CASE WHEN t THEN b ELSE -b END) AS difference, sqrt(sum(sse) / (sum(n) - 4) * sum(1 / sxx)) AS error, sum(n) AS n FROM r""", whole="n", doubles="difference error")
add("c23_bootstrap", lambda t: uplift.bootstrap(t.sales.groupBy("product_id", "store_id").agg(F.sum("gross_profit").alias("num"), F.sum("revenue").alias("den")), 100), None, whole="draws", doubles="lower upper")
add("c24_c25_k04_event_impact", lambda t: uplift.impact(_impact_rows(t)).orderBy(F.col("roi").desc_nulls_last(), "promotion_id"),
    f"""SELECT promotion_id, incremental_units, incremental_units * price AS incremental_revenue, incremental_units * (price - unit_cost) - promotion_spend AS incremental_profit,
          (incremental_units * (price - unit_cost) - promotion_spend) / nullif(promotion_spend, 0) AS roi
        FROM (SELECT p.promotion_id, p.promotion_spend, sum(units - mu0) AS incremental_units, sum(revenue) / sum(units) AS price, sum(cost) / sum(units) AS unit_cost
              FROM {QUALIFIED} p JOIN {SCORED} s ON s.product_id = p.product_id AND s.store_id = p.store_id AND s.date BETWEEN p.start_date AND p.end_date GROUP BY ALL)""",
    "sales_daily promotions", plain="promotion_id", doubles="incremental_units incremental_revenue incremental_profit roi")


def _impact_rows(t):
    rows = joins.event_windows(_scored(t), _qualified(t))
    sums = rows.groupBy("promotion_id").agg(F.sum(F.col("units") - F.col("mu0")).alias("incremental_units"), (F.sum("revenue") / F.sum("units")).alias("price"), (F.sum("cost") / F.sum("units")).alias("unit_cost"))
    return sums.join(_qualified(t).select("promotion_id", "promotion_spend"), "promotion_id")


add("c26_w30_qini", lambda t: uplift.qini(_scored(t), _t(), "selling_price", "units"),
    f"""WITH e AS (SELECT quantile_cont(selling_price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM {SCORED}),
        b AS (SELECT 10 - len(list_filter(q, lambda x: x <= selling_price)) AS bucket, sum(treated::INT) AS nt, sum((NOT treated)::INT) AS nc, sum(treated::INT * units) AS yt, sum((NOT treated)::INT * units) AS yc FROM {SCORED}, e GROUP BY ALL)
        SELECT bucket, sum(nt) OVER w AS nt, sum(nc) OVER w AS nc, sum(yt) OVER w - sum(yc) OVER w * sum(nt) OVER w / sum(nc) OVER w AS gain FROM b WINDOW w AS (ORDER BY bucket)""", whole="bucket nt nc", doubles="gain")


def _economics(t):
    e = metrics.economics(t.sales).withColumnRenamed("units_a_day", "units")
    return e.join(elasticity.fixed_effects(elasticity.clean_panel(t.sales)).select("product_id", F.col("slope").alias("elasticity")), "product_id").withColumn("cross_elasticity", F.lit(0.2))


ECON = f"""(SELECT product_id, avg(selling_price) AS price, sum(units) / count(DISTINCT date) AS units, sum(cost) / sum(units) AS unit_cost, any_value(slope) AS elasticity, 0.2::DOUBLE AS cross_elasticity
  FROM (SELECT s.*, bool_or(NOT promotion_flag) OVER (PARTITION BY product_id) AS plain FROM sales_daily s JOIN (SELECT product_id, max(date) AS edge FROM sales_daily GROUP BY ALL) USING (product_id) WHERE date > edge - 90) r
  JOIN ({FE}) f USING (product_id) WHERE NOT plain OR NOT promotion_flag GROUP BY product_id)"""
GRID = f"""(SELECT *, CASE WHEN new_price < unit_cost OR (new_price - unit_cost) / nullif(new_price, 0) < 0.05 THEN 1 ELSE 0 END AS bad, (new_price - unit_cost) * new_units AS profit
  FROM (SELECT product_id, change, unit_cost, price * (1 + change) AS new_price, units * power(1 + change, elasticity) AS new_units FROM {ECON}, (SELECT -0.3 + 0.6 * i / 20.0 AS change FROM range(21) r(i))))"""
add("d01_price_grid", lambda t: decide.price_grid(_economics(t)).withColumn("bad", F.size("violations") > 0).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("int")).alias("bad"), F.sum("new_units").alias("units"), F.max("margin").alias("margin")),
    f"SELECT product_id, count(*) AS n, sum(bad) AS bad, sum(new_units) AS units, max((new_price - unit_cost) / new_price) AS margin FROM {GRID} GROUP BY product_id", plain="product_id", whole="n bad", doubles="units margin")
add("d02_recommendation", lambda t: decide.recommend(decide.price_grid(_economics(t))),
    f"""SELECT product_id, coalesce(arg_max(change, profit) FILTER (bad = 0), 0) AS change, max(profit) FILTER (bad = 0) AS profit, min(change) FILTER (bad = 0 AND profit >= best - 0.02 * abs(best)) AS low,
          max(change) FILTER (bad = 0 AND profit >= best - 0.02 * abs(best)) AS high, CASE WHEN max(profit) FILTER (bad = 0) IS NULL THEN 'hold' ELSE 'move' END AS action
        FROM (SELECT *, max(CASE WHEN bad = 0 THEN profit END) OVER (PARTITION BY product_id) AS best FROM {GRID}) GROUP BY product_id""", plain="product_id action", doubles="change profit low high")


def _cells(t):
    return t("promotions").groupBy(F.col("product_id").alias("candidate_id")).agg((F.sum("promotion_units") * 10.0).alias("reference_profit"), F.sum("promotion_spend").alias("reference_spend"))


SEGMENTS = """(SELECT candidate_id, 2 * s / 5 AS width, p / s * exp(-3 * (part + 0.5) * 2 / 5) / ((1 - exp(-3)) / 3) AS marginal, part
  FROM (SELECT product_id AS candidate_id, sum(promotion_units) * 10.0::DOUBLE AS p, sum(promotion_spend) AS s FROM promotions GROUP BY ALL), range(5) r(part) WHERE s > 0)"""
add("d03_segments", lambda t: decide.segments(_cells(t)), f"SELECT candidate_id, part, width, marginal FROM {SEGMENTS}", "promotions", plain="candidate_id", whole="part", doubles="width marginal")
add("d04_d05_allocation", lambda t: decide.lines(decide.allocate(decide.segments(_cells(t)), 200_000.0)),
    f"""SELECT candidate_id, sum(spend) AS spend, sum(spend * marginal) AS profit, min(marginal) FILTER (spend > 0) AS marginal_roi, sum(spend * marginal) / nullif(sum(spend), 0) AS roi
        FROM (SELECT *, width * least(greatest((200000 - (sum(width) OVER (ORDER BY marginal DESC) - width)) / width, 0), 1) AS spend FROM {SEGMENTS}) GROUP BY candidate_id""", "promotions", plain="candidate_id", doubles="spend profit marginal_roi roi")


def _projection(t):
    levers = t("products").select("product_id").withColumn("x", F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(v).alias("lever"), F.lit(c).alias("change")) for s, v, c in LEVERS]))).select("product_id", "x.*")
    return decide.project(levers, _economics(t))


LEVERS = (("cheaper", "price", -0.1), ("promoted", "promotion", 0.3), ("promoted", "price", -0.05), ("attacked", "competitor", -0.1), ("odd", "weather", 0.5))
add("d06_d08_scenarios", lambda t: decide.compare(_projection(t)),
    f"""WITH l(scenario, lever, change) AS (VALUES {", ".join(f"('{s}', '{v}', {c})" for s, v, c in LEVERS)}),
        p AS (SELECT scenario, product_id, coalesce(sum(CASE lever WHEN 'price' THEN elasticity * ln(1 + change) WHEN 'promotion' THEN ln(1 + change) WHEN 'competitor' THEN cross_elasticity * ln(1 + change) END), 0) AS effect,
                sum(CASE WHEN lever = 'price' THEN ln(1 + change) ELSE 0 END) AS pe, count(*) FILTER (lever = 'weather') AS na, any_value(units) AS u, any_value(price) AS p, any_value(unit_cost) AS c FROM l, {ECON} GROUP BY ALL)
        SELECT scenario, sum(u * exp(effect) * (p * exp(pe) - c) * 28) AS profit, sum(u * (p - c) * 28) AS baseline_profit, sum(u * exp(effect) * p * exp(pe) * 28) AS revenue,
               sum(u * exp(effect) * (p * exp(pe) - c) * 28) - sum(u * (p - c) * 28) AS gain, sum(na) AS not_applied FROM p GROUP BY scenario""",
    plain="scenario", whole="not_applied", doubles="profit baseline_profit revenue gain")
