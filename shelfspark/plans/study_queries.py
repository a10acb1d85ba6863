"""Registered queries: limited budgets, specification sweeps, importance, effect models, relationship
tests and exact tail probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import scalar
from shelfspark.operators import decide, effects, elasticity, explain, horizon, metrics, models, recovery, uplift, windows
from shelfspark.operators.windows import KEYS, series
from shelfspark.plans.catalog import add
from shelfspark.plans.check_queries import FESTIVAL, SPAN
from shelfspark.plans.feature_queries import GRID
from shelfspark.plans.model_queries import CROSS, QUALIFIED, ROLES, SCORED, _cross, _qualified, _scored
from shelfspark.plans.uplift_queries import COVARIATES, PSEUDO, _pseudo


def student_sql(t: str, freedom: str) -> str:
    """Two-sided p of Student's t in DuckDB, by Simpson's rule over the angle."""
    angle = f"atan(abs({t}) / sqrt({freedom}))"
    weights = "CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"""(1 - 2 * exp(lgamma(({freedom} + 1) / 2.0) - lgamma({freedom} / 2.0)) / sqrt(pi()) * {angle} / 1200
      * list_sum(list_transform(range(401), lambda i: ({weights}) * power(cos({angle} * i / 400.0), {freedom} - 1))))"""


# ---- a budget with floors and caps ----

LIMITS = (("ASIA", 40_000.0, None), ("EUROPE", None, 5_000.0), ("AFRICA", 2_000.0, 20_000.0), ("MARS", 100.0, None))
BUDGET = 100_000.0


def _store_cells(t):
    return t("promotions").groupBy(F.concat_ws("|", *KEYS).alias("candidate_id"), "store_id").agg(
        (F.sum("promotion_units") * 10.0).alias("reference_profit"), F.sum("promotion_spend").alias("reference_spend"))


def _limits(t):
    return t.spark.createDataFrame(list(LIMITS), "store_id string, least double, most double")


def _limited(t):
    return decide.allocate_limited(decide.segments(_store_cells(t)), BUDGET, _limits(t), "store_id")


def _number(x) -> str:
    return "NULL" if x is None else str(x)


LIMITED = f"""
WITH l(store_id, least, most) AS (VALUES {", ".join(f"('{s}', {_number(a)}::DOUBLE, {_number(b)}::DOUBLE)" for s, a, b in LIMITS)}),
seg AS (SELECT candidate_id, store_id, 2 * s / 5 AS width, p / s * exp(-3 * (part + 0.5) * 2 / 5) / ((1 - exp(-3)) / 3) AS marginal
        FROM (SELECT concat_ws('|', product_id, store_id) AS candidate_id, store_id, sum(promotion_units) * 10.0::DOUBLE AS p, sum(promotion_spend) AS s FROM promotions GROUP BY ALL),
             range(5) r(part) WHERE s > 0),
lev AS (SELECT store_id, marginal, sum(width) AS size FROM seg GROUP BY ALL),
run AS (SELECT *, sum(size) OVER (PARTITION BY store_id ORDER BY marginal DESC) - size AS start FROM lev),
cut AS (SELECT run.*, coalesce(most, 1e300) AS cap, least(coalesce(least, 0), coalesce(most, 1e300)) AS floor FROM run LEFT JOIN l USING (store_id)),
held AS (SELECT *, least(greatest(floor - start, 0), size) AS held, least(greatest(cap - start, 0), size) AS upto FROM cut),
free AS (SELECT *, CASE WHEN marginal > 0 THEN upto - held ELSE 0 END AS open, sum(held) OVER () AS all_held FROM held),
fill AS (SELECT marginal, sum(open) AS level, any_value(all_held) AS all_held FROM free GROUP BY marginal HAVING sum(open) > 0),
part AS (SELECT marginal, least(greatest((greatest({BUDGET} - all_held, 0) - (sum(level) OVER (ORDER BY marginal DESC) - level)) / level, 0), 1) AS share FROM fill),
paid AS (SELECT store_id, free.marginal, (held * least(1, {BUDGET} / all_held) + open * coalesce(share, 0)) / size AS funded FROM free LEFT JOIN part USING (marginal)),
lines AS (SELECT candidate_id, seg.store_id, width, width * funded AS spend, width * funded * marginal AS profit FROM seg JOIN paid USING (store_id, marginal))"""
add("d04_limited_allocation", lambda t: decide.lines(_limited(t)),
    f"{LIMITED} SELECT candidate_id, sum(spend) AS spend, sum(profit) AS profit FROM lines GROUP BY candidate_id", "promotions", plain="candidate_id", doubles="spend profit")
add("d04_limit_report", lambda t: decide.limit_report(_limited(t), _limits(t), "store_id"),
    f"""{LIMITED}, s AS (SELECT store_id, sum(width) AS capacity, sum(spend) AS spend FROM lines GROUP BY store_id)
    SELECT store_id, least, most, capacity, spend, CASE WHEN capacity IS NULL THEN 'unmatched' WHEN spend < least - 1e-6 THEN 'infeasible' WHEN spend >= most - 1e-6 THEN 'at_cap'
           WHEN spend <= least + 1e-6 THEN 'at_floor' ELSE 'inside' END AS status FROM l LEFT JOIN s USING (store_id)""",
    "promotions", plain="store_id status", doubles="least most capacity spend")

# ---- the estimator under ten specifications ----

ROLES_0 = ROLES.replace("BETWEEN 1 AND 10", "BETWEEN 1 AND 0")
SWEEP = f"""
WITH q AS MATERIALIZED (SELECT * FROM {QUALIFIED}),
c AS MATERIALIZED (SELECT date, product_id, store_id, role, units, demand_mean_28 FROM {COVARIATES.replace(ROLES, ROLES_0)} WHERE role IN ('treated', 'control') AND demand_mean_28 IS NOT NULL),
n AS (SELECT c.date, c.product_id, c.store_id, min(CASE WHEN c.date > q.end_date THEN c.date - q.end_date WHEN c.date < q.start_date THEN q.start_date - c.date ELSE 0 END) AS nearest,
             min(c.date - q.end_date) FILTER (q.end_date <= c.date) AS since
      FROM c LEFT JOIN q USING (product_id, store_id) GROUP BY ALL),
spec(spec, parameter, washout, win, trim) AS (VALUES {", ".join(f"({i}, '{p}', {w}, {d}, {e})" for i, (p, w, d, e) in enumerate(effects.SPECIFICATIONS))}),
tagged AS (SELECT spec, trim, product_id, store_id, date_trunc('quarter', date) AS quarter, (role = 'treated')::INT AS t, units::DOUBLE AS y, demand_mean_28 AS x
           FROM c JOIN n USING (date, product_id, store_id), spec WHERE role = 'treated' OR ((since IS NULL OR since > washout) AND nearest <= win)),
cell AS (SELECT spec, trim, product_id, store_id, quarter, sum(t) AS nt, sum(1 - t) AS nc FROM tagged GROUP BY ALL),
kept AS (SELECT tagged.*, nt / (nt + nc) AS e FROM tagged JOIN cell USING (spec, product_id, store_id, quarter) WHERE nt / (nt + nc) BETWEEN cell.trim AND 1 - cell.trim),
fit AS (SELECT spec, product_id, CASE WHEN var_pop(x) > 1e-12 THEN regr_slope(y, x) ELSE 0 END AS b, avg(y) AS my, avg(x) AS mx FROM kept WHERE t = 0 GROUP BY ALL),
score AS (SELECT spec, product_id, store_id, t, my + b * (x - mx) AS mu, (y - my - b * (x - mx)) * CASE WHEN t = 1 THEN 1 ELSE -e / (1 - e) END AS s FROM kept JOIN fit USING (spec, product_id)),
tot AS (SELECT spec, sum(s) / sum(t) AS att, sum(s) / sum(mu * t) AS att_share, sum(t) AS n_treated, sum(1 - t) AS n_control FROM score GROUP BY spec),
g AS (SELECT spec, sum(s - t * att) AS g FROM score JOIN tot USING (spec) GROUP BY spec, product_id, store_id),
err AS (SELECT spec, sqrt(sum(g * g) * count(*) / (count(*) - 1)) AS e FROM g GROUP BY spec)
SELECT parameter, washout, win AS control_window, trim, att, e / n_treated AS error, att_share, n_treated, n_control, max(att_share) OVER () - min(att_share) OVER () AS spread,
       (max(att_share) OVER () - min(att_share) OVER ()) / abs(max(att_share) FILTER (washout = 10 AND win = 45 AND trim = 0.02) OVER ()) AS relative_spread
FROM tot JOIN err USING (spec) JOIN spec USING (spec)"""


def _sweep(t):
    q = _qualified(t)
    return effects.sweep(effects.sweep_rows(uplift.covariates(uplift.roles(t.sales, q, 0), q), t.sales, q))


add("c22_estimator_sweep", _sweep, SWEEP, "sales_daily promotions", plain="parameter", whole="washout control_window n_treated n_control", doubles="trim att error att_share spread relative_spread")
add("c07_overlap", lambda t: effects.overlap(_scored(t), F.col("treated"), "e").crossJoin(models.auc(effects.trimmed(_scored(t), "e"), F.col("treated"), "e")),
    f"""WITH s AS (SELECT treated AS t, e FROM {SCORED}), w AS (SELECT *, max(e) FILTER (NOT t) OVER () AS top_c, min(e) FILTER (t) OVER () AS low_t FROM s),
        k AS (SELECT t, e FROM s WHERE e BETWEEN 0.02 AND 0.98),
        c AS (SELECT e, sum(t::INT) AS p, sum((NOT t)::INT) AS n FROM k GROUP BY e), r AS (SELECT *, sum(n) OVER (ORDER BY e) - n AS below FROM c)
        SELECT count(*) AS rows, avg((NOT e BETWEEN 0.02 AND 0.98)::INT) AS trimmed_share, avg(((t AND e > top_c) OR (NOT t AND e < low_t))::INT) AS off_support,
               count(*) FILTER (t AND e BETWEEN 0.02 AND 0.98) AS effective_treated,
               (SELECT sum(e / (1 - e)) ** 2 / sum((e / (1 - e)) ** 2) FROM k WHERE NOT t) AS effective_control, (SELECT sum(p * (below + n / 2)) / (sum(p) * sum(n)) FROM r) AS auc FROM w""",
    whole="rows effective_treated", doubles="trimmed_share off_support effective_control auc")

# ---- importance by horizon and family ----

FEATURES = ("lag_1", "rolling_mean_7", "rolling_mean_28", "season", "origin_units")
WEIGHTS = {"lag_1": 0.2, "rolling_mean_7": 0.1, "rolling_mean_28": 0.3, "season": 0.4}
FAMILY = {"lag_1": "recent history", "rolling_mean_7": "recent history", "rolling_mean_28": "recent history", "season": "seasonal anchor"}
BLOCKS, SEEDS = 4, ("1", "2")


def _linear(df):
    """A fixed linear forecast; it makes no use of origin_units."""
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = out + weight * F.col(name)
    return df.withColumn("predicted", out)


def _importance(t):
    rows = horizon.seasonal(horizon.dataset(t.sales), t.sales).drop("predicted").filter("season is not null")
    return explain.permutation_importance(rows, _linear, list(FEATURES), [*KEYS, "origin_date", "step"], "target_units", "bucket", BLOCKS, SEEDS)


def _hash_sql(salt: str) -> str:
    return f"md5(concat_ws('|', product_id, store_id, origin_date::VARCHAR, step::VARCHAR, seed || '{salt}'))"


NAMES = {"rolling_mean_7": "m7", "rolling_mean_28": "m28"}
SCORE = {f: " + ".join(f"{w} * {'o' if c == f else 'r'}.{NAMES.get(c, c)}" for c, w in WEIGHTS.items()) for f in ("", *FEATURES)}
IMPORTANCE = f"""
WITH seeds(seed) AS (VALUES {", ".join(f"('{s}')" for s in SEEDS)}),
base AS MATERIALIZED (SELECT *, ('0x' || substr({_hash_sql('block')}, 1, 8))::BIGINT % {BLOCKS} AS block, {_hash_sql('a')} AS a, {_hash_sql('b')} AS b FROM {GRID} g, seeds WHERE season IS NOT NULL),
own AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seed, bucket, block ORDER BY a) AS taker, row_number() OVER (PARTITION BY seed, bucket, block ORDER BY b) AS giver FROM base),
scored AS (SELECT r.seed, r.bucket, r.target_units AS y, {", ".join(f'{SCORE[f]} AS p{i}' for i, f in enumerate(SCORE))}
           FROM own r JOIN own o ON o.seed = r.seed AND o.bucket = r.bucket AND o.block = r.block AND o.giver = r.taker),
errors AS (SELECT seed, bucket, {", ".join(f'sum(abs(p{i} - y)) / sum(y) AS w{i}' for i in range(len(SCORE)))}, count(*) AS n FROM scored GROUP BY ALL),
importance AS ({" UNION ALL ".join(f"SELECT bucket, '{f}' AS feature, avg(w{i} - w0) AS importance, stddev_pop(w{i} - w0) AS deviation, avg(w0) AS baseline, max(n) AS n FROM errors GROUP BY bucket" for i, f in enumerate(SCORE) if f)})"""
IN_FAMILY = f"CASE {' '.join(f'''WHEN feature = '{f}' THEN '{g}' ''' for f, g in FAMILY.items())} ELSE 'other' END"
FAMILY_SQL = f"(SELECT {IN_FAMILY} AS family, bucket, sum(importance) AS importance, sum(importance) / sum(sum(importance)) OVER (PARTITION BY bucket) AS share FROM importance GROUP BY 1, 2)"
add("b19_importance", _importance, f"{IMPORTANCE} SELECT * FROM importance", plain="bucket feature", whole="n", doubles="importance deviation baseline")
add("g25_family_importance", lambda t: explain.families(_importance(t), FAMILY, "bucket"), f"{IMPORTANCE} SELECT * FROM {FAMILY_SQL}", plain="family bucket", doubles="importance share")
add("g25_recent_decay", lambda t: explain.decay(explain.families(_importance(t), FAMILY, "bucket"), "bucket"),
    f"""{IMPORTANCE} SELECT bucket, sum(share) FILTER (family = 'recent history') AS recent_history_share, sum(share) FILTER (family = 'seasonal anchor') AS seasonal_anchor_share
    FROM {FAMILY_SQL} GROUP BY bucket""", plain="bucket", doubles="recent_history_share seasonal_anchor_share")

# ---- a cross-fitted effect model ----

XS = ["lag_1", "selling_price"]
FOLD = "('0x' || substr(md5(concat_ws('|', product_id, store_id, '7')), 1, 8))::BIGINT % 5"
LINES = f"""
WITH p AS MATERIALIZED (SELECT *, {FOLD} AS fold FROM {PSEUDO} WHERE lag_1 IS NOT NULL),
f AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS f),
s AS (SELECT f, avg(lag_1) AS m1, avg(selling_price) AS m2, avg(pseudo) AS my, var_pop(lag_1) AS v1, var_pop(selling_price) AS v2, covar_pop(lag_1, selling_price) AS v12,
             covar_pop(lag_1, pseudo) AS y1, covar_pop(selling_price, pseudo) AS y2 FROM f, p WHERE fold <> f GROUP BY f),
b AS (SELECT *, (y1 * v2 - y2 * v12) / (v1 * v2 - v12 * v12) AS b1, (y2 * v1 - y1 * v12) / (v1 * v2 - v12 * v12) AS b2 FROM s)"""


def _effect_model(t):
    return effects.fit_effects(models.folds(_pseudo(t)), XS)


def _out_of_fold(t):
    rows = models.folds(_pseudo(t))
    return effects.fit_effects(rows, XS).out_of_fold(rows.dropna(subset=XS))


def _new_plans(t):
    """Unseen plans: a fortnight of each listing at a tenth under its highest regular price."""
    return t.sales.groupBy(*KEYS).agg(F.max_by("units", "date").alias("lag_1"), (0.9 * F.max("regular_price")).alias("selling_price")).withColumn("days", F.lit(14))


add("c15_cross_fitted_cate", lambda t: _out_of_fold(t).groupBy(*KEYS).agg(F.avg("cate").alias("cate"), F.count(F.lit(1)).alias("n")),
    f"{LINES} SELECT product_id, store_id, avg(my + b1 * (lag_1 - m1) + b2 * (selling_price - m2)) AS cate, count(*) AS n FROM p JOIN b ON f = fold GROUP BY ALL", plain="product_id store_id", whole="n", doubles="cate")
add("c15_cross_fitted_att", lambda t: effects.att(_out_of_fold(t), F.col("treated")),
    f"{LINES} SELECT avg(my + b1 * (lag_1 - m1) + b2 * (selling_price - m2)) AS att, stddev_samp(pseudo) / sqrt(count(*)) AS error, count(*) AS n FROM p JOIN b ON f = fold WHERE treated", whole="n", doubles="att error")
add("c31_scored_plans", lambda t: _effect_model(t).predict(_new_plans(t)),
    f"""{LINES}, n AS (SELECT product_id, store_id, arg_max(units, date) AS lag_1, 0.9::DOUBLE * max(regular_price) AS price FROM sales_daily GROUP BY ALL)
        SELECT product_id, store_id, my + b1 * (lag_1 - m1) + b2 * (price - m2) AS cate, 14 * (my + b1 * (lag_1 - m1) + b2 * (price - m2)) AS uplift, false AS unknown FROM n, b WHERE f = -1""",
    plain="product_id store_id unknown", doubles="cate uplift")

# ---- relationships of the panel ----


def _relationships(t):
    expected = F.avg(F.when(~F.col("stockout_flag"), F.col("units"))).over(series())
    plain = F.avg(F.when(~F.col("promotion_flag"), F.col("units"))).over(series())
    sales = t.sales
    region = t("stores").select("store_id", "region")
    # the stores of one region against those of the other
    ours = sales.join(region.filter("region = 'R0'"), "store_id", "left_semi")
    theirs = t("competitor_pricing").join(region.filter("region = 'R1'").withColumnRenamed("store_id", "competitor_id"), "competitor_id", "left_semi")
    out = recovery.stockout_suppression(sales, expected)
    for part in (recovery.competitor_effect(ours, theirs), recovery.festival_lift(sales, scalar.calendar_of(scalar.days_of(sales))), recovery.regional_spread(sales, t("stores")),
                 recovery.price_direction(sales), recovery.depth_response(sales, plain, F.col("promotion_type"))):
        out = out.unionByName(part)
    return out


def _typed(t):
    """Sales with the band of the day's discount."""
    return t.sales.withColumn("promotion_type", F.when(F.col("discount_percentage") >= 9, "deep").when(F.col("discount_percentage") >= 8, "middle").otherwise("light"))


class _WithTypes:
    """The tables, whose sales carry the band of the discount."""

    def __init__(self, t):
        self.t, self.sales, self.spark = t, _typed(t), t.spark

    def __call__(self, name):
        return self.t(name)


RELATIONS = f"""
WITH s AS (SELECT *, avg(units) FILTER (NOT stockout_flag) OVER w AS expected, avg(units) FILTER (NOT promotion_flag) OVER w AS base FROM sales_daily WINDOW w AS (PARTITION BY product_id, store_id)),
festivals AS (SELECT date, {FESTIVAL} AS f FROM {SPAN}),
l AS (SELECT product_id, date_trunc('month', date) AS m, ln(units) AS y, ln(own) AS p, ln(rival) AS q
      FROM (SELECT date, product_id, sum(units) AS units, avg(selling_price) AS own FROM sales_daily JOIN stores USING (store_id) WHERE region = 'R0' AND units > 0 GROUP BY ALL)
      JOIN (SELECT date, product_id, avg(competitor_effective_price) AS rival FROM competitor_pricing JOIN stores ON store_id = competitor_id WHERE region = 'R1' GROUP BY ALL) USING (date, product_id) WHERE rival > 0),
l1 AS (SELECT m, y - avg(y) OVER w AS y, p - avg(p) OVER w AS p, q - avg(q) OVER w AS q FROM l WINDOW w AS (PARTITION BY product_id)),
l2 AS (SELECT y - avg(y) OVER w AS y, p - avg(p) OVER w AS p, q - avg(q) OVER w AS q FROM l1 WINDOW w AS (PARTITION BY m)),
c AS (SELECT sum(p * p) AS pp, sum(q * q) AS qq, sum(p * q) AS pq, sum(p * y) AS py, sum(q * y) AS qy, count(*) AS n FROM l2),
d AS (SELECT product_id, regr_sxy(ln(units), ln(selling_price)) AS sxy, regr_sxx(ln(units), ln(selling_price)) AS sxx, count(*) AS n FROM sales_daily WHERE units > 0 AND selling_price > 0 GROUP BY ALL),
band AS (SELECT CASE WHEN discount_percentage >= 9 THEN 'deep' WHEN discount_percentage >= 8 THEN 'middle' ELSE 'light' END AS band, avg(units / nullif(base, 0)) AS lift, avg(discount_percentage) AS depth, count(*) AS n
         FROM s WHERE promotion_flag GROUP BY ALL),
r AS (SELECT region, avg(units) AS m, count(*) AS n FROM sales_daily JOIN stores USING (store_id) GROUP BY region),
found AS (
  SELECT 'stockouts_suppress_sales' AS relationship, (1 - sum(units) FILTER (stockout_flag) / sum(expected) FILTER (stockout_flag)) - (1 - sum(units) FILTER (NOT stockout_flag) / sum(expected) FILTER (NOT stockout_flag)) AS observed,
         0 AS threshold, count(*) FILTER (stockout_flag) AS n, 1 AS least_n FROM s WHERE expected IS NOT NULL
  UNION ALL SELECT 'competitor_price_raises_demand', (qy - pq * py / pp) / (qq - pq * pq / pp), 0, n, 200 FROM c
  UNION ALL SELECT 'festival_demand_peak', avg(units) FILTER (f) / avg(units) FILTER (NOT f) - 1, 0.05, count(*), 1 FROM sales_daily JOIN festivals USING (date)
  UNION ALL SELECT 'regional_variation', max(m) / min(m), 1.1, sum(n), 1 FROM r
  UNION ALL SELECT 'price_lowers_demand', -sum(sxy) / sum(sxx), 0, sum(n), 500 FROM d
  UNION ALL SELECT 'deeper_discounts_lift_more', arg_max(lift, depth) - arg_min(lift, depth), 0, sum(n), 1 FROM band)
SELECT relationship, observed, threshold, n, coalesce(observed > threshold AND n >= least_n, false) AS passed FROM found"""
add("e12_relationships", lambda t: _relationships(_WithTypes(t)), RELATIONS, "sales_daily competitor_pricing stores", plain="relationship passed", whole="n", doubles="observed threshold")

# ---- tail probabilities ----

KINDS = f"""SELECT product_a, product_b, n, other, p_adjusted, CASE WHEN p_adjusted > 0.05 OR abs(other) < 0.1 THEN 'unrelated' WHEN other > 0 THEN 'substitute' ELSE 'complement' END AS kind,
  CASE WHEN p_adjusted > 0.05 OR abs(other) < 0.1 THEN 'none' WHEN abs(other) >= 0.3 THEN 'strong' ELSE 'weak' END AS strength
FROM (SELECT *, min(least(p * m / k, 1)) OVER (PARTITION BY product_a ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS p_adjusted
      FROM (SELECT *, row_number() OVER (PARTITION BY product_a ORDER BY p, product_b) AS k, count(*) OVER (PARTITION BY product_a) AS m
            FROM (SELECT *, {student_sql('t', '(n - 2)')} AS p FROM ({CROSS}))))"""
add("e11_adjusted_relationships", lambda t: elasticity.relationships(_cross(t)), KINDS, "sales_daily relationships", plain="product_a product_b kind strength", whole="n", doubles="p_adjusted other")


def _trend_rows(t):
    """Days of the 56 before the first event, in listings with events and in those without."""
    q = _qualified(t)
    first = q.agg(F.min("start_date").alias("first"))
    ever = q.select(*KEYS).distinct().withColumn("ever", F.lit(True))
    rows = t.sales.crossJoin(F.broadcast(first)).filter(F.datediff("first", "date").between(1, 56))  # one row
    return rows.join(ever, list(KEYS), "left").withColumns({"ever": F.coalesce("ever", F.lit(False)), "day": F.datediff("date", "first")})


add("c20_trend_test", lambda t: uplift.parallel_trends(_trend_rows(t), F.col("ever"), "day", "units"),
    f"""WITH f AS (SELECT min(start_date) AS first FROM {QUALIFIED}),
        a AS (SELECT (product_id, store_id) IN (SELECT (product_id, store_id) FROM {QUALIFIED}) AS t, units AS y, date_diff('day', first, date) AS x FROM sales_daily, f WHERE date_diff('day', date, first) BETWEEN 1 AND 56),
        r AS (SELECT t, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS sse, count(*) AS n FROM a GROUP BY t),
        d AS (SELECT sum(CASE WHEN t THEN b ELSE -b END) AS difference, sqrt(sum(sse) / (sum(n) - 4) * sum(1 / sxx)) AS error, sum(n) AS n FROM r),
        p AS (SELECT *, difference / error AS t, {student_sql('(difference / error)', '(n - 4)')} AS p FROM d)
        SELECT *, p > 0.05 AS parallel FROM p""", "sales_daily promotions", plain="parallel", whole="n", doubles="difference error t p")
DRAWS = 100
add("c23_series_bootstrap", lambda t: uplift.bootstrap(t.sales.groupBy(*KEYS).agg(F.sum("gross_profit").alias("num"), F.sum("revenue").alias("den")), DRAWS),
    f"""WITH s AS (SELECT product_id, store_id, sum(gross_profit) AS num, sum(revenue) AS den FROM sales_daily GROUP BY ALL),
        u AS (SELECT *, ('0x' || substr(md5(concat_ws('|', product_id, store_id, d::VARCHAR, '5')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s, range(1, {DRAWS + 1}) r(d)),
        w AS (SELECT *, len(list_filter(range(8), lambda k: list_sum(list_transform(range(k + 1), lambda j: exp(-1) / gamma(j + 1.0))) <= u)) AS w FROM u),
        x AS (SELECT d, sum(w * num) / sum(w * den) AS x FROM w GROUP BY d)
        SELECT quantile_cont(x, 0.025) AS lower, quantile_cont(x, 0.975) AS upper, count(x) AS draws FROM x""", whole="draws", doubles="lower upper")


def _psi_sql(feature: str) -> str:
    return f"""(WITH e AS (SELECT list_distinct(quantile_cont({feature}::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM sales_daily WHERE date < '1999-01-01'),
       b AS (SELECT len(list_filter(q, lambda x: x < {feature})) AS bin, sum((date < '1999-01-01')::INT) AS a, sum((date >= '1999-01-01')::INT) AS b FROM sales_daily, e GROUP BY ALL),
       s AS (SELECT sum((greatest(b / nb, 1e-6) - greatest(a / na, 1e-6)) * ln(greatest(b / nb, 1e-6) / greatest(a / na, 1e-6))) AS psi FROM b, (SELECT sum(a) AS na, sum(b) AS nb FROM b))
       SELECT '{feature}' AS feature, psi, CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'minor' ELSE 'none' END AS severity FROM s)"""


def _drift(t):
    old = F.col("date") < "1999-01-01"
    return metrics.psi(t.sales, "selling_price", old).unionByName(metrics.psi(t.sales, "units", old)).orderBy(F.col("psi").desc())


add("k06_feature_drift", _drift, f"SELECT * FROM {_psi_sql('selling_price')} UNION ALL SELECT * FROM {_psi_sql('units')}", plain="feature severity", doubles="psi")
