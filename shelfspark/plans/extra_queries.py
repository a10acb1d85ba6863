"""Registered queries: writers and readers, sweeps, placebo estimates and remaining reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfspark.functions import scalar
from shelfspark.operators import forecast, joins, metrics, uplift, windows
from shelfspark.operators.windows import KEYS, safe
from shelfspark.plans.catalog import PANEL, W, add, frame
from shelfspark.plans.model_queries import QUALIFIED, ROLES, _qualified
from shelfspark.plans.panel_queries import PRED
from shelfspark.sources import tables as src


def _folder(t) -> str:
    """A new folder in the storage that driver and executors share."""
    root = src.shared_dir(t.spark)
    return f"{root}/written-{uuid.uuid4().hex}"


def _whole(t):
    path = _folder(t)
    rows = src.write_table(t.sales, path)
    return src.read_dir(t.spark, path).groupBy("product_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("units").alias("units")).withColumn("recorded", F.lit(rows))


add("s02_whole_table", _whole, "SELECT product_id, count(*) AS rows, sum(units) AS units, (SELECT count(*) FROM sales_daily) AS recorded FROM sales_daily GROUP BY product_id", plain="product_id", whole="rows units recorded")


def _monthly(t):
    """All months, then those from 1998 once more, which replaces them and leaves the others."""
    path = _folder(t)
    src.write_monthly(t.sales, path)
    src.write_monthly(t.sales.filter("date >= '1998-01-01'").withColumn("units", F.col("units") + 1), path)
    return src.read_dir(t.spark, path)


add("s03_month_partitions", _monthly, "SELECT date, product_id, store_id, units + (date >= '1998-01-01')::INT AS units FROM sales_daily", plain=PANEL, whole="units")


def _extract(t):
    path = _folder(t)
    src.write_sample(t.sales, path, ["date", *KEYS], 50)
    return t.spark.read.option("header", True).csv(path)


add("s04_csv_extract", _extract, "SELECT date, product_id, store_id, units FROM sales_daily ORDER BY date, product_id, store_id LIMIT 50", plain=PANEL, whole="units")
add("s07_columns", lambda t: src.describe({n: t(n) for n in ("lineitem", "part")}),
    "SELECT table_name, column_name, ordinal_position - 1 AS position FROM information_schema.columns WHERE table_name IN ('lineitem', 'part')", "products", plain="table_name column_name", whole="position")
add("f03_equality_filter", lambda t: src.read(t.spark, t.sf_dir, "sales_daily", equal={"store_id": "ASIA", "promotion_flag": True}, most=10_000_000),
    "SELECT date, product_id, units FROM sales_daily WHERE store_id = 'ASIA' AND promotion_flag", plain="date product_id", whole="units")
add("x07_first_available", lambda t: windows.demand_rolling(windows.demand_lags(t.sales)).withColumn("level", scalar.coalesced("lag_364", "rolling_mean_28", "rolling_mean_7", default=-1.0)),
    f"SELECT date, product_id, store_id, coalesce(lag(units, 364) {W}, avg(units) {frame(28)}, avg(units) {frame(7)}, -1) AS level FROM sales_daily", plain=PANEL, doubles="level")


def _scored(t):
    return forecast.seasonal_naive(t.sales)


ERROR = "sum(abs(predicted - units)) / sum(units)"
add("k01_worst_stores", lambda t: _scored(t).groupBy("store_id").agg(*metrics.accuracy()).orderBy(F.col("wmape").desc(), "store_id").limit(15),
    f"SELECT store_id, {ERROR} AS wmape FROM {PRED} GROUP BY store_id ORDER BY wmape DESC, store_id LIMIT 15", plain="store_id", doubles="wmape")
add("k01_largest_errors", lambda t: _scored(t).withColumn("error", F.abs(F.col("predicted") - F.col("units"))).orderBy(F.round("error", 6).desc(), "date", *KEYS).limit(15),
    f"SELECT date, product_id, store_id, abs(predicted - units) AS error FROM {PRED} ORDER BY round(error, 6) DESC, date, product_id, store_id LIMIT 15", plain=PANEL, doubles="error")


def _totals(t):
    """One row a series, with its share of the grand total of predictions."""
    sums = _scored(t).groupBy(*KEYS).agg(F.sum("predicted").alias("predicted"), F.sum("units").alias("units"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("predicted").alias("all_")))).withColumn("share", safe(F.col("predicted"), F.col("all_")))


add("g18_series_totals", _totals,
    f"SELECT product_id, store_id, sum(predicted) AS predicted, sum(units) AS units, sum(predicted) / sum(sum(predicted)) OVER () AS share FROM {PRED} GROUP BY ALL", plain="product_id store_id", whole="units", doubles="predicted share")
add("e12_price_demand_sign", lambda t: scalar.logs(t.sales).groupBy("product_id").agg(F.corr("log_units", "log_price").alias("corr")).withColumn("expected", F.col("corr") < 0),
    "SELECT product_id, corr(ln(units), ln(selling_price)) AS corr, corr(ln(units), ln(selling_price)) < 0 AS expected FROM sales_daily WHERE units > 0 AND selling_price > 0 GROUP BY product_id", plain="product_id expected", doubles="corr")


def _controls(t):
    """Per event its controls: rows of its listing with the role control, 30 days to either side."""
    rows = uplift.roles(t.sales, _qualified(t)).filter("role = 'control'").select(*KEYS, "date", "units")
    return joins.event_windows(rows, _qualified(t), 30, 30).groupBy("promotion_id").agg(F.count(F.lit(1)).alias("rows"), F.avg("units").alias("mean_units"))


add("j25_event_controls", _controls,
    f"""SELECT q.promotion_id, count(*) AS rows, avg(r.units) AS mean_units FROM {QUALIFIED} q JOIN {ROLES} r ON r.product_id = q.product_id AND r.store_id = q.store_id
        AND r.date BETWEEN q.start_date - 30 AND q.end_date + 30 WHERE r.role = 'control' GROUP BY q.promotion_id""", "sales_daily promotions", plain="promotion_id", whole="rows", doubles="mean_units")


def _gap(rows):
    return rows.agg((F.avg(F.when(F.col("role") == "treated", F.col("units"))) - F.avg(F.when(F.col("role") == "control", F.col("units")))).alias("gap"))


def _window_sweep(t):
    """The gap of treated rows and controls within so many days of an event, and the spread."""
    q, out = _qualified(t), None
    rows = uplift.roles(t.sales, q)
    near = joins.days_to_nearest(rows.filter("role = 'control'"), q).select(*KEYS, "date", "nearest")
    rows = rows.join(near, [*KEYS, "date"], "left")
    for days in (21, 45, 90):
        part = _gap(rows.filter((F.col("role") == "treated") | (F.col("nearest") <= days))).select(F.lit(days).alias("days"), "gap")
        out = part if out is None else out.unionByName(part)
    ends = out.agg((F.max("gap") - F.min("gap")).alias("spread"))
    return out.crossJoin(F.broadcast(ends))  # one row


NEAR = f"""(SELECT r.*, (SELECT min(CASE WHEN r.date > q.end_date THEN r.date - q.end_date WHEN r.date < q.start_date THEN q.start_date - r.date ELSE 0 END) FROM {QUALIFIED} q
  WHERE q.product_id = r.product_id AND q.store_id = r.store_id) AS nearest FROM {ROLES} r)"""
add("c22_window_sweep", _window_sweep,
    f"""WITH n AS (SELECT * FROM {NEAR}), g AS (SELECT d AS days, avg(units) FILTER (role = 'treated') - avg(units) FILTER (role = 'control' AND nearest <= d) AS gap FROM n, (SELECT unnest([21, 45, 90]) AS d) GROUP BY d)
        SELECT days, gap, max(gap) OVER () - min(gap) OVER () AS spread FROM g""", "sales_daily promotions", whole="days", doubles="gap spread")


def _placebo(t):
    """The gap for events moved 30 days back, on rows no event touches, against that of the events."""
    q = _qualified(t)
    moved = q.withColumns({"start_date": F.date_sub("start_date", 30), "end_date": F.date_sub("end_date", 30)})
    real, placebo = _gap(uplift.roles(t.sales, q)), _gap(uplift.roles(t.sales.filter("not promotion_flag"), moved))
    both = real.withColumnRenamed("gap", "effect").crossJoin(F.broadcast(placebo.withColumnRenamed("gap", "placebo")))  # one row each
    return both.withColumn("ratio", safe(F.col("placebo"), F.col("effect"))).withColumn("passed", F.abs("ratio") <= 0.05)


MOVED = ROLES.replace(QUALIFIED, f"(SELECT promotion_id, product_id, store_id, start_date - 30 AS start_date, end_date - 30 AS end_date FROM {QUALIFIED})").replace(
    "FROM sales_daily s ASOF", "FROM (SELECT * FROM sales_daily WHERE NOT promotion_flag) s ASOF")
GAP = "SELECT avg(units) FILTER (role = 'treated') - avg(units) FILTER (role = 'control') AS gap FROM "
add("c21_placebo_ratio", _placebo,
    f"SELECT e.gap AS effect, p.gap AS placebo, p.gap / nullif(e.gap, 0) AS ratio, abs(p.gap / nullif(e.gap, 0)) <= 0.05 AS passed FROM ({GAP} {ROLES}) e, ({GAP} {MOVED}) p", "sales_daily promotions", plain="passed", doubles="effect placebo ratio")
