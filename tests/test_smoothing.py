"""Smoothing with a hold-out, calibration of thinned origins and totals, windows, trade cells."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from shelfspark.operators import horizon, sampling, smoothing, uplift
from shelfspark.sources import tables as src

SUNDAY = dt.date(2020, 1, 5)


def by_hand(ys, seasonal):
    """The forecasts of the last weeks, by a plain loop."""
    train, m = ys[:-12], 52 if seasonal else 1
    level = sum(train[:52]) / 52 if seasonal else train[0]
    trend, season = 0.0, [y - level for y in train[:52]] if seasonal else [0.0]
    for i in range(m, len(train)):
        head = season[i - m] if seasonal else 0.0
        new = 0.3 * (train[i] - head) + 0.7 * (level + trend)
        trend, level = 0.1 * (new - level) + 0.9 * trend, new
        season.append(0.2 * (train[i] - new) + 0.8 * head if seasonal else 0.0)
    return [max(level + h * trend + (season[len(train) - m + h - 1] if seasonal else 0.0), 0.0) for h in range(1, 13)]


def test_held_out_weeks(spark):
    rng = random.Random(3)
    made = {"long": 150, "short": 60, "edge": 38, "edge_season": 116, "few": 37, "falls": 45}
    ys = {k: [float(rng.randint(0, 90)) + 40 * math.sin(i / 8) for i in range(n)] for k, n in made.items()}
    ys["falls"] = [100.0 - 3 * i if i < 33 else 0.0 for i in range(45)]
    rows = [("x", k, SUNDAY + dt.timedelta(7 * i), y) for k, v in ys.items() for i, y in enumerate(v)]
    held = smoothing.held_out(spark.createDataFrame(rows, "level string, key string, week date, units double"))
    got = {}
    for r in held.orderBy("key", "week").collect():
        got.setdefault((r.key, r.seasonal, r.weeks), []).append((r.week, r.units, r.predicted))
    assert set(got) == {("long", True, 150), ("short", False, 60), ("edge", False, 38), ("edge_season", True, 116), ("falls", False, 45)}
    for (key, seasonal, n), found in got.items():
        assert [u for _, u, _ in found] == ys[key][-12:] and found[-1][0] == SUNDAY + dt.timedelta(7 * (n - 1))
        for (_, _, p), want in zip(found, by_hand(ys[key], seasonal), strict=True):
            assert abs(p - want) < 1e-9
    assert min(p for _, _, p in got["falls", False, 45]) == 0.0


def test_a_season_is_learnt(spark):
    rows = [("x", "k", SUNDAY + dt.timedelta(7 * i), 100.0 + 50 * math.sin(2 * math.pi * i / 52)) for i in range(220)]
    report = smoothing.report(smoothing.held_out(spark.createDataFrame(rows, "level string, key string, week date, units double"))).first()
    assert report.seasonal and report.n == 12 and report.wmape < 1e-9


def test_level_weeks(spark):
    rows = [(dt.date(2020, 1, 1), "c", "r", 1), (dt.date(2020, 1, 5), "c", "s", 2), (dt.date(2020, 1, 20), None, "r", 4), (None, "c", "r", 8), (dt.date(2020, 1, 21), "c", "r", None)]
    df = spark.createDataFrame(rows, "date date, category string, region string, units int")
    got = {(r.level, r.key, r.week.day): r.units for r in smoothing.level_weeks(df).collect()}
    assert {k: v for k, v in got.items() if k[0] == "total"} == {("total", "all", 5): 3, ("total", "all", 12): 0, ("total", "all", 19): 0, ("total", "all", 26): 4}
    assert got["region", "r", 5] == 1 and got["region", "r", 26] == 4 and got["region", "s", 5] == 2
    assert got["category", "unknown", 26] == 4 and got["category", "c", 26] == 0 and got["category_region", "unknown|r", 26] == 4
    empty = smoothing.level_weeks(df.limit(0))
    assert empty.count() == 0 and smoothing.by_level(smoothing.held_out(empty)).count() == 0


FORECASTS = "product_id string, store_id string, origin_date date, step int, bucket string, target_units int, predicted double"


def test_calibration_of_thinned_origins(spark):
    day = dt.date(2020, 1, 1)
    # residuals of origins a week apart; every other one is thinned away and holds wild values
    rows = [(f"p{p}", "s", day + dt.timedelta(7 * o), step, "near" if step < 3 else "far", 100 + (p if o % 2 == 0 else 5000), 100.0) for p in range(10) for o in range(8) for step in (1, 2, 30)]
    rows += [("p0", "s", day, 31, "far", None, 100.0), ("p0", "s", day, 32, "far", 7, None)]
    df = spark.createDataFrame(rows, FORECASTS)
    assert sorted(r.origin_date for r in horizon.thinned(df, 14).select("origin_date").distinct().collect()) == [day + dt.timedelta(14 * i) for i in range(4)]
    got = {r.bucket: r for r in horizon.calibration(df, 14, least=40).collect()}
    assert {b: (r.n, r.pooled) for b, r in got.items()} == {"near": (80, False), "far": (40, False), "total": (40, False)}
    # 40 sums, each of three steps: residual 3p / 300 for p in 0 .. 9, four times each; rank ceil(41 * 0.9) / 40 * 39
    ordered = sorted(3 * p / 300 for p in range(10) for _ in range(4))
    at = math.ceil(41 * 0.9) / 40 * 39
    want = ordered[int(at)] + (at - int(at)) * (ordered[math.ceil(at)] - ordered[int(at)])
    assert abs(got["total"].width - want) < 1e-9
    few = {r.bucket: r for r in horizon.calibration(df, 14, least=41).collect()}
    assert few["far"].pooled and not few["near"].pooled and few["total"].width is None
    bounds = horizon.bounded_totals(df, spark.createDataFrame([("total", 40, None, False)], "bucket string, n long, width double, pooled boolean"))
    assert all(r.lower is None and r.upper is None for r in bounds.collect()) and bounds.count() == 80
    bounded = horizon.bounded(df.withColumn("units", F.col("target_units")), horizon.calibration(df, 14, least=40)).filter("bucket = 'near' and units < 200")
    assert bounded.filter("lower is null or upper is null").count() == 0 and bounded.filter("units between lower and upper").count() == bounded.count()
    assert horizon.calibration(df.limit(0), 14).count() == 0


def test_adjacent_windows(spark):
    days = spark.range(400).select(F.date_add(F.to_date(F.lit("2020-01-01")), F.col("id").cast("int")).alias("date"))
    r = sampling.adjacent(days, 300, 28).first()
    last = dt.date(2020, 1, 1) + dt.timedelta(399)
    assert r.test_end == last and r.test_start == last - dt.timedelta(27) and r.train_end == r.test_start - dt.timedelta(1) and r.train_start == r.train_end - dt.timedelta(299) and r.enough
    short = sampling.adjacent(days, 300, 28, "2020-06-30").first()
    assert short.test_end == dt.date(2020, 6, 30) and not short.enough
    assert sampling.adjacent(days, 300, 28, "2030-01-01").first().test_end == last


def test_trade_cells(spark):
    impacts = spark.createDataFrame([("p", "a", 20.0, 120.0, 10.0, 1.0), ("p", "b", -5.0, 45.0, 30.0, -0.5), ("q", "a", 5.0, 5.0, 0.0, None)],
                                    "product_id string, store_id string, incremental_units double, promotion_units double, promotion_spend double, roi double")
    products = spark.createDataFrame([("p", "c", 10.0, 6.0)], "product_id string, category string, base_price double, unit_cost double")
    stores = spark.createDataFrame([("a", "r"), ("b", "r")], "store_id string, region string")
    got = {r.product_id: r for r in uplift.trade_cells(impacts, products, stores).collect()}
    p, q = got["p"], got["q"]
    assert (p.region, p.events, p.mean_roi, p.mean_spend, p.total_spend, p.least_spend, p.most_spend) == ("r", 2, 0.25, 20.0, 40.0, 0.0, 60.0)
    assert abs(p.mean_uplift - (0.2 - 0.1) / 2) < 1e-12 and abs(p.margin - 0.4) < 1e-12 and abs(p.sd_roi - math.sqrt(1.125)) < 1e-12
    assert q.mean_roi is None and q.mean_uplift is None and q.margin is None and q.events == 1


def test_written_tables(spark):
    df = spark.range(5).withColumn("x", F.lit(None).cast("string"))
    out = src.written(df)
    assert out.dtypes == df.dtypes and out.count() == 5 and src.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
