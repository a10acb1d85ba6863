"""Limited budgets, sweeps, importance, effect models, relationships and tail probabilities."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import stats
from shelfspark.operators import decide, effects, explain, recovery, uplift, windows

D0 = dt.date(2020, 1, 1)


# Two-sided 0.05, 0.01 and 0.001 points of Student's t, as tables print them.
POINTS = [(3, 3.182446), (3, 5.840909), (3, 12.923979), (10, 2.228139), (10, 3.169273), (10, 4.586894), (30, 2.042272), (30, 2.749996), (100, 1.983972), (100, 3.390491), (500, 1.964720), (500, 3.310091)]
LEVELS = [0.05, 0.01, 0.001, 0.05, 0.01, 0.001, 0.05, 0.01, 0.05, 0.001, 0.05, 0.001]


def test_student_p(spark):
    rows = spark.createDataFrame([(float(t), n) for n, t in POINTS], "t double, n int").withColumn("p", stats.student_p(F.col("t"), F.col("n"))).collect()
    for r, level in zip(rows, LEVELS):
        assert abs(r.p - level) < 1e-6
    # one and two degrees have closed forms; far out and in the middle; without freedom
    odd = [(1.0, 1), (-7.5, 1), (0.3, 2), (40.0, 2), (0.0, 5), (1.96, 1_000_000), (2.0, 0), (None, 5)]
    p = [r.p for r in spark.createDataFrame(odd, "t double, n int").withColumn("p", stats.student_p(F.col("t"), F.col("n"))).collect()]
    assert abs(p[0] - 0.5) < 1e-9 and abs(p[1] - (1 - 2 / math.pi * math.atan(7.5))) < 1e-9
    for got, t in ((p[2], 0.3), (p[3], 40.0)):
        assert abs(got - (1 - t / math.sqrt(2 + t * t))) < 1e-9
    assert p[4] == 1 and abs(p[5] - math.erfc(1.96 / math.sqrt(2))) < 1e-6 and p[6] is None and p[7] is None


def test_incomplete_beta(spark):
    # I_x(1, b) = 1 - (1 - x)^b and I_x(a, 1) = x^a
    rows = [(x, k) for x in (0.0, 0.05, 0.5, 0.93, 1.0) for k in (0.5, 1.0, 3.5, 40.0)]
    df = spark.createDataFrame(rows, "x double, k double")
    got = df.select("x", "k", stats.incomplete_beta(F.lit(1.0), F.col("k"), F.col("x")).alias("a"), stats.incomplete_beta(F.col("k"), F.lit(1.0), F.col("x")).alias("b")).collect()
    for r in got:
        assert abs(r.a - (1 - (1 - r.x) ** r.k)) < 1e-10 and abs(r.b - r.x**r.k) < 1e-10


def best_of(parts, budget, limits):
    """The best whole segments by trying all sets; widths are one."""
    best = None
    for chosen in itertools.product((0, 1), repeat=len(parts)):
        spent = {}
        for on, (_, d, _) in zip(chosen, parts):
            spent[d] = spent.get(d, 0) + on
        if sum(chosen) > budget or any(spent.get(d, 0) < (lo or 0) or (hi is not None and spent.get(d, 0) > hi) for d, lo, hi in limits if d in {p[1] for p in parts}):
            continue
        value = sum(m for on, (_, _, m) in zip(chosen, parts) if on)
        best = value if best is None else max(best, value)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_limited_allocation_is_optimal(spark, seed):
    rng = random.Random(seed)
    parts = [(f"c{i}", rng.choice("xyz"), float(rng.choice([-3, -1, 1, 2, 2, 4, 5, 8]))) for i in range(11)]
    n = {d: sum(p[1] == d for p in parts) for d in "xyz"}
    limits = [(d, float(rng.randint(0, n[d])) if rng.random() < 0.6 else None, None) for d in "xyz"]
    limits = [(d, lo, float(rng.randint(int(lo or 0), n[d])) if rng.random() < 0.6 else None) for d, lo, _ in limits]
    budget = max(sum(lo or 0 for _, lo, _ in limits), rng.randint(1, 9))
    df = spark.createDataFrame([(*p, 1.0) for p in parts], "candidate_id string, d string, marginal double, width double")
    bounds = spark.createDataFrame(limits, "d string, least double, most double")
    got = decide.allocate_limited(df, float(budget), bounds, "d").collect()
    assert len(got) == len(parts) and sum(r.spend for r in got) <= budget + 1e-9
    assert abs(sum(r.spend * r.marginal for r in got) - best_of(parts, budget, limits)) < 1e-9
    for d, lo, hi in limits:
        spent = sum(r.spend for r in got if r.d == d)
        assert spent >= (lo or 0) - 1e-9 and (hi is None or spent <= hi + 1e-9)


def test_limit_report(spark):
    parts = spark.createDataFrame([("a", "x", 5.0, 10.0), ("b", "y", 4.0, 10.0), ("c", None, 9.0, 10.0)], "candidate_id string, d string, marginal double, width double")
    limits = spark.createDataFrame([("x", 50.0, None), ("y", None, 3.0), ("q", 1.0, None), ("y", 1.0, None)], "d string, least double, most double")
    got = {r.d: (r.status, r.spend) for r in decide.limit_report(decide.allocate_limited(parts, 100.0, limits, "d"), limits, "d").collect()}
    assert got == {"x": ("infeasible", 10.0), "y": ("at_cap", 3.0), "q": ("unmatched", None)}
    # floors that pass the budget are funded in proportion; without limits it is the plain fill
    short = decide.allocate_limited(parts, 6.0, spark.createDataFrame([("x", 10.0, None), ("y", 5.0, None)], "d string, least double, most double"), "d")
    assert {r.candidate_id: r.spend for r in short.collect()} == {"a": 4.0, "b": 2.0, "c": 0.0}
    plain = decide.allocate_limited(parts, 12.0, limits.limit(0), "d")
    assert {r.candidate_id: r.spend for r in plain.collect()} == {"c": 10.0, "a": 2.0, "b": 0.0}
    assert decide.allocate_limited(parts.limit(0), 5.0, limits, "d").count() == 0


def test_sweep_recovers_an_effect(spark):
    """Events raise units by 5; treated days are those of high demand, which the covariate holds."""
    rng = random.Random(6)
    rows = []
    for s in range(30):
        for d in range(180):
            x = rng.uniform(10, 20)
            t = rng.random() < (x - 8) / 30
            rows.append((D0 + dt.timedelta(d), f"p{s % 3}", f"s{s}", "treated" if t else "control", 2 * x + 5 * t + rng.gauss(0, 1), x, rng.randint(0, 60), rng.choice([None, 3, 8, 15, 30])))
    df = spark.createDataFrame(rows, "date date, product_id string, store_id string, role string, units double, demand_mean_28 double, nearest int, since int")
    got = effects.sweep(df).collect()
    assert len(got) == 10 and all(abs(r.att - 5) < 0.3 and 0 < r.error < 0.3 for r in got)
    by = {(r.parameter, r.washout, r.control_window, r.trim): r for r in got}
    assert by["washout_days", 0, 45, 0.02].n_control > by["washout_days", 10, 45, 0.02].n_control > by["washout_days", 21, 45, 0.02].n_control
    assert by["control_window_days", 10, 21, 0.02].n_control < by["control_window_days", 10, 90, 0.02].n_control
    spread = max(r.att_share for r in got) - min(r.att_share for r in got)
    assert all(abs(r.spread - spread) < 1e-12 for r in got)
    naive = df.groupBy("role").agg(F.avg("units").alias("m")).collect()
    assert abs(max(r.m for r in naive) - min(r.m for r in naive) - 5) > 1  # what the covariate takes away


def test_overlap_and_trimming(spark):
    df = spark.createDataFrame([(True, 0.99), (True, 0.5), (True, 0.3), (False, 0.5), (False, 0.2), (False, 0.01)], "t boolean, e double")
    r = effects.overlap(df, F.col("t"), "e").first()
    assert (r.rows, r.effective_treated) == (6, 2) and abs(r.trimmed_share - 2 / 6) < 1e-9 and abs(r.off_support - 3 / 6) < 1e-9
    assert abs(r.effective_control - (1 + 0.25) ** 2 / (1 + 0.0625)) < 1e-9
    assert effects.trimmed(df, "e").count() == 4


def panel(spark, n=900):
    rng = random.Random(8)
    rows = [(f"k{i}", ("near", "far")[i % 2], rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(n)]
    rows = [(k, b, x, z, u, 100 + (8 * x + 1 * z if b == "near" else 1 * x + 6 * z)) for k, b, x, z, u in rows]
    return spark.createDataFrame(rows, "k string, b string, x double, z double, u double, y double")


def test_importance(spark):
    def predict(df):
        near = F.col("b") == "near"
        return df.withColumn("predicted", 100 + F.when(near, 8 * F.col("x") + F.col("z")).otherwise(F.col("x") + 6 * F.col("z")))

    df = panel(spark)
    table = explain.permutation_importance(df, predict, ["x", "z", "u"], ["k"], "y", "b", blocks=3)
    got = {(r.b, r.feature): r for r in table.collect()}
    assert len(got) == 6 and all(r.baseline < 1e-12 and r.n == 450 for r in got.values())
    assert got["near", "u"].importance == got["far", "u"].importance == 0
    assert got["near", "x"].importance > 4 * got["near", "z"].importance > 0 and got["far", "z"].importance > 4 * got["far", "x"].importance > 0
    shares = explain.families(table, {"x": "recent history", "z": "seasonal anchor"}, "b")
    decay = {r.b: (r.recent_history_share, r.seasonal_anchor_share) for r in explain.decay(shares, "b").collect()}
    assert decay["near"][0] > 0.8 > 0.3 > decay["far"][0] and abs(sum(decay["near"]) - 1) < 1e-9


def test_dealt_is_a_permutation_inside_blocks(spark):
    df = panel(spark, 200)
    rows = explain.dealt(df, ["x"], ["k"], "b", 4, "s").collect()
    assert len(rows) == 200
    for b in ("near", "far"):
        assert sorted(r.x for r in rows if r.b == b) == sorted(r.other.x for r in rows if r.b == b)
    assert sum(r.x == r.other.x for r in rows) < 40


def test_importance_of_a_fitted_model(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df = panel(spark).filter("b = 'near'")
    gather = VectorAssembler(inputCols=["x", "z", "u"], outputCol="f")
    model = LinearRegression(featuresCol="f", labelCol="y", predictionCol="predicted").fit(gather.transform(df))
    got = {r.feature: r.importance for r in explain.permutation_importance(df, lambda d: model.transform(gather.transform(d)), ["x", "z", "u"], ["k"], "y", "b", seeds=("1",)).collect()}
    assert got["x"] > got["z"] > abs(got["u"]) and abs(got["u"]) < 1e-6


def test_effect_model(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i % 5, x, z, 3.0, 2 + 1.5 * x - 0.5 * z + rng.gauss(0, 0.01), i % 3 == 0) for i in range(500) for x, z in [(rng.uniform(0, 4), rng.uniform(0, 4))]]
    df = spark.createDataFrame([*rows, (1, None, 1.0, 3.0, 9.0, True)], "fold int, x double, z double, same double, pseudo double, treated boolean")
    model = effects.fit_effects(df, ["x", "z", "same"])
    assert set(model.coefficients) == {-1, 0, 1, 2, 3, 4}
    a, x, z, same = model.coefficients[-1]
    assert abs(x - 1.5) < 0.01 and abs(z + 0.5) < 0.01 and abs(same) < 1e-6 and abs(a - 2) < 0.02
    out = model.out_of_fold(df)
    treated = [r for r in out.collect() if r.treated and r.cate is not None]
    got = effects.att(out, F.col("treated")).first()
    assert got.n == len(treated) and abs(got.att - sum(r.cate for r in treated) / len(treated)) < 1e-9
    # a fold's line never saw the fold
    shifted = df.withColumn("pseudo", F.when(F.col("fold") == 2, F.col("pseudo") + 1000).otherwise(F.col("pseudo")))
    assert all(abs(p - q) < 1e-6 for p, q in zip(model.coefficients[2], effects.fit_effects(shifted, ["x", "z", "same"]).coefficients[2]))
    model.save(spark, str(tmp_path / "model"))
    again = effects.EffectModel.load(spark, str(tmp_path / "model"))
    assert again == model
    plans = spark.createDataFrame([(1.0, 1.0, 3.0, 10), (None, 1.0, 3.0, 10)], "x double, z double, same double, days int")
    first, second = again.predict(plans).collect()
    assert abs(first.uplift - 30) < 0.2 and not first.unknown and second.unknown and second.uplift is None
    with pytest.raises(ValueError):
        effects.fit_effects(df.limit(0), ["x"])


def test_relationships_of_a_panel(spark):
    """Own prices follow the rivals', so the plain slope of units on the rival's price is negative."""
    rng = random.Random(10)
    sales, rivals = [], []
    for p in range(4):
        for d in range(200):
            cost = rng.gauss(0, 0.3)
            own, rival = math.exp(1 + cost + rng.gauss(0, 0.05)), math.exp(1 + cost + rng.gauss(0, 0.1))
            units = math.exp(6 - 2 * math.log(own) + 0.6 * math.log(rival) + rng.gauss(0, 0.02))
            sales.append((D0 + dt.timedelta(d), f"p{p}", "s0", units, own, False, False, 0.0))
            rivals.append((D0 + dt.timedelta(d), f"p{p}", rival))
    df = spark.createDataFrame(sales, "date date, product_id string, store_id string, units double, selling_price double, promotion_flag boolean, stockout_flag boolean, discount_percentage double")
    found = recovery.competitor_effect(df, spark.createDataFrame(rivals, "date date, product_id string, competitor_effective_price double")).first()
    assert found.passed and abs(found.observed - 0.6) < 0.1 and found.n == 800
    same = df.select("date", "product_id", F.col("selling_price").alias("competitor_effective_price"))
    assert recovery.competitor_effect(df, same).first().observed is None
    few = recovery.competitor_effect(df.limit(50), spark.createDataFrame(rivals, "date date, product_id string, competitor_effective_price double")).first()
    assert not few.passed
    assert recovery.price_direction(df).first().passed
    out = df.withColumn("stockout_flag", F.dayofmonth("date") == 1).withColumn("units", F.when(F.col("stockout_flag"), F.col("units") / 4).otherwise(F.col("units")))
    expected = F.avg(F.when(~F.col("stockout_flag"), F.col("units"))).over(windows.series())
    assert recovery.stockout_suppression(out, expected).first().observed > 0.5
    calendar = spark.createDataFrame([(D0 + dt.timedelta(d), d % 50 == 0) for d in range(200)], "date date, festival_flag boolean")
    high = df.join(calendar, "date").withColumn("units", F.when(F.col("festival_flag"), 3 * F.col("units")).otherwise(F.col("units"))).drop("festival_flag")
    assert recovery.festival_lift(high, calendar).first().passed
    stores = spark.createDataFrame([("s0", "north")], "store_id string, region string")
    assert not recovery.regional_spread(df, stores).first().passed
    deep = df.withColumns({"promotion_flag": F.dayofmonth("date") < 10, "discount_percentage": F.dayofmonth("date").cast("double")}).withColumn("units", F.col("units") * (1 + F.col("discount_percentage") / 10))
    assert recovery.depth_response(deep, F.lit(50.0), F.col("discount_percentage") > 5).first().passed


def test_parallel_trends_by_hand(spark):
    rng = random.Random(12)
    rows = [(arm, day, 10 + (0.5 if arm else 0.1) * day + rng.gauss(0, 0.5)) for arm in (True, False) for day in range(-56, 0)]
    r = uplift.parallel_trends(spark.createDataFrame(rows, "t boolean, day int, y double"), F.col("t"), "day", "y").first()
    assert abs(r.difference - 0.4) < 0.03 and r.t > 10 and r.p < 1e-6 and not r.parallel
