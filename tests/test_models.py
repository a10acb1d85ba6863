"""Fitted models: sessions that have observed a query, and how often an input is read."""

import datetime as dt
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from shelfspark.operators import horizon, joins, models, uplift
from shelfspark.plans import more_queries

D0 = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(3)
    rows = []
    for p in range(4):
        for s in range(3):
            for d in range(40):
                flag, x = rng.random() < 0.3, rng.gauss(0, 1)
                rows.append((D0 + dt.timedelta(d), f"p{p}", f"s{s}", 10 + 3 * x + 2 * flag + rng.gauss(0, 1), x, flag))
    return spark.createDataFrame(rows, "date date, product_id string, store_id string, units double, x double, flag boolean")


def test_logistic_models_in_a_session_that_has_observed(spark, panel):
    seen = Observation()
    assert spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).count() == 5 and seen.get["n"] == 5
    found = models.propensity(panel, F.col("flag"), ["x"], ["store_id"])
    assert found.filter("e between 0.02 and 0.98").count() == panel.count()
    crossed = models.cross_fitted(panel, F.col("flag"), "units", ["x"], ["store_id"], 2)
    assert crossed.filter("mu0 is not null and e between 0.02 and 0.98").count() == panel.count()


def counted(spark, df):
    """df, and an accumulator of the rows that are computed of it."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_models_compute_their_input_once(spark, panel):
    n = panel.count()
    df, seen = counted(spark, panel)
    assert models.propensity(df, F.col("flag"), ["x"], ["store_id"]).count() == n and seen.value == n
    df, seen = counted(spark, panel)
    found = uplift.aipw(models.cross_fitted(df, F.col("flag"), "units", ["x"], ["store_id"], 2), F.col("flag"), "units", "mu0", "e").first()
    assert 1 < found.att < 3 and found.clusters == 12 and seen.value == n


def test_matching_of_equal_scores(spark):
    """Controls of the same score are found from either side, and of several the one of most units."""
    rows = [("p", 0.3, 5, True), ("p", 0.3, 1, False), ("p", 0.3, 4, False), ("p", 0.31, 9, False), ("p", 0.5, 7, True), ("p", 0.52, 2, False), ("p", 0.46, 3, False), ("q", 0.5, 1, True)]
    df = spark.createDataFrame(rows, "product_id string, e double, units long, flag boolean")
    found = {r.units: r.match.u for r in joins.nearest_score(df, F.col("flag"), "e", 0.05, "product_id").collect()}
    assert found == {5: 4, 7: 2}


def test_pseudo_outcomes_compute_their_input_once(spark, panel):
    rows = panel.select("date", "product_id", "store_id", "units", "flag", F.lit(10.0).alias("mu0"), F.lit(12.0).alias("mu1"), F.lit(0.3).alias("e"))
    df, seen = counted(spark, rows)
    out = uplift.pseudo_outcome(df, F.col("flag"), "units", "mu0", "mu1", "e")
    assert models.regression(out, out.filter("flag"), "pseudo", ["units"], ["store_id"], "trees").count() == rows.filter("flag").count()
    assert seen.value == rows.count()


def test_evaluation_computes_its_rows_once(spark, panel):
    rows = panel.crossJoin(spark.range(10).select(F.col("id").cast("int").alias("k"))).withColumn("date", F.date_add("date", 40 * F.col("k"))).drop("k")
    df, seen = counted(spark, rows.withColumns({"stockout_flag": F.lit(False), "promotion_flag": F.col("flag")}))
    found = {r.role: r for r in models.fit_evaluate(df, ["x"], ["store_id"]).collect()}
    assert set(found) == {"clean", "promoted"} and found["clean"].n + found["promoted"].n == 12 * 120 and seen.value == rows.count()


@pytest.mark.parametrize("kind", ["ridge", "trees"])
def test_test_rows_come_from_a_panel_computed_once(spark, panel, kind):
    class Sales:
        sales, seen = counted(spark, panel.withColumn("units", F.floor("units").cast("bigint")).crossJoin(spark.range(9).select(F.col("id").cast("int").alias("k")))
                              .withColumn("date", F.date_add("date", 40 * F.col("k"))).drop("k").withColumn("selling_price", F.col("x")))

    assert more_queries._tested(Sales, kind).count() == 12 * 120 and Sales.seen.value == 9 * panel.count()


def test_search_computes_its_rows_once(spark, panel):
    rows = panel.crossJoin(spark.range(10).select(F.col("id").cast("int").alias("k"))).withColumn("date", F.date_add("date", 40 * F.col("k"))).drop("k")
    df, seen = counted(spark, rows)
    found = models.search(df, ["x"], ["store_id"], trials=2).collect()
    assert [r.name for r in found] == ["default", "trial_0", "trial_1"] and sum(r.kept for r in found) == 1 and seen.value == rows.count()


def test_horizon_widths_compute_sales_once(spark):
    rows = [(D0 + dt.timedelta(d), p, "s", 5 + (d * 7 + len(p)) % 11, d % 50 == 0) for p in ("a", "bb") for d in range(600)]
    df, seen = counted(spark, spark.createDataFrame(rows, "date date, product_id string, store_id string, units long, stockout_flag boolean"))
    found = horizon.widths(horizon.naive(horizon.dataset(df)), least=30).collect()
    assert found and all(r.width is not None for r in found) and seen.value == len(rows)
