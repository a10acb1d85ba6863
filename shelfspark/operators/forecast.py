"""Naive forecasters, splits and evaluation panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.windows import KEYS, lagged, rolling, safe, series


def seasonal_naive(df: DataFrame) -> DataFrame:
    """0.4 of the units a season ago and 0.6 of recent demand; what is known of the two;
    else the mean of all: never negative."""
    recent = F.coalesce(rolling("units", 28), rolling("units", 14), rolling("units", 7))
    season = lagged("units", 364)
    mean = df.agg(F.avg("units").alias("__mean"))
    rows = df.withColumns({"recent": recent, "season": season}).crossJoin(F.broadcast(mean))
    p = F.coalesce(0.4 * F.col("season") + 0.6 * F.col("recent"), "recent", "season", "__mean")
    return rows.withColumn("predicted", F.greatest(p, F.lit(0.0))).drop("__mean")


def horizon_naive(df: DataFrame) -> DataFrame:
    return df.withColumn("predicted", F.coalesce(lagged("units", 1).cast("double"), rolling("units", 7), rolling("units", 28)))


def with_fallback(df: DataFrame, model: str) -> DataFrame:
    """A model's prediction, else the first of the fallbacks that is known, with its reason."""
    steps = [(model, F.col(model)), ("rolling_28", rolling("units", 28)), ("rolling_7", rolling("units", 7)), ("lag_1", lagged("units", 1).cast("double"))]
    out = df.withColumns({f"__{i}": c for i, (_, c) in enumerate(steps)})
    reason = F.coalesce(*[F.when(F.col(f"__{i}").isNotNull(), F.lit(n)) for i, (n, _) in enumerate(steps)], F.lit("zero"))
    value = F.coalesce(*[f"__{i}" for i in range(len(steps))], F.lit(0.0))
    return out.withColumns({"predicted": F.greatest(value, F.lit(0.0)), "reason": reason}).drop(*[f"__{i}" for i in range(len(steps))])


def split(df: DataFrame, test: int = 120, valid: int = 90, calibration: int = 60) -> DataFrame:
    """Rows labelled train, calibration, valid or test by date from the end."""
    last = df.agg(F.max("date").alias("__last"))
    age = F.datediff("__last", "date")
    label = F.when(age < test, "test").when(age < test + valid, "valid").when(age < test + valid + calibration, "calibration").otherwise("train")
    return df.crossJoin(F.broadcast(last)).withColumn("part", label).drop("__last")


def folds(df: DataFrame, n: int = 4, days: int = 90) -> DataFrame:
    """(fold, date range) of an expanding-window backtest joined to the rows it tests."""
    last = df.agg(F.max("date").alias("__last"))
    age = F.datediff("__last", "date")
    return df.crossJoin(F.broadcast(last)).filter(age < n * days).withColumn("fold", n - F.floor(age / days)).drop("__last")


def cold_start(df: DataFrame, products: DataFrame, stores: DataFrame, days: int = 60) -> DataFrame:
    """Mean units of established rows by category and channel, with the overall mean beside."""
    first = df.groupBy(*KEYS).agg(F.min("date").alias("__first"))
    rows = df.join(first, list(KEYS)).filter(F.datediff("date", "__first") >= days)
    rows = rows.join(products.select("product_id", "category"), "product_id").join(stores.select("store_id", "channel"), "store_id")
    overall = rows.agg(F.avg("units").alias("overall"))
    return rows.groupBy("category", "channel").agg(F.avg("units").alias("mean_units"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(overall))


def baseline_slice(df: DataFrame, by: list[str]) -> DataFrame:
    """Sums of units and baseline (predicted, lower, upper) over slices: gap, gap by the baseline,
    gap in revenue, and whether the units lie outside the summed bounds."""
    gap = F.col("units") - F.col("predicted")
    outside = (F.sum("units") < F.sum("lower")) | (F.sum("units") > F.sum("upper"))
    return df.groupBy(*by).agg(F.sum("units").alias("units"), F.sum("predicted").alias("baseline"), F.sum(gap).alias("gap"), safe(F.sum(gap), F.sum("predicted")).alias("gap_pct"),
                               F.sum(gap * F.col("selling_price")).alias("revenue_gap"), F.coalesce(outside, F.lit(False)).alias("significant"))


def baseline_table(sales: DataFrame, products: DataFrame, stores: DataFrame, days: int = 60) -> DataFrame:
    """Every row with its baseline: the recent mean, or for listings under `days` old the mean of
    established rows of category and channel, else of all; with gaps in units and revenue."""
    means = cold_start(sales, products, stores, days)
    overall = means.agg(F.max("overall").alias("overall"))
    first = F.min("date").over(series())
    rows = sales.withColumns({"cold": F.datediff("date", first) < days, "recent": rolling("units", 28)})
    rows = rows.join(products.select("product_id", "category"), "product_id").join(stores.select("store_id", "channel"), "store_id")
    rows = rows.join(means.drop("overall", "n"), ["category", "channel"], "left").crossJoin(F.broadcast(overall))
    fallback = F.coalesce("mean_units", "overall")
    rows = rows.withColumn("baseline", F.when(F.col("cold"), fallback).otherwise(F.coalesce("recent", fallback)))
    gap = F.col("units") - F.col("baseline")
    return rows.withColumns({"gap": gap, "gap_pct": safe(gap, F.col("baseline")), "revenue_gap": gap * F.col("selling_price")})
