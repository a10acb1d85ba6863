"""Forecast horizons: data sets of origins and steps, scaffolds, forecasters, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import scalar
from shelfspark.operators import joins, metrics, windows
from shelfspark.operators.windows import KEYS, safe
from shelfspark.sources.tables import written

HEX = "0123456789abcdef"
BANDS, BAND, LAST = 8, 11, 90  # steps of an origin: one in each band of days, the last band up to LAST


def steps() -> Column:
    """BANDS distinct steps in 1 .. LAST, drawn by the md5 of series, origin and band."""
    def one(band: Column) -> Column:
        h = F.md5(F.concat_ws("|", *KEYS, F.col("origin_date").cast("string"), band.cast("string")).cast("binary"))
        drawn = 16 * (F.instr(F.lit(HEX), F.substring(h, 1, 1)) - 1) + F.instr(F.lit(HEX), F.substring(h, 2, 1)) - 1
        width = F.when(band == BANDS - 1, LAST - BAND * (BANDS - 1)).otherwise(BAND)
        return (1 + BAND * band + drawn % width).cast("int")

    return F.array(*[one(F.lit(b)) for b in range(BANDS)])


def origins(sales: DataFrame, every: int = 7) -> DataFrame:
    """Origin rows: every `every` days from the first date, with units a season ago known."""
    first = sales.agg(F.min("date").alias("first"))
    rows = windows.demand_rolling(windows.demand_lags(sales)).crossJoin(F.broadcast(first))
    known = rows.filter((F.datediff("date", "first") % every == 0) & F.col("lag_364").isNotNull())
    return known.select(*KEYS, F.col("date").alias("origin_date"), "units", "lag_1", "lag_7", "rolling_mean_7", "rolling_mean_28")


def dataset(sales: DataFrame, every: int = 7) -> DataFrame:
    """Origins with their drawn steps and the target's units; targets that ran out of stock and
    targets without a row are left out.  sales is computed once, for origins and targets."""
    sales = written(sales.select(*KEYS, "date", "units", "stockout_flag"))
    grid = origins(sales, every).withColumnRenamed("units", "origin_units").withColumn("step", F.explode(steps()))
    grid = grid.withColumns({"target_date": F.date_add("origin_date", F.col("step")), "bucket": scalar.bucket(F.col("step"))})
    target = sales.filter("not stockout_flag").select(*KEYS, F.col("date").alias("target_date"), F.col("units").alias("target_units"))
    return grid.join(target, [*KEYS, "target_date"])


def target_side(grid: DataFrame, calendar: DataFrame, promotions: DataFrame) -> DataFrame:
    """grid with what is known in advance of its target dates, prefixed h_: the calendar and the
    planned event of the day."""
    days = calendar.select(F.col("date").alias("target_date"), *(F.col(c).alias(f"h_{c}") for c in ("day_of_week", "weekend_flag", "festival_flag", "season")))
    planned = joins.event_days(promotions).select(*KEYS, F.col("date").alias("target_date"), F.col("discount_percentage").alias("h_discount"))
    out = grid.join(days, "target_date", "left").join(planned, [*KEYS, "target_date"], "left")
    return out.withColumns({"h_on_promotion": F.col("h_discount").isNotNull(), "h_discount": F.coalesce("h_discount", F.lit(0.0))})


def scaffold(sales: DataFrame, as_of: str, most: int, calendar_end: str | None = None) -> DataFrame:
    """Each series' last row at or before as_of with the steps 1 .. most.  A horizon that passes
    the end of the known calendar is refused."""
    if calendar_end is not None:
        late = sales.sparkSession.range(1).select(F.date_add(F.to_date(F.lit(as_of)), most) > F.to_date(F.lit(calendar_end))).first()[0]
        if late:
            raise ValueError(f"{most} days after {as_of} pass the calendar's end, {calendar_end}")
    last = sales.filter(F.col("date") <= F.to_date(F.lit(as_of))).groupBy(*KEYS).agg(F.max_by("units", "date").alias("origin_units"), F.max("date").alias("origin_date"))
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("target_date", F.date_add("origin_date", F.col("step")))


def naive(rows: DataFrame) -> DataFrame:
    """The last units, else the last means."""
    return rows.withColumn("predicted", F.coalesce(F.col("lag_1").cast("double"), "rolling_mean_7", "rolling_mean_28"))


def seasonal(rows: DataFrame, sales: DataFrame, days: int = 364) -> DataFrame:
    """Half the units a season before the target and half the recent level; what is known of both."""
    past = sales.select(*KEYS, F.date_add("date", days).alias("target_date"), F.col("units").alias("season"))
    out = rows.join(past, [*KEYS, "target_date"], "left")
    recent = F.coalesce("rolling_mean_28", "rolling_mean_7", F.col("lag_1").cast("double"))
    return out.withColumn("predicted", F.coalesce(0.5 * F.col("season") + 0.5 * recent, recent, F.col("season").cast("double")))


def by_bucket(rows: DataFrame) -> DataFrame:
    """Accuracy of each horizon bucket."""
    return rows.groupBy("bucket").agg(*metrics.accuracy("target_units", "predicted"))


def value_added(rows: DataFrame, benchmark: DataFrame, scale: DataFrame) -> DataFrame:
    """Per bucket: WMAPE of a forecast and of a benchmark on the same rows, what the forecast
    adds, its error by the naive scale (MASE), and whether its error is greater than in the
    bucket before."""
    keys = [*KEYS, "origin_date", "step"]
    both = rows.select(*keys, "bucket", "target_units", "predicted").join(benchmark.select(*keys, F.col("predicted").alias("bench")), keys)
    error, other = F.abs(F.col("predicted") - F.col("target_units")), F.abs(F.col("bench") - F.col("target_units"))
    total = F.sum("target_units")
    out = both.groupBy("bucket").agg(F.min("step").alias("from_step"), F.count(F.lit(1)).alias("n"), safe(F.sum(error), total).alias("wmape"), safe(F.sum(other), total).alias("benchmark"), F.avg(error).alias("mae"))
    out = out.crossJoin(F.broadcast(scale)).withColumns({"added": F.col("benchmark") - F.col("wmape"), "mase": safe(F.col("mae"), F.col("scale"))})
    w = windows.Window.orderBy("from_step")  # one row a bucket
    return out.withColumn("grows", F.coalesce(F.col("wmape") > F.lag("wmape").over(w), F.lit(False))).drop("scale", "mae")


def widths(rows: DataFrame, alpha: float = 0.1, least: int = 100) -> DataFrame:
    """(bucket, n, width, pooled): conformal widths of the buckets; one under `least` rows takes
    the width of all rows together.  rows are computed once."""
    named = written(rows.select("bucket", F.col("target_units").alias("units"), "predicted").filter("units is not null and predicted is not null"))
    own = metrics.conformal(named, "bucket", alpha, least)
    pooled = metrics.conformal(named.withColumn("all", F.lit("all")), "all", alpha, 1).select(F.col("width").alias("of_all"))
    counts = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(own.select("bucket", "width"), "bucket", "left").crossJoin(F.broadcast(pooled)).select(
        "bucket", "n", F.coalesce("width", "of_all").alias("width"), F.col("width").isNull().alias("pooled"))


def totals(rows: DataFrame) -> DataFrame:
    """Target and prediction summed over the steps of each series and origin."""
    return rows.groupBy(*KEYS, "origin_date").agg(F.sum("target_units").alias("units"), F.sum("predicted").alias("predicted"), F.count(F.lit(1)).alias("steps"))


def thinned(rows: DataFrame, spacing: int) -> DataFrame:
    """The rows whose origin is kept by a greedy thinning of the origins' dates: origins that share
    their recent history are not counted as independent."""
    kept = windows.thin(rows.select(F.col("origin_date").alias("date")), spacing)
    return rows.join(kept.withColumnRenamed("date", "origin_date"), "origin_date", "left_semi")


def calibration(rows: DataFrame, spacing: int = 7, alpha: float = 0.1, least: int = 100) -> DataFrame:
    """(bucket, n, width, pooled) from forecasts of thinned origins: one row a bucket, pooled where
    it holds fewer than `least` rows, and one named total, from the residuals of the sums over the
    steps of a series and origin.  With fewer than `least` sums the total has no width: the widths
    of days say nothing of their sum.  No rows give no calibration."""
    used = thinned(rows.filter(F.col("target_units").isNotNull() & F.col("predicted").isNotNull()), spacing)
    sums = totals(used).withColumn("bucket", F.lit("total"))
    counts = sums.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    of_sums = counts.join(metrics.conformal(sums, "bucket", alpha, least).select("bucket", "width"), "bucket", "left")
    return widths(used, alpha, least).unionByName(of_sums.select("bucket", "n", "width", F.lit(False).alias("pooled")))


def _with_bounds(rows: DataFrame, calibrated: DataFrame) -> DataFrame:
    out = metrics.intervals(rows, calibrated, "bucket")
    return out.withColumn("lower", F.when(F.col("width").isNotNull(), F.col("lower")))


def bounded(rows: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Forecasts with the bounds of their bucket (null for a bucket that was not calibrated)."""
    return _with_bounds(rows, calibrated.filter("bucket <> 'total'"))


def bounded_totals(rows: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Sums over the steps of a series and origin, with bounds of their own width (null without one)."""
    return _with_bounds(totals(rows).withColumn("bucket", F.lit("total")), calibrated).drop("bucket")
