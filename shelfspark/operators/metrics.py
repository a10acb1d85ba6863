"""Aggregations: roll-ups, accuracy metrics, profiles and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.windows import KEYS, order_statistics, quantiles, safe


def rollup(df: DataFrame, unit: str) -> DataFrame:
    """Weekly (from Monday) or monthly sums by product and store."""
    return df.groupBy(F.to_date(F.date_trunc(unit, "date")).alias("date"), *KEYS).agg(
        F.sum("units").alias("units"), F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost"), F.sum("gross_profit").alias("gross_profit"),
        F.sum(F.col("promotion_flag").cast("int")).alias("promo_days"), F.sum(F.col("stockout_flag").cast("int")).alias("stockout_days"),
        F.count(F.lit(1)).alias("days"), F.sum("selling_price").alias("price_sum"), F.avg("selling_price").alias("price"))


def merged(parts: DataFrame) -> DataFrame:
    """Partial roll-ups of the same keys combined: sums again, the mean price from its sum."""
    return parts.groupBy("date", *KEYS).agg(F.sum("units").alias("units"), F.sum("days").alias("days"), (F.sum("price_sum") / F.sum("days")).alias("price"))


def accuracy(y: str = "units", f: str = "predicted") -> list[Column]:
    """Aggregates of forecast accuracy over the rows with both values."""
    ok = F.col(y).isNotNull() & F.col(f).isNotNull() & ~F.isnan(f)
    a, e = F.when(ok, F.col(y)), F.when(ok, F.col(f) - F.col(y))
    total, rows = F.sum(a), F.count(a)
    return [rows.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), safe(F.sum(F.abs(e)), total).alias("wmape"), F.avg(e).alias("bias"),
            safe(F.sum(e), total).alias("bias_pct"), F.avg(F.when(a != 0, F.abs(e / a))).alias("mape"), F.sum(F.when(a == 0, 1).otherwise(0)).alias("mape_excluded"),
            total.alias("actual_total"), F.sum(F.when(ok, F.col(f))).alias("predicted_total")]


def by_segments(df: DataFrame, segments: list[str], least: int = 30) -> DataFrame:
    """Accuracy by the values of each segment column in one pass; small groups are left out."""
    long = df.select("units", "predicted", F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), F.col(s).cast("string").alias("value")) for s in segments])).alias("s"))
    return long.groupBy("s.segment", "s.value").agg(*accuracy()).filter(F.col("n") >= least)


def hierarchy(df: DataFrame) -> DataFrame:
    """Accuracy after summing to each level and date, by grouping sets."""
    levels = [["date", "product_id", "store_id"], ["date", "product_id"], ["date", "store_id"], ["date", "category"], ["date", "region"], ["date"]]
    columns = ["date", "product_id", "store_id", "category", "region"]
    sums = df.groupingSets([[F.col(c) for c in level] for level in levels], *columns).agg(
        F.sum("units").alias("units"), F.sum("predicted").alias("predicted"), F.grouping_id().alias("gid"))
    ids = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in level): "x".join(level[1:]) or "total" for level in levels}
    name = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return sums.groupBy(name[F.col("gid").cast("int")].alias("level")).agg(*accuracy())


def coherence(parts: DataFrame, top: DataFrame) -> DataFrame:
    """Bottom-up daily totals of predictions against an independent forecast of the daily total
    (date, predicted): days, largest gap and largest gap by the total."""
    up = parts.groupBy("date").agg(F.sum("predicted").alias("bottom_up"))
    gap = F.abs(F.col("bottom_up") - F.col("predicted"))
    return up.join(top.select("date", "predicted"), "date").agg(F.count(F.lit(1)).alias("days"), F.max(gap).alias("gap"), F.max(safe(gap, F.abs("predicted"))).alias("gap_pct"))


def zero_profile(df: DataFrame) -> DataFrame:
    sums = df.agg(F.count("units").alias("rows"), F.avg((F.col("units") == 0).cast("int")).alias("zero_share"), F.avg((F.col("units") < 5).cast("int")).alias("low_share"),
                  F.avg("units").alias("mean"))
    middle = quantiles(df, F.col("units"), [0.5])
    return sums.join(F.broadcast(middle), how="left").select(F.col("rows").alias("n"), "zero_share", "low_share", "mean", F.col("q")[0].alias("median"))  # one row each


def distribution(df: DataFrame, c: str) -> DataFrame:
    sums = df.agg(F.count(c).alias("rows"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
    return sums.join(F.broadcast(quantiles(df, F.col(c), [0.1, 0.5, 0.9])), how="left").select(  # one row each
        F.col("rows").alias("n"), "mean", "std", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"), safe(F.col("std"), F.col("mean")).alias("cv"))


def missing(df: DataFrame) -> DataFrame:
    """Null rate of each column, worst first."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rate")) for c in df.columns])
    return rates.select(F.inline(pairs)).withColumn("all_null", F.col("null_rate") == 1).orderBy(F.col("null_rate").desc(), "column_name")


def economics(df: DataFrame, last: int = 90) -> DataFrame:
    """Per product over its last days: price, units a day and unit cost, from unpromoted rows
    where there are any."""
    edge = df.groupBy("product_id").agg(F.max("date").alias("edge"))
    rows = df.join(edge, "product_id").filter(F.col("date") > F.date_sub("edge", last))
    plain = F.max((~F.col("promotion_flag")).cast("int")).over(Window.partitionBy("product_id")) == 1
    used = rows.withColumn("__plain", plain).filter(~F.col("__plain") | ~F.col("promotion_flag"))
    return used.groupBy("product_id").agg(F.avg("selling_price").alias("price"), (F.sum("units") / F.count_distinct("date")).alias("units_a_day"),
                                          F.coalesce(safe(F.sum("cost"), F.sum("units")), 0.62 * F.avg("selling_price")).alias("unit_cost"))


def weekly(df: DataFrame) -> DataFrame:
    """Weekly units by product with absent weeks as zero; weeks are named by their Sunday."""
    week = F.date_add(F.to_date(F.date_trunc("week", "date")), 6)
    sums = df.groupBy("product_id", week.alias("week")).agg(F.sum("units").alias("units"))
    grid = sums.groupBy("product_id").agg(F.explode(F.sequence(F.min("week"), F.max("week"), F.expr("interval 7 days"))).alias("week"))
    return grid.join(sums, ["product_id", "week"], "left").fillna(0, ["units"])


def holt(weeks: DataFrame, alpha: float = 0.3, beta: float = 0.1) -> DataFrame:
    """Level and trend of each product's weekly series, by a fold over its sorted weeks."""
    series = weeks.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("week", F.col("units").cast("double").alias("y")))).alias("s"))
    start = F.struct(F.col("s")[0]["y"].alias("level"), F.lit(0.0).alias("trend"))

    def step(a: Column, x: Column) -> Column:
        level = alpha * x["y"] + (1 - alpha) * (a["level"] + a["trend"])
        return F.struct(level.alias("level"), (beta * (level - a["level"]) + (1 - beta) * a["trend"]).alias("trend"))

    return series.select("product_id", F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), start, step).alias("a")).select("product_id", "a.level", "a.trend")


def conformal(df: DataFrame, bucket: str, alpha: float = 0.1, least: int = 100) -> DataFrame:
    """Split-conformal width of each bucket: the residual quantile at min(ceil((n + 1)(1 -
    alpha)) / n, 1), interpolated between order statistics."""
    r = F.abs(F.col("units") - F.col("predicted")) / F.greatest(F.col("predicted"), F.lit(1.0))
    rows = df.filter(F.col("units").isNotNull() & F.col("predicted").isNotNull()).select(F.col(bucket).alias("bucket"), r.alias("r"))
    at = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"), F.lit(1.0)) * (F.col("n") - 1)
    found = order_statistics(rows, F.col("r"), [at], ["bucket"])
    return found.filter(F.col("n") >= least).select("bucket", "n", F.col("q")[0].alias("width"))


def intervals(df: DataFrame, widths: DataFrame, bucket: str) -> DataFrame:
    w = widths.select(F.col("bucket").alias(bucket), "width")
    half = F.col("width") * F.greatest(F.col("predicted"), F.lit(1.0))
    return df.join(w, bucket, "left").withColumns({"lower": F.greatest(F.col("predicted") - half, F.lit(0.0)), "upper": F.col("predicted") + half})


def coverage(df: DataFrame, nominal: float = 0.9) -> DataFrame:
    inside = F.col("units").between(F.col("lower"), F.col("upper")).cast("double")
    return df.agg(F.count("units").alias("n"), F.avg(inside).alias("empirical"), F.avg(F.col("upper") - F.col("lower")).alias("mean_width")).withColumn(
        "calibrated", F.abs(F.col("empirical") - nominal) <= 0.05)


def naive_scale(df: DataFrame, season: int = 7) -> DataFrame:
    past = F.lag("units", season).over(Window.partitionBy(*KEYS).orderBy("date"))
    return df.withColumn("__e", F.abs(F.col("units") - past)).agg(F.avg("__e").alias("scale"))


def psi(df: DataFrame, feature: str, split: Column, bins: int = 10, tiny: float = 1e-6, least: int = 50) -> DataFrame:
    """Population stability of a feature between reference rows (split true) and the rest."""
    rows = df.filter(F.col(feature).isNotNull()).select(F.col(feature).cast("double").alias("x"), split.alias("ref"))
    edges = quantiles(rows.filter("ref"), F.col("x"), [i / bins for i in range(1, bins)]).select(F.array_distinct("q").alias("edges"))
    binned = rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("x"))))
    counts = binned.groupBy("bin").agg(F.sum(F.col("ref").cast("long")).alias("a"), F.sum((~F.col("ref")).cast("long")).alias("b"))
    total = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    pa, pb = F.greatest(F.col("a") / F.col("na"), F.lit(tiny)), F.greatest(F.col("b") / F.col("nb"), F.lit(tiny))
    return counts.crossJoin(F.broadcast(total)).groupBy("na", "nb").agg(F.sum((pb - pa) * F.ln(pb / pa)).alias("psi")).select(
        F.lit(feature).alias("feature"), F.when((F.col("na") >= least) & (F.col("nb") >= least), F.col("psi")).alias("psi")).withColumn(
        "severity", F.when(F.col("psi") >= 0.25, "major").when(F.col("psi") >= 0.1, "minor").otherwise("none"))
