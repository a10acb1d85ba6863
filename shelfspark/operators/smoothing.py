"""Exponential smoothing of weekly sums at several levels, scored on the last weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators import metrics

#: Weeks held out, in a season, in a series at least (without those held out), and in one with a season.
HELD, SEASON, LEAST, SEASONAL = 12, 52, 26, 104
LEVELS = {"total": (), "region": ("region",), "category": ("category",), "category_region": ("category", "region")}


def level_weeks(df: DataFrame) -> DataFrame:
    """(level, key, week, units): weekly units in total, by region, by category and by both, from one
    pass over grouping sets; absent weeks are zero and weeks are named by their Sunday.  Values of
    a key are joined by a bar, and an unknown category or region is named so."""
    columns = ["week", "category", "region"]
    week = F.date_add(F.to_date(F.date_trunc("week", "date")), 6)
    rows = df.select(week.alias("week"), *[F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in columns[1:]], "units").filter("week is not null")
    sums = rows.groupingSets([[F.col(c) for c in ("week", *by)] for by in LEVELS.values()], *columns).agg(F.sum("units").alias("units"), F.grouping_id().alias("gid"))
    ids = {sum(1 << i for i, c in enumerate(reversed(columns)) if c not in ("week", *by)): level for level, by in LEVELS.items()}
    level = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])[F.col("gid").cast("int")]
    key = F.concat_ws("|", "category", "region")
    sums = sums.select(level.alias("level"), F.when(key == "", "all").otherwise(key).alias("key"), "week", "units")
    grid = sums.groupBy("level", "key").agg(F.explode(F.sequence(F.min("week"), F.max("week"), F.expr("interval 7 days"))).alias("week"))
    return grid.join(sums, ["level", "key", "week"], "left").fillna(0, ["units"])


def held_out(weeks: DataFrame, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.2) -> DataFrame:
    """Forecasts of the last HELD weeks of each (level, key), from additive smoothing of the weeks
    before: level, trend and, where SEASONAL weeks are known, a season.  Series with fewer than
    LEAST weeks before are left out; forecasts are not negative.

    A series is one sorted array (a few hundred weeks whatever the number of sales) and a fold over
    it.  The season is a queue: its head is what was learnt a season ago.  Without a season the
    queue is one zero that is never changed."""
    point = F.struct("week", F.col("units").cast("double").alias("y"))
    series = weeks.groupBy("level", "key").agg(F.array_sort(F.collect_list(point)).alias("s")).filter(F.size("s") >= LEAST + HELD)
    known = F.size("s") - HELD
    series = series.withColumns({"seasonal": known >= SEASONAL, "weeks": F.size("s"), "train": F.slice("s", F.lit(1), known), "test": F.slice("s", -HELD, HELD)})
    first = F.aggregate(F.slice("train", 1, SEASON), F.lit(0.0), lambda a, x: a + x["y"]) / SEASON
    start = F.when(F.col("seasonal"), F.struct(first.alias("level"), F.lit(0.0).alias("trend"), F.transform(F.slice("train", 1, SEASON), lambda x: x["y"] - first).alias("queue"))).otherwise(
        F.struct(F.col("train")[0]["y"].alias("level"), F.lit(0.0).alias("trend"), F.array(F.lit(0.0)).alias("queue")))
    skip = F.when(F.col("seasonal"), SEASON).otherwise(1)
    g = F.when(F.col("seasonal"), gamma).otherwise(0.0)

    def step(a: Column, x: Column) -> Column:
        head = a["queue"][0]
        level = alpha * (x["y"] - head) + (1 - alpha) * (a["level"] + a["trend"])
        season = g * (x["y"] - level) + (1 - g) * head
        return F.struct(level.alias("level"), (beta * (level - a["level"]) + (1 - beta) * a["trend"]).alias("trend"),
                        F.concat(F.slice(a["queue"], F.lit(2), F.size(a["queue"]) - 1), F.array(season)).alias("queue"))

    series = series.withColumn("start", start)
    fitted = series.withColumn("a", F.aggregate(F.slice("train", skip + 1, F.size("train") - skip), F.col("start"), step))
    ahead = fitted.select("level", "key", "weeks", "seasonal", "a", F.posexplode("test").alias("h", "x"))
    season = F.when(F.col("seasonal"), F.get("a.queue", F.col("h"))).otherwise(0.0)
    predicted = F.col("a.level") + (F.col("h") + 1) * F.col("a.trend") + season
    return ahead.select("level", "key", "weeks", "seasonal", F.col("x.week").alias("week"), F.col("x.y").alias("units"), F.greatest(predicted, F.lit(0.0)).alias("predicted"))


def report(held: DataFrame) -> DataFrame:
    """Accuracy of each series over its held-out weeks."""
    return held.groupBy("level", "key", "weeks", "seasonal").agg(*metrics.accuracy())


def by_level(held: DataFrame) -> DataFrame:
    """Of each level: series fitted, those with a season, and the mean and greatest WMAPE."""
    return report(held).groupBy("level").agg(F.count(F.lit(1)).alias("fits"), F.sum(F.col("seasonal").cast("int")).alias("with_season"), F.avg("wmape").alias("mean_wmape"), F.max("wmape").alias("worst_wmape"))
