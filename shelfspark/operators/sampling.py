"""Reproducible samples in hash order: md5 of key and seed decides, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.windows import KEYS, running


def order(*key: str, seed: str = "7") -> Column:
    return F.md5(F.concat_ws("|", *key, F.lit(seed)))


def products(df: DataFrame, n: int) -> DataFrame:
    """n products, active ones first."""
    return df.orderBy(F.when(F.col("product_status") == "Active", 0).otherwise(1), order("product_id"), "product_id").limit(n)


def stratified(df: DataFrame, key: str, stratum: str, n: int) -> DataFrame:
    """n rows with equal shares of the strata; a shortfall is filled in hash order."""
    w = Window.partitionBy(stratum).orderBy(order(key), key)
    return df.withColumn("__n", F.row_number().over(w)).orderBy("__n", order(key), key).limit(n).drop("__n")


def listings(df: DataFrame, n: int) -> DataFrame:
    found = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("observations"), F.sum("units").alias("total_units"))
    return found.orderBy(order(*KEYS), *KEYS).limit(n)


def series(df: DataFrame, per_decile: int) -> DataFrame:
    """An equal number of series from each decile of volume."""
    found = df.groupBy(*KEYS).agg(F.sum("units").alias("total_units"))
    # ranks from the counts of distinct totals, in ranges, so that no task sorts all series
    counts = found.groupBy("total_units").agg(F.count(F.lit(1)).alias("n"))
    all_ = counts.agg(F.sum("n").alias("all_"))
    below = running(counts, "total_units", ["n"]).crossJoin(F.broadcast(all_)).select("total_units", "all_", (F.col("all_") - F.col("run_n")).alias("below"))
    same = Window.partitionBy("total_units").orderBy(*KEYS)
    ranked = found.join(below, "total_units").withColumn("rank", F.col("below") + F.row_number().over(same) - 1)
    # equal parts, the first `all % 10` of them with one more
    part, more = F.floor(F.col("all_") / 10), F.col("all_") % 10
    decile = F.when(F.col("rank") < more * (part + 1), F.floor(F.col("rank") / (part + 1))).otherwise(more + F.floor((F.col("rank") - more * (part + 1)) / part))
    ranked = ranked.withColumn("decile", (decile + 1).cast("int"))
    w = Window.partitionBy("decile").orderBy(order(*KEYS), *KEYS)
    return ranked.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= per_decile).drop("__n")


def adjacent(df: DataFrame, train: int = 365, test: int = 28, end: str | None = None) -> DataFrame:
    """One row: the first and last day of a training window and of the test window right after it,
    which ends at `end` or, where that is sooner, at the last date; `enough` says whether the dates
    reach back to the start."""
    edges = df.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    stop = F.least("last", F.to_date(F.lit(end)))  # a null end is left out
    begin = F.date_sub(stop, test - 1)
    return edges.select(F.date_sub(begin, train).alias("train_start"), F.date_sub(begin, 1).alias("train_end"), begin.alias("test_start"), stop.alias("test_end"),
                        (F.date_sub(begin, train) >= F.col("first")).alias("enough"))
