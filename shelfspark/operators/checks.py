"""Data-quality jobs: each gives rows (check, failing, total, passed) from one or two passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.windows import KEYS


def rules(df: DataFrame, table: str, tests: dict[str, Column]) -> DataFrame:
    """One aggregate pass over failing conditions; a null condition does not fail."""
    sums = df.agg(F.count(F.lit(1)).alias("__total"), *[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in tests.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).alias("failing")) for n in tests])
    return sums.select(F.lit(table).alias("table_name"), F.col("__total").alias("total"), F.inline(rows)).withColumn("passed", F.col("failing") == 0)


def sales(df: DataFrame) -> DataFrame:
    c = F.col
    return rules(df, "sales_daily", {
        "negative_units": c("units") < 0, "price_not_positive": c("selling_price") <= 0, "discount_range": ~c("discount_percentage").between(0, 100),
        "price_over_regular": c("selling_price") > c("regular_price") + 0.01, "revenue_mismatch": F.abs(c("revenue") - c("units") * c("selling_price")) > 0.05,
        "profit_mismatch": F.abs(c("gross_profit") - (c("revenue") - c("cost"))) > 0.05, "null_key": c("date").isNull() | c("product_id").isNull() | c("store_id").isNull()})


def inventory(df: DataFrame) -> DataFrame:
    c = F.col
    return rules(df, "inventory", {"identity": c("opening_inventory") + c("received_units") - c("sold_units") != c("closing_inventory"),
                                   "negative_closing": c("closing_inventory") < 0, "oversold": c("sold_units") > c("opening_inventory") + c("received_units")})


def promotions(df: DataFrame) -> DataFrame:
    c = F.col
    return rules(df, "promotions", {"inverted_dates": c("start_date") > c("end_date"), "discount_range": ~((c("discount_percentage") > 0) & (c("discount_percentage") < 100)),
                                    "negative_spend": c("promotion_spend") < 0})


def duplicates(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failing")).select(F.lit(table).alias("table_name"), F.lit("duplicate_key").alias("check"), "failing", (F.col("failing") == 0).alias("passed"))


def static_prices(df: DataFrame, most: float = 0.1) -> DataFrame:
    """Share of products whose price never changes."""
    per = df.groupBy("product_id").agg((F.min("selling_price") == F.max("selling_price")).alias("static"))
    return per.agg(F.avg(F.col("static").cast("int")).alias("share")).withColumn("passed", F.col("share") < most)


def summary(checks: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [c.select("table_name", "check", "failing", "passed") for c in checks])
    return rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("checks"), F.sum(F.col("passed").cast("int")).alias("passed"), F.sum("failing").alias("failing"))


def panel(df: DataFrame) -> DataFrame:
    """Forecast-panel suite: rows, series, span, gaps, zero and promoted shares, flag agreement."""
    per = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.datediff(F.max("date"), F.min("date")).alias("span"), F.sum((F.col("units") == 0).cast("int")).alias("zero"),
                                F.sum(F.col("promotion_flag").cast("int")).alias("promoted"), F.sum(F.col("stockout_flag").cast("int")).alias("out"),
                                F.sum((F.col("promotion_flag") & (F.col("discount_percentage") <= 0)).cast("int")).alias("flag_without_discount"))
    return per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("series"), F.sum(F.greatest(F.col("span") + 1 - F.col("n"), F.lit(0))).alias("missing_days"),
                   F.sum("flag_without_discount").alias("flag_without_discount"), F.sum((F.col("promoted") > 0.95 * F.col("n")).cast("int")).alias("always_treated"),
                   F.sum((F.col("n") < 180).cast("int")).alias("short_series"), (F.sum("zero") / F.sum("n")).alias("zero_share"),
                   (F.sum("promoted") / F.sum("n")).alias("promoted_share"), (F.sum("out") / F.sum("n")).alias("stockout_share"))


def quarantine(df: DataFrame) -> DataFrame:
    """Rows with the reasons that keep them out (an empty list for good rows)."""
    c = F.col
    reasons = {"null_id": c("product_id").isNull() | c("store_id").isNull(), "price": c("selling_price") <= 0, "units": c("units") < 0,
               "discount": ~c("discount_percentage").between(0, 100), "reconciliation": F.abs(c("revenue") - c("units") * c("selling_price")) > 0.05}
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in reasons.items()])))
