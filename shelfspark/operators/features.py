"""Feature panel: groups of features in one pass, feature sets, training sets and guards.

The panel is built entity, demand, price, calendar: dimensions join by key, all windows share
the partitioning by product and store, so the whole panel takes one shuffle of the facts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import scalar
from shelfspark.operators import joins, windows
from shelfspark.operators.windows import KEYS, safe

#: Columns of each group of features; every set carries the keys besides.
GROUPS = {
    "entity": ("category", "product_age_days", "is_new_product", "channel", "store_age_days"),
    "demand": ("lag_1", "lag_7", "lag_28", "rolling_mean_7", "rolling_mean_28", "momentum"),
    "pricing": ("discount_depth", "price_change_7", "price_vs_28", "historical_price"),
    "promotion": ("on_promotion", "event_discount", "days_into", "days_left", "promotion_intensity"),
    "inventory": ("available", "stockout_yesterday"),
    "competitor": ("rival_price", "price_gap", "price_ratio"),
    "calendar": ("day_of_week", "month", "weekend", "financial_quarter"),
}
#: Families of columns that a selection may drop.
FAMILIES = {
    "target": ("units", "revenue", "cost", "gross_profit"),
    "supply": ("stockout_flag", "inventory_available"),
    "promotion": ("promotion_flag", "promotion_id", "discount_percentage", *GROUPS["promotion"]),
    "identifier": KEYS,
}
#: Columns that an event changes itself: never part of an adjustment set.
AFTER_TREATMENT = (*FAMILIES["target"], "selling_price", "discount_depth", "discount_percentage", "stockout_flag", "promotion_flag", "inventory_available")


def ages(df: DataFrame, products: DataFrame, stores: DataFrame, new: int = 90) -> DataFrame:
    """Product and store attributes with their ages on the row's date, from launch_date and
    opening_date: product_age_days, is_new_product (under `new` days), store_age_days."""
    out = joins.attributes(joins.attributes(df, products, "product_id"), stores, "store_id")
    age = F.datediff("date", "launch_date")
    return out.withColumns({"product_age_days": age, "is_new_product": age < new, "store_age_days": F.datediff("date", "opening_date")})


def intensity(df: DataFrame) -> DataFrame:
    """promotion_intensity: an event's spend for each of its days, zero outside events."""
    each = safe(F.col("promotion_spend"), F.col("duration_days"))
    return df.withColumn("promotion_intensity", F.when(F.col("on_promotion"), F.coalesce(each, F.lit(0.0))).otherwise(0.0))


def stock(df: DataFrame, inventory: DataFrame) -> DataFrame:
    """What was available on the row's date, and whether the listing ran out on the row before."""
    held = inventory.select("date", *KEYS, (F.col("opening_inventory") + F.col("received_units")).alias("available"))
    before = F.lag("stockout_flag", 1).over(windows.by_date())
    return df.join(held, ["date", *KEYS], "left").withColumn("stockout_yesterday", F.coalesce(before, F.lit(False)))


def panel(sales: DataFrame, products: DataFrame, stores: DataFrame, promotions: DataFrame | None = None,
          inventory: DataFrame | None = None, rivals: DataFrame | None = None) -> DataFrame:
    """All groups whose tables are given, on every row of sales."""
    out = ages(sales, products, stores)
    out = windows.demand_dynamics(windows.demand_rolling(windows.demand_lags(out)))
    out = scalar.date_parts(windows.price_features(out))
    if promotions is not None:
        spend = promotions.select("promotion_id", "promotion_spend")
        out = intensity(joins.promotion_features(out, promotions).join(spend, "promotion_id", "left"))
    if inventory is not None:
        out = stock(out, inventory)
    if rivals is not None:
        out = windows.competitor_features(out, rivals)
    return out


def group_set(features: DataFrame, group: str) -> DataFrame:
    """Keys and the columns of one group; an unknown group, or one of which the panel has
    nothing, is an error."""
    columns = [c for c in GROUPS[group] if c in features.columns]
    if not columns:
        raise ValueError(f"the panel has no column of the group {group}")
    return features.select("date", *KEYS, *columns)


def without(df: DataFrame, *families: str) -> DataFrame:
    """df without the columns of the named families."""
    return df.drop(*(c for f in families for c in FAMILIES[f]))


def training(features: DataFrame, groups: list[str], target: str = "units", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Keys, target as y and the columns of the groups but for excluded ones; rows without a
    target are left out."""
    columns = [c for g in groups for c in GROUPS[g] if c in features.columns and c not in exclude]
    return features.filter(F.col(target).isNotNull()).select("date", *KEYS, F.col(target).alias("y"), *columns)


def guarded(covariates: list[str]) -> list[str]:
    """The covariates, or an error that names those which an event changes itself."""
    if bad := sorted(set(covariates) & set(AFTER_TREATMENT)):
        raise ValueError(f"not known before treatment: {', '.join(bad)}")
    return covariates


def complete(df: DataFrame, treated: Column, prefixes: tuple[str, ...] = ("demand_", "promo_share")) -> DataFrame:
    """Rows whose covariates (by prefix) are all known; an error when no treated row is left."""
    out = df.na.drop(subset=[c for c in df.columns if c.startswith(prefixes)])
    if out.filter(treated).isEmpty():
        raise ValueError("no treated row has all covariates")
    return out


def levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, level, code): codes of categories in the order of their names, over the whole data
    set, so that a fold without a level codes the others alike.  Null is no level."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level")) for c in columns])).alias("v"))
    distinct = long.select("v.name", "v.level").filter("level is not null").distinct()
    return distinct.withColumn("code", F.row_number().over(Window.partitionBy("name").orderBy("level")) - 1)


def coded(df: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """df with `name`_code: the level's code, -1 for a level that is not in the table."""
    codes = found.filter(F.col("name") == name).select(F.col("level").alias(name), F.col("code").alias(f"{name}_code"))
    return df.join(codes, name, "left").fillna(-1, [f"{name}_code"])


def cached(spark: SparkSession, root: str, spec: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The panel that `spec` describes: read from its folder under root where a finished one is
    there, else built, written and read back.  root must be shared by driver and executors."""
    key = hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{root}/panel-{key}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.mode("ignore").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def family_importance(importance: DataFrame, family_of: Column) -> DataFrame:
    """(family, bucket, importance, share) from (feature, bucket, importance)."""
    sums = importance.groupBy(family_of.alias("family"), "bucket").agg(F.sum("importance").alias("importance"))
    return sums.withColumn("share", safe(F.col("importance"), F.sum("importance").over(Window.partitionBy("bucket"))))
