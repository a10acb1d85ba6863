"""All registered queries of the retail library, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import windows
from shelfspark.plans import (  # noqa: F401  registers
    catalog, check_queries, extra_queries, feature_queries, forecast_queries, model_queries, more_queries, panel_queries, study_queries, uplift_queries, window_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly units and revenue of each brand and region with the trailing demand at its end."""
    t = catalog.Tables(spark, sf_dir)
    daily = t.sales.withColumns({"lag_7": windows.lagged("units", 7), "rolling_28": windows.rolling("units", 28)})
    return daily.groupBy(F.to_date(F.date_trunc("week", "date")).alias("week"), "product_id", "store_id").agg(
        F.sum("units").alias("units"), F.round(F.sum("revenue"), 4).alias("revenue"),
        F.max_by("lag_7", "date").alias("lag_7"), F.round(F.max_by("rolling_28", "date"), 4).alias("rolling_28"))


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict:
    return dict(catalog.ORACLES)
