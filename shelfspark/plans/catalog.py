"""A catalogue of queries: each pairs a DataFrame builder with SQL for checking it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Halves round up, and so do values that summation order leaves a hair under one.
HALF = 0.5001
DATES = {"date", "start_date", "end_date", "last", "week", "month_start", "origin_date", "target_date", "anchor_date"}


class Tables:
    """The tables of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return src.table(self.spark, self.sf_dir, name)

    @property
    def sales(self) -> DataFrame:
        return self("sales_daily")


def add(name: str, build: Callable[[Tables], DataFrame], sql: str | None, tables: str = "sales_daily", plain: str = "", whole: str = "", doubles: str = "") -> None:
    """Register a query.  plain columns are taken as they are (dates as text), whole ones as
    bigint, doubles rounded to four places, on both sides."""
    p, w, d = plain.split(), whole.split(), doubles.split()
    dates = {c for c in p if c in DATES}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir)).select(
            *(F.col(c).cast("string").alias(c) if c in dates else c for c in p), *(F.col(c).cast("bigint").alias(c) for c in w), *((F.floor(F.col(c).cast("double") * 10000 + HALF) / 10000.0).alias(c) for c in d))

    QUERIES[name] = run
    if sql:
        shown = ", ".join([*(f"CAST({c} AS VARCHAR) AS {c}" if c in dates else c for c in p), *(f"CAST({c} AS BIGINT) AS {c}" for c in w), *(f"floor(CAST({c} AS DOUBLE) * 10000 + {HALF}) / 10000 AS {c}" for c in d)])
        ORACLES[name] = src.with_tables(f"SELECT {shown} FROM (\n{sql}\n) q", *tables.split())


PANEL = "date product_id store_id"
W = "OVER (PARTITION BY product_id, store_id ORDER BY date)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY product_id, store_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
