"""Table contracts, keys, dimension checks and panel suites.  Every check is a row; all
failures are collected, none stops the others."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.windows import KEYS, by_date


@dataclass(frozen=True)
class Field:
    """One column's terms: type it must cast to, whether null is allowed, bounds, allowed values."""

    name: str
    kind: str
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Contract:
    table: str
    key: tuple[str, ...]
    fields: tuple[Field, ...]
    rules: dict[str, str] = field(default_factory=dict)  # name: condition in SQL that a good row satisfies


def _stacked(sums: DataFrame, table: str, names: list[tuple[str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(p).alias("problem"), F.coalesce(F.col(f"x{i}"), F.lit(0)).cast("long").alias("failing")) for i, (c, p) in enumerate(names)])
    return sums.select(F.lit(table).alias("table_name"), F.inline(rows))


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """(table_name, column_name, problem, failing) in one pass: absent columns (all rows fail),
    values that do not cast, nulls, values out of range or not allowed, broken rules."""
    names, sums = [], []

    def test(column: str, problem: str, bad: Column) -> None:
        names.append((column, problem))
        sums.append(F.sum(F.when(bad, 1).otherwise(0)).alias(f"x{len(sums)}"))

    for f in contract.fields:
        if f.name not in df.columns:
            test(f.name, "absent", F.lit(True))
            continue
        c = F.col(f.name)
        test(f.name, "type", c.isNotNull() & c.try_cast(f.kind).isNull())
        if not f.nullable:
            test(f.name, "null", c.isNull())
        if f.low is not None or f.high is not None:
            low, high = (F.lit(False) if x is None else y for x, y in ((f.low, c < F.lit(f.low)), (f.high, c > F.lit(f.high))))
            test(f.name, "range", low | high)
        if f.allowed:
            test(f.name, "allowed", ~c.isin(*f.allowed))
    for name, good in contract.rules.items():
        test(name, "rule", ~F.expr(good))
    return _stacked(df.agg(*sums), contract.table, names)


def primary_key(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """(table_name, problem, failing): key columns that are absent, rows with a null component,
    rows beyond the first of each key.  Where no key column is there, only those are reported."""
    there = [c for c in key if c in df.columns]
    if not there:
        one = df.sparkSession.range(1).withColumns({"nulls": F.lit(0), "again": F.lit(0)})
        return _key_rows(one, table, len(key))
    null = reduce(Column.__or__, [F.col(c).isNull() for c in there], F.lit(False))
    groups = df.withColumn("null_", null).groupBy(*there).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("null_").cast("int")).alias("nulls"))
    sums = groups.agg(F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("again"))
    return _key_rows(sums, table, len(key) - len(there))


def _key_rows(sums: DataFrame, table: str, absent: int) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("problem"), v.cast("long").alias("failing")) for n, v in
                     (("absent_columns", F.lit(absent)), ("null_component", F.col("nulls")), ("duplicate_rows", F.col("again")))])
    return sums.select(F.lit(table).alias("table_name"), F.inline(rows))


def gaps(days: DataFrame) -> DataFrame:
    """(date, after, missing): dates that do not follow the date before by one day.  days: one row
    a date."""
    w = Window.orderBy("date")  # a calendar: a few thousand rows
    rows = days.select("date", F.lag("date").over(w).alias("after"))
    return rows.withColumn("missing", F.datediff("date", "after") - 1).filter("missing <> 0")


def _checks(table: str, tests: dict[str, DataFrame]) -> DataFrame:
    """One row a test from one-row, one-column counts."""
    rows = [df.toDF("failing").select(F.lit(table).alias("table_name"), F.lit(n).alias("rule"), F.col("failing").cast("long").alias("failing")) for n, df in tests.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("failing") == 0)


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)))


def surplus(df: DataFrame, key: str) -> DataFrame:
    """One row: the rows beyond the first of each key; rows without a key are all surplus."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)))


def dimensions(products: DataFrame, stores: DataFrame, calendar: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keys unique, calendar contiguous and with festivals, no internal columns, substitutes
    with a positive cross effect and complements with a negative one."""
    internal = sum(c.startswith("_") for df in (products, stores, calendar, pairs) for c in df.columns)
    return _checks("dimensions", {
        "product_key": surplus(products, "product_id"), "store_key": surplus(stores, "store_id"), "calendar_gaps": _count(gaps(calendar.select("date"))),
        "no_festivals": calendar.agg((F.count(F.when(F.col("festival_flag"), 1)) == 0).cast("long")), "internal_columns": calendar.agg(F.max(F.lit(internal))),
        "substitute_sign": _count(pairs.filter("relationship_type = 'substitute' and cross_elasticity <= 0")),
        "complement_sign": _count(pairs.filter("relationship_type = 'complement' and cross_elasticity >= 0"))})


def promotion_suite(df: DataFrame, least_types: int = 3) -> DataFrame:
    """Unique ids and enough types."""
    return _checks("promotions", {"duplicate_id": surplus(df, "promotion_id"),
                                  "few_types": df.agg((F.count_distinct("promotion_type") < least_types).cast("long"))})


def pricing_suite(df: DataFrame, tests: Column, static: float = 0.1) -> DataFrame:
    """Prices above zero, few products whose price never moves, randomised tests present."""
    per = df.groupBy("product_id").agg((F.min("selling_price") == F.max("selling_price")).cast("int").alias("static"))
    return _checks("pricing", {"price_not_positive": _count(df.filter("selling_price <= 0")), "static_products": per.agg((F.avg("static") >= static).cast("long")),
                               "no_randomised_tests": df.agg((F.count(F.when(tests, 1)) == 0).cast("long"))})


def stockout_rate(df: DataFrame, most: float = 0.35) -> DataFrame:
    """(rate, status): WARN outside 0 .. most, both excluded."""
    rate = df.agg(F.avg(F.col("stockout_flag").cast("int")).alias("rate"))
    return rate.withColumn("status", F.when((F.col("rate") > 0) & (F.col("rate") < most), "PASS").otherwise("WARN"))


def suite(measures: DataFrame, limits: dict[str, tuple[float, float, str]]) -> DataFrame:
    """(measure, value, status) of a one-row table: PASS inside the limits (low, high, both
    included), else the limit's own status, WARN or FAIL."""
    rows = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value"),
                              F.when(F.col(n).between(low, high), "PASS").otherwise(bad).alias("status")) for n, (low, high, bad) in limits.items()])
    return measures.select(F.inline(rows))


#: Limits of the panel suites.
FORECAST_LIMITS = {
    "duplicates": (0, 0, "FAIL"), "missing_days": (0, 0, "WARN"), "negative_units": (0, 0, "FAIL"), "zero_share": (0, 0.5, "WARN"), "missing_target": (0, 0, "FAIL"),
    "price_not_positive": (0, 0, "FAIL"), "price_jumps": (0, 0, "WARN"), "flag_without_discount": (0, 0, "WARN"), "promoted_share": (0.000001, 0.6, "WARN"), "stockout_share": (0, 0.35, "WARN")}
UPLIFT_LIMITS = {
    "duplicates": (0, 0, "FAIL"), "missing_treatment": (0, 0, "FAIL"), "missing_outcome": (0, 0, "FAIL"), "negative_units": (0, 0, "FAIL"), "price_not_positive": (0, 0, "FAIL"),
    "flag_without_discount": (0, 0, "WARN"), "discount_without_flag": (0, 0.05, "WARN"), "overlapping_events": (0, 0, "WARN"), "censoring_gap": (0, 0.01, "WARN"),
    "short_history": (0, 0, "WARN"), "control_share": (0.1, 1, "FAIL"), "always_treated": (0, 0, "WARN"), "promoted_share": (0.000001, 0.6, "WARN"), "missing_days": (0, 0, "WARN")}


def _share(c: Column) -> Column:
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))


def _total(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def _base(df: DataFrame) -> DataFrame:
    """One row: duplicates, missing days, short and always promoted series."""
    per = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("days"), F.datediff(F.max("date"), F.min("date")).alias("span"),
                                F.sum(F.col("promotion_flag").cast("int")).alias("promoted"))
    return per.agg(F.sum(F.col("n") - F.col("days")).alias("duplicates"), F.sum(F.greatest(F.col("span") + 1 - F.col("days"), F.lit(0))).alias("missing_days"),
                   _total(F.col("n") < 180).alias("short_history"), _total(F.col("promoted") > 0.95 * F.col("n")).alias("always_treated"))


def forecast_suite(df: DataFrame) -> DataFrame:
    c = F.col
    before = F.lag("selling_price").over(by_date())
    rows = df.withColumn("ratio", F.when(before > 0, c("selling_price") / before))
    one = rows.agg(_total(c("units") < 0).alias("negative_units"), _share(c("units") == 0).alias("zero_share"), _total(c("units").isNull()).alias("missing_target"),
                   _total(c("selling_price") <= 0).alias("price_not_positive"), _total((c("ratio") > 10) | (c("ratio") < 0.1)).alias("price_jumps"),
                   _total(c("promotion_flag") & (c("discount_percentage") <= 0)).alias("flag_without_discount"), _share(c("promotion_flag")).alias("promoted_share"), _share(c("stockout_flag")).alias("stockout_share"))
    return suite(_base(df).crossJoin(F.broadcast(one)), FORECAST_LIMITS)  # one row each


def uplift_suite(df: DataFrame, events: DataFrame, deep: float = 8.0) -> DataFrame:
    """The 14 checks of an uplift panel; a discount of `deep` per cent without a flag counts."""
    c = F.col
    one = df.agg(_total(c("promotion_flag").isNull()).alias("missing_treatment"), _total(c("units").isNull()).alias("missing_outcome"), _total(c("units") < 0).alias("negative_units"),
                 _total(c("selling_price") <= 0).alias("price_not_positive"), _total(c("promotion_flag") & (c("discount_percentage") <= 0)).alias("flag_without_discount"),
                 _share(~c("promotion_flag") & (c("discount_percentage") >= deep)).alias("discount_without_flag"), _share(~c("promotion_flag")).alias("control_share"), _share(c("promotion_flag")).alias("promoted_share"),
                 F.abs(F.avg(F.when(c("promotion_flag"), c("stockout_flag").cast("int"))) - F.avg(F.when(~c("promotion_flag"), c("stockout_flag").cast("int")))).alias("censoring_gap"))
    last = F.max("end_date").over(Window.partitionBy(*KEYS).orderBy("start_date", "end_date", "promotion_id").rowsBetween(Window.unboundedPreceding, -1))
    overlap = events.withColumn("last", last).agg(_total(c("start_date") <= c("last")).alias("overlapping_events"))
    return suite(_base(df).crossJoin(F.broadcast(one)).crossJoin(F.broadcast(overlap)), UPLIFT_LIMITS)
