"""Row expressions and small calendar tables."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Holidays (month, day) and festival days (month, day) with their lead.
HOLIDAYS = ((1, 26), (8, 15), (10, 2), (12, 25))
FESTIVALS = ((10, 15), (12, 25))
LEAD_DAYS = 6
BUCKETS = ((3, "1-3"), (7, "4-7"), (14, "8-14"), (28, "15-28"), (56, "29-56"), (90, "57-90"))


def training_rows(df: DataFrame) -> DataFrame:
    """One row: rows lost to each reason, one reason after the other, and rows kept."""
    out, promo = F.coalesce(F.col("stockout_flag"), F.lit(False)), F.coalesce(F.col("promotion_flag"), F.lit(False))
    none = F.col("units").isNull()

    def n(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0))

    return df.agg(F.count(F.lit(1)).alias("total"), n(out).alias("stockout"), n(~out & promo).alias("promoted"),
                  n(~out & ~promo & none).alias("no_target"), n(~out & ~promo & ~none).alias("kept"))


def censored(df: DataFrame) -> DataFrame:
    """units is blank on stockout days; units_uncensored keeps it."""
    return df.withColumn("units_uncensored", F.col("units")).withColumn("units", F.when(~F.coalesce(F.col("stockout_flag"), F.lit(False)), F.col("units")))


def date_parts(df: DataFrame) -> DataFrame:
    d, month = F.col("date"), F.month("date")
    fm = F.pmod(month - 4, F.lit(12)) + 1
    turn = F.dayofyear(d) / 365.25
    return df.withColumns({
        "day_of_week": F.weekday(d), "week_of_year": F.weekofyear(d), "month": month, "quarter": F.quarter(d), "year": F.year(d), "weekend": F.weekday(d) >= 5,
        "financial_month": fm, "financial_quarter": F.floor((fm - 1) / 3) + 1, "financial_year": F.year(d) - F.when(month < 4, 1).otherwise(0),
        "dow_sin": F.sin(2 * pi * F.weekday(d) / 7), "dow_cos": F.cos(2 * pi * F.weekday(d) / 7), "month_sin": F.sin(2 * pi * month / 12), "month_cos": F.cos(2 * pi * month / 12),
        "doy_sin": F.sin(2 * pi * turn), "doy_cos": F.cos(2 * pi * turn), "season_sin_2": F.sin(4 * pi * turn), "season_cos_2": F.cos(4 * pi * turn)})


def time_index(df: DataFrame) -> DataFrame:
    """Days since the frame's first date."""
    first = df.agg(F.min("date").alias("__first"))  # one row
    return df.crossJoin(F.broadcast(first)).withColumn("time_index", F.datediff("date", "__first")).drop("__first")


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The calendar dimension of a date range."""
    return calendar_of(spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date")))


def days_of(df: DataFrame) -> DataFrame:
    """Every day from the first to the last date of a table."""
    return df.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))


def calendar_of(days: DataFrame) -> DataFrame:
    """Calendar attributes of the dates of `days`."""
    holiday, festival = F.lit(False), F.lit(False)
    for m, d in HOLIDAYS:
        holiday = holiday | ((F.month("date") == m) & (F.dayofmonth("date") == d))
    for m, d in FESTIVALS:
        day = F.make_date(F.year("date"), F.lit(m), F.lit(d))
        festival = festival | F.col("date").between(F.date_sub(day, LEAD_DAYS), day)
    month = F.month("date")
    season = F.when(month.isin(12, 1, 2), "winter").when(month <= 5, "summer").when(month <= 9, "monsoon").otherwise("autumn")
    return days.select("date", F.weekday("date").alias("day_of_week"), (F.weekday("date") >= 5).alias("weekend_flag"), holiday.alias("holiday_flag"),
                       festival.alias("festival_flag"), season.alias("season"))


def festival_proximity(days: DataFrame) -> DataFrame:
    """Days to the next festival day (today counts) and since the last one before today."""
    w = Window.orderBy("date")  # a calendar: a few thousand rows
    at = F.when(F.col("festival_flag"), F.col("date"))
    return days.withColumn("days_to_festival", F.datediff(F.min(at).over(w.rowsBetween(0, Window.unboundedFollowing)), "date")).withColumn(
        "days_since_festival", F.datediff("date", F.max(at).over(w.rowsBetween(Window.unboundedPreceding, -1))))


def logs(df: DataFrame) -> DataFrame:
    return df.filter("units > 0 and selling_price > 0").withColumns({"log_units": F.ln("units"), "log_price": F.ln("selling_price")})


def bucket(step: Column) -> Column:
    out = F.when(step <= BUCKETS[0][0], BUCKETS[0][1])
    for most, label in BUCKETS[1:]:
        out = out.when(step <= most, label)
    return out


def depth_band(pct: Column) -> Column:
    return F.when(pct <= 0, "none").when(pct <= 10, "0-10").when(pct <= 20, "10-20").when(pct <= 30, "20-30").otherwise("30-100")


def neutral(df: DataFrame) -> DataFrame:
    """Promotion features as if nothing were promoted."""
    zero = {c: F.lit(0.0) for c in ("discount_percentage", "promotion_spend", "promotion_duration") if c in df.columns}
    away = {c: F.lit(-1) for c in df.columns if c.startswith(("days_since_promotion", "days_to_next_promotion"))}
    flags = {c: F.lit(False) for c in ("promotion_flag", "display_flag", "bundle_flag") if c in df.columns}
    kind = {"promotion_type": F.lit(None).cast("string")} if "promotion_type" in df.columns else {}
    return df.withColumns(zero | away | flags | kind)


def curves(df: DataFrame) -> DataFrame:
    i = F.col("time_index")
    return df.withColumns({"seasonal": 1 + 0.2 * F.cos(2 * pi * (F.dayofyear("date") - 180) / 365.25), "trend": F.log1p(i / 365.0),
                           "ramp": 1 - F.exp(-3 * F.least(i / 180.0, F.lit(1.0))), "decay": F.pow(F.lit(0.5), i / 90.0)})


def coalesced(*columns: str, default: float = 0.0) -> Column:
    """The first of the columns that is neither null nor NaN, else the default."""
    return F.coalesce(*[F.when(~F.isnan(c), F.col(c)) for c in columns], F.lit(default))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(q / (1 - q))
