"""Whether a panel shows the relationships that analyses rest on: one row a relationship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.windows import safe


def _row(one: DataFrame, name: str, threshold: float, least: int = 1) -> DataFrame:
    """(relationship, observed, threshold, n, passed) of a one-row table (observed, n): passed when
    the observed value is above the threshold on at least `least` rows."""
    return one.select(F.lit(name).alias("relationship"), F.col("observed").cast("double").alias("observed"), F.lit(threshold).alias("threshold"), F.col("n").cast("long").alias("n"),
                      F.coalesce((F.col("observed") > threshold) & (F.col("n") >= least), F.lit(False)).alias("passed"))


def stockout_suppression(sales: DataFrame, expected: Column) -> DataFrame:
    """On stockout days the units are below what is expected, by more than on other days.
    expected: what would sell, from rows without a stockout."""
    rows = sales.withColumn("expected_", expected).filter("expected_ is not null")

    def short(c: Column) -> Column:
        return 1 - safe(F.sum(F.when(c, F.col("units"))), F.sum(F.when(c, F.col("expected_"))))

    out = F.col("stockout_flag")
    return _row(rows.agg((short(out) - short(~out)).alias("observed"), F.count(F.when(out, 1)).alias("n")), "stockouts_suppress_sales", 0.0)


def competitor_effect(sales: DataFrame, competitor: DataFrame, least: int = 200) -> DataFrame:
    """Units rise with a rival's price while the own price is held: product and month effects and
    the own price are taken out of both sides before the rival's price enters.  A rival's price
    that follows the own price exactly says nothing: no value."""
    rival = competitor.groupBy("date", "product_id").agg(F.avg("competitor_effective_price").alias("rival"))
    own = sales.filter("units > 0").groupBy("date", "product_id").agg(F.sum("units").alias("units"), F.avg("selling_price").alias("own"))
    rows = own.join(rival, ["date", "product_id"]).filter("rival > 0")
    rows = rows.select("product_id", F.date_trunc("month", "date").alias("date"), *[F.ln(F.greatest(F.col(c).cast("double"), F.lit(1e-6))).alias(c) for c in ("units", "own", "rival")])
    for key in ("product_id", "date"):  # means by a small table, so that no month is one task
        means = rows.groupBy(key).agg(*[F.avg(c).alias(f"m_{c}") for c in ("units", "own", "rival")])
        rows = rows.join(means, key).select("product_id", "date", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in ("units", "own", "rival")])
    y, p, q = (F.col(c) for c in ("units", "own", "rival"))
    # residuals of y and q on p are y - p (py / pp) and q - p (pq / pp); their slope from the sums
    s = rows.agg(F.sum(p * p).alias("pp"), F.sum(q * q).alias("qq"), F.sum(p * q).alias("pq"), F.sum(p * y).alias("py"), F.sum(q * y).alias("qy"), F.count(F.lit(1)).alias("n"))
    left = F.col("qq") - safe(F.col("pq") * F.col("pq"), F.col("pp"))
    slope = F.when(left > 1e-9 * F.col("qq"), (F.col("qy") - safe(F.col("pq") * F.col("py"), F.col("pp"))) / left)
    return _row(s.select(slope.alias("observed"), "n"), "competitor_price_raises_demand", 0.0, least)


def festival_lift(sales: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mean units of festival days by those of other days, less 1, above 0.05."""
    rows = sales.join(calendar.select("date", "festival_flag"), "date", "left")
    on = F.coalesce("festival_flag", F.lit(False))
    lift = safe(F.avg(F.when(on, F.col("units"))), F.avg(F.when(~on, F.col("units")))) - 1
    return _row(rows.agg(lift.alias("observed"), F.count(F.lit(1)).alias("n")), "festival_demand_peak", 0.05)


def regional_spread(sales: DataFrame, stores: DataFrame, least: int = 2) -> DataFrame:
    """Largest mean units of a region by the smallest, above 1.1, over at least `least` regions."""
    means = sales.join(stores.select("store_id", "region"), "store_id", "left").filter("region is not null").groupBy("region").agg(F.avg("units").alias("m"), F.count(F.lit(1)).alias("c"))
    one = means.agg(F.when(F.count(F.lit(1)) >= least, safe(F.max("m"), F.min("m"))).alias("observed"), F.sum("c").alias("n"))
    return _row(one, "regional_variation", 1.1)


def price_direction(sales: DataFrame, least: int = 500) -> DataFrame:
    """The slope of log units on log price within products is below zero (its negative is reported)."""
    rows = sales.filter("units > 0 and selling_price > 0").select("product_id", F.ln("units").alias("y"), F.ln("selling_price").alias("x"))
    per = rows.groupBy("product_id").agg(F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx"), F.count(F.lit(1)).alias("c"))
    return _row(per.agg((-safe(F.sum("sxy"), F.sum("sxx"))).alias("observed"), F.sum("c").alias("n")), "price_lowers_demand", 0.0, least)


def depth_response(sales: DataFrame, base: Column, band: Column) -> DataFrame:
    """The lift over the unpromoted mean is larger in the deepest band than in the shallowest."""
    rows = sales.withColumn("base_", base).filter("promotion_flag").groupBy(band.alias("band")).agg(
        F.avg(safe(F.col("units"), F.col("base_"))).alias("lift"), F.avg("discount_percentage").alias("depth"), F.count(F.lit(1)).alias("c"))
    one = rows.agg((F.max_by("lift", "depth") - F.min_by("lift", "depth")).alias("observed"), F.sum("c").alias("n"))
    return _row(one, "deeper_discounts_lift_more", 0.0)
