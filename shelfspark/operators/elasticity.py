"""Own- and cross-price elasticities of all products in one job, from sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.scalar import logs
from shelfspark.functions.stats import student_p
from shelfspark.operators.windows import KEYS, safe, within


def clean_panel(df: DataFrame) -> DataFrame:
    return logs(df.filter("not promotion_flag and not stockout_flag"))


def naive(df: DataFrame, y: str = "log_units", x: str = "log_price") -> DataFrame:
    return df.groupBy("product_id").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
                                        F.count(F.lit(1)).alias("n"), F.count_distinct(F.round("selling_price", 4)).alias("prices"))


def clustered_error(df: DataFrame, y: str = "log_units", x: str = "log_price") -> DataFrame:
    """Slope with a standard error clustered on stores (one pass for the fit, one for errors)."""
    fit = df.groupBy("product_id").agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.avg(x).alias("mx"), F.regr_sxx(y, x).alias("sxx"), F.count(F.lit(1)).alias("n"))
    rows = df.select("product_id", "store_id", F.col(y).alias("y"), F.col(x).alias("x")).join(fit, "product_id")
    score = (F.col("x") - F.col("mx")) * (F.col("y") - F.col("a") - F.col("b") * F.col("x"))
    groups = rows.groupBy("product_id", "store_id").agg(F.sum(score).alias("g"), F.sum(score * score).alias("g2"), F.first("sxx").alias("sxx"), F.first("b").alias("b"), F.first("n").alias("n"))
    k = F.count(F.lit(1))
    clustered = F.sqrt(F.sum(F.col("g") * F.col("g")) * k / (k - 1)) / F.first("sxx")
    # under two clusters: heteroscedasticity-robust, from the rows' own scores
    plain = F.sqrt(F.sum("g2")) / F.first("sxx")
    return groups.groupBy("product_id").agg(F.first("b").alias("slope"), F.when(k > 1, clustered).otherwise(plain).alias("error"), F.first("n").alias("n")).withColumns(
        {"low": F.col("slope") - 1.96 * F.col("error"), "high": F.col("slope") + 1.96 * F.col("error")})


def fixed_effects(df: DataFrame) -> DataFrame:
    """Panel fixed effects within each product: stores, then dates, absorbed."""
    w = within(df, ["log_units", "log_price"], list(KEYS))
    xx = F.sum(F.col("w_log_price") * F.col("w_log_price"))
    return w.groupBy("product_id").agg(safe(F.sum(F.col("w_log_units") * F.col("w_log_price")), xx).alias("slope"), F.count(F.lit(1)).alias("n"))


def two_stage(df: DataFrame, instrument: str) -> DataFrame:
    """Instrumented slope with the first stage's heteroscedasticity-robust F."""
    z, x, y = instrument, "log_price", "log_units"
    first = df.groupBy("product_id").agg(F.regr_slope(x, z).alias("g"), F.regr_intercept(x, z).alias("c"), F.avg(z).alias("mz"), F.covar_samp(y, z).alias("cyz"),
                                         F.covar_samp(x, z).alias("cxz"), F.regr_sxx(x, z).alias("szz"), F.count(F.lit(1)).alias("n"))
    rows = df.select("product_id", F.col(x).alias("x"), F.col(z).alias("z")).join(first, "product_id")
    e = (F.col("z") - F.col("mz")) * (F.col("x") - F.col("c") - F.col("g") * F.col("z"))
    meat = rows.groupBy("product_id").agg(F.sum(e * e).alias("meat"))
    f = safe(F.col("g") * F.col("g") * F.col("szz") * F.col("szz"), F.col("meat"))
    return first.join(meat, "product_id").select("product_id", safe(F.col("cyz"), F.col("cxz")).alias("slope"), f.alias("first_f"), (f < 10).alias("weak"), "n")


def identification(df: DataFrame, rows: int = 60, prices: int = 5, spread: float = 0.02) -> DataFrame:
    return df.groupBy("product_id").agg((F.count(F.lit(1)) < rows).alias("few_rows"), (F.count_distinct(F.round("selling_price", 4)) < prices).alias("few_prices"),
                                        (F.stddev_samp("log_price") < spread).alias("little_variation"))


def choose(products: DataFrame, panel_fe: DataFrame, randomised: DataFrame) -> DataFrame:
    """Per product the panel estimate, else that of randomised prices, else none with the reason.
    Naive and instrumented slopes are never selected."""
    out = products.select("product_id").distinct().join(panel_fe.select("product_id", F.col("slope").alias("fe")), "product_id", "left").join(
        randomised.select("product_id", F.col("slope").alias("rd")), "product_id", "left")
    method = F.when(F.col("fe").isNotNull(), "panel_fe").when(F.col("rd").isNotNull(), "randomised")
    return out.select("product_id", method.alias("method"), F.coalesce("fe", "rd").alias("slope"), F.when(F.coalesce("fe", "rd").isNull(), "no identified estimate").alias("reason"))


def cross(pairs: DataFrame, least: int = 120) -> DataFrame:
    """Two-regressor model of each pair (own and other price) after absorbing stores and
    dates, by its normal equations; columns ln_demand_a, ln_price_a, ln_price_b.  Pairs with
    under `least` shared rows have no estimate and are left out.  p is that of Student's t with
    n - 2 degrees of freedom."""
    names = ["ln_demand_a", "ln_price_a", "ln_price_b"]
    unit, day = Window.partitionBy("product_a", "product_b", "store_id"), Window.partitionBy("product_a", "product_b", "date")
    w = pairs.withColumns({f"u_{c}": F.col(c) - F.avg(c).over(unit) for c in names})
    w = w.withColumns({c: F.col(f"u_{c}") - F.avg(f"u_{c}").over(day) for c in names})
    y, p, q = (F.col(c) for c in names)
    s = w.groupBy("product_a", "product_b").agg(F.sum(p * p).alias("pp"), F.sum(q * q).alias("qq"), F.sum(p * q).alias("pq"), F.sum(p * y).alias("py"), F.sum(q * y).alias("qy"), F.count(F.lit(1)).alias("n"))
    s = s.filter(F.col("n") >= least)
    det = F.col("pp") * F.col("qq") - F.col("pq") * F.col("pq")
    s = s.withColumns({"own": safe(F.col("qq") * F.col("py") - F.col("pq") * F.col("qy"), det), "other": safe(F.col("pp") * F.col("qy") - F.col("pq") * F.col("py"), det)})
    fit = w.select("product_a", "product_b", *names).join(s, ["product_a", "product_b"])
    e = y - F.col("own") * p - F.col("other") * q
    v = (F.col("pp") * q - F.col("pq") * p) * e
    meat = fit.groupBy("product_a", "product_b").agg(F.sum(v * v).alias("meat"))
    return s.join(meat, ["product_a", "product_b"]).withColumn("t", safe(F.col("other") * det, F.sqrt("meat"))).withColumn("p", student_p(F.col("t"), F.col("n") - 2)).select("product_a", "product_b", "n", "own", "other", "t", "p")


def two_sided_p(t: Column) -> Column:
    """Two-sided p of a large-sample t: complementary error function by a rational polynomial."""
    x = F.abs(t) / 2**0.5
    k = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k
    return poly * F.exp(-x * x)


def relationships(found: DataFrame, level: float = 0.05, least: float = 0.1, strong: float = 0.3) -> DataFrame:
    """Benjamini-Hochberg within each focal product, then the kind of each pair."""
    focal = Window.partitionBy("product_a")
    rows = found.withColumns({"k": F.row_number().over(focal.orderBy("p", "product_b")), "m": F.count(F.lit(1)).over(focal)})
    scaled = F.least(F.col("p") * F.col("m") / F.col("k"), F.lit(1.0))
    rows = rows.withColumn("p_adjusted", F.min(scaled).over(focal.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    none = (F.col("p_adjusted") > level) | (F.abs("other") < least)
    kind = F.when(none, "unrelated").when(F.col("other") > 0, "substitute").otherwise("complement")
    return rows.withColumns({"kind": kind, "strength": F.when(none, "none").when(F.abs("other") >= strong, "strong").otherwise("weak")})
