"""Window features of a panel keyed by product, store and date.

All frames count rows and exclude the current one unless said otherwise; a zero denominator
gives null.  One partitioning serves all features, so a whole panel needs one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("product_id", "store_id")


def by_date():
    return Window.partitionBy(*KEYS).orderBy("date")


def series():
    return Window.partitionBy(*KEYS)


def prior(n: int):
    return by_date().rowsBetween(-n, -1)


def safe(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def lagged(c: str, n: int) -> Column:
    if n < 1:
        raise ValueError("a lag must look back")
    return F.lag(c, n).over(by_date())


def rolling(c: str, n: int, how=F.avg, least: int = 1) -> Column:
    w = prior(n)
    return F.when(F.count(c).over(w) >= least, how(c).over(w))


def expanding(c: str, how=F.avg) -> Column:
    return how(c).over(by_date().rowsBetween(Window.unboundedPreceding, -1))


def days_since(flag: str) -> Column:
    """Days since the last row whose previous row was flagged: 0 on the first day after."""
    after = F.when(F.lag(flag, 1).over(by_date()), F.col("date"))
    return F.datediff("date", F.last(after, ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0)))


def flags_in(flag: str, n: int) -> Column:
    return F.sum(F.col(flag).cast("int")).over(prior(n))


def change(c: str, n: int) -> Column:
    past = F.lag(c, n).over(by_date())
    return safe(F.col(c) - past, past)


def demand_lags(df: DataFrame) -> DataFrame:
    return df.withColumns({f"lag_{n}": lagged("units", n) for n in (1, 7, 14, 28, 56, 364)})


def demand_rolling(df: DataFrame) -> DataFrame:
    out = {}
    for n in (7, 14, 28, 56):
        out[f"rolling_mean_{n}"], out[f"rolling_std_{n}"] = rolling("units", n), rolling("units", n, F.stddev_samp)
    return df.withColumns(out)


def demand_dynamics(df: DataFrame) -> DataFrame:
    m7, m28, s28, l28 = rolling("units", 7), rolling("units", 28), rolling("units", 28, F.stddev_samp), lagged("units", 28)
    return df.withColumns({"momentum": safe(m7, m28), "volatility": safe(s28, m28), "trend": safe(m7 - l28, l28)})


def price_features(df: DataFrame) -> DataFrame:
    p = F.col("selling_price")
    return df.withColumns({
        "discount_depth": F.greatest(safe(F.col("regular_price") - p, F.col("regular_price")), F.lit(0.0)),
        "price_change_1": change("selling_price", 1), "price_change_7": change("selling_price", 7),
        "price_changed": ~p.eqNullSafe(F.lag("selling_price", 1).over(by_date())),
        "price_vs_28": safe(p, rolling("selling_price", 28)), "historical_price": expanding("selling_price")})


def price_index(df: DataFrame, products: DataFrame) -> DataFrame:
    """Price against the mean of its date and category."""
    joined = df.join(products.select("product_id", "category"), "product_id", "left")
    return joined.withColumn("price_index", safe(F.col("selling_price"), F.avg("selling_price").over(Window.partitionBy("date", "category"))))


def competitor_features(df: DataFrame, rivals: DataFrame) -> DataFrame:
    """Gap, ratio and change against the day's competitor prices of the product."""
    daily = rivals.groupBy("date", "product_id").agg(
        F.avg("competitor_effective_price").alias("rival_price"), F.min("competitor_effective_price").alias("rival_low"),
        F.avg("competitor_discount").alias("rival_discount"), F.max("competitor_promotion_flag").alias("rival_promotion"))
    p = F.col("selling_price")
    return df.join(daily, ["date", "product_id"], "left").withColumns({
        "price_gap": p - F.col("rival_price"), "price_ratio": safe(p, F.col("rival_price")), "cheaper": p < F.col("rival_low")}).withColumn(
        "rival_change_7", change("rival_price", 7))


def inventory_features(df: DataFrame, inventory: DataFrame) -> DataFrame:
    stock = inventory.select("date", *KEYS, (F.col("opening_inventory") + F.col("received_units")).alias("available"), "closing_inventory")
    return df.join(stock, ["date", *KEYS], "left").withColumns({
        "stockout_yesterday": F.coalesce(F.lag("stockout_flag", 1).over(by_date()), F.lit(False)), "days_since_stockout": days_since("stockout_flag"),
        "stockouts_28": flags_in("stockout_flag", 28), "stockouts_90": flags_in("stockout_flag", 90),
        "cover": safe(F.col("available"), rolling("units", 28)), "closing_lag_1": lagged("closing_inventory", 1)})


def promotion_history(df: DataFrame) -> DataFrame:
    return df.withColumns({"days_since_promotion": days_since("promotion_flag"), "promotions_28": flags_in("promotion_flag", 28),
                           "promotions_90": flags_in("promotion_flag", 90)})


def trailing_covariates(df: DataFrame) -> DataFrame:
    out = {f"demand_lag_{n}": lagged("units", n) for n in (1, 7, 14, 28)}
    out |= {f"demand_mean_{n}": rolling("units", n, least=max(n // 2, 3)) for n in (7, 14, 28, 56)}
    out |= {f"demand_std_{n}": rolling("units", n, F.stddev_samp, max(n // 2, 3)) for n in (14, 28)}
    flag = F.col("promotion_flag").cast("double")
    df = df.withColumn("__flag", flag)
    out |= {"price_lag_1": lagged("selling_price", 1), "price_ratio_56": safe(F.col("selling_price"), rolling("selling_price", 56, least=14)),
            "promo_share_28": rolling("__flag", 28, least=7), "promo_share_90": rolling("__flag", 90, least=21)}
    df = df.withColumns(out)
    return df.withColumns({"demand_momentum": safe(F.col("demand_mean_7"), F.col("demand_mean_28")),
                           "demand_volatility": safe(F.col("demand_std_28"), F.col("demand_mean_28")), "demand_level": F.log1p("demand_mean_28")}).drop("__flag")


def within(df: DataFrame, columns: list[str], unit: list[str], date: str = "date") -> DataFrame:
    """Subtract the unit mean, then the date mean of the result (two passes in this order);
    results are named with a w_ before them."""
    first = df.withColumns({f"__{c}": F.col(c) - F.avg(c).over(Window.partitionBy(*unit)) for c in columns})
    by_day = Window.partitionBy(*[u for u in unit if u != "store_id"], date)
    return first.withColumns({f"w_{c}": F.col(f"__{c}") - F.avg(f"__{c}").over(by_day) for c in columns}).drop(*[f"__{c}" for c in columns])


def last_rows(df: DataFrame, day: Column) -> DataFrame:
    """The last row of each series at or before `day`."""
    w = Window.partitionBy(*KEYS).orderBy(F.col("date").desc())
    return df.filter(F.col("date") <= day).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def origins(df: DataFrame, stride: int = 7) -> DataFrame:
    """Every stride-th distinct date from the first (dates are few: one small window)."""
    days = df.select("date").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("date")))
    return days.filter(F.col("k") % stride == 1).select("date")


def thin(days: DataFrame, apart: int) -> DataFrame:
    """Greedy thinning of dates so that kept ones are at least `apart` days apart."""
    dates = days.agg(F.array_sort(F.collect_set("date")).alias("d"))
    none = F.array().cast("array<date>")
    kept = F.aggregate("d", none, lambda got, d: F.when(
        (F.size(got) == 0) | (F.datediff(d, F.element_at(got, -1)) >= apart), F.concat(got, F.array(d))).otherwise(got))
    return dates.select(F.explode(kept).alias("date"))


def date_gaps(df: DataFrame) -> DataFrame:
    """Missing days of each series: span less count, at least zero."""
    return df.groupBy(*KEYS).agg(F.greatest(F.datediff(F.max("date"), F.min("date")) + 1 - F.count(F.lit(1)), F.lit(0)).cast("long").alias("missing"))


def price_jumps(df: DataFrame, factor: float = 10.0) -> DataFrame:
    """Rows whose price is over `factor` times the previous one, or under its inverse."""
    ratio = safe(F.col("selling_price"), F.lag("selling_price", 1).over(by_date()))
    return df.withColumn("price_jump", ratio).filter((F.col("price_jump") > factor) | (F.col("price_jump") < 1 / factor))


def densify(df: DataFrame, zero: tuple[str, ...] = ("units",)) -> DataFrame:
    """One row for every day between a series' first and last; absent measures are zero."""
    grid = df.groupBy(*KEYS).agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    return grid.join(df, [*KEYS, "date"], "left").fillna(0, list(zero))


def value_range(df: DataFrame, value: Column, ranges: int = 1000) -> Column:
    """The number of the range that a value lies in, 0 to ranges - 1, null in the lowest.

    The ranges lie between quantiles of the values in df, from one sketch of constant size, so
    each holds a like share of the rows whatever the values' tails; equal values share one.  The
    edges are found once, on the driver (fewer than `ranges` numbers), so every use of the
    column deals alike.  They are looked up in two steps, by blocks of edges."""
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(value.cast("double"), shares, 20 * ranges).alias("e")).first().e
    edges = sorted(set(found or []))
    size = max(1, round(len(edges) ** 0.5))
    blocks = [edges[i:i + size] for i in range(0, len(edges), size)]
    if not blocks:
        return F.lit(0)

    def lies_above(edge: Column) -> Column:
        return edge <= value.cast("double")

    block = F.size(F.filter(F.array(*[F.lit(b[0]) for b in blocks]), lies_above))
    inside = F.element_at(F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks]), F.greatest(block, F.lit(1)))
    return F.greatest((block - 1) * size, F.lit(0)) + F.size(F.filter(inside, lies_above))


def running(df: DataFrame, value: str, sums: list[str], ranges: int = 1000, by: tuple[str, ...] = ()) -> DataFrame:
    """df (one row for each distinct value of a group `by`) with run_<c> of the columns in sums:
    totals over the group's rows of greater value and the row itself.

    No task sorts everything: rows are dealt by ranges between quantiles of the value, each range
    is summed in its own window, and the totals of the ranges (at most `ranges` rows) are added."""
    rows = df.withColumn("range_", value_range(df, F.col(value), ranges))
    totals = rows.groupBy(*by, "range_").agg(*[F.sum(c).alias(f"of_{c}") for c in sums])
    above = Window.partitionBy(*by).orderBy(F.col("range_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"key_{c}") for c in (*by, "range_")], *[F.coalesce(F.sum(f"of_{c}").over(above), F.lit(0)).alias(f"from_{c}") for c in sums])
    inside = Window.partitionBy(*by, "range_").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"key_{c}")) for c in (*by, "range_")])
    out = rows.join(starts if by else F.broadcast(starts), same).withColumns({f"run_{c}": F.col(f"from_{c}") + F.sum(c).over(inside) for c in sums})
    return out.select(*df.columns, *[f"run_{c}" for c in sums])


def order_statistics(df: DataFrame, value: Column, levels: list[Column], by: list[str], ranges: int = 1000) -> DataFrame:
    """(by, n, q): of each group its number of rows and an array with, for each level (a column of
    n: the fractional rank from 0), the value at that rank, interpolated as in an exact percentile.

    Rows are first counted by distinct value; the ranks are found in counts by ranges between
    quantiles of the value over all groups, and only the ranges that hold one are ordered, so a
    task orders one range of a group."""
    rows = df.select(*by, value.cast("double").alias("v_")).filter("v_ is not null")
    at = value_range(rows, F.col("v_"), ranges)
    rows = rows.groupBy(*by, "v_").agg(F.count(F.lit(1)).alias("c_")).withColumn("range_", at)
    counts = rows.groupBy(*by, "range_").agg(F.sum("c_").alias("of_"))
    group = Window.partitionBy(*by)  # `ranges` rows a group at most
    counts = counts.withColumns({"before_": F.sum("of_").over(group.orderBy("range_")) - F.col("of_"), "n": F.sum("of_").over(group)})
    counts = counts.withColumn("at_", F.array(*[level.cast("double") for level in levels]))
    held = rows.join(counts, [*by, "range_"])

    def inside(start: str, size: str) -> Column:
        return F.exists("at_", lambda x: (F.ceil(x) >= F.col(start)) & (F.floor(x) < F.col(start) + F.col(size)))

    held = held.filter(inside("before_", "of_"))
    run = F.sum("c_").over(Window.partitionBy(*by, "range_").orderBy("v_")) - F.col("c_")
    held = held.withColumn("from_", F.col("before_") + run).filter(inside("from_", "c_"))
    found = held.groupBy(*by, "n", "at_").agg(F.collect_list(F.struct("from_", "c_", "v_")).alias("held_"))  # two values a level at most

    def value_at(rank: Column) -> Column:
        return F.filter("held_", lambda h: (h["from_"] <= rank) & (rank < h["from_"] + h["c_"]))[0]["v_"]

    q = F.transform("at_", lambda x: value_at(F.floor(x)) + (value_at(F.ceil(x)) - value_at(F.floor(x))) * (x - F.floor(x)))
    return found.select(*by, "n", q.alias("q"))


def quantiles(df: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """One row (n, q) with the exact percentiles of a column; no row for an empty table."""
    return order_statistics(df, value, [share * (F.col("n") - 1) for share in shares], [])
