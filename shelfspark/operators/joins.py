"""Joins of panels with events, dimensions and one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.windows import KEYS


def attributes(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join of a dimension, one row a key; its columns replace those of the panel."""
    clash = [c for c in dim.columns if c in df.columns and c != key]
    return df.drop(*clash).join(dim.dropDuplicates([key]), key, "left")


def event_days(events: DataFrame) -> DataFrame:
    """One row for each active day and listing: the deepest event, ties by promotion_id."""
    days = events.withColumn("date", F.explode(F.sequence("start_date", "end_date")))
    w = Window.partitionBy(*KEYS, "date").orderBy(F.col("discount_percentage").desc(), "promotion_id")
    return days.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def promotion_features(df: DataFrame, events: DataFrame) -> DataFrame:
    """The active event of each panel row, with fills where there is none."""
    days = event_days(events).select(*KEYS, "date", "promotion_id", F.col("discount_percentage").alias("event_discount"), "duration_days",
                                     F.datediff("date", "start_date").alias("days_into"), F.datediff("end_date", "date").alias("days_left"))
    joined = df.join(days, [*KEYS, "date"], "left")
    return joined.withColumns({"on_promotion": F.col("promotion_id").isNotNull(), "event_discount": F.coalesce("event_discount", F.lit(0.0)),
                               "duration_days": F.coalesce("duration_days", F.lit(0)), "days_into": F.coalesce("days_into", F.lit(-1)), "days_left": F.coalesce("days_left", F.lit(-1))})


def asof_dates(df: DataFrame, events: DataFrame) -> DataFrame:
    """Panel rows with the next event start at or after the date, the last event end and the
    last event start at or before it: one pass over the union of rows and event dates."""
    rows = df.select(*KEYS, "date", F.lit(None).cast("date").alias("s"), F.lit(None).cast("date").alias("e"), F.lit(1).alias("panel"))
    starts = events.select(*KEYS, F.col("start_date").alias("date"), F.col("start_date").alias("s"), F.lit(None).cast("date").alias("e"), F.lit(0).alias("panel"))
    ends = events.select(*KEYS, F.col("end_date").alias("date"), F.lit(None).cast("date").alias("s"), F.col("end_date").alias("e"), F.lit(0).alias("panel"))
    w = Window.partitionBy(*KEYS).orderBy(F.unix_date("date"))
    to, since = w.rangeBetween(0, Window.unboundedFollowing), w.rangeBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(starts).unionByName(ends).withColumns(
        {"next_start": F.min("s").over(to), "last_end": F.max("e").over(since), "last_start": F.max("s").over(since)})
    return both.filter("panel = 1").drop("s", "e", "panel")


def days_to_next(df: DataFrame, events: DataFrame) -> DataFrame:
    return asof_dates(df, events).withColumn("days_to_next_promotion", F.datediff("next_start", "date"))


def washout(df: DataFrame, events: DataFrame, days: int = 10) -> DataFrame:
    """Whether the last event ended 1 to `days` days before the row."""
    gap = F.datediff("date", "last_end")
    return asof_dates(df, events).withColumn("washout", F.coalesce(gap.between(1, days), F.lit(False)))


def days_to_nearest(df: DataFrame, events: DataFrame) -> DataFrame:
    """Days to the nearest event: 0 while one is open, null for listings without events."""
    after, before = F.datediff("date", "last_end"), F.datediff("next_start", "date")
    opened = F.col("last_start").isNotNull() & (F.col("last_end").isNull() | (F.col("last_start") > F.col("last_end")))
    return asof_dates(df, events).withColumn("nearest", F.when(opened, 0).when(F.least(after, before).isNotNull(), F.greatest(F.least(after, before), F.lit(0))))


def cross_pairs(df: DataFrame, pairs: DataFrame, value: str = "units") -> DataFrame:
    """Shared store-days of declared pairs: demand of a with the prices of both, logged."""
    a = df.filter(F.col(value) > 0).select(F.col("product_id").alias("product_a"), "store_id", "date", F.col(value).alias("demand_a"), F.col("selling_price").alias("price_a"))
    b = df.select(F.col("product_id").alias("product_b"), "store_id", "date", F.col("selling_price").alias("price_b"))
    return a.join(pairs.select("product_a", "product_b"), "product_a").join(b, ["product_b", "store_id", "date"]).withColumns(
        {"ln_demand_a": F.ln("demand_a"), "ln_price_a": F.ln("price_a"), "ln_price_b": F.ln("price_b")})


def candidate_pairs(products: DataFrame, declared: DataFrame, most: int = 40) -> DataFrame:
    """Per focal product its declared related products, then others of its category, at most
    `most` (the cap is the operator's parameter)."""
    said = declared.filter("relationship_type <> 'unrelated'").select(F.col("product_a").alias("focal"), F.col("product_b").alias("other"), F.lit(0).alias("tier"))
    p = products.select("product_id", "category")
    # the first most + 1 products of a category hold all that a focal product can take from it
    first = p.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy("product_id"))).filter(F.col("n") <= most + 1)
    same = p.alias("x").join(first.alias("y"), F.expr("x.category = y.category and x.product_id <> y.product_id")).select(
        F.col("x.product_id").alias("focal"), F.col("y.product_id").alias("other"), F.lit(1).alias("tier"))
    best = said.union(same).groupBy("focal", "other").agg(F.min("tier").alias("tier"))
    w = Window.partitionBy("focal").orderBy("tier", "other")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def horizon(df: DataFrame, origins: DataFrame, steps: list[int]) -> DataFrame:
    """Origin rows joined with the target `step` days later."""
    at = df.join(origins.withColumnRenamed("date", "o"), F.col("date") == F.col("o"), "left_semi").select(*KEYS, F.col("date").alias("origin_date"), F.col("units").alias("origin_units"))
    grid = at.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps]))).withColumn("target_date", F.date_add("origin_date", F.col("step")))
    return grid.join(df.select(*KEYS, F.col("date").alias("target_date"), F.col("units").alias("target_units")), [*KEYS, "target_date"])


def seasonal_reference(df: DataFrame, days: int = 364) -> DataFrame:
    past = df.select(*KEYS, F.date_add("date", days).alias("date"), F.col("units").alias("seasonal_units"))
    return df.join(past, [*KEYS, "date"], "left")


def keep_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.select(*KEYS).distinct(), list(KEYS), "left_semi")


def orphans(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null key is not in the dimension."""
    return df.filter(F.col(key).isNotNull()).join(dim.select(key), key, "left_anti")


def first_day_spend(df: DataFrame, events: DataFrame) -> DataFrame:
    """Event spend on the event's first day, else zero."""
    first = events.select(*KEYS, F.col("start_date").alias("date"), "promotion_spend")
    return df.join(first, [*KEYS, "date"], "left").withColumn("promotion_spend", F.coalesce("promotion_spend", F.lit(0.0)))


def event_windows(df: DataFrame, events: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Panel rows of each event's listing from `before` days before its start to `after` days
    after its end: events are spread over their days, so that the join is on equal keys."""
    days = events.select("promotion_id", *KEYS, F.explode(F.sequence(F.date_sub("start_date", before), F.date_add("end_date", after))).alias("date"))
    return df.join(days, [*KEYS, "date"])


def contemporary_controls(df: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Unpromoted rows of never promoted listings whose category and region had promotions,
    within the span of those promotions."""
    rows = df.join(products.select("product_id", "category"), "product_id").join(stores.select("store_id", "region"), "store_id")
    treated = rows.filter("promotion_flag")
    strata, listings = treated.select("category", "region").distinct(), treated.select(*KEYS).distinct()
    span = treated.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return rows.join(listings, list(KEYS), "left_anti").join(strata, ["category", "region"], "left_semi").crossJoin(F.broadcast(span)).filter("date between lo and hi").drop("lo", "hi")


def nearest_score(df: DataFrame, treated: Column, score: str, within: float, stratum: str) -> DataFrame:
    """Matching with replacement: of each treated row the control with the nearest score in
    its stratum, if nearer than `within`; of controls with equal scores the one of most units.  One
    pass each way over the sorted scores, controls before treated rows of the same score (a frame
    that ends with the partition would be summed anew for every row)."""
    one = Window.partitionBy(stratum)
    up, down = [one.orderBy(by, treated, "units").rowsBetween(Window.unboundedPreceding, 0) for by in (score, F.col(score).desc())]
    control = F.when(~treated, F.struct(F.col(score).alias("s"), F.col("units").alias("u")))
    found = df.withColumns({"__lo": F.last(control, True).over(up), "__hi": F.last(control, True).over(down)}).filter(treated)
    lo, hi = F.abs(F.col(score) - F.col("__lo.s")), F.abs(F.col("__hi.s") - F.col(score))
    near = F.when(hi.isNull() | (lo <= hi), F.col("__lo")).otherwise(F.col("__hi"))
    return found.withColumn("match", near).withColumn("distance", F.abs(F.col(score) - F.col("match.s"))).filter(F.col("distance") <= within).drop("__lo", "__hi")
