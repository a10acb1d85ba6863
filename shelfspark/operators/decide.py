"""Decision tables: price grids, budget allocation and what-if projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.windows import running, safe


def price_grid(products: DataFrame, steps: int = 21, most: float = 0.3, margin: float = 0.05) -> DataFrame:
    """All products (price, units, unit_cost, elasticity) at evenly spaced price changes."""
    changes = F.array(*[F.lit(-most + 2 * most * i / (steps - 1)) for i in range(steps)])
    rows = products.withColumn("change", F.explode(changes))
    new = F.col("price") * (1 + F.col("change"))
    units = F.col("units") * F.pow(1 + F.col("change"), F.col("elasticity"))
    rows = rows.withColumns({"new_price": new, "new_units": units}).withColumns({"revenue": F.col("new_price") * F.col("new_units"), "profit": (F.col("new_price") - F.col("unit_cost")) * F.col("new_units"),
                                                                             "margin": safe(F.col("new_price") - F.col("unit_cost"), F.col("new_price"))})
    return rows.withColumn("violations", F.array_compact(F.array(F.when(F.col("new_price") < F.col("unit_cost"), "below_cost"), F.when(F.col("margin") < margin, "thin_margin"))))


def recommend(grid: DataFrame, near: float = 0.02) -> DataFrame:
    """Per product the feasible change of highest profit, the range within `near` of it, and
    holding the price where nothing is feasible."""
    free = F.size("violations") == 0
    w = Window.partitionBy("product_id")
    rows = grid.withColumn("best", F.max(F.when(free, F.col("profit"))).over(w))
    ok = free & (F.col("profit") >= F.col("best") - near * F.abs("best"))
    key = F.struct("profit", -F.abs("change"), "change")
    return rows.groupBy("product_id").agg(F.max(F.when(free, key)).alias("top"), F.min(F.when(ok, F.col("change"))).alias("low"), F.max(F.when(ok, F.col("change"))).alias("high")).select(
        "product_id", F.coalesce(F.col("top.change"), F.lit(0.0)).alias("change"), F.col("top.profit").alias("profit"), "low", "high", F.when(F.col("top").isNull(), "hold").otherwise("move").alias("action"))


def segments(cells: DataFrame, curve: float = 3.0, parts: int = 5) -> DataFrame:
    """Concave response of each candidate (reference_profit, reference_spend): equal spend
    segments up to twice its reference, with falling marginal return."""
    from math import exp

    width = 2 * F.col("reference_spend") / parts
    rows = cells.filter("reference_spend > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rate = safe(F.col("reference_profit"), F.col("reference_spend"))
    mid = (F.col("part") + 0.5) * 2 / parts
    return rows.withColumns({"width": width, "marginal": rate * F.exp(-curve * mid) / ((1 - exp(-curve)) / curve)})


def allocate(parts: DataFrame, budget: float) -> DataFrame:
    """Greedy fill of one budget by marginal return, which is optimal for concave segments;
    segments without a gain stay unfunded.  Segments are first summed by exact return, and the
    running sum goes by ranges of returns."""
    levels = parts.filter("marginal > 0").groupBy("marginal").agg(F.sum("width").alias("level"))
    cut = running(levels, "marginal", ["level"]).withColumnRenamed("run_level", "upto").withColumn("share", F.least(F.greatest((budget - (F.col("upto") - F.col("level"))) / F.col("level"), F.lit(0.0)), F.lit(1.0)))
    return parts.join(cut.select("marginal", "share"), "marginal", "left").withColumn("spend", F.col("width") * F.coalesce("share", F.lit(0.0)))


def allocate_limited(parts: DataFrame, budget: float, limits: DataFrame, dimension: str) -> DataFrame:
    """Spend of one budget under floors and caps on the values of a dimension.

    parts: segments with a column `dimension`; limits: (dimension, least, most), either may be
    null, rows of one value count together.  First each value's best segments are funded up to
    its floor, those without a gain too; then what is left goes by marginal return to the
    segments between floor and cap that gain.  The constraints are nested, so the two greedy
    fills are optimal.  A floor above its cap is cut to the cap; floors that together pass the
    budget are funded in proportion (both are reported by `limit_report`).  A null value of the
    dimension has no limits.
    """
    bounds = limits.groupBy(dimension).agg(F.max("least").alias("least"), F.min("most").alias("most"))
    levels = parts.groupBy(dimension, "marginal").agg(F.sum("width").alias("level"))
    rows = running(levels, "marginal", ["level"], by=(dimension,)).join(bounds, dimension, "left")
    cap = F.coalesce("most", F.lit(float("inf")))
    floor = F.least(F.coalesce("least", F.lit(0.0)), cap)
    start = F.col("run_level") - F.col("level")

    def covered(upto: Column) -> Column:
        return F.least(F.greatest(upto - start, F.lit(0.0)), F.col("level"))

    rows = rows.select(dimension, "marginal", F.col("level").alias("size"), covered(floor).alias("held"),
                       F.when(F.col("marginal") > 0, covered(cap) - covered(floor)).otherwise(0.0).alias("level"))
    held = rows.agg(F.coalesce(F.sum("held"), F.lit(0.0)).alias("held_all"))
    held = held.select(F.greatest(budget - F.col("held_all"), F.lit(0.0)).alias("left_over"), F.when(F.col("held_all") > budget, budget / F.col("held_all")).otherwise(1.0).alias("cut"))
    open_ = rows.groupBy("marginal").agg(F.sum("level").alias("level")).filter("level > 0")
    share = (F.col("left_over") - (F.col("run_level") - F.col("level"))) / F.col("level")
    shares = running(open_, "marginal", ["level"]).crossJoin(F.broadcast(held)).select(F.col("marginal").alias("at_"), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).alias("share"))
    paid = rows.crossJoin(F.broadcast(held)).join(shares, F.col("marginal") == F.col("at_"), "left")
    paid = paid.select(F.col(dimension).alias("of_"), F.col("marginal").alias("at_"), ((F.col("held") * F.col("cut") + F.col("level") * F.coalesce("share", F.lit(0.0))) / F.col("size")).alias("funded"))
    both = parts[dimension].eqNullSafe(paid["of_"]) & (parts["marginal"] == paid["at_"])
    return parts.join(paid, both).withColumn("spend", F.col("width") * F.col("funded")).drop("of_", "at_", "funded")


def limit_report(funded: DataFrame, limits: DataFrame, dimension: str) -> DataFrame:
    """(dimension, least, most, capacity, spend, status) of each limit: unmatched where no candidate
    has the value, infeasible where the floor is not met, at_floor, at_cap or inside."""
    bounds = limits.groupBy(dimension).agg(F.max("least").alias("least"), F.min("most").alias("most"))
    sums = funded.groupBy(dimension).agg(F.sum("width").alias("capacity"), F.sum("spend").alias("spend"))
    rows = bounds.join(sums, dimension, "left")
    near = 1e-6
    status = (F.when(F.col("capacity").isNull(), "unmatched").when((F.col("spend") < F.col("least") - near) | (F.col("least") > F.col("most")), "infeasible")
              .when(F.col("spend") >= F.col("most") - near, "at_cap").when(F.col("spend") <= F.col("least") + near, "at_floor").otherwise("inside"))
    return rows.withColumn("status", status)


def lines(funded: DataFrame) -> DataFrame:
    out = funded.groupBy("candidate_id").agg(F.sum("spend").alias("spend"), F.sum(F.col("spend") * F.col("marginal")).alias("profit"), F.min(F.when(F.col("spend") > 0, F.col("marginal"))).alias("marginal_roi"))
    return out.withColumn("roi", safe(F.col("profit"), F.col("spend")))


def project(levers: DataFrame, economics: DataFrame, days: int = 28) -> DataFrame:
    """What-if: levers (scenario, product_id, lever, change) act on log units; those that lack
    an input are counted as not applied."""
    rows = levers.join(economics, "product_id")
    log = F.when(F.col("lever") == "price", F.col("elasticity") * F.log1p("change")).when(F.col("lever") == "promotion", F.log1p("change")).when(F.col("lever") == "competitor", F.col("cross_elasticity") * F.log1p("change"))
    price = F.when(F.col("lever") == "price", F.log1p("change")).otherwise(0.0)
    sums = rows.withColumns({"__e": log, "__p": price}).groupBy("scenario", "product_id").agg(
        F.coalesce(F.sum("__e"), F.lit(0.0)).alias("effect"), F.sum("__p").alias("price_effect"), F.sum(F.col("__e").isNull().cast("int")).alias("not_applied"),
        F.first("units").alias("units"), F.first("price").alias("price"), F.first("unit_cost").alias("unit_cost"))
    new_units, new_price = F.col("units") * F.exp("effect"), F.col("price") * F.exp("price_effect")
    return sums.withColumns({"new_units": new_units * days, "revenue": new_units * new_price * days, "profit": new_units * (new_price - F.col("unit_cost")) * days,
                             "baseline_profit": F.col("units") * (F.col("price") - F.col("unit_cost")) * days})


def compare(projected: DataFrame) -> DataFrame:
    return projected.groupBy("scenario").agg(F.sum("profit").alias("profit"), F.sum("baseline_profit").alias("baseline_profit"), F.sum("revenue").alias("revenue"), F.sum("not_applied").alias("not_applied")).withColumn("gain", F.col("profit") - F.col("baseline_profit"))


def cross_effects(pairs: DataFrame, economics: DataFrame) -> DataFrame:
    """(product_id, related_id, effect, units, margin): of each product its significant pairs
    (product_a, product_b, other, kind) with the related product's units and unit margin."""
    related = economics.select(F.col("product_id").alias("product_b"), "units", (F.col("price") - F.col("unit_cost")).alias("margin"))
    return pairs.filter("kind <> 'unrelated'").join(related, "product_b").select(
        F.col("product_a").alias("product_id"), F.col("product_b").alias("related_id"), F.col("other").alias("effect"), "units", "margin")


def with_cross(grid: DataFrame, effects: DataFrame) -> DataFrame:
    """The price grid with cross_profit: what a change of price does to the profit on related
    products, whose units move by (1 + change) ** effect."""
    moves = grid.select("product_id", "change").join(effects, "product_id")
    gain = F.col("units") * (F.pow(1 + F.col("change"), F.col("effect")) - 1) * F.col("margin")
    sums = moves.groupBy("product_id", "change").agg(F.sum(gain).alias("cross_profit"))
    return grid.join(sums, ["product_id", "change"], "left").fillna(0.0, ["cross_profit"])


def assessed(recommended: DataFrame, most: float = 0.3) -> DataFrame:
    """Recommendations with risk (by the size of the move) and whether it lies on the grid's edge."""
    size = F.abs("change")
    risk = F.when(size <= 0.05, "low").when(size <= 0.15, "medium").otherwise("high")
    return recommended.withColumns({"risk": risk, "at_edge": size >= most - 1e-9})


def corners(products: DataFrame, change: float, days: int = 28) -> DataFrame:
    """(product_id, profit, low, high, confidence, risk) of one price change: the range over the
    corners of two intervals, of the elasticity (low, high) and of the units (low, high); the
    confidence is the lesser of its parts; a range that spans zero gain is a high risk."""
    ends = F.array(*[F.struct(F.col(e).alias("e"), F.col(u).alias("u")) for e in ("elasticity_low", "elasticity_high") for u in ("units_low", "units_high")])

    def profit(e: Column, u: Column) -> Column:
        return u * F.pow(F.lit(1 + change), e) * (F.col("price") * (1 + change) - F.col("unit_cost")) * days

    held = F.col("units") * (F.col("price") - F.col("unit_cost")) * days
    rows = products.withColumns({"profit": profit(F.col("elasticity"), F.col("units")), "held": held, "ends": F.transform(ends, lambda x: profit(x["e"], x["u"]))})
    rows = rows.withColumns({"low": F.array_min("ends"), "high": F.array_max("ends"), "confidence": F.least("elasticity_confidence", "units_confidence")})
    risk = F.when((F.col("low") < F.col("held")) & (F.col("high") > F.col("held")), "high").when(F.col("confidence") < 0.5, "medium").otherwise("low")
    return rows.select("product_id", "profit", "low", "high", "confidence", risk.alias("risk"))


def realised_spend(sales: DataFrame, events: DataFrame, fixed: float, each: float) -> DataFrame:
    """(promotion_id, units, spend): units sold on an event's days, and its fixed cost with one
    for each unit."""
    span = events.select("promotion_id", "product_id", "store_id", F.explode(F.sequence("start_date", "end_date")).alias("date"))
    return sales.join(span, ["product_id", "store_id", "date"]).groupBy("promotion_id").agg(F.sum("units").alias("units")).withColumn("spend", fixed + each * F.col("units"))


def limits(allocated: DataFrame, references: DataFrame, floors: DataFrame, budget: float) -> DataFrame:
    """(candidate_id, spend, vs_reference, at_limit, floor_missed): spend against the reference, a
    candidate at its upper limit (twice the reference), floors (candidate_id, least) that the
    allocation misses; floors of unknown candidates have no spend.  binding: the budget is spent."""
    rows = allocated.join(references, "candidate_id", "left").join(floors, "candidate_id", "full_outer")
    total = allocated.agg((F.sum("spend") >= budget - 1e-6).alias("binding"))
    return rows.crossJoin(F.broadcast(total)).select(
        "candidate_id", "spend", safe(F.col("spend"), F.col("reference_spend")).alias("vs_reference"), (F.col("spend") >= 2 * F.col("reference_spend") - 1e-6).alias("at_limit"),
        (F.coalesce("spend", F.lit(0.0)) < F.col("least")).alias("floor_missed"), F.col("reference_spend").isNull().alias("unmatched"), "binding")
