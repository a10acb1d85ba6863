"""Promotion uplift: events, roles, weights and estimators in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.stats import student_p
from shelfspark.operators.joins import attributes, days_to_nearest, first_day_spend, keep_keys, washout
from shelfspark.operators.windows import KEYS, lagged, quantiles, rolling, running, safe
from shelfspark.sources.tables import written


def events(days: DataFrame) -> DataFrame:
    """One row an event from its panel rows (promotion_id not null)."""
    return days.groupBy("promotion_id").agg(
        F.min("product_id").alias("product_id"), F.min("store_id").alias("store_id"), F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        F.count(F.lit(1)).alias("observed"), (F.max("discount_percentage") / 100).alias("depth")).withColumn("duration", F.datediff("end_date", "start_date") + 1)


def qualify(found: DataFrame, depth: float = 0.05, duration: int = 2) -> DataFrame:
    reason = F.when(F.col("depth") < depth, "shallow").when(F.col("duration") < duration, "short").otherwise("qualified")
    return found.withColumn("reason", reason)


def roles(df: DataFrame, qualified: DataFrame, days: int = 10) -> DataFrame:
    """treated, washout, control or excluded; a promoted row is never washout."""
    span = qualified.select(*KEYS, "promotion_id", F.explode(F.sequence("start_date", "end_date")).alias("date"))
    out = washout(df, qualified, days).select(*KEYS, "date", "washout")
    rows = df.join(span, [*KEYS, "date"], "left").join(out, [*KEYS, "date"])
    role = F.when(F.col("promotion_id").isNotNull(), "treated").when(F.col("promotion_flag"), "excluded").when(F.col("washout"), "washout").otherwise("control")
    return rows.withColumn("role", role)


def control_pool(rows: DataFrame, found: DataFrame, window: int = 45) -> DataFrame:
    """Treated rows and controls near an event of their own listing, tagged by origin."""
    near = days_to_nearest(rows.filter("role = 'control'"), found).filter(F.col("nearest") <= window).select(*KEYS, "date")
    treated = rows.filter("role = 'treated'").withColumn("control_origin", F.lit("treated"))
    return treated.unionByName(rows.join(near, [*KEYS, "date"], "left_semi").withColumn("control_origin", F.lit("within_series")))


def drop_censored(rows: DataFrame) -> DataFrame:
    lost = F.col("stockout_flag").cast("int")
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.sum(lost).alias("lost"), F.avg(lost).alias("lost_share"))


def att_weights(df: DataFrame, treated: Column, e: str, cap: float = 0.99) -> DataFrame:
    """1 for treated rows, odds for controls, capped at a quantile of the controls' odds."""
    odds = F.col(e) / (1 - F.col(e))
    edge = quantiles(df.filter(~treated), odds, [cap]).select(F.col("q")[0].alias("__cap"))
    return df.crossJoin(F.broadcast(edge)).withColumn("weight", F.when(treated, 1.0).otherwise(F.least(odds, F.col("__cap")))).drop("__cap")


def effective_size(w: str) -> Column:
    return F.sum(w) * F.sum(w) / F.sum(F.col(w) * F.col(w))


def balance(df: DataFrame, treated: Column, covariates: list[str], weight: str) -> DataFrame:
    """Standardised differences before and after weights, by unweighted pooled variance."""
    long = df.select(treated.alias("t"), F.col(weight).alias("w"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in covariates])).alias("c"))
    long = long.select("t", "w", "c.name", "c.v").filter("v is not null")

    def at(c: Column, on: bool) -> Column:
        return F.when(F.col("t") == on, c)

    v, wv = F.col("v"), F.col("w") * F.col("v")
    sd = F.sqrt((F.var_samp(at(v, True)) + F.var_samp(at(v, False))) / 2)
    before = F.avg(at(v, True)) - F.avg(at(v, False))
    after = F.sum(at(wv, True)) / F.sum(at(F.col("w"), True)) - F.sum(at(wv, False)) / F.sum(at(F.col("w"), False))
    return long.groupBy("name").agg(safe(before, sd).alias("smd_before"), safe(after, sd).alias("smd_after"))


def ipw(df: DataFrame, treated: Column, y: str, weight: str) -> DataFrame:
    w, v = F.col(weight), F.col(y)
    t, c = F.when(treated, 1.0).otherwise(0.0), F.when(treated, 0.0).otherwise(1.0)
    mean_t, mean_c = F.sum(t * w * v) / F.sum(t * w), F.sum(c * w * v) / F.sum(c * w)
    return df.agg((mean_t - mean_c).alias("att"), F.sum(t).cast("long").alias("n_treated"), F.sum(c).cast("long").alias("n_control"))


def aipw(df: DataFrame, treated: Column, y: str, mu0: str, e: str) -> DataFrame:
    """Augmented estimate with a standard error clustered on listings."""
    t, odds, r = treated.cast("double"), F.col(e) / (1 - F.col(e)), F.col(y) - F.col(mu0)
    rows = df.withColumns({"__t": t, "__s": t * r - (1 - t) * odds * r})
    n = rows.agg(F.sum("__t").alias("nt"), (F.sum("__s") / F.sum("__t")).alias("att"))
    psi = rows.crossJoin(F.broadcast(n)).groupBy(*KEYS).agg(F.sum(F.col("__s") - F.col("__t") * F.col("att")).alias("g"), F.first("nt").alias("nt"), F.first("att").alias("att"))
    k = F.count(F.lit(1))
    return psi.agg(F.first("att").alias("att"), (F.sqrt(F.sum(F.col("g") * F.col("g")) * k / (k - 1)) / F.first("nt")).alias("error"), k.alias("clusters"))


def during_vs_before(windows: DataFrame, y: str = "units") -> DataFrame:
    """Mean over events of the mean during less the mean of the days before."""
    inside = F.col("date") >= F.col("start_date")
    per = windows.groupBy("promotion_id").agg(F.avg(F.when(inside, F.col(y))).alias("during"), F.avg(F.when(~inside, F.col(y))).alias("before")).dropna()
    return per.agg(F.avg(F.col("during") - F.col("before")).alias("effect"), F.count(F.lit(1)).alias("events"))


def differences(df: DataFrame, treated: Column, after: Column, y: str) -> DataFrame:
    """Difference in differences on four cell means."""
    cells = df.groupBy(treated.alias("t"), after.alias("p")).agg(F.avg(y).alias("m"), F.var_samp(y).alias("v"), F.count(y).alias("n"))
    sign = F.when(F.col("t") == F.col("p"), 1).otherwise(-1)
    return cells.agg(F.sum(sign * F.col("m")).alias("effect"), F.sqrt(F.sum(F.col("v") / F.col("n"))).alias("error"), F.sum("n").alias("n"))


def parallel_trends(df: DataFrame, treated: Column, time: str, y: str) -> DataFrame:
    """Difference of the two arms' slopes with its pooled standard error, t and its p by Student's
    distribution with n - 4 degrees of freedom; parallel: p above 0.05."""
    arm = df.groupBy(treated.alias("t")).agg(F.regr_slope(y, time).alias("b"), F.regr_sxx(y, time).alias("sxx"), (F.regr_syy(y, time) - F.regr_sxy(y, time) * F.regr_sxy(y, time) / F.regr_sxx(y, time)).alias("sse"), F.count(y).alias("n"))
    diff = F.sum(F.when(F.col("t"), F.col("b")).otherwise(-F.col("b")))
    return arm.agg(diff.alias("difference"), F.sqrt(F.sum("sse") / (F.sum("n") - 4) * F.sum(1 / F.col("sxx"))).alias("error"), F.sum("n").alias("n")).withColumn(
        "t", safe(F.col("difference"), F.col("error"))).withColumn("p", student_p(F.col("t"), F.col("n") - 4)).withColumn("parallel", F.col("p") > 0.05)


def qini(df: DataFrame, treated: Column, score: str, y: str, buckets: int = 10) -> DataFrame:
    """Incremental outcome by descending score bucket, cumulated over the few buckets."""
    edges = quantiles(df, F.col(score), [i / buckets for i in range(1, buckets)]).select(F.col("q").alias("edges"))
    bucket = buckets - F.size(F.filter("edges", lambda e: e <= F.col(score)))
    t = treated.cast("double")
    sums = df.crossJoin(F.broadcast(edges)).groupBy(bucket.alias("bucket")).agg(F.sum(t).alias("nt"), F.sum(1 - t).alias("nc"), F.sum(t * F.col(y)).alias("yt"), F.sum((1 - t) * F.col(y)).alias("yc"))
    w = Window.orderBy("bucket")  # as many rows as buckets
    run = sums.withColumns({c: F.sum(c).over(w) for c in ("nt", "nc", "yt", "yc")})
    return run.withColumn("gain", F.col("yt") - F.col("yc") * safe(F.col("nt"), F.col("nc")))


def qini_curve(df: DataFrame, treated: Column, score: str, y: str) -> DataFrame:
    """(score, nt, nc, gain): the exact curve, a point for each distinct score from the greatest
    down; the sums run over ranges of scores."""
    t = treated.cast("double")
    sums = df.groupBy(score).agg(F.sum(t).alias("nt"), F.sum(1 - t).alias("nc"), F.sum(t * F.col(y)).alias("yt"), F.sum((1 - t) * F.col(y)).alias("yc"))
    run = running(sums, score, ["nt", "nc", "yt", "yc"])
    return run.select(score, F.col("run_nt").alias("nt"), F.col("run_nc").alias("nc"), (F.col("run_yt") - F.col("run_yc") * safe(F.col("run_nt"), F.col("run_nc"))).alias("gain"))


def impact(effects: DataFrame) -> DataFrame:
    """Per event: incremental units, revenue and profit, spend and return, best first."""
    rows = effects.withColumns({"incremental_revenue": F.col("incremental_units") * F.col("price"), "incremental_profit": F.col("incremental_units") * (F.col("price") - F.col("unit_cost")) - F.col("promotion_spend")})
    return rows.withColumn("roi", safe(F.col("incremental_profit"), F.col("promotion_spend")))


def bootstrap(per_series: DataFrame, draws: int = 200, seed: int = 5) -> DataFrame:
    """Percentile interval of a ratio of sums (num, den by listing): each draw weighs each
    listing by a Poisson(1) count from a hash."""
    h = F.md5(F.concat_ws("|", *KEYS, F.col("draw").cast("string"), F.lit(str(seed))).cast("binary"))
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 2.0**32
    cuts, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        cuts.append(total)
        p /= k + 1
    w = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("u")))
    rows = per_series.select(*KEYS, "num", "den", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("u", u).withColumn("w", w)
    each = rows.groupBy("draw").agg((F.sum(F.col("w") * F.col("num")) / F.sum(F.col("w") * F.col("den"))).alias("x"))
    return each.agg(F.percentile("x", 0.025).alias("lower"), F.percentile("x", 0.975).alias("upper"), F.count("x").alias("draws"))


def covariates(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (roles) with trailing demand as of the anchor date: the event's start for treated
    rows, the own date for others; and the season's harmonics of the own date."""
    trailing = trailing_demand(rows)
    at = rows.join(found.select("promotion_id", F.col("start_date").alias("starts")), "promotion_id", "left")
    at = at.withColumn("anchor_date", F.when(F.col("role") == "treated", F.col("starts")).otherwise(F.col("date"))).drop("starts")
    turn = 6.283185307179586 * F.dayofyear("date") / 365.25
    harmonics = {f"season_{f.__name__}_{k}": f(k * turn) for k in (1, 2) for f in (F.sin, F.cos)}
    return at.join(trailing.withColumnRenamed("date", "anchor_date"), [*KEYS, "anchor_date"], "left").withColumns(harmonics)


def trailing_demand(rows: DataFrame) -> DataFrame:
    """(keys, date, demand_*): lags and means of the units before each date."""
    known = {"demand_lag_1": lagged("units", 1), "demand_lag_7": lagged("units", 7), "demand_mean_7": rolling("units", 7), "demand_mean_28": rolling("units", 28), "promo_share_28": rolling("promoted_", 28)}
    out = rows.withColumn("promoted_", F.col("promotion_flag").cast("int")).withColumns(known)
    return out.select(*KEYS, "date", *known).dropDuplicates([*KEYS, "date"])


def panel(sales: DataFrame, pairs: DataFrame, products: DataFrame, stores: DataFrame, events: DataFrame, start: str, end: str, pad: int = 120) -> DataFrame:
    """Sales of the sampled pairs from `pad` days before start to end, with product and store
    attributes and the spend of events on their first day."""
    days = sales.filter(F.col("date").between(F.date_sub(F.to_date(F.lit(start)), pad), F.to_date(F.lit(end))))
    out = attributes(attributes(keep_keys(days, pairs), products, "product_id"), stores, "store_id")
    return first_day_spend(out, events)


def with_baseline(df: DataFrame, predicted: DataFrame) -> DataFrame:
    """df with baseline, the prediction of its date, product and store (null where there is none)."""
    return df.join(predicted.select(*KEYS, "date", F.col("predicted").alias("baseline")), [*KEYS, "date"], "left")


def whole_pool(rows: DataFrame, found: DataFrame, others: DataFrame, window: int = 45, controls: int = 30, treated: int = 5) -> DataFrame:
    """Treated rows, controls near an event of their own listing, and cross-sectional controls
    (`others`, rows of never promoted listings); too few of either kind is an error."""
    near = control_pool(rows, found, window).select(*KEYS, "date", "units", "control_origin")
    pool = near.unionByName(others.select(*KEYS, "date", "units").withColumn("control_origin", F.lit("cross_sectional")))
    n = pool.agg(F.count(F.when(F.col("control_origin") == "treated", 1)).alias("t"), F.count(F.when(F.col("control_origin") != "treated", 1)).alias("c")).first()
    if n.t < treated or n.c < controls:
        raise ValueError(f"{n.t} treated rows and {n.c} controls: at least {treated} and {controls} are needed")
    return pool


def pseudo_outcome(df: DataFrame, treated: Column, y: str, mu0: str, mu1: str, e: str, tail: float = 0.01) -> DataFrame:
    """df with pseudo, the doubly robust outcome, cut at its `tail` quantiles on both sides.  df is
    computed once."""
    t = treated.cast("double")
    raw = F.col(mu1) - F.col(mu0) + t * (F.col(y) - F.col(mu1)) / F.col(e) - (1 - t) * (F.col(y) - F.col(mu0)) / (1 - F.col(e))
    rows = written(df.withColumn("pseudo", raw))
    edges = quantiles(rows, F.col("pseudo"), [tail, 1 - tail]).select(F.col("q")[0].alias("lo_"), F.col("q")[1].alias("hi_"))
    return rows.crossJoin(F.broadcast(edges)).withColumn("pseudo", F.least(F.greatest("pseudo", "lo_"), F.col("hi_"))).drop("lo_", "hi_")


def segment_cate(df: DataFrame, treated: Column, segment: str, least: int = 30) -> DataFrame:
    """(segment, n_treated, cate, error): mean effect (pseudo) of a segment; null with under
    `least` treated rows."""
    n = F.sum(treated.cast("long"))
    enough = n >= least
    return df.groupBy(segment).agg(n.alias("n_treated"), F.when(enough, F.avg("pseudo")).alias("cate"), F.when(enough, F.stddev_samp("pseudo") / F.sqrt(F.count("pseudo"))).alias("error"))


def att_of(df: DataFrame, cate: DataFrame, treated: Column, segment: str) -> DataFrame:
    """Mean of the segments' effects over the treated rows."""
    return df.filter(treated).join(cate.select(segment, "cate"), segment).agg(F.avg("cate").alias("att"), F.count("cate").alias("n"))


def score_promotions(plans: DataFrame, cate: DataFrame, segment: str) -> DataFrame:
    """Hypothetical promotions (promotion_id, segment, baseline_units, days) with their expected
    uplift; a segment without an effect is left null and marked."""
    out = plans.join(cate.select(segment, "cate", "error"), segment, "left")
    return out.withColumns({"uplift": F.col("cate") * F.col("days"), "low": (F.col("cate") - 1.96 * F.col("error")) * F.col("days"), "high": (F.col("cate") + 1.96 * F.col("error")) * F.col("days"), "unknown": F.col("cate").isNull()})


def auuc(curve: DataFrame) -> DataFrame:
    """Area under the Qini table (bucket, nt, gain) by trapezoids over the treated share, less
    that of the straight line to its end."""
    w = Window.orderBy("bucket")  # as many rows as buckets
    top = curve.agg(F.max("nt").alias("all_"), F.max_by("gain", "bucket").alias("end_"))
    rows = curve.crossJoin(F.broadcast(top)).withColumn("x", F.col("nt") / F.col("all_"))
    before_x, before_y = F.coalesce(F.lag("x").over(w), F.lit(0.0)), F.coalesce(F.lag("gain").over(w), F.lit(0.0))
    rows = rows.withColumn("area", (F.col("x") - before_x) * (F.col("gain") + before_y) / 2)
    return rows.agg(F.sum("area").alias("area"), (F.sum("area") - F.max("end_") / 2).alias("auuc"))


#: Methods from the weakest assumptions to the strongest; the naive one is never selected.
STRENGTH = ("aipw", "ipw", "differences", "during_vs_before")


def select_method(estimates: DataFrame) -> DataFrame:
    """estimates (method, att, error) with rank and selected: methods without an estimate or not
    listed drop out, the weakest assumptions win, then the narrower interval."""
    rank = F.array_position(F.array(*[F.lit(m) for m in STRENGTH]), F.col("method"))
    rows = estimates.withColumn("rank", F.when((rank > 0) & F.col("att").isNotNull(), rank))
    best = rows.filter("rank is not null").agg(F.min_by("method", F.struct("rank", F.coalesce("error", F.lit(float("inf"))))).alias("best"))
    return rows.crossJoin(F.broadcast(best)).withColumn("selected", F.coalesce(F.col("method") == F.col("best"), F.lit(False))).drop("best")


def verdicts(diagnostics: DataFrame) -> DataFrame:
    """(method, verdict, reasons) from (method, worst_smd, trimmed, placebo_ratio, spread): sound,
    weak with one reason, not credible with more."""
    tests = {"imbalance": F.col("worst_smd") > 0.1, "little overlap": F.col("trimmed") > 0.1, "placebo effect": F.abs("placebo_ratio") > 0.05, "sensitive": F.col("spread") > 0.25}
    rows = diagnostics.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()])))
    n = F.size("reasons")
    return rows.withColumn("verdict", F.when(n == 0, "sound").when(n == 1, "weak").otherwise("not credible"))


def select_events(found: DataFrame, ids: list[str] | None = None, equal: dict[str, str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events by id, by column values, and wholly inside the dates; an id that does not occur is
    an error."""
    out = found
    if ids:
        asked = found.sparkSession.createDataFrame([(i,) for i in ids], "promotion_id string")
        if unknown := [r[0] for r in asked.join(found, "promotion_id", "left_anti").collect()]:  # at most the ids asked for
            raise ValueError(f"unknown events: {', '.join(sorted(unknown))}")
        out = out.filter(F.col("promotion_id").isin(*ids))
    for c, v in (equal or {}).items():
        out = out.filter(F.col(c) == v)
    out = out.filter(F.col("start_date") >= F.to_date(F.lit(start))) if start else out
    return out.filter(F.col("end_date") <= F.to_date(F.lit(end))) if end else out


def trade_cells(impacts: DataFrame, products: DataFrame, stores: DataFrame, most: float = 3.0) -> DataFrame:
    """Decision cells by product and region from measured events (promotion_units with the columns
    of `impact`): mean and deviation of the return, mean uplift over the expected units, spend, the
    product's margin, and bounds of the spend from nothing to `most` times its mean."""
    uplifted = safe(F.col("incremental_units"), F.col("promotion_units") - F.col("incremental_units"))
    rows = impacts.withColumn("uplift", uplifted).join(stores.select("store_id", "region"), "store_id")
    cells = rows.groupBy("product_id", "region").agg(
        F.avg("roi").alias("mean_roi"), F.stddev_samp("roi").alias("sd_roi"), F.avg("uplift").alias("mean_uplift"), F.avg("promotion_spend").alias("mean_spend"),
        F.sum("promotion_spend").alias("total_spend"), F.count(F.lit(1)).alias("events"))
    margin = safe(F.col("base_price") - F.col("unit_cost"), F.col("base_price"))
    out = cells.join(products.select("product_id", "category", "base_price", "unit_cost"), "product_id", "left").withColumn("margin", margin)
    return out.withColumns({"least_spend": F.lit(0.0), "most_spend": most * F.col("mean_spend")})
