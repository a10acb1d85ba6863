"""Effects from sums: a sweep of specifications, overlap, and a cross-fitted effect model.

Every estimate here comes from sums over small groups, which are taken in one pass over the
panel whatever the number of specifications or folds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import joins
from shelfspark.operators.windows import KEYS, safe

#: The specifications of the sweep, (parameter, washout, window, trim).
SPECIFICATIONS = (
    *(("washout_days", w, max(45, w + 1), 0.02) for w in (0, 5, 10, 21)),
    *(("control_window_days", 10, w, 0.02) for w in (21, 45, 90)),
    *(("propensity_trim", 10, 45, e) for e in (0.01, 0.02, 0.05)),
)


def sweep_rows(covariates: DataFrame, sales: DataFrame, events: DataFrame) -> DataFrame:
    """Treated rows and rows outside promotions (of `uplift.covariates` over sales, with a washout
    of 0) with the days since the last event and to the nearest one."""
    rows = covariates.filter("role in ('treated', 'control') and demand_mean_28 is not null")
    near = joins.days_to_nearest(sales, events).select(*KEYS, "date", "nearest", F.datediff("date", "last_end").alias("since"))
    return rows.join(near, [*KEYS, "date"])


def sweep(rows: DataFrame, y: str = "units", x: str = "demand_mean_28", specifications=SPECIFICATIONS) -> DataFrame:
    """(parameter, washout, control_window, trim, att, error, att_share, n_treated, n_control, spread,
    relative_spread): the augmented inverse-propensity estimate under each specification.

    A row belongs to every specification whose washout and control window let it in.  One pass
    sums y and x by specification, listing and quarter; from these come the propensity (the
    treated share of a listing's quarter; quarters outside trim .. 1 - trim are dropped, not
    clipped), the outcome model (of each product, a line in x over the controls) and the
    estimate, whose error is clustered on listings.  spread: the range of att_share, the effect
    by the mean expected without treatment; relative_spread: by its size under the usual values
    (10 days, 45 days, 0.02).
    """
    specs = F.array(*[F.struct(F.lit(i).alias("spec"), F.lit(p).alias("parameter"), F.lit(w).alias("washout"), F.lit(d).alias("control_window"), F.lit(float(e)).alias("trim"))
                      for i, (p, w, d, e) in enumerate(specifications)])
    treated = F.col("role") == "treated"
    fits = F.filter(specs, lambda s: treated | (((F.col("since") > s["washout"]) | F.col("since").isNull()) & (F.col("nearest") <= s["control_window"])))
    tagged = rows.select(*KEYS, F.date_trunc("quarter", "date").alias("quarter"), treated.cast("int").alias("t"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"), F.explode(fits).alias("s"))
    names = ["spec", "parameter", "washout", "control_window", "trim"]
    tagged = tagged.select(*KEYS, "quarter", "t", "y", "x", *[F.col(f"s.{c}").alias(c) for c in names])

    def of(t: int, c: Column) -> Column:
        return F.sum(F.when(F.col("t") == t, c).otherwise(0.0))

    one, cx, cy = F.lit(1.0), F.col("x"), F.col("y")
    cells = tagged.groupBy(*names, *KEYS, "quarter").agg(of(1, one).alias("nt"), of(0, one).alias("nc"), of(1, cy).alias("yt"), of(0, cy).alias("yc"), of(1, cx).alias("xt"), of(0, cx).alias("xc"),
                                                         of(0, cx * cx).alias("xx"), of(0, cx * cy).alias("xy"))
    e = F.col("nt") / (F.col("nt") + F.col("nc"))
    cells = cells.withColumn("e", e).filter(F.col("e").between(F.col("trim"), 1 - F.col("trim")))
    n, sx, sy = F.sum("nc"), F.sum("xc"), F.sum("yc")
    slope = F.coalesce(safe(F.sum("xy") - sx * sy / n, F.sum("xx") - sx * sx / n), F.lit(0.0))
    fit = cells.groupBy("spec", "product_id").agg(slope.alias("b"), ((sy - slope * sx) / n).alias("a"))
    rows_t = F.col("yt") - F.col("a") * F.col("nt") - F.col("b") * F.col("xt")
    rows_c = F.col("yc") - F.col("a") * F.col("nc") - F.col("b") * F.col("xc")
    scored = cells.join(fit, ["spec", "product_id"]).withColumns({"score": rows_t - F.col("e") / (1 - F.col("e")) * rows_c, "expected": F.col("a") * F.col("nt") + F.col("b") * F.col("xt")})
    listing = scored.groupBy(*names, *KEYS).agg(*[F.sum(c).alias(c) for c in ("score", "nt", "nc", "expected")])
    totals = listing.groupBy("spec").agg(F.sum("nt").alias("all_t"), (F.sum("score") / F.sum("nt")).alias("att"))  # a row a specification
    psi = F.col("score") - F.col("nt") * F.col("att")
    k = F.count(F.lit(1))
    found = listing.join(F.broadcast(totals), "spec").groupBy(*names).agg(
        F.first("att").alias("att"), (F.sqrt(F.sum(psi * psi) * k / (k - 1)) / F.first("all_t")).alias("error"),
        safe(F.sum("score"), F.sum("expected")).alias("att_share"), F.sum("nt").cast("long").alias("n_treated"), F.sum("nc").cast("long").alias("n_control"))
    usual = (F.col("washout") == 10) & (F.col("control_window") == 45) & (F.col("trim") == 0.02)
    ends = found.agg((F.max("att_share") - F.min("att_share")).alias("spread"), F.max(F.when(usual, F.col("att_share"))).alias("base"))
    return found.crossJoin(F.broadcast(ends)).withColumn("relative_spread", safe(F.col("spread"), F.abs("base"))).drop("base")


def trimmed(df: DataFrame, e: str, trim: float = 0.02) -> DataFrame:
    """df without the rows whose propensity lies outside trim .. 1 - trim.  They are dropped, not
    clipped: a clipped row would keep a weight that no comparable row stands behind."""
    return df.filter(F.col(e).between(trim, 1 - trim))


def overlap(df: DataFrame, treated: Column, e: str, trim: float = 0.02) -> DataFrame:
    """One row: rows, trimmed share, treated rows above the controls' largest and controls under
    the treated rows' smallest propensity (off_support), and the effective sizes of both arms
    after trimming, with weights of 1 and the odds."""
    t = treated.cast("boolean")
    p, inside = F.col(e), F.col(e).between(trim, 1 - trim)
    ends = df.agg(F.max(F.when(~t, p)).alias("top_c"), F.min(F.when(t, p)).alias("low_t"))
    rows = df.crossJoin(F.broadcast(ends))  # one row
    off = (t & (p > F.col("top_c"))) | (~t & (p < F.col("low_t")))
    odds = F.when(inside & ~t, p / (1 - p))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.avg((~inside).cast("double")).alias("trimmed_share"), F.avg(off.cast("double")).alias("off_support"),
                    F.count(F.when(inside & t, 1)).alias("effective_treated"), safe(F.sum(odds) * F.sum(odds), F.sum(odds * odds)).alias("effective_control"))


@dataclass(frozen=True)
class EffectModel:
    """Lines in the covariates `xs`, one for each fold left out and one of all rows (fold -1)."""

    xs: tuple[str, ...]
    coefficients: dict[int, tuple[float, ...]]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(f, list(c)) for f, c in self.coefficients.items()]
        spark.createDataFrame(rows, "fold int, coefficients array<double>").withColumn("xs", F.array(*[F.lit(x) for x in self.xs])).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> EffectModel:
        rows = spark.read.parquet(path).collect()  # a row a fold
        return EffectModel(tuple(rows[0].xs), {r.fold: tuple(r.coefficients) for r in rows})

    def line(self, fold: int) -> Column:
        out = F.lit(self.coefficients[fold][0])
        for x, c in zip(self.xs, self.coefficients[fold][1:]):
            out = out + c * F.col(x)
        return out

    def out_of_fold(self, df: DataFrame, fold: str = "fold") -> DataFrame:
        """df with cate, each row's effect by the line of the other folds."""
        cate = F.coalesce(*[F.when(F.col(fold) == f, self.line(f)) for f in self.coefficients if f >= 0])
        return df.withColumn("cate", cate)

    def predict(self, plans: DataFrame, days: str = "days") -> DataFrame:
        """plans, which were not among the rows, with the effect a day and over their days; a plan
        without one of the covariates has none and is marked."""
        return plans.withColumn("cate", self.line(-1)).withColumns({"uplift": F.col("cate") * F.col(days), "unknown": F.col("cate").isNull()})


def fit_effects(df: DataFrame, xs: list[str], y: str = "pseudo", fold: str = "fold", ridge: float = 0.0) -> EffectModel:
    """Second-stage regression of pseudo-outcomes on the covariates, for each fold by the rows of
    the others, from one pass of cross products ((k + 2)^2 / 2 numbers a fold).  Rows without one
    of the covariates are left out; a covariate that does not vary has coefficient 0."""
    columns = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    k = len(columns)
    rows = df.dropna(subset=[*xs, y])
    sums = [F.sum(columns[i] * columns[j]).alias(f"s_{i}_{j}") for i in range(k) for j in range(i, k)]
    found = rows.groupBy(fold).agg(*sums).collect()  # a row a fold
    moments = {}
    for r in found:
        m = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                m[i, j] = m[j, i] = r[f"s_{i}_{j}"]
        moments[int(r[fold])] = m
    if not moments:
        raise ValueError("no rows with all covariates")
    total = sum(moments.values())

    def solve(m: np.ndarray) -> tuple[float, ...]:
        a, b = m[:-1, :-1], m[:-1, -1]
        mean = a[0, 1:] / max(a[0, 0], 1.0)
        spread = a[1:, 1:] - a[0, 0] * np.outer(mean, mean) + ridge * np.eye(k - 2)
        slope = np.linalg.lstsq(spread, b[1:] - mean * b[0], rcond=1e-10)[0] if a[0, 0] else np.zeros(k - 2)
        return (float(b[0] / max(a[0, 0], 1.0) - mean @ slope), *map(float, slope))

    return EffectModel(tuple(xs), {f: solve(total - m) for f, m in moments.items()} | {-1: solve(total)})


def att(df: DataFrame, treated: Column) -> DataFrame:
    """Mean of the out-of-fold effects over the treated rows, with the error of the
    pseudo-outcomes' spread, which the smoothing leaves out of account."""
    mine = df.filter(treated & F.col("cate").isNotNull())
    return mine.agg(F.avg("cate").alias("att"), (F.stddev_samp("pseudo") / F.sqrt(F.count("pseudo"))).alias("error"), F.count(F.lit(1)).alias("n"))
