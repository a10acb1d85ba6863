"""Models fitted with Spark ML, and rankings of their results."""

from __future__ import annotations

import random
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators import forecast, metrics
from shelfspark.operators.windows import KEYS, running
from shelfspark.sources.tables import shared_dir, written


def features(numeric: list[str], category: list[str]) -> list:
    """Stages: median imputation, scaling, one-hot categories (unknown ones are kept)."""
    filled, index, hot = [f"{c}__f" for c in numeric], [f"{c}__i" for c in category], [f"{c}__h" for c in category]
    return [Imputer(inputCols=numeric, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__num"),
            StandardScaler(inputCol="__num", outputCol="__scaled", withMean=True), StringIndexer(inputCols=category, outputCols=index, handleInvalid="keep"),
            OneHotEncoder(inputCols=index, outputCols=hot), VectorAssembler(inputCols=["__scaled", *hot], outputCol="features")]


def _plain(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def _logistic(train: DataFrame, penalty: float, numeric: list[str], category: list[str]) -> PipelineModel:
    """A logistic model of `label`.  Its last stage is saved and loaded, which leaves out the training
    summary: that refers to the session, which cannot be sent to tasks once it has observed a query."""
    *stages, logit = Pipeline(stages=[*features(numeric, category), LogisticRegression(regParam=penalty)]).fit(train).stages
    path = f"{shared_dir(train.sparkSession)}/model-{uuid.uuid4().hex}"
    logit.save(path)
    return PipelineModel([*stages, LogisticRegressionModel.load(path)])


def _probability() -> Column:
    return F.least(F.greatest(vector_to_array("probability")[1], F.lit(0.02)), F.lit(0.98))


def propensity(df: DataFrame, treated: Column, numeric: list[str], category: list[str]) -> DataFrame:
    """df with e, the probability of treatment by a logistic model, inside 0.02 .. 0.98.  df is
    computed once: fitting takes many passes over what is written of it."""
    rows = written(df.withColumn("label", treated.cast("double")))
    n = rows.count()
    fitted = _logistic(rows, 1.0 / max(n, 1), numeric, category)
    return _plain(fitted.transform(rows).withColumn("e", _probability()), [*df.columns, "e"])


REGRESSORS = {"ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0), "trees": lambda: GBTRegressor(maxIter=20, maxDepth=4, seed=7),
              "poisson": lambda: GeneralizedLinearRegression(family="poisson", link="log", regParam=1e-3)}


def _labelled(train: DataFrame, y: str, numeric: list[str], category: list[str]) -> DataFrame:
    return train.select(*numeric, *category, F.col(y).cast("double").alias("label"))


def regression(train: DataFrame, rows: DataFrame, y: str, numeric: list[str], category: list[str], kind: str = "ridge") -> DataFrame:
    """rows with `predicted`, never negative, by a model fitted on train, which is computed once."""
    return _regression(written(_labelled(train, y, numeric, category)), rows, numeric, category, kind)


def _regression(train: DataFrame, rows: DataFrame, numeric: list[str], category: list[str], kind: str) -> DataFrame:
    """`regression` by a train with its label that is cheap to read again."""
    fitted = Pipeline(stages=[*features(numeric, category), REGRESSORS[kind]().setLabelCol("label")]).fit(train)
    return _plain(fitted.transform(rows).withColumn("predicted", F.greatest("prediction", F.lit(0.0))), [*rows.columns, "predicted"])


def folds(df: DataFrame, k: int = 5, seed: str = "7") -> DataFrame:
    """Cross-fitting folds: all rows of a listing share one, from the md5 of its key."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *KEYS, F.lit(seed))), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", F.pmod(h, F.lit(k)))


def time_blocks(df: DataFrame, k: int = 5) -> DataFrame:
    """Folds of equal numbers of distinct dates (dates are few: one small window)."""
    days = df.select("date").distinct().withColumn("__r", F.dense_rank().over(Window.orderBy("date")) - 1)
    top = days.agg(F.max("__r").alias("__top"))
    days = days.crossJoin(F.broadcast(top)).select("date", F.least(F.floor(F.col("__r") * k / F.greatest("__top", F.lit(1))), F.lit(k - 1)).cast("int").alias("fold"))
    return df.join(days, "date")


def cross_fitted(df: DataFrame, treated: Column, y: str, numeric: list[str], category: list[str], k: int = 3) -> DataFrame:
    """df with fold, e and mu0: each fold's nuisances come from models of the other folds.  df is
    computed once, for all of them."""
    rows, out = written(folds(df, k)), None
    for i in range(k):
        rest, mine = rows.filter(F.col("fold") != i), rows.filter(F.col("fold") == i)
        logit = _logistic(rest.withColumn("label", treated.cast("double")), 1e-4, numeric, category)
        scored = _plain(logit.transform(mine).withColumn("e", _probability()), [*rows.columns, "e"])
        part = _regression(_labelled(rest.filter(~treated), y, numeric, category), scored, numeric, category, "ridge").withColumnRenamed("predicted", "mu0")
        out = part if out is None else out.unionByName(part)
    return out


def auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """Area under the curve by ranks, ties counting one half: from counts of distinct scores and
    running sums over ranges of them."""
    counts = df.groupBy(score).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n"))
    totals = counts.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    rows = running(counts, score, ["n"]).crossJoin(F.broadcast(totals))
    below = F.col("all_n") - F.col("run_n")
    return rows.agg((F.sum(F.col("p") * (below + F.col("n") / 2)) / (F.first("all_p") * F.first("all_n"))).alias("auc"))


def permuted(df: DataFrame, feature: str, seed: str = "7") -> DataFrame:
    """df with one feature's values dealt anew inside each date, by ranks in two hash orders."""
    a = Window.partitionBy("date").orderBy(F.md5(F.concat_ws("|", *KEYS, F.lit(seed))), *KEYS)
    b = Window.partitionBy("date").orderBy(F.md5(F.concat_ws("|", *KEYS, F.lit(seed + "x"))), *KEYS)
    rows = df.withColumn("__r", F.row_number().over(a))
    dealt = df.select(F.col("date").alias("__d"), F.col(feature).alias("__v"), F.row_number().over(b).alias("__s"))
    return rows.join(dealt, (F.col("date") == F.col("__d")) & (F.col("__r") == F.col("__s"))).withColumn(feature, F.col("__v")).drop("__r", "__d", "__v", "__s")


def select_model(scores: DataFrame, within: float = 0.02, naive: str = "seasonal_naive", lift: float = 1.2) -> DataFrame:
    """Of (model, wmape, stockout_lift) the lowest error among models whose predictions on stockout
    days are at least `lift` times the units sold (one that learnt the censoring drops out); the
    naive one wins when it is as good within a margin."""
    best = scores.filter(F.col("stockout_lift") >= lift).agg(
        F.min_by("model", F.struct("wmape", "model")).alias("best"), F.min("wmape").alias("error"), F.min(F.when(F.col("model") == naive, F.col("wmape"))).alias("naive"))
    wins = F.coalesce(F.col("naive") <= F.col("error") + within, F.lit(False))
    return best.select(F.when(wins, F.lit(naive)).otherwise(F.col("best")).alias("model"), F.when(wins, F.col("naive")).otherwise(F.col("error")).alias("wmape"))


def fit_evaluate(rows: DataFrame, numeric: list[str], category: list[str], kind: str = "ridge") -> DataFrame:
    """Split by date, fit on clean training rows, calibrate on clean calibration rows, and score
    the test rows by role (clean, promoted, stockout): accuracy and coverage of the bounds.  rows
    are computed once."""
    parts = forecast.split(written(rows.filter("units is not null")))
    clean = ~F.col("stockout_flag") & ~F.col("promotion_flag")
    train = _labelled(parts.filter((F.col("part") == "train") & clean), "units", numeric, category)
    scored = _regression(train, parts.filter("part in ('calibration', 'test')"), numeric, category, kind)
    scored = written(scored.withColumn("all_", F.lit("all")))
    widths = metrics.conformal(scored.filter((F.col("part") == "calibration") & clean), "all_", least=1)
    test = metrics.intervals(scored.filter("part = 'test'"), widths, "all_")
    role = F.when(F.col("stockout_flag"), "stockout").when(F.col("promotion_flag"), "promoted").otherwise("clean")
    inside = F.col("units").between(F.col("lower"), F.col("upper")).cast("double")
    return test.groupBy(role.alias("role")).agg(*metrics.accuracy(), F.avg(inside).alias("empirical"))


def search(rows: DataFrame, numeric: list[str], category: list[str], trials: int = 8, gain: float = 0.005, seed: int = 7) -> DataFrame:
    """(name, reg_param, wmape, kept): ridge penalties drawn at random, scored on the validation
    window; the default stays unless another gains more than `gain`.  `trials` bounds the fits.
    rows are computed once, and so are the features, which all penalties share."""
    rng = random.Random(seed)
    parts = forecast.split(written(rows.filter("units is not null"))).withColumn("label", F.col("units").cast("double"))
    train, valid = parts.filter("part = 'train'"), parts.filter("part = 'valid'")
    stages = Pipeline(stages=features(numeric, category)).fit(train)
    train, valid = [written(stages.transform(x).select("features", "label", "units")) for x in (train, valid)]
    found = []
    for name, penalty in [("default", 1.0), *((f"trial_{i}", 10 ** rng.uniform(-3, 2)) for i in range(trials))]:
        model = LinearRegression(regParam=penalty, elasticNetParam=0.0, labelCol="label")
        score = model.fit(train).transform(valid).withColumn("predicted", F.greatest("prediction", F.lit(0.0))).agg(*metrics.accuracy()).first()
        found.append((name, penalty, score.wmape))
    base, best = found[0][2], min(found, key=lambda x: x[2])
    kept = best[0] if best[2] < base - gain else "default"
    return rows.sparkSession.createDataFrame([(n, p, w, n == kept) for n, p, w in found], "name string, reg_param double, wmape double, kept boolean")
