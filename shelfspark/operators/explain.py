"""What a forecast leans on: permutation importance, by horizon and by family of features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.windows import safe

#: Rows of a block, inside which values are dealt anew.
BLOCK = 5000


def dealt(rows: DataFrame, features: list[str], key: list[str], bucket: str, blocks: int, seed: str) -> DataFrame:
    """rows with `other`, the features of another row of its block: blocks of a bucket by the md5 of
    the key, and inside a block the rows in one hash order meet those in another."""
    def h(salt: str) -> Column:
        return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(seed + salt)).cast("binary"))

    part = F.pmod(F.conv(F.substring(h("block"), 1, 8), 16, 10).cast("long"), F.lit(blocks))
    own = rows.withColumns({"block_": part, "a_": h("a"), "b_": h("b")})
    block = Window.partitionBy(bucket, "block_")
    own = own.withColumns({"to_": F.row_number().over(block.orderBy("a_")), "from_": F.row_number().over(block.orderBy("b_"))})
    giver = own.select(F.col(bucket).alias("of_"), F.col("block_").alias("in_"), F.col("from_").alias("at_"), F.struct(*features).alias("other"))
    same = (F.col(bucket) == F.col("of_")) & (F.col("block_") == F.col("in_")) & (F.col("to_") == F.col("at_"))
    return own.join(giver, same).drop("block_", "a_", "b_", "to_", "from_", "of_", "in_", "at_")


def permutation_importance(rows: DataFrame, predict: Callable[[DataFrame], DataFrame], features: list[str], key: list[str], y: str, bucket: str,
                           blocks: int | None = None, seeds: tuple[str, ...] = ("1", "2", "3")) -> DataFrame:
    """(bucket, feature, importance, deviation, baseline, n): the rise of the weighted error when one
    feature's values are dealt anew among the rows of a bucket, the mean over the seeds.

    All copies, one with each feature permuted and one as it is, are scored in one job by
    `predict`, which adds `predicted` to a table (of a fitted model or a formula).  A feature
    that the model does not use rises by exactly 0.  Rows without a bucket are left out.
    """
    rows = rows.filter(F.col(bucket).isNotNull() & F.col(y).isNotNull())
    blocks = blocks or max(1, rows.count() // BLOCK)

    def copy(name: str) -> Column:
        return F.struct(F.lit(name).alias("permuted"), *[(F.col("other")[c] if c == name else F.col(c)).alias(c) for c in features])

    kept = [c for c in rows.columns if c not in features]
    out = None
    for seed in seeds:
        copies = dealt(rows, features, key, bucket, blocks, seed).select(*kept, F.lit(seed).alias("seed"), F.inline(F.array(copy(""), *[copy(c) for c in features])))
        out = copies if out is None else out.unionByName(copies)
    scored = predict(out)
    errors = scored.groupBy(bucket, "seed", "permuted").agg(safe(F.sum(F.abs(F.col("predicted") - F.col(y))), F.sum(F.when(F.col("predicted").isNotNull(), F.col(y)))).alias("wmape"), F.count("predicted").alias("n"))
    base = F.max(F.when(F.col("permuted") == "", F.struct("wmape", "n"))).over(Window.partitionBy(bucket, "seed"))  # a row a feature
    rises = errors.withColumn("base", base).filter("permuted <> ''").withColumn("rise", F.col("wmape") - F.col("base.wmape"))
    return rises.groupBy(bucket, F.col("permuted").alias("feature")).agg(F.avg("rise").alias("importance"), F.stddev_pop("rise").alias("deviation"), F.avg("base.wmape").alias("baseline"), F.max("base.n").alias("n"))


def families(importance: DataFrame, family_of: dict[str, str], bucket: str) -> DataFrame:
    """(family, bucket, importance, share): features are summed to their family, others to 'other'."""
    names = F.create_map(*[F.lit(x) for pair in family_of.items() for x in pair])
    sums = importance.groupBy(F.coalesce(names[F.col("feature")], F.lit("other")).alias("family"), bucket).agg(F.sum("importance").alias("importance"))
    return sums.withColumn("share", safe(F.col("importance"), F.sum("importance").over(Window.partitionBy(bucket))))


def decay(family_table: DataFrame, bucket: str) -> DataFrame:
    """(bucket, recent_history_share, seasonal_anchor_share): the first should fall as the horizon
    grows.  The seasonal anchor is kept apart, as its share rises when the recent one falls."""
    def share(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("family") == name, F.col("share"))), F.lit(0.0))

    return family_table.groupBy(bucket).agg(share("recent history").alias("recent_history_share"), share("seasonal anchor").alias("seasonal_anchor_share"))
