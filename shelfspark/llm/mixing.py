"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks.  With q of every T slots as its quota, block k of a
source is released at floor(k T / q) and due at ceil((k + 1) T / q); earliest deadline first
fills one slot after the other.  At any slot every source that still has blocks is less than
one block away from its share.  The schedule repeats after T slots, so it is computed once
for T slots, from the parameters alone, by a fold over them; documents are placed by
arithmetic on their rank.  Ranks within a source (in hash order) come from counts of hash
ranges and row numbers inside a range, so no source is ever one task's work.  A source that
has run out leaves its slots empty; the others keep their proportions.
DataFrame functions only.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OTHER = "*"
BLOCK, RANGES, MOST_PERIOD = 10, 3, 10_000  # documents, hexadecimal digits of a hash range, slots
#: Parameters of the registered query: shares of the sources, the rest pooled.
WEIGHTS = {"src0": 20, "src1": 8, "src2": 8, "src3": 8, "src4": 8, "src5": 4, "src6": 4, "src7": 4, "src8": 4, "src9": 4,
           "src10": 3, "src11": 3, "src12": 3, "src13": 3, "src14": 3}
REST = 13


def quotas(weights: dict[str, float], rest: float, period: int | None = None) -> dict[str, int]:
    """Slots of each class in a period.  Without a period the least one in which every share is
    whole is taken, so the quotas are the target weights exactly; weights that need more than
    MOST_PERIOD slots are refused.  With a period shares are rounded by largest remainders, to
    one slot at least, and the deviation bound holds for the rounded shares."""
    shares = {k: Fraction(w).limit_denominator(10**6) for k, w in (dict(weights) | {OTHER: rest}).items() if w > 0}
    total = sum(shares.values())
    if period is None:
        period = math.lcm(*((s / total).denominator for s in shares.values()))
        if period > MOST_PERIOD:
            raise ValueError(f"these weights need {period} slots: round them, or give a period")
    if len(shares) > period:
        raise ValueError("a period must have a slot for each source")
    exact = {k: period * s / total for k, s in shares.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    by_rest = sorted(shares, key=lambda k: (-(exact[k] - int(exact[k])), k))
    i = 0
    while sum(out.values()) < period:
        out[by_rest[i % len(by_rest)]] += 1
        i += 1
    while sum(out.values()) > period:
        k = max(out, key=lambda k: (out[k], k))
        out[k] -= 1
    return out


def schedule(spark: SparkSession, quota: dict[str, int]) -> DataFrame:
    """One row for each slot of a period: (slot, class, k, release, deadline, before), before
    being the blocks that each class has had by then.  Earliest deadline first, ties by the
    order of `quota`."""
    period, names = sum(quota.values()), list(quota)
    q = F.array(*[F.lit(v) for v in quota.values()])

    def release(k: Column, n: Column) -> Column:
        return F.floor(k * period / n).cast("int")

    def due(k: Column, n: Column) -> Column:
        return F.ceil((k + 1) * period / n).cast("int")

    def step(state: Column, t: Column) -> Column:
        done = state["done"]
        ready = F.filter(
            F.transform(F.arrays_zip(done.alias("k"), q.alias("n")), lambda x, i: F.struct(
                due(x["k"], x["n"]).alias("due"), i.alias("i"), x["k"].alias("k"), release(x["k"], x["n"]).alias("release"), x["n"].alias("n"))),
            lambda x: (x["k"] < x["n"]) & (x["release"] <= t))
        pick = F.array_min(ready)
        return F.struct(
            F.transform(done, lambda k, i: F.when(i == pick["i"], k + 1).otherwise(k)).alias("done"),
            F.concat(state["out"], F.array(F.struct(t.alias("slot"), pick["i"].alias("i"), pick["k"].alias("k"), pick["release"].alias("release"),
                                                    pick["due"].alias("deadline"), done.alias("before")))).alias("out"))

    nothing = F.expr("cast(array() as array<struct<slot:int,i:int,k:int,release:int,deadline:int,before:array<int>>>)")
    start = F.struct(F.array_repeat(F.lit(0), len(names)).alias("done"), nothing.alias("out"))
    folded = F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), start, step, lambda s: s["out"])
    rows = spark.range(1).select(F.inline(folded))
    labels = F.array(*[F.lit(n) for n in names])
    return rows.select("slot", F.element_at(labels, F.col("i") + 1).alias("class"), "k", "release", "deadline", "before")


def place(docs: DataFrame, weights: dict[str, float] = WEIGHTS, rest: float = REST, id_col: str = "doc_id", source: str = "source",
          block: int = BLOCK, period: int | None = None, prefix: str = "") -> DataFrame:
    """docs with block, release, deadline, slot and position (from 0, without gaps).

    Sources without a weight, null among them, share the class of the rest.  Within a class
    documents are in the order of the md5 of their id (null: of the empty string), then the
    id, then the md5 of all columns; rows that are equal in all columns follow each other in
    any order.  A weight of zero is refused (no document may be dropped), and so are more
    classes than slots.  All columns pass through; `prefix` is put before the new names, and
    a name that is taken nevertheless is an error.  Empty table: empty.
    """
    spark = docs.sparkSession
    if rest <= 0 or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    if taken := {prefix + n for n in ("block", "release", "deadline", "slot", "position")} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns {sorted(taken)}: give another prefix")
    quota = quotas(weights, rest, period)
    period, names = sum(quota.values()), list(quota)
    known = F.when(F.col(source).isin(*weights), F.col(source)).otherwise(F.lit(OTHER))
    # the documents' own columns travel as one, so no name can clash
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("doc"), known.alias("__mix_class"), F.col(id_col).alias("__mix_id"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("__mix_h"))
    rows = rows.withColumn("__mix_r", F.substring("__mix_h", 1, RANGES))
    counts = rows.groupBy("__mix_class", "__mix_r").agg(F.count(F.lit(1)).alias("__mix_n"))
    before = F.sum("__mix_n").over(Window.partitionBy("__mix_class").orderBy("__mix_r")) - F.col("__mix_n")
    starts = counts.select(F.col("__mix_class").alias("__mix_c2"), F.col("__mix_r").alias("__mix_r2"), before.alias("__mix_start"))
    # at most 16 ** RANGES rows for each class of the parameters
    ranked = rows.withColumn("__mix_i", F.row_number().over(Window.partitionBy("__mix_class", "__mix_r").orderBy("__mix_h", "__mix_id", F.md5(F.to_json("doc").cast("binary")))) - 1)
    ranked = ranked.join(F.broadcast(starts), (F.col("__mix_class") == F.col("__mix_c2")) & (F.col("__mix_r") == F.col("__mix_r2")))
    rank = (F.col("__mix_start") + F.col("__mix_i")).cast("long")
    totals = counts.groupBy("__mix_class").agg(F.sum("__mix_n").alias("n"))
    map_of = totals.agg(F.map_from_entries(F.collect_list(F.struct("__mix_class", "n"))).alias("__mix_all"))
    q_of = F.create_map(*[x for n, v in quota.items() for x in (F.lit(n), F.lit(v))])
    placed = ranked.withColumn("__mix_rank", rank).withColumn("__mix_b", F.floor(F.col("__mix_rank") / block)).withColumn("__mix_q", q_of[F.col("__mix_class")])
    placed = placed.withColumn("__mix_p", F.floor(F.col("__mix_b") / F.col("__mix_q"))).withColumn("__mix_k", (F.col("__mix_b") % F.col("__mix_q")).cast("int"))
    slots = schedule(spark, quota).select(F.col("class").alias("__mix_c3"), F.col("k").alias("__mix_k3"), F.col("slot").alias("__mix_slot"),
                                          F.col("release").alias("__mix_rel"), F.col("deadline").alias("__mix_due"), F.col("before").alias("__mix_before"))
    # one row for each slot of the period, and one row of class totals
    placed = placed.join(F.broadcast(slots), (F.col("__mix_class") == F.col("__mix_c3")) & (F.col("__mix_k") == F.col("__mix_k3")))
    placed = placed.crossJoin(F.broadcast(map_of))
    others = None
    for i, name in enumerate(names):
        had = F.col("__mix_p") * quota[name] + F.col("__mix_before")[i]
        part = F.least(F.coalesce(F.col("__mix_all")[name], F.lit(0)), had * block)
        others = part if others is None else others + part
    round_of = F.col("__mix_p") * period
    return placed.select(
        "doc.*", F.col("__mix_b").cast("long").alias(f"{prefix}block"), (round_of + F.col("__mix_rel")).cast("long").alias(f"{prefix}release"),
        (round_of + F.col("__mix_due")).cast("long").alias(f"{prefix}deadline"), (round_of + F.col("__mix_slot")).cast("long").alias(f"{prefix}slot"),
        (others + F.col("__mix_rank") % block).cast("long").alias(f"{prefix}position"))


def interleave(docs: DataFrame, weights: dict[str, float] = WEIGHTS, rest: float = REST, id_col: str = "doc_id", source: str = "source",
               block: int = BLOCK, period: int | None = None) -> DataFrame:
    """docs in mixed order, with their own columns: ranges of positions, each sorted, so that
    files written from it follow one another in the order of the mix.  Nulls and repeated
    rows as in `place`.  Empty table: empty."""
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    placed = place(docs, weights, rest, id_col, source, block, period, prefix)
    at = f"{prefix}position"
    return placed.repartitionByRange(at).sortWithinPartitions(at).select(*(F.col(f"`{c}`") for c in docs.columns))


def brute_schedule(quota: dict[str, int]) -> list[tuple[int, str, int]]:
    """(slot, class, k) by plain simulation, for tests and oracles."""
    period, done, out = sum(quota.values()), dict.fromkeys(quota, 0), []
    for t in range(period):
        ready = [(-(-(done[c] + 1) * period // q), i, c) for i, (c, q) in enumerate(quota.items()) if done[c] < q and done[c] * period // q <= t]
        _, _, c = min(ready)
        out.append((t, c, done[c]))
        done[c] += 1
    return out


def oracle() -> str:
    """DuckDB SQL of the registered query's rows."""
    quota = quotas(WEIGHTS, REST)
    period = sum(quota.values())
    slots = ", ".join(f"({t}, '{c}', {k}, {k * period // quota[c]}, {-(-(k + 1) * period // quota[c])}, {quota[c]})" for t, c, k in brute_schedule(quota))
    listed = ", ".join(f"'{s}'" for s in WEIGHTS)
    return f"""
WITH slots(slot, class, k, release, deadline, q) AS (VALUES {slots}),
ranked AS (
  SELECT doc_id, source, class, row_number() OVER (PARTITION BY class ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r
  FROM (SELECT doc_id, source, CASE WHEN source IN ({listed}) THEN source ELSE '{OTHER}' END AS class FROM documents)),
blocks AS (SELECT *, r // {BLOCK} AS block FROM ranked),
placed AS (
  SELECT b.doc_id, b.source, b.block, b.r, (b.block // s.q) * {period} + s.release AS release, (b.block // s.q) * {period} + s.deadline AS deadline,
         (b.block // s.q) * {period} + s.slot AS slot
  FROM blocks b JOIN slots s ON s.class = b.class AND s.k = b.block % s.q)
SELECT doc_id, source, block, release, deadline, slot, row_number() OVER (ORDER BY slot, r) - 1 AS position FROM placed"""
