"""Helpers shared by the corpus operators: shared storage, byte access to texts, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Newline-free ASCII white space plus line breaks, as the contracts state it.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where none is set, a folder in the working directory of a
    local session; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def free(taken: DataFrame | list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it."""
    used = {c.lower() for c in (taken if isinstance(taken, list) else taken.columns)}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def identity(text: str) -> Column:
    """128 bits that stand for a text; null reads as empty."""
    return F.unhex(F.md5(utf8(text)))


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def utf8(col: str) -> Column:
    """The text's bytes; null reads as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def added(df: DataFrame, ddl: str) -> StructType:
    """df's schema with more fields, given as in DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast when it has at most `rows` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as rows (a, b).

    Returns (node, root): every node of an edge with the smallest node of its component.
    Each round hooks every node to its smallest neighbour, follows that pointer once more,
    renames the edges and drops loops and repeats, so the graph shrinks by a constant share
    when node ids are in no particular order (hashes).  Nothing is gathered on the driver
    but the question whether edges remain.  Self loops and repeated edges are allowed; an
    empty edge table gives an empty result.
    """
    edges = checkpointed(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    mapping = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root"))
    live = edges.filter("a <> b")
    while not live.isEmpty():
        both = live.union(live.select(F.col("b"), F.col("a")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("y"))
        hook = checkpointed(hook)
        up = hook.select(F.col("x").alias("y"), F.col("y").alias("z"))
        hook = checkpointed(hook.join(up, "y", "left").select("x", F.coalesce("z", "y").alias("y")))
        mapping = checkpointed(
            mapping.join(hook, mapping["root"] == hook["x"], "left").select("node", F.coalesce("y", "root").alias("root"))
        )
        ha = hook.select(F.col("x").alias("a"), F.col("y").alias("na"))
        hb = hook.select(F.col("x").alias("b"), F.col("y").alias("nb"))
        moved = live.join(ha, "a").join(hb, "b").filter("na <> nb")
        live = checkpointed(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
    # The last names are local minima chosen by hooking; name each component by its smallest node.
    small = mapping.groupBy("root").agg(F.min("node").alias("least"))
    return mapping.join(small, "root").select("node", F.col("least").alias("root"))
