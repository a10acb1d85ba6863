"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints are 64 bits over word shingles; two link when they differ in at most three
bits.  Distinct fingerprints are taken once, so a group of exact copies is one row.

1. Filter.  Of four blocks of 16 bits one holds the most of three differing bits; the other
   48 bits differ in at most two.  Every fingerprint emits, for each block left out, the
   other 48 bits and all their variants within one bit (196 rows); one shuffle on the variants
   finds which fingerprints have a partner.  A variant that only two have is verified at once.
2. Balls of one bit (65 rows) of those fingerprints link all pairs at distance 1 and 2: the
   members of a variant are within two of each other, so the smallest is a hub to which all
   others link, group size minus one edges and no pairs.
3. Pairs at distance 3 matter between components of step 2 only.  The filter's variants are
   made once more for what has a partner.  Where one holds several components and FEW members at
   most, all its pairs are compared: every pair within three bits meets in some variant.  In
   larger groups all members emit their balls of one bit, and those that are not of the largest
   component there add all variants of two bits in one half (two of any three bits lie in one
   half).  Such a pair meets in a variant at one bit from the one and two from the
   other; all rows at one bit are of one component, so the smallest is the hub again.  The
   pairs of bits are taken in ROUNDS, and what has joined the components it met drops out.
4. Components of the verified edges: after each step its edges are taken between the roots of the
   components so far, so no component is found twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import added, components, free, identity, materialise, utf8

RADIUS = 3
SHINGLE = 3
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text; bytes.lower and bytes.split are ASCII only."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, CHUNK):
        size = min(CHUNK, n - at)
        hashes = np.fromiter((digest(next(grams), 42) for _ in range(size)), np.uint64, size)
        # columns are bits: a 8 x 256 count of byte values gives each bit's total
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            seen = np.bincount(octets[:, byte], minlength=256)
            total[8 * byte : 8 * byte + 8] += seen @ BITS
    set_bits = np.flatnonzero(2 * total > n)
    return sum(1 << int(b) for b in set_bits)


#: BITS[v, b]: whether bit b of byte value v is set.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", out: str = "fp") -> DataFrame:
    """Columns `keys` and `out` (signed long) for every row; null or wordless texts get zero."""
    schema = added(docs.select(*keys), f"`{out}` long")

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_buffer().to_pybytes()) for x in batch.columns[-1]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:-1], out])

    [temp] = free(keys, "llm_text")
    return docs.select(*keys, utf8(text).alias(temp)).mapInArrow(run, schema)


def _mask(*bits: int) -> str:
    """SQL of a long with these bits set."""
    return " | ".join(f"shiftleft(1L, {b})" for b in bits) or "0L"


#: Masks of at most one bit, and of two bits of one half, as SQL.
ONES = [_mask(), *(_mask(i) for i in range(64))]
TWOS = [_mask(i, j) for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
#: The pairs in rounds: most of a dense group's components join in the first, few are left for the rest.
ROUNDS = [TWOS[0::16], [m for i, m in enumerate(TWOS) if i % 16 in (4, 8, 12)], [m for i, m in enumerate(TWOS) if i % 4]]
BLOCK = 16
#: Members of a variant's group up to which its pairs are compared directly.
FEW = 32


def _flips(masks: list[str]) -> Column:
    return F.expr(f"array({', '.join(masks)})")


def _filter_keys() -> Column:
    """For each block left out: a mark of the block, the mask of the bits that stay and a flip
    of at most one of those."""
    rows = []
    for block in range(64 // BLOCK):
        out = range(BLOCK * block, BLOCK * (block + 1))
        stay = f"~({((1 << BLOCK) - 1)}L << {BLOCK * block})"
        rows += [f"named_struct('mark', {_mask(BLOCK * block)}, 'stay', {stay}, 'flip', {_mask(*bits)})" for bits in ((), *((b,) for b in range(64) if b not in out))]
    return F.expr(f"array({', '.join(rows)})")


def _met(fps: DataFrame) -> DataFrame:
    """fps (fp and more) with each of their variants of 48 bits, v.  The bits left out are zero
    in it, so the block's mark fits there and the key is one long."""
    rows = fps.select("*", F.explode(_filter_keys()).alias("k"))
    v = F.col("fp").bitwiseAND(F.col("k.stay")).bitwiseXOR(F.col("k.flip")).bitwiseXOR(F.col("k.mark"))
    return rows.select(*fps.columns, v.alias("v"))


def _linked(variants: DataFrame) -> DataFrame:
    """Edges (a, b) from the members (fp, close) of each variant v to the smallest close one."""
    hub = F.min(F.when(F.col("close"), F.col("fp"))).over(Window.partitionBy("v"))
    return (
        variants.withColumn("hub", hub).filter("hub <> fp")
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= RADIUS)
        .select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()
    )


def _united(named: DataFrame, edges: DataFrame) -> DataFrame:
    """named (fp, root), root being the smallest of fp's component, after more edges (a, b).

    The edges are taken between roots, so only what they unite is gone through again, not the
    components found before."""
    ends = edges.join(named.select(F.col("fp").alias("a"), F.col("root").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("root").alias("y")), "b")
    renamed = components(ends.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("least"))
    return materialise(named.join(renamed, "root", "left").select("fp", F.coalesce("least", "root").alias("root")))


def _sized(named: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(fp, of) of the fingerprints, or of those in `only`: of is the size and root of its
    component."""
    sizes = named.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    mine = named if only is None else named.join(only.select("fp"), "fp", "left_semi")
    return mine.join(sizes, "root").select("fp", F.struct("size", "root").alias("of"))


def _several(sized: DataFrame) -> DataFrame:
    """(fp, of, v, n, most) of the variants of 48 bits that hold several components: n members, the
    largest component `most`.  Components only grow, so what met no other before meets none
    later."""
    w = Window.partitionBy("v")
    met = _met(sized).withColumns({"n": F.count(F.lit(1)).over(w), "most": F.max("of").over(w), "least": F.min("of").over(w)})
    return met.filter("least < most").drop("least")


def _pairs(several: DataFrame) -> DataFrame:
    """Edges (a, b) between components inside each variant's group, all pairs compared: groups of
    FEW at most, and only pairs within RADIUS leave the array."""
    groups = several.groupBy("v").agg(F.collect_list(F.struct("fp", "of.root")).alias("m"))

    def partners(x: Column) -> Column:
        near = F.filter("m", lambda y: (y["fp"] > x["fp"]) & (y["root"] != x["root"]) & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= RADIUS))
        return F.transform(near, lambda y: F.struct(x["fp"].alias("a"), y["fp"].alias("b")))

    found = groups.select(F.flatten(F.transform("m", partners)).alias("p")).filter(F.size("p") > 0)
    return found.select(F.inline("p")).distinct()


def classes(fps: DataFrame) -> DataFrame:
    """(fp, root) of the distinct values of fp that may have a partner: root is the smallest value
    that links within RADIUS bits reach.  What is not in it is alone."""
    distinct = materialise(fps.select("fp").distinct())
    w = Window.partitionBy("v")
    low, high = F.min("fp").over(w), F.max("fp").over(w)
    met = _met(distinct).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("low", low).withColumn("high", high).filter("n > 1")
    near = materialise(met.filter((F.col("n") > 2) | (F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= RADIUS)).select("fp").distinct())
    ball = near.select("fp", F.explode(_flips(ONES)).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"), F.lit(True).alias("close"))
    named = _united(near.select("fp", F.col("fp").alias("root")), materialise(_linked(ball)))
    several = materialise(_several(_sized(named)))
    # a pair within RADIUS bits meets in one variant at least: small groups are compared at once
    named = _united(named, materialise(_pairs(several.filter(F.col("n") <= FEW))))
    open_ = materialise(several.filter(F.col("n") > FEW).select("fp").distinct())
    for pairs in ROUNDS:
        if open_.isEmpty():
            break
        several = _several(_sized(named, open_)).filter(F.col("n") > FEW)
        open_ = materialise(several.groupBy("fp").agg(F.max(F.col("of") < F.col("most")).alias("wide")))
        if open_.isEmpty():
            break
        masks = F.when(F.col("wide"), _flips(ONES + pairs)).otherwise(_flips(ONES))
        wide = open_.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"), (F.bit_count("m") <= 1).alias("close"))
        named = _united(named, materialise(_linked(wide)))
    return named


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) from each component's smallest value of fp, a, to its others: they connect what
    is within RADIUS bits, directly or over others."""
    return classes(fps).filter("fp <> root").select(F.col("root").alias("a"), F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component, root) for every row of docs: the smallest id its fingerprint
    reaches, and the smallest fingerprint, which names the component whatever ids repeat.

    Null texts count as empty (fingerprint zero, linked like any other); rows with a null id
    are kept and take part, but a component is named by its smallest non-null id (null if it
    has none).  Repeated rows and ids stay, each with its result.  Empty table: empty result.
    """
    return _components(materialise(fingerprints(docs, [id_col], text)), id_col)


def _components(fps: DataFrame, id_col: str) -> DataFrame:
    roots = classes(fps).select(F.col("fp").alias("node"), "root")
    least = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    named = least.join(roots, least["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least")
    # partial minima first, so that a large component's rows do not meet in one task
    component = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(component, "root").select("fp", "component", "root")
    return fps.join(named, "fp").select(*fps.columns, "component", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one row of each near-duplicate group, all columns kept.

    The row with the smallest id stays; a null id comes after all others, and among rows of
    one id the one with the smallest fingerprint, then text hash.  Groups are told apart by
    their fingerprints, so rows of unlike texts that share an id are all kept.  Rows that
    repeat id and text are one document: any one of them stays.
    """
    rows = docs.select(F.col(id_col).alias("id"), identity(text).alias("key"), F.col(text).alias("text"))
    found = _components(materialise(fingerprints(rows, ["id", "key"], "text")), "id")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "fp", "key")
    winners = found.groupBy("root").agg(F.min(order).alias("w"))
    key, wid, wkey = free(docs, "llm_key", "llm_id", "llm_win")
    win = materialise(winners.select(F.col("w.id").alias(wid), F.col("w.key").alias(wkey)))
    marked = docs.withColumn(key, identity(text))
    here = F.col(id_col).eqNullSafe(F.col(wid)) & (F.col(key) == F.col(wkey))
    kept = marked.join(win, here, "left_semi")
    again = found.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias(wid), F.col("key").alias(wkey))
    again = materialise(again)
    once = kept.join(again, here, "left_anti")
    one = kept.join(again, here, "left_semi").dropDuplicates([id_col, key])
    return once.unionByName(one).drop(key)
