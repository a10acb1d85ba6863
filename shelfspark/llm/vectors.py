"""Vector code compression: product codebooks by Lloyd rounds, pruned with LAESA pivots.

Components become integers and a vector is cut into equal parts, each with a codebook of its
own.  The distances of every part to a few fixed pivots are computed once and written with the
integers.  In each round the distances of the pivots to the codebook's entries give, for every
part and entry, a lower bound of their distance (the largest difference of their distances to
a pivot).  A part looks at the entries by ascending bound and stops at the first bound above
the best distance so far, so most exact integer distances are never evaluated.  Bounds are taken
down by more than their rounding, so the nearest entry, ties to the lower index, is exact.

A round sends one row for each part position, entry, component and task; the codebooks have
parts x entries vectors, whatever the table holds, and live on the driver between the rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, materialise

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 4
#: Beyond this magnitude of a component sums of squares might leave 64 bits.
MOST = 1 << 15
#: What a bound is lowered by, relative to the distances it is made from: far above their rounding.
SLACK = 1e-9


def whole(vectors: DataFrame, id_col: str, vector: str, label: str | None) -> DataFrame:
    """(id, label, v) of the rows whose vector has finite components only, v being whole numbers."""
    x = F.col(vector)
    names = [F.col(id_col).alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label")]
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.filter(x.isNotNull() & good)
    value = F.transform(x, lambda c: F.when(F.abs(c.cast("double")) <= MOST, F.floor(c.cast("double") * SCALE))
                        .otherwise(F.raise_error(F.lit(f"a component is beyond {MOST}: scale the vectors")).cast("long")))
    return rows.select(*names, value.alias("v"))


def pivots(seeds: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """For each part position, seeds that lie far from each other: (parts, pivots, width).  The
    first is seed 0, each next one has the largest summed distance to those before it."""
    chosen = []
    for part in seeds.transpose(1, 0, 2).astype(float):
        at, far = [0], np.zeros(len(part))
        while len(at) < min(most, len(part)):
            far += np.sqrt(((part - part[at[-1]]) ** 2).sum(1))
            far[at] = -1
            at.append(int(far.argmax()))
        chosen.append(part[at])
    return np.array(chosen)


def distances(parts: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Of each row's part at each position to each of the position's points: (rows, parts, points)."""
    return np.sqrt(((parts[:, :, None, :].astype(float) - points[None]) ** 2).sum(-1))


def nearest(parts: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivot_entry: np.ndarray, count: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For one part position: index of each part's nearest entry and its exact squared distance.

    parts (rows, width) and book (entries, width) are whole numbers, to_pivots (rows, pivots)
    and pivot_entry (pivots, entries) distances.  count, if given, gets the evaluations made.
    """
    bound = np.abs(to_pivots[:, :, None] - pivot_entry[None])
    bound -= SLACK * (to_pivots[:, :, None] + pivot_entry[None] + 1)
    bound = bound.max(1)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.maximum(np.take_along_axis(bound, order, 1), 0) ** 2 * (1 - SLACK)
    best = np.full(len(parts), np.iinfo(np.int64).max)
    index = np.full(len(parts), len(book))
    live = np.arange(len(parts))
    for k in range(len(book)):
        live = live[bound[live, k] <= best[live]]  # bounds ascend: what stops here stays stopped
        if not len(live):
            break
        entry = order[live, k]
        d = ((parts[live] - book[entry]) ** 2).sum(1)
        better = (d < best[live]) | ((d == best[live]) & (entry < index[live]))
        best[live[better]], index[live[better]] = d[better], entry[better]
        if count is not None:
            count.append(len(live))
    return index, best


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(rows, -1)


def _assigned(batch: pa.RecordBatch, books: np.ndarray, pivot_entry: np.ndarray):
    """(part position, its parts, index, distance) of a batch with columns v and to_pivots."""
    n, (parts, _, width) = batch.num_rows, books.shape
    v = _matrix(batch.column("v"), n).astype(np.int64).reshape(n, parts, width)
    near = _matrix(batch.column("to_pivots"), n).reshape(n, parts, -1)
    for p in range(parts):
        yield p, v[:, p], *nearest(v[:, p], near[:, p], books[p], pivot_entry[p])


def _sums(rows: DataFrame, books: np.ndarray, pivot_entry: np.ndarray) -> DataFrame:
    """(part, entry, position, n, total) of the parts that are nearest to each entry."""
    shape = books.shape

    def run(batches):
        count, total = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                for p, parts, index, _ in _assigned(batch, books, pivot_entry):
                    count[p] += np.bincount(index, minlength=shape[1])
                    np.add.at(total[p], index, parts)
        part, entry, position = (x.ravel() for x in np.indices(shape))
        used = count[part, entry] > 0
        made = [part, entry, position, count[part, entry], total.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x[used], pa.int64()) for x in made], names=["part", "entry", "position", "n", "total"])

    out = rows.select("v", "to_pivots").mapInArrow(run, "part long, entry long, position long, n long, total long")
    return out.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors, and the codebooks (parts, entries, width).

    The table has (id, label, code, error): two hex digits for each part position, and the
    squared distance to the chosen entries.  Rows without a vector, or with null or non-finite
    components, are left out; components beyond MOST are an error, not a wrong sum.  Vectors
    of unequal lengths are padded with zeros to the longest, and that to whole parts.  The first
    entries are the parts of the ENTRIES smallest ids (equal ids by their vectors, null ids last);
    fewer vectors give fewer entries, none give an empty table.  Repeated rows and ids stay.
    """
    rows = whole(vectors, id_col, vector, label)
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width * PARTS) - F.size("v"))))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    books = np.array([r.v for r in first], np.int64).reshape(-1, PARTS, width)
    if not len(books):
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, width), np.int64)
    fixed = pivots(books)
    books = books.transpose(1, 0, 2)

    def measure(batches):
        for batch in batches:
            v = _matrix(batch.column("v"), batch.num_rows).astype(np.int64).reshape(batch.num_rows, PARTS, width)
            d = distances(v, fixed).reshape(batch.num_rows, -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "to_pivots"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = materialise(rows.mapInArrow(measure, f"{kinds}, to_pivots array<double>"))
    for _ in range(ROUNDS):
        new = books.copy()
        for r in _sums(rows, books, _pivot_entry(fixed, books)).collect():
            new[r.part, r.entry, r.position] = r.total // r.n
        if (new == books).all():
            break  # nor would a later round change anything
        books = new
    final, pivot_entry = books, _pivot_entry(fixed, books)

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                found = [(index, d) for _, _, index, d in _assigned(batch, final, pivot_entry)]
                code = ["".join(f"{x:02x}" for x in r) for r in np.stack([i for i, _ in found], 1).tolist()]
                made = [pa.array(code), pa.array(sum(d for _, d in found), pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *made], names=["id", "label", "code", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("id", "label").schema)
    return rows.mapInArrow(encode, f"{kinds}, code string, error long"), final


def _pivot_entry(fixed: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Distances of each position's pivots to its entries: (parts, pivots, entries)."""
    return np.sqrt(((fixed[:, :, None, :] - books[:, None].astype(float)) ** 2).sum(-1))


def digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digests(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every usable vector; see compress."""
    codes, books = compress(vectors, id_col, vector, label)
    codes = materialise(codes)
    totals = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: np.ndarray, code: str = "code", out: str = "vector") -> DataFrame:
    """codes with the vector that each code stands for, in the unit of the input.  A null code
    gives a null vector; a column named `out` is replaced."""
    parts, entries, _ = books.shape
    codes = codes.drop(out)
    [book] = free(codes, "llm_book")
    table = F.array(*[F.array(*[F.array(*[F.lit(float(c) / SCALE) for c in e]) for e in p]) for p in books])
    at = [F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") for p in range(parts)]
    pick = F.concat(*[F.get(F.get(F.col(book), F.lit(p)), at[p]) for p in range(parts)])
    return codes.withColumn(book, table).withColumn(out, pick).drop(book)
