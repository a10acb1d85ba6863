"""Ordinal quality classifier: a cumulative-link model on hashed words.

Ratings are grades 0 .. K-1.  One weight for each hashed word is shared by all grades and
ordered thresholds split the scale: P(grade <= k) = logistic(threshold[k] - score), where
the score sums the weights of a text's distinct words.  From it come the expected grade and
the tail probability P(grade >= k) used for selection.

The fit takes at most `sample` labelled rows (a documented bound, the smallest by a hash of
the id), so the driver holds a bounded set of sparse rows; weights and thresholds are a few
hundred kilobytes whatever the input.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added, free, utf8

SAMPLE = 20_000
BUCKETS = 1 << 18
EPOCHS, STEPS, BATCH, RATE, L1 = 12, 3_000, 64, 0.15, 1.0e-3  # passes and steps: at least this many of both
LEAST_DOCS = 5  # a bucket that fewer labelled texts have gets no weight
LONG = 1 << 22  # bytes of a text tokenised at once
TOKEN = regex.compile(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+")
REMEMBER = 1_000_000


def tokens(text: bytes) -> set[bytes]:
    """Distinct lower-cased (A-Z) words and runs of signs of a UTF-8 text."""
    found: set[bytes] = set()
    at = 0
    while at < len(text):
        end = at + LONG
        if end < len(text):  # not inside a word
            end = next((i for i in range(end, len(text)) if text[i] in b" \t\n\v\f\r"), len(text))
        found.update(TOKEN.findall(text[at:end].lower()))
        at = end
    return found


def bucket(token: bytes, buckets: int = BUCKETS) -> int:
    return xxhash.xxh64_intdigest(token) % buckets


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """Fitted weights and thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """Rows of P(grade = k)."""
        below = _logistic(self.thresholds[None, :] - scores[:, None])
        below = np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], 1)
        return np.diff(below, axis=1)

    def score(self, found: set[bytes], memory: dict[bytes, float]) -> float:
        total, weights = 0.0, self.weights
        for token in found:
            w = memory.get(token)
            if w is None:
                w = memory[token] = float(weights[bucket(token, len(weights))])
            total += w
        return total


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, buckets: int = BUCKETS, seed: int = 7) -> Ordinal:
    """`fit_sparse` of one array of buckets a row."""
    ends = np.cumsum([0, *map(len, rows)])
    return fit_sparse(np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32), ends, grades, levels, buckets, seed)


def fit_sparse(flat: np.ndarray, ends: np.ndarray, grades: np.ndarray, levels: int, buckets: int = BUCKETS, seed: int = 7) -> Ordinal:
    """Maximum likelihood with an L1 penalty: proximal AdaGrad over sparse rows of buckets,
    row i being flat[ends[i]:ends[i + 1]].

    Without rows, or with one grade only, the model gives the observed shares.
    """
    shares = np.bincount(grades, minlength=levels) + 0.5
    below = np.cumsum(shares / shares.sum())[:-1]
    thresholds = np.log(below / (1 - below))
    weights = np.zeros(buckets)
    n = len(grades)
    if not n or len(set(grades.tolist())) < 2:
        return Ordinal(weights.astype(np.float32), thresholds)
    often = np.bincount(flat, minlength=buckets)[flat] >= LEAST_DOCS
    ends = np.concatenate([[0], np.cumsum(often)])[ends]
    flat = flat[often]
    size = np.diff(ends)
    squares, squares_t = np.full(buckets, 1e-2), np.full(levels - 1, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // n))):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            pick = order[at : at + BATCH]
            mine = np.concatenate([flat[ends[i] : ends[i + 1]] for i in pick])
            owner = np.repeat(np.arange(len(pick)), size[pick])
            scores = np.bincount(owner, weights[mine], len(pick))
            edge = np.concatenate([np.full((len(pick), 1), -np.inf), thresholds[None, :] - scores[:, None], np.full((len(pick), 1), np.inf)], 1)
            cdf = _logistic(edge)
            pdf = cdf * (1 - cdf)
            y = grades[pick]
            at_rows = np.arange(len(pick))
            up, low = pdf[at_rows, y + 1], pdf[at_rows, y]
            p = np.maximum(cdf[at_rows, y + 1] - cdf[at_rows, y], 1e-9)
            slope = (up - low) / p / len(pick)  # d(-log likelihood) / d score
            hit, where = np.unique(mine, return_inverse=True)
            g = np.bincount(where, slope[owner], len(hit))
            squares[hit] += g**2
            step = RATE / np.sqrt(squares[hit])
            w = weights[hit] - step * g
            weights[hit] = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
            gt = np.array([(-(up * (y == k)) + low * (y == k + 1)) @ (1 / p) for k in range(levels - 1)]) / len(pick)
            squares_t += gt**2
            thresholds = thresholds - RATE / np.sqrt(squares_t) * gt
            thresholds = np.maximum.accumulate(thresholds)
    return Ordinal(weights.astype(np.float32), thresholds)


def grade_of_labels() -> Column:
    """Grades of the labels table: 0 toxic, 1 poor, 2 good; null where a label is missing."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def train(docs: DataFrame, ratings: DataFrame, levels: int = 3, id_col: str = "doc_id", text: str = "text",
          sample: int = SAMPLE, buckets: int = BUCKETS) -> Ordinal | None:
    """Fit on ratings (id, grade) of documents; None where no document has a rating.

    At most `sample` rated ids are taken, smallest md5 first; an id rated more than once
    takes its lowest grade.  Null ids, null or foreign grades and ids without a document are
    left out; a null text is empty.  The driver holds the sampled rows' bucket numbers in
    flat arrays of 4 bytes each.
    """
    ratings = ratings.filter(F.col(id_col).isNotNull() & F.col("grade").between(0, levels - 1)).groupBy(
        F.col(id_col).alias("id")).agg(F.min("grade").cast("int").alias("grade"))
    chosen = ratings.orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample)
    # `sample` bounds this table, so it may be broadcast
    rated = docs.select(F.col(id_col).alias("id"), utf8(text).alias("text")).join(F.broadcast(chosen), "id")

    def rows_of(batches):
        for batch in batches:
            got = [sorted({bucket(t, buckets) for t in tokens(v.as_buffer().to_pybytes())}) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), pa.array(got, pa.list_(pa.int32()))], names=["id", "grade", "buckets"])

    schema = added(rated.select("id"), "grade int, buckets array<int>")
    # repeated document rows of an id: one of them, so that the bound holds
    table = rated.select("id", "grade", "text").mapInArrow(rows_of, schema).groupBy("id").agg(
        F.min_by("grade", F.size("buckets")).alias("grade"), F.min("buckets").alias("buckets")).toArrow()
    if not table.num_rows:
        return None
    order = np.argsort(table["id"].to_numpy(zero_copy_only=False), kind="stable")
    pieces = table["buckets"].chunks
    flat = np.concatenate([p.flatten().to_numpy() for p in pieces])
    size = np.concatenate([np.diff(p.offsets.to_numpy()) for p in pieces])
    grades = table["grade"].to_numpy().astype(np.int64)
    del table, pieces
    starts = np.concatenate([[0], np.cumsum(size)])
    ends = np.concatenate([[0], np.cumsum(size[order])])
    sorted_ = np.concatenate([flat[starts[i] : starts[i + 1]] for i in order])
    return fit_sparse(sorted_, ends, grades[order], levels, buckets)


def rate(docs: DataFrame, model: Ordinal, good: int, text: str = "text", grade: str = "expected_grade", tail: str = "tail_probability") -> DataFrame:
    """docs with the columns `grade` (expected grade) and `tail` (P(grade >= good)); a column
    that has one of these names already is refused.  A null text is empty and gets the
    thresholds' own shares.  Empty table: empty."""
    if {grade.lower(), tail.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {grade} or {tail}")
    schema = added(docs, f"`{grade}` double, `{tail}` double")
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of buckets
    [temp] = free(docs, "llm_text")

    def run(batches):
        ordinal, memory = shipped.value, {}
        for batch in batches:
            scores = []
            for value in batch.columns[-1]:
                scores.append(ordinal.score(tokens(value.as_buffer().to_pybytes()), memory))
                if len(memory) > REMEMBER:
                    memory.clear()
            p = ordinal.probabilities(np.array(scores, float))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(p @ np.arange(p.shape[1])), pa.array(p[:, good:].sum(1))], names=[*batch.schema.names[:-1], grade, tail])

    return docs.withColumn(temp, utf8(text)).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(id, expected_grade, tail_probability, kept) of every document, from labels (id,
    quality, toxic).  kept: P(good) >= least.  Without a usable label all documents are kept;
    labels of one grade only, or with no word that LEAST_DOCS of their texts share, give every
    document the labels' shares of the grades.  Null text: empty.  Null and
    repeated ids stay, each row rated on its own text."""
    return rate(docs.select(id_col, text), _trained(docs, labels, id_col, text, sample), 2, text).select(
        id_col, "expected_grade", "tail_probability", (F.col("tail_probability") >= least).alias("kept"))


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier keeps (as `judge`), with their columns."""
    grade, tail = free(docs, "llm_grade", "llm_tail")
    rated = rate(docs, _trained(docs, labels, id_col, text, sample), 2, text, grade, tail)
    return rated.filter(F.col(tail) >= least).drop(grade, tail)


def _trained(docs, labels, id_col, text, sample) -> Ordinal:
    ordinal = train(docs, labels.select(id_col, grade_of_labels().alias("grade")), 3, id_col, text, sample)
    if ordinal is None:  # nothing to learn from: everything passes
        return Ordinal(np.zeros(BUCKETS, np.float32), np.array([-40.0, -39.0]))
    return ordinal
