"""Packing documents into token sequences: best-fit decreasing over a segment tree.

1. Every document is encoded and ends in one more token; what is longer than a window is first
   cut into full windows and a rest.  Each task numbers its pieces within their length.  The
   pieces are written once: (document, start, length, checksum), no token ids.
2. Pieces of one length are interchangeable, so best-fit decreasing runs over the counts of the
   lengths (at most `window` numbers, whatever the corpus holds): a segment tree indexed by
   remaining capacity finds the tightest open windows, and all pieces of a length that go to
   windows of one capacity are placed by one step.  The number of steps depends on the lengths
   that occur and hardly on the number of pieces.
3. A piece's place follows from its length and its number among the pieces of that length: the
   numbers of the tasks are joined with the counts of earlier tasks, and each task looks its
   pieces up in the steps.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_letters, default_path
from .common import materialise, utf8

WINDOW = 1024
#: The token that ends every document.
END_ID = 0
#: Rows of an output batch; bits for the number of a piece in a step's key.
BATCH, NUMBER_BITS = 1 << 15, 46


class Encoder:
    """Token ids of texts as the vocabulary file's own library gives them: special tokens in a
    text are taken as such, nothing is added."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = byte_letters()
        ids = data["model"]["vocab"]
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        # ranks: single bytes, then the merges in their order
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in data["model"]["merges"]]
        order = list(dict.fromkeys([*letters, *made]))
        ranks = {bytes(letters[c] for c in token): rank for rank, token in enumerate(order)}
        marks = {s: len(order) + i for i, s in enumerate(special)}
        self.ids = np.array([*(ids[t] for t in order), *special.values()], np.uint32)
        self.coder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=marks)

    def encode(self, text: str) -> np.ndarray:
        return self.ids[self.coder.encode_to_numpy(text, allowed_special="all")]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Tightest:
    """A segment tree over capacities 1 to size: the leaf of a capacity counts its open windows,
    an inner node the open windows below it."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += n
            at >>= 1

    def find(self, least: int) -> int:
        """The smallest capacity of at least `least` that has an open window; 0: none."""
        at = least + self.leaves
        while not self.open[at]:
            while at & 1:  # a right child: nothing more to the right below this parent
                at >>= 1
            if not at:
                return 0
            at += 1
        while at < self.leaves:
            at *= 2
            if not self.open[at]:
                at += 1
        return at - self.leaves


def plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Best-fit decreasing of counts[length] pieces of each length, as steps (length, first, each,
    sequence, offset): from its length's piece number `first` on, `each` pieces at a time go to
    sequence `sequence`, the next to the one after it, and so on, from `offset`.

    Longest pieces first, each into the open window with the least room that holds it, or a new
    one.  A window that still holds another piece of the same length is then the tightest, so
    it takes as many as fit.
    """
    tree, spare, steps, opened = Tightest(window), defaultdict(list), [], 0

    def leave(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            spare[capacity].append((first, n))
            tree.add(capacity, n)

    for length in sorted(counts, reverse=True):
        left, done = counts[length], 0
        while left:
            capacity = tree.find(length)
            if capacity:
                first, n = spare[capacity].pop()
                tree.add(capacity, -n)
            else:
                capacity, first, n = window, opened, -(-left // (window // length))
                opened += n
            each = capacity // length
            full = min(n, left // each)
            last = min(left - full * each, each) if full < n else 0
            steps.append((length, done, each, first, window - capacity))
            leave(capacity - each * length, first, full)
            leave(capacity - last * length, first + full, 1 if last else 0)
            rest = full + (last > 0)
            leave(capacity, first + rest, n - rest)
            done += full * each + last
            left -= full * each + last
    return np.array(steps, np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None, ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, task, number) of every piece, with the piece's
    ids if asked for: full windows, then the rest of a document."""
    names = ["start", "length", "ids_crc32", "doc_tokens", "task", "number"] + ["ids"] * ids
    if id_col.lower() in names:
        raise ValueError(f"rename the id column {id_col}: a piece has a column of that name")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length int, ids_crc32 long, doc_tokens long, task int, number long" + ", ids binary" * ids

    def run(batches):
        coder, task, seen = encoder(path or default_path()), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.columns[1]):
                tokens = np.append(coder.encode(value.as_buffer().to_pybytes().decode("utf-8", "replace")), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(tokens), window):
                    part = tokens[start : start + window].tobytes()
                    n = len(part) // 4
                    rows.append((start, n, zlib.crc32(part), len(tokens), task, seen[n], *[part] * ids))
                    at.append(i)
                    seen[n] += 1
                if len(rows) >= BATCH:
                    yield _batch(batch, at, rows, id_col, names)
                    at, rows = [], []
            yield _batch(batch, at, rows, id_col, names)

    return docs.select(F.col(id_col), utf8(text).alias("llm_text")).mapInArrow(run, schema)


KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]


def _batch(batch: pa.RecordBatch, at: list[int], rows: list[tuple], id_col: str, names: list[str]) -> pa.RecordBatch:
    made = [pa.array([r[k] for r in rows], KINDS[k]) for k in range(len(names))]
    return pa.RecordBatch.from_arrays([batch.columns[0].take(pa.array(at, pa.int64())), *made], names=[id_col, *names])


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None, ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every
    document, with the piece's token ids if asked for.

    Each token lies in one piece and each sequence holds its pieces without gaps from 0.  A null
    or empty text is one piece of one token.  Null and repeated ids stay, each row a document of
    its own.  Other columns of docs are not looked at.  Empty table: no rows.
    """
    cut = materialise(pieces(docs, id_col, text, window, path, ids))
    # at most `window` rows a task, then at most `window` rows
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    steps = plan({r.length: r.n for r in totals}, window)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    numbered = cut.join(counts.select("length", "task", before.alias("before")), ["length", "task"])
    out = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * ids
    numbered = numbered.select(F.col(id_col), "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids, (F.col("before") + F.col("number")).alias("number"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * ids
    # steps come with the longest first, and by number within a length
    keys = (window - steps[:, 0] << NUMBER_BITS) + steps[:, 1]

    def run(batches):
        for batch in batches:
            length, number = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "number"))
            here = np.searchsorted(keys, (window - length << NUMBER_BITS) + number, side="right") - 1
            _, first, each, sequence, offset = steps[here].T
            at = number - first
            made = {"length": pa.array(length), "sequence_id": pa.array(sequence + at // each), "offset": pa.array(offset + at % each * length)}
            yield pa.RecordBatch.from_arrays([batch.columns[0], *(made[c] if c in made else batch.column(c) for c in out)], names=[id_col, *out])

    return numbered.mapInArrow(run, schema)


def sequences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """(sequence_id, n_tokens, ids) of the packed sequences, the ids as little-endian unsigned
    32-bit integers without padding.  A group is a window at most."""
    packed = pack(docs, id_col, text, window, path, ids=True)
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.unhex(F.array_join(F.transform(parts, lambda x: x["ids"]), "")).alias("ids"))
