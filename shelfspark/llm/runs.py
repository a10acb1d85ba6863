"""Periodic runs of words: Kruskal's algorithm on the longest common prefixes of suffixes.

A run is a stretch of words with smallest period q, at least max(LEAST, FOLD q) words long, that
cannot be extended.  The texts of an Arrow batch are taken together: words become numbers,
texts without a repeated stretch of FLOOR words are set aside (no run fits below that), and the
suffixes of the others are sorted by prefix doubling.  Then neighbouring suffixes are united by
descending common prefix.  A class is an ordered set of positions; the smaller set is poured into
the larger one, and each position that comes in meets the one before and the one after it.
Two that become neighbours at a distance d of at most the common prefix L are the start of a
stretch of L + d words with period d, and of a run if the word before breaks the period.

Why each run is found once: its start s and s + q share exactly length - q words, no position
between them shares as many (the period would be smaller), so they become neighbours when
prefixes of that length are united; and the words before them differ for no other pair of it.
A period that is a multiple of a smaller one is never found, as the smaller one's positions, with a
longer common prefix, already lie between.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, utf8

#: A run has LEAST words and FOLD periods at least.
LEAST, FOLD = 24, 3
#: Longest period that LEAST words hold FOLD times, and the least common prefix of a run's start.
SHORT = LEAST // FOLD
FLOOR = min(LEAST - SHORT, (FOLD - 1) * SHORT)
#: Bytes of texts that are taken together.
PORTION = 2 << 20


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, one text after the other, and where each text ends."""
    names: dict[bytes, int] = {}
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    ids = np.fromiter((names.setdefault(w, len(names)) for t in texts for w in t), np.int64, int(ends[-1]) if len(ends) else 0)
    return ids, ends


def repeating(ids: np.ndarray, ends: np.ndarray, size: int = FLOOR) -> np.ndarray:
    """Which texts may hold one stretch of `size` words twice: hashes of all stretches are compared
    within a text, so none that holds one is missed."""
    found = np.zeros(len(ends), bool)
    if len(ids) < size:
        return found
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        h = h * np.uint64(0xD1342543DE82EF95) + x[k : k + len(h)]
    at = np.arange(len(h))
    text = np.searchsorted(ends, at, side="right")
    inside = at + size <= ends[text]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + text.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    h, text = h[inside], text[inside]
    order = np.argsort(h)
    again = (h[order[1:]] == h[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    found[text[order[1:][again]]] = True
    return found


def suffixes(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffixes in order, and for 1, 2, 4, ... words the rank of each position by so many.

    A suffix stops at the end of its text, and a rank never equals one of another text.  Only
    groups that are not told apart yet are sorted again.
    """
    n = len(ids)
    text = np.searchsorted(ends, np.arange(n), side="right")
    order = np.lexsort([ids, text])
    key = text[order] * (ids.max(initial=0) + 1) + ids[order]
    rank = np.empty(n, np.int32)
    rank[order] = _starts(key)
    levels, k = [(1, rank.copy())], 1
    while True:
        at = _shared(rank)
        if not len(at):
            return np.argsort(rank, kind="stable"), levels
        after = at + k
        inside = after < ends[text[at]]
        second = np.where(inside, rank[np.minimum(after, n - 1)], -1)
        order = np.lexsort([second, rank[at]])
        first, second = rank[at][order], second[order]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        head = np.r_[True, first[1:] != first[:-1]]
        place = np.arange(len(at))
        # a rank is the number of smaller suffixes: the group's, and those before it in the group
        within = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
        rank[at[order]] = first + within
        k *= 2
        levels.append((k, rank.copy()))


def _starts(key: np.ndarray) -> np.ndarray:
    """For sorted keys, the place of the first equal key."""
    place = np.arange(len(key))
    return np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], place, 0))[: len(key)]


def _shared(rank: np.ndarray) -> np.ndarray:
    """Positions whose rank another position has too."""
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Number of words that the suffixes at a and b share."""
    out, n = np.zeros(len(a), np.int64), len(levels[0][1])
    for k, rank in reversed(levels):
        x, y = a + out, b + out
        inside = (x < n) & (y < n)
        same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        out[same] += k
    return out


def seeds(a: np.ndarray, b: np.ndarray, prefix: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, second, common prefix) of positions that become neighbours in a class at a distance
    of at most their common prefix.  a and b are neighbouring suffixes."""
    order = np.argsort(-prefix, kind="stable")
    sets: dict[int, list[int]] = {}
    home: dict[int, int] = {}
    out = []

    def find(x: int) -> int:
        while (up := home.setdefault(x, x)) != x:
            home[x] = home[up]
            x = home[x]
        return x

    for x, y, shared in zip(a[order].tolist(), b[order].tolist(), prefix[order].tolist()):
        x, y = find(x), find(y)
        large, small = sets.setdefault(x, [x]), sets.setdefault(y, [y])
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        home[y] = x
        del sets[y]
        last = -1
        for p, following in zip(small, [*small[1:], inf]):  # ascending
            i = bisect_left(large, p)
            # neighbours in the united set: not over another position of the small one
            if i and large[i - 1] != last and p - large[i - 1] <= shared:
                out.append((large[i - 1], p, shared))
            if i < len(large) and large[i] < following and large[i] - p <= shared:
                out.append((p, large[i], shared))
            large.insert(i, p)
            last = p
    return out


def find(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, a list of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ids, ends = numbered(texts)
    chosen = np.flatnonzero(repeating(ids, ends))
    if not len(chosen):
        return out
    begins = np.r_[0, ends[:-1]]
    ids = np.concatenate([ids[begins[t] : ends[t]] for t in chosen])
    size = (ends - begins)[chosen]
    ends = np.cumsum(size)
    begins = ends - size
    order, levels = suffixes(ids, ends)
    # neighbouring suffixes that share a rank by the largest level within FLOOR words
    near = next(rank for k, rank in reversed(levels) if k <= FLOOR)
    pair = np.flatnonzero(near[order[:-1]] == near[order[1:]])
    a, b = order[pair], order[pair + 1]
    prefix = common_prefixes(a, b, levels)
    enough = prefix >= FLOOR
    text = np.searchsorted(ends, np.arange(len(ids)), side="right")
    for i, j, shared in seeds(a[enough], b[enough], prefix[enough]):
        period, t = j - i, text[i]
        begin = begins[t]
        if shared + period >= max(LEAST, FOLD * period) and (i == begin or ids[i - 1] != ids[j - 1]):
            out[chosen[t]].append((int(i - begin), int(shared + period), int(period)))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, exactly; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a text, of every tenth text with a periodic tail, by the checksum of its id."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _portions(ids: list, column: pa.Array, plant: bool):
    """Words of texts in portions of about PORTION bytes."""
    part, size = [], 0
    for key, value in zip(ids, column):
        raw = value.as_buffer().to_pybytes()
        words = raw.split()  # ASCII white space only
        part.append(planted(key, words) if plant else words)
        size += len(raw)
        if size >= PORTION:
            yield part
            part, size = [], 0
    if part:
        yield part


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", plant: bool = True) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every
    row: the strongest run, the digest of all, and of the words that are left after each run is
    cut down to its first period.

    Null and empty texts have no words.  With `plant` every tenth text gets a periodic tail first
    (a null id: none).  Null and repeated ids stay.  Empty table: no rows.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    if id_col.lower() in names:
        raise ValueError(f"rename the id column {id_col}: the result has a column of that name")
    schema = f"`{id_col}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches):
        for batch in batches:
            rows = []
            for texts in _portions(batch.columns[0].to_pylist(), batch.columns[1], plant):
                for words, runs in zip(texts, find(texts)):
                    best = strongest(runs)
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                    left = b" ".join(np.array(words, object)[kept(len(words), runs)].tolist() if runs else words)
                    rows.append((len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                                 hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
            made = [pa.array([r[k] for r in rows], types[k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.columns[0], *made], names=[id_col, *names])

    return docs.select(F.col(id_col), utf8(text).alias("llm_text")).mapInArrow(run, schema)


def runs(docs: DataFrame, text: str = "text", out: str = "runs") -> DataFrame:
    """docs with the runs of each text, an array of (start, length, period) by start, then period;
    a column named as `out` is replaced.  Null and empty texts: an empty array."""
    docs = docs.drop(out)
    [temp] = free(docs, "llm_text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = []
            for texts in _portions([None] * batch.num_rows, batch.columns[-1], False):
                found += [[dict(zip(("start", "length", "period"), r)) for r in f] for f in find(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*batch.schema.names[:-1], out])

    schema = docs.withColumn(out, F.expr("cast(array() as array<struct<start:long,length:long,period:long>>)")).schema
    return docs.withColumn(temp, utf8(text)).mapInArrow(run, schema)


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each text that holds runs cut down to the first period of each run, words joined
    by one space; texts without runs stay as they are, null stays null."""
    [temp] = free(docs, "llm_raw")
    columns, place = docs.columns, docs.columns.index(text)

    def run(batches):
        for batch in batches:
            done = []
            for texts in _portions([None] * batch.num_rows, batch.columns[-1], False):
                for words, found in zip(texts, find(texts)):
                    done.append(b" ".join(np.array(words, object)[kept(len(words), found)].tolist()).decode("utf-8", "replace") if found else None)
            old = batch.columns[place]
            new = pa.array([o if d is None else d for o, d in zip(old.to_pylist(), done)], old.type)
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(batch.columns[:-1])], names=columns)

    return docs.withColumn(temp, utf8(text)).mapInArrow(run, docs.schema)
