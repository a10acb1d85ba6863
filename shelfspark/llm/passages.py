"""Substring deduplication: paragraph MinHash banding.

A paragraph is a run of words, cut before words whose hash (with the next word's) is the least
among CUT words to either side, so that a passage that repeats inside other text is cut alike
wherever it stands and however its lines break (CUT + 1 words or more, 17 on average; a text's
ends have MIN or more, a text of SHINGLE words or more has one at least).  Each has a MinHash
signature over its five-word shingles in BANDS bands of ROWS rows; the band curve finds a pair
of similarity 0.8 with probability 0.98 and equal paragraphs always.  Paragraphs that collide
in a band are compared with the band's smallest and largest; where that leaves a band in
several components, its paragraphs meet on rare shingles, in large groups on more and more of them, so no
similar pair of a band is missed.  Exact Jaccard similarity of 0.8 or more is verified, and components of
the links are the classes.  All but the first place of a class are marked for removal.

Exact repeats of SPAN words or more are found to their true ends besides.  The least hash of
any ANCHORS consecutive grams of GRAM words is an anchor, so every span of SPAN = GRAM +
ANCHORS - 1 words holds one, the same in each copy.  Windows of SPAN words round anchors that
occur in two places are compared by their hashes, and the words before and after them tell
where a repeat starts and ends, so that only its ends leave the one shuffle of the windows.
Texts that are equal as a whole need no windows for that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import added, components, materialise, small, utf8

SHINGLE, SIMILAR = 5, 0.8
CUT, MIN, RUN = 8, 8, 20  # words: to either side of a cut (a power of two), least at a text's ends, least stretch
BANDS, ROWS = 4, 2
GRAM, ANCHORS = 20, 32  # words of an anchor's gram; consecutive grams of which the least is an anchor (a power of two)
SPAN = GRAM + ANCHORS - 1  # words: least exact repeat
BITS = 27  # log2 of the most bits of a broadcast filter of hashes; only costs depend on it
#: Paragraph hashes (8 bytes) that may be broadcast; more are joined.
BROADCAST_ROWS = 2_000_000
FEW = 32  # paragraphs that share a key up to which all pairs are compared; only costs depend on it
REMEMBER = 1_000_000  # hashes that a task knows again
PIECE = 1 << 20  # bytes of texts handled at once

_rng = np.random.default_rng(11)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_MOST = np.uint64(2**64 - 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values times powers of _BASE before each place, and the inverse powers."""
    n = len(values) + 1
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors, dtype=np.uint64)
    out = np.zeros(n, np.uint64)
    np.cumsum(values * _powers[0][: n - 1], dtype=np.uint64, out=out[1:])
    return out, _powers[1]


def _hashes(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of values[a:b] for each pair: a polynomial in 64 bits."""
    sums, inverse = _sums(values)
    return _mixed((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * _MIX)


def _grams(values: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k values."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    sums, inverse = _sums(values)
    return _mixed((sums[k:] - sums[:-k]) * inverse[: len(values) - k + 1])


def _least(values: np.ndarray, k: int, of=np.minimum) -> np.ndarray:
    """The least of every k (a power of two) consecutive values."""
    for step in (1 << i for i in range(k.bit_length() - 1)):
        values = of(values[:-step], values[step:])
    return values


class Paragraphs:
    """The paragraphs of one text, or of several that start at `offsets` with white space between
    them: word bounds (a, b), shingle hashes, paragraph hashes and anchors."""

    def __init__(self, text: bytes, offsets=(0,)):
        codes = np.frombuffer(text.lower(), np.uint8)
        gap = np.concatenate([[True], _SPACE[codes], [True]])
        self.starts = np.flatnonzero(gap[:-1] & ~gap[1:])
        self.ends = np.flatnonzero(~gap[:-1] & gap[1:])
        self.n = n = len(self.starts)
        self.first = np.searchsorted(self.starts, offsets)
        self.last = np.append(self.first[1:], n)
        texts = len(self.first)
        self.owner = np.repeat(np.arange(texts), self.last - self.first)
        self.hashed = self._words(codes)
        # positions with SPAN empty ones behind each text, so that no run of words crosses texts
        at = np.arange(n)
        self.pos = at + self.owner * SPAN
        self.since, self.left = at - self.first[self.owner], self.last[self.owner] - at
        self.spaced, self.room = np.zeros(n + texts * SPAN + CUT, np.uint64), np.zeros(n + texts * SPAN + CUT, np.int64)
        self.spaced[self.pos], self.room[self.pos] = self.hashed, self.left
        self.a = np.flatnonzero(self._cuts() | ((self.since == 0) & (self.left >= SHINGLE)))
        self.b = np.minimum(np.append(self.a[1:], n), self.last[self.owner[self.a]]) if len(self.a) else self.a
        self.shingles = self.hashed[: max(0, n - SHINGLE + 1)].copy()
        for k in range(1, SHINGLE):
            self.shingles = _mixed(self.shingles * np.uint64(3) + self.hashed[k : k + len(self.shingles)])

    def _words(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, np.uint64)
        i = 0
        while i < self.n:
            low = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, low + PIECE, "right")))
            out[i:j] = _hashes(_BYTE[codes[low : self.ends[j - 1]]], self.starts[i:j] - low, self.ends[i:j] - low)
            i = j
        return out

    def _cuts(self) -> np.ndarray:
        """Whether a paragraph starts at a word inside a text."""
        if not self.n:
            return np.zeros(0, bool)
        pairs = np.full(len(self.spaced), _MOST)
        pairs[self.pos] = _mixed(self.spaced[self.pos] * np.uint64(3) + self.spaced[self.pos + 1])
        least = _least(pairs, CUT)
        mine = pairs[self.pos]
        return (mine < least[np.maximum(self.pos - CUT, 0)]) & (mine <= least[self.pos + 1]) & (self.since >= MIN) & (self.left >= MIN)

    def __len__(self) -> int:
        return len(self.a)

    def leasts(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the grams, and the least of each window of SPAN words (0 where none starts)."""
        grams = _grams(self.spaced, GRAM)
        least = _least(grams, ANCHORS)
        return grams, np.where(self.room[: len(least)] >= SPAN, least, np.uint64(0))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions (among the spaced words) and hashes of the anchors."""
        if not self.n or self.left.max() < SPAN:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams, least = self.leasts()
        edge = np.zeros(ANCHORS - 1, np.uint64)
        # a gram is an anchor if it is the least of some window
        most = _least(np.concatenate([edge, least, edge]), ANCHORS, np.maximum)
        at = np.flatnonzero((most == grams) & (self.room[: len(grams)] >= GRAM))
        return at, grams[at]

    def hashes(self) -> list[int]:
        return self.digests().tolist()

    def digests(self) -> np.ndarray:
        """Text hashes of the paragraphs."""
        return _hashes(self.hashed, self.a, self.b)

    def keys(self) -> np.ndarray:
        """Band keys, one row a paragraph."""
        edges = np.stack([self.a, self.b - SHINGLE + 1], 1).ravel()
        if edges[-1] == len(self.shingles):
            edges = edges[:-1]
        least = [np.minimum.reduceat(_mixed(self.shingles * m + add), edges)[::2] for m, add in zip(_A, _B)]
        out = []
        for band in range(BANDS):
            key = np.full(len(self.a), np.uint64(band + 1))
            for row in least[band * ROWS : (band + 1) * ROWS]:
                key = _mixed(key * np.uint64(5) + row)
            out.append(key)
        return np.stack(out, 1)


def _pieces(batch, column: str = "text"):
    """(rows, texts joined by line breaks, their offsets, code points before each byte) of about
    PIECE bytes."""
    rows, parts, size = [], [], 0
    values = batch.column(column)

    def done():
        offsets = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        joined = b"\n".join(parts)
        points = np.zeros(len(joined) + 1, np.int32)
        np.cumsum(np.frombuffer(joined, np.uint8) & 0xC0 != 0x80, dtype=np.int32, out=points[1:])
        return np.array(rows), joined, offsets, points

    for row in range(batch.num_rows):
        raw = values[row].as_buffer().to_pybytes()
        if parts and size + len(raw) > PIECE:
            yield done()
            rows, parts, size = [], [], 0
        rows.append(row)
        parts.append(raw)
        size += len(raw) + 1
    if parts:
        yield done()


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of the given sizes, one after the other; null for size 0."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)), mask=pa.array(sizes == 0))


def _source(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(utf8(text)).alias("th"), utf8(text).alias("text"))


def paragraphs(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, th, number, start, end, words, h, keys, anchors): every paragraph of every text; start and
    end in code points, end exclusive; th is a hash of the text; h is the paragraph's text hash; keys
    are its bands' keys, null where the task has met the same h before (so a paragraph that many
    documents share is not shuffled for each); a text's first paragraph has the hashes of its anchors.

    Null texts and texts under SHINGLE words have none; null and repeated ids stay."""
    schema = added(docs.select(F.col(id_col).alias("id")), "th long, number int, start int, `end` int, words int, h long, keys array<long>, anchors array<long>")

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for rows, joined, offsets, points in _pieces(batch):
                p = Paragraphs(joined, offsets)
                if not len(p):
                    continue
                owner = p.owner[p.a]
                h = p.digests()
                fresh = np.zeros(len(p), bool)
                for i, x in enumerate(h.tolist()):
                    if x not in seen:
                        fresh[i] = True
                        if len(seen) < REMEMBER:
                            seen.add(x)
                at, grams = p.anchors()
                # spaced positions back to texts; a text with an anchor has a first paragraph
                held = np.bincount(p.owner[np.searchsorted(p.pos, at)], minlength=len(rows))
                opens = p.since[p.a] == 0
                base = points[offsets[owner]]
                take = pa.array(rows[owner])
                number = np.arange(len(p)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
                ints = (number, points[p.starts[p.a]] - base, points[p.ends[p.b - 1]] - base, p.b - p.a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("th").take(take), *(pa.array(x, pa.int32()) for x in ints), pa.array(h.view(np.int64)),
                     _lists(p.keys()[fresh].ravel(), fresh * BANDS), _lists(grams, np.where(opens, held[owner], 0))], names=schema.names)

    return _source(docs, id_col, text).mapInArrow(run, schema)


def _bits(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A bit array, and log2 of its size, in which the bit of every hash (h, distinct) is set."""
    bits = min(BITS, max(12, (64 * hashes.count()).bit_length()))
    # the low bits: anchors are least hashes, so their high bits are alike
    word = F.shiftrightunsigned(F.col("h").bitwiseAND((1 << bits) - 1), 6)
    words = hashes.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["set"].to_numpy()
    return out.view(np.uint64), bits


def _known(table: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter has."""
    slot = h & np.uint64((1 << bits) - 1)
    return table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) == 1


def _shingles(docs: DataFrame, text: str, need: DataFrame) -> DataFrame:
    """(h, shingles) of the paragraphs whose hash is in need (h, distinct)."""
    table, bits = _bits(need)
    table = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, joined, offsets, _ in _pieces(batch):
                p = Paragraphs(joined, offsets)
                if not len(p):
                    continue
                h = p.digests()
                hs, lists = [], []
                for i in np.flatnonzero(_known(table.value, bits, h)).tolist():
                    if (x := int(h[i])) not in seen:
                        if len(seen) < REMEMBER:
                            seen.add(x)
                        hs.append(i)
                        lists.append(np.unique(p.shingles[p.a[i] : p.b[i] - SHINGLE + 1]))
                if hs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[hs].view(np.int64)), _lists(np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists)))], names=["h", "shingles"])

    found = docs.select(utf8(text).alias("text")).mapInArrow(run, "h long, shingles array<long>")
    return found.join(need, "h", "left_semi").groupBy("h").agg(F.min("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b and more) of text hashes whose shingles are similar."""
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= SIMILAR * (F.size("x") + F.size("y") - common)).select(*pairs.columns)


def _keyed(ranked: DataFrame) -> DataFrame:
    """Rows (h, root, n, low, high, o, d, at, key) of ranked (h, root, n, x): for every size that a
    similar set may have, the pair's sizes, the o shingles that such a pair shares at least and
    the d of x that h may lack; a key for each of the first d + 1 of x, at its place."""
    sizes = F.sequence(F.ceil(SIMILAR * F.col("n") - 1e-9), F.floor(F.col("n") / SIMILAR + 1e-9))
    rows = ranked.select("*", F.explode(sizes).alias("m")).withColumn("o", F.ceil(SIMILAR / (1 + SIMILAR) * (F.col("n") + F.col("m")) - 1e-9).cast("int"))
    rows = rows.withColumn("d", F.size("x") - F.col("o")).filter("d >= 0")
    rows = rows.select("*", F.posexplode(F.slice("x", 1, F.col("d") + 1)).alias("at", "s"))
    rows = rows.withColumns({"low": F.least("n", "m"), "high": F.greatest("n", "m")})
    return rows.select("h", "root", "n", "low", "high", "o", "d", "at", F.xxhash64("s", "low", "high").alias("key"))


def _longer(rows: DataFrame, ranked: DataFrame, level: int) -> DataFrame:
    """The rows, whose keys stand for `level` shingles, with keys of twice as many, or of o where
    that is less: h has the first k shingles that a pair shares among its first d + k."""
    rows = rows.join(ranked.select("h", "x"), "h")
    for k in range(level, 2 * level):
        more = F.col("o") > k
        rows = rows.withColumn("to", F.explode(F.when(more, F.sequence(F.col("at") + 1, F.col("d") + k)).otherwise(F.array("at"))))
        rows = rows.withColumns({"key": F.when(more, F.xxhash64("key", F.get("x", F.col("to")))).otherwise(F.col("key")), "at": F.col("to")}).drop("to")
    return rows.drop("x")


def _mixed_groups(rows: DataFrame, level: int) -> DataFrame:
    """The rows whose key is one of several components and has both sizes of its pairs; with hub, the
    smallest member, and few: whether to compare all pairs costs no more than longer keys."""
    w = Window.partitionBy("key")
    # keys of k of the first d + k: those of twice as many over those of `level`
    longer = F.aggregate(F.sequence(F.lit(1), F.col("d") + 1), F.lit(1.0), lambda so_far, i: so_far * (2 * level + i - 1) / (level + i - 1)) / 2
    met = rows.withColumns({"members": F.count(F.lit(1)).over(w), "longer": F.sum(longer).over(w), "hub": F.min(F.struct("n", "h", "root")).over(w),
                            "most": F.max("n").over(w), "first": F.min("root").over(w), "last": F.max("root").over(w)})
    met = met.filter("first < last and hub.n = low and most = high")
    few = (F.col("members") <= FEW) | (F.col("members") * F.col("members") <= 2 * F.col("longer"))
    return met.select(*rows.columns, "hub", few.alias("few"))


def _all_pairs(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of a key's sizes between components, all pairs of each group compared."""
    left = groups.filter("n = low").select("key", F.col("h").alias("a"), F.col("root").alias("root_a"))
    right = groups.filter("n = high").select("key", F.col("h").alias("b"), F.col("root").alias("root_b"), (F.col("low") < F.col("high")).alias("unlike"))
    return left.join(right, "key").filter("root_a <> root_b and (unlike or a < b)").select("a", "b").distinct()


def _apart(banded: DataFrame, sets: DataFrame, edges: DataFrame) -> DataFrame:
    """More verified edges (a, b), which connect all similar texts of the bands that the edges
    leave in several components.

    Similar sets of n and m shingles share o = ceil(SIMILAR / (1 + SIMILAR) (n + m)), so one of the rarest n - o + 1
    of each; shingles that one set alone has count to n only.  Where texts of several components
    meet on one, all are compared with the smallest; then in groups of FEW at most all pairs are,
    and larger ones meet again on twice as many shingles, unless that makes more rows than all
    pairs.  What shares o is similar to the smallest, so what a text costs is bounded by its
    number of shingles, whatever the size of its group.
    """
    named = banded.join(components(edges).select(F.col("node").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    split = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    open_ = named.join(split, "key").select("h", "root").distinct()
    rows = materialise(open_.join(sets, "h").select("h", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s")))
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    x = F.array_sort(F.collect_list(F.struct("often", "s")))["s"]
    ranked = materialise(rows.join(often, "s").groupBy("h").agg(F.first("root").alias("root"), F.first("n").alias("n"), x.alias("x")))
    level, met = 1, materialise(_mixed_groups(_keyed(ranked), 1))
    found = edges.limit(0)
    while not met.isEmpty():
        to_hub = met.filter("root <> hub.root").select(F.col("hub.h").alias("a"), F.col("h").alias("b"), F.col("hub.root").alias("root_a"), F.col("root").alias("root_b"))
        near = materialise(_verified(to_hub.distinct(), sets))
        renamed = components(near.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("least"))
        met = met.drop("hub", "few").join(renamed, "root", "left").withColumn("root", F.coalesce("least", "root")).drop("least")
        met = materialise(_mixed_groups(met, level))
        found = found.union(near.select("a", "b")).union(materialise(_verified(_all_pairs(met.filter("few")), sets)))
        met = met.filter(~F.col("few") & (F.col("o") > level)).drop("hub", "few")
        level *= 2
        met = materialise(_mixed_groups(_longer(met, ranked, level // 2), level))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _banded(table: DataFrame) -> DataFrame:
    """(key, h, low, high): members of bands that have two rows or more, low and high being the
    band's least and greatest member."""
    w = Window.partitionBy("key")
    rows = table.select("h", F.explode("keys").alias("key"))
    rows = rows.select("key", "h", F.min("h").over(w).alias("low"), F.max("h").over(w).alias("high"), F.count(F.lit(1)).over(w).alias("n"))
    return materialise(rows.filter("n > 1").drop("n").distinct())


def links(docs: DataFrame, table: DataFrame, text: str = "text", banded: DataFrame | None = None) -> DataFrame:
    """Verified edges (a, b) between text hashes of paragraphs (table as of `paragraphs`), which
    connect every similar pair that collides in a band."""
    banded = (_banded(table) if banded is None else banded).filter("low <> high")
    pairs = banded.select("h", F.explode(F.array("low", "high")).alias("hub")).filter("h <> hub")
    pairs = pairs.select(F.least("h", "hub").alias("a"), F.greatest("h", "hub").alias("b")).distinct()
    need = materialise(banded.select("h").distinct())
    sets = materialise(_shingles(docs, text, need))
    edges = materialise(_verified(pairs, sets))
    return edges.union(_apart(banded.select("key", "h"), sets, edges))


def _release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of steps that are over: it does when the driver collects garbage."""
    df.sparkSession.sparkContext._jvm.System.gc()


def _windows(docs: DataFrame, id_col: str, text: str, table: DataFrame) -> DataFrame:
    """(id, th, s, w, words, a, b, near): windows of SPAN words whose anchor (least gram) occurs in
    two places (equal texts are one; the filter lets some others through): first word, hash, start
    and end in code points.  Two numbers of 32 bits are packed in words, the hashes of the words
    before and after (0 at a text's ends), and in near the lengths of the first word with its gap
    and of the last; `gap` is the length of the gap before the last word."""
    anchors = table.select("th", F.posexplode("anchors").alias("i", "h"))
    mark = F.xxhash64("th", "i")
    twice = materialise(anchors.groupBy("h").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low <> high").select("h"))
    known, bits = _bits(twice)
    known = docs.sparkSession.sparkContext.broadcast(known)
    schema = added(docs.select(F.col(id_col).alias("id")), "th long, s int, w long, words long, a int, b int, near long, gap int")

    def packed(high: np.ndarray, low: np.ndarray) -> pa.Array:
        return pa.array(high.astype(np.int64) << 32 | low.astype(np.int64))

    def run(batches):
        for batch in batches:
            for rows, joined, offsets, points in _pieces(batch):
                p = Paragraphs(joined, offsets)
                if not p.n or p.left.max() < SPAN:
                    continue
                _, least = p.leasts()
                s = np.flatnonzero(least)
                s = s[_known(known.value, bits, least[s])]
                if not len(s):
                    continue
                k = np.searchsorted(p.pos, s)
                owner, last = p.owner[k], k + SPAN - 1
                words = (p.spaced >> np.uint64(33)).astype(np.int64) | 1  # 31 bits; 0 stands for no word
                words[p.room == 0] = 0
                before = np.where(p.since[k] > 0, words[s - 1], 0)
                a, d, e, c, b = (points[x] for x in (p.starts[k], p.starts[k + 1], p.ends[last - 1], p.starts[last], p.ends[last]))
                base = points[offsets[owner]]
                take = pa.array(rows[owner])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("th").take(take), pa.array(p.since[k], pa.int32()), pa.array(_grams(p.spaced, SPAN)[s].view(np.int64)),
                     packed(before, words[s + SPAN]), pa.array(a - base, pa.int32()), pa.array(b - base, pa.int32()), packed(d - a, b - c), pa.array(c - e, pa.int32())], names=schema.names)

    return _source(docs, id_col, text).mapInArrow(run, schema)


def _place(*more: str) -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "th", "s", *more)


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _ends(windows: DataFrame) -> DataFrame:
    """The windows where a repeat may start or end: with first, the window's first place; opens,
    whether what it and its first place repeat together starts here; closes, whether it ends
    here; and goes_on, the first place with which the next window is a repeat all the same.

    A window's neighbour repeats with the same partner if the word between is equal.  A first
    place itself opens (closes) if no other place has its word before (after).
    """
    w = Window.partitionBy("w")
    low = (1 << 32) - 1
    # dealt before anything is derived, so that only what `windows` has is shuffled
    rows = windows.repartition("w").withColumns({"mark": F.xxhash64("id", "th", "s"), "before": F.shiftright("words", 32), "after": F.col("words").bitwiseAND(low),
                                "d": (F.col("a") + F.shiftright("near", 32)).cast("int"), "c": (F.col("b") - F.col("near").bitwiseAND(low)).cast("int")})
    rows = rows.withColumn("e", F.col("c") - F.col("gap")).drop("words", "near", "gap")
    rows = rows.withColumn("first", F.min(_place("before", "after", "a", "b", "mark")).over(w))
    other = F.col("mark") != F.col("first.mark")

    def shared(word: str) -> Column:
        return (F.col(word) == F.col(f"first.{word}")) & (F.col(word) != 0)

    rows = rows.select("*", *(F.max(shared(x) & other).over(w).alias(f"any_{x}") for x in ("before", "after")), F.max(other).over(w).alias("repeats")).filter("repeats")
    own = F.col("mark") == F.col("first.mark")
    rows = rows.withColumn("own", own).withColumn("opens", F.when(own, ~F.col("any_before")).otherwise(~shared("before")))
    rows = rows.withColumn("closes", F.when(own, ~F.col("any_after")).otherwise(~shared("after"))).filter("opens or closes")
    # those with another word after than their first place: the least of all with that word
    v = Window.partitionBy("w", "after")
    astray = F.col("closes") & ~F.col("own") & (F.col("after") != 0)
    places = F.when(astray, _place("d", "mark"))
    rows = rows.withColumn("next", F.min(places).over(v)).withColumn("more", F.min(F.when(astray, F.col("mark"))).over(v) != F.max(F.when(astray, F.col("mark"))).over(v))
    return rows.select("id", "th", "s", "a", "d", "e", "c", "b", "own", "opens", "closes", "first", F.when(astray & F.col("more"), F.col("next")).alias("goes_on"))


def exact(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, start, end, words, class_id, class_start, removed): exact repeats of SPAN words or
    more to their true ends; table as of `paragraphs`.

    A row is a longest run of windows whose first places lie in one document.  A run that
    overlaps its own first place is taken from the last word of its first window on.  Texts
    that are equal as a whole have one row each for that.
    """
    doc = Window.partitionBy("id", "th").orderBy("s")
    rows = _ends(_windows(docs, id_col, text, table))
    again = F.lag("s").over(doc)  # rows that repeat id and text
    rows = rows.withColumn("again", F.coalesce(again == F.col("s"), F.lit(False))).filter("not again")
    rows = rows.withColumn("then", F.lead(F.struct("s", "opens", "e", "b")).over(doc))
    # a piece that a row opens ends there if the row closes it, else before the next row that opens or with the next that closes
    until = F.when(F.col("then.opens"), F.struct((F.col("then.s") - 1).alias("s"), F.col("then.e").alias("b"))).otherwise(F.struct(F.col("then.s").alias("s"), F.col("then.b").alias("b")))
    here = F.struct("s", "b")
    first = F.struct(F.col("first.id").alias("id"), F.col("first.th").alias("th"), F.col("first.s").alias("s"), F.col("first.a").alias("a"), F.col("first.b").alias("b"))
    start = F.when(F.col("opens"), F.struct("s", "a", "c", first.alias("of"), F.when(F.col("closes"), here).otherwise(until).alias("until")))
    # after a row that closes, another partner may go on
    on = F.struct(F.col("goes_on.id").alias("id"), F.col("goes_on.th").alias("th"), (F.col("goes_on.s") + 1).alias("s"), F.col("goes_on.d").alias("a"), F.lit(None).cast("int").alias("b"))
    later = F.when(F.col("goes_on").isNotNull(), F.struct((F.col("s") + 1).alias("s"), F.col("d").alias("a"), F.lit(None).cast("int").alias("c"), on.alias("of"), until.alias("until")))
    pieces = rows.select("id", "th", F.explode(F.array(start, later)).alias("p")).filter("p is not null and p.until.s >= p.s")
    pieces = pieces.withColumn("s", F.col("p.s")).withColumn("me", F.struct("id", "th"))
    same = _same("me", "p.of")
    pieces = pieces.withColumn("own", same & (F.col("p.of.s") == F.col("s")))
    # neighbours whose first places lie in one document are one run
    last = F.lag(F.struct(F.col("own").alias("own"), F.col("p.of.id").alias("id"), F.col("p.of.th").alias("th"), F.col("p.until.s").alias("s"))).over(doc)
    pieces = pieces.withColumn("last", last)
    joins = (F.col("last.s") == F.col("s") - 1) & (F.col("last.own") == F.col("own")) & _same("last", "p.of")
    pieces = pieces.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(doc))
    runs = pieces.groupBy("id", "th", "run").agg(F.min(F.struct("s", "p", "own")).alias("head"), F.max("p.until").alias("until"), F.first("me").alias("me"))
    lapped = _same("me", "head.p.of") & ~F.col("head.own") & F.col("head.p.c").isNotNull() & (F.col("head.p.of.b") > F.col("head.p.a"))
    found = runs.select("id", "th", F.when(lapped, F.col("head.p.c")).otherwise(F.col("head.p.a")).alias("start"), F.col("until.b").alias("end"),
                        (F.col("until.s") - F.col("head.s") + F.when(lapped, 1).otherwise(SPAN)).alias("words"), F.col("head.p.of.id").alias("class_id"),
                        F.col("head.p.of.a").alias("class_start"), (~F.col("head.own")).alias("removed"))
    return found.unionByName(_wholes(table))


def _wholes(table: DataFrame) -> DataFrame:
    """The rows of `exact` for texts of SPAN words or more that are equal as a whole."""
    place = F.struct(F.col("id").isNull().alias("none"), "id")
    copied = table.filter("number = 0").groupBy("th").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("th", "first")
    rows = table.select("id", "th", "start", "end", "words").join(small(materialise(copied), BROADCAST_ROWS), "th").distinct()
    texts = rows.groupBy("id", "th").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").cast("int").alias("words"), F.min("first.id").alias("class_id"))
    return texts.filter(F.col("words") >= SPAN).select(
        "id", "th", "start", "end", "words", "class_id", F.col("start").alias("class_start"), (~F.col("id").eqNullSafe(F.col("class_id"))).alias("removed"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """(id, th, start, end, words, run_words, class_id, class_start, removed): every paragraph of a
    repeated stretch, and every exact repeat of SPAN words or more (`exact`; its run_words are
    its words).  Rows of the two kinds overlap; what is removed is the union.

    A class is the paragraphs that links connect, equal texts among them; it counts when it
    has two places or more.  class_id and class_start are its first place (smallest id, null
    last, then th and start), and removed is false for that place alone.  Paragraphs next to
    one another in a document, or with one other between them, form a stretch; those of
    stretches of under `run` words are left out (run=1: none are).  Null texts and texts under
    SHINGLE words have no paragraphs; rows that repeat id and text are one document; an empty
    table gives no rows.
    """
    table = materialise(paragraphs(docs, id_col, text))
    banded = _banded(table)
    roots = components(links(docs, table, text, banded))
    # what occurs once and collides with nothing is no repeat
    some = materialise(banded.select("h").union(table.filter("keys is null").select("h")).distinct())
    rows = materialise(table.select("id", "th", "number", "start", "end", "words", "h").join(small(some, BROADCAST_ROWS), "h", "left_semi"))
    named = roots.select(F.col("node").alias("h"), "root")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th", "start")
    by_text = rows.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).join(named, "h", "left").withColumn("root", F.coalesce("root", "h"))
    by_text = materialise(by_text)
    heads = by_text.groupBy("root").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first <> last")
    repeated = by_text.select("h", "root").join(heads.select("root", "first"), "root").select("h", "first")
    found = rows.distinct().join(repeated, "h")
    w = Window.partitionBy("id", "th").orderBy("number")
    # a stretch goes on over one paragraph that is no repeat, as an edit leaves
    fresh = F.coalesce(F.col("number") - F.lag("number").over(w) > 2, F.lit(True)).cast("int")
    found = found.withColumn("fresh", fresh).withColumn("stretch", F.sum("fresh").over(w))
    found = found.withColumn("run_words", F.sum("words").over(Window.partitionBy("id", "th", "stretch"))).filter(F.col("run_words") >= run)
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("start") == F.col("first.start"))
    near = materialise(found.select("id", "th", "start", "end", "words", "run_words", F.col("first.id").alias("class_id"), F.col("first.start").alias("class_start"), (~own).alias("removed")))
    _release(docs)
    whole = materialise(exact(docs, table, id_col, text)).withColumn("run_words", F.col("words"))
    return near.unionByName(whole).withColumnRenamed("id", id_col)
