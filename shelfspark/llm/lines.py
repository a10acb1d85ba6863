"""Line deduplication by a segment-partition edit join.

Two lines are near-duplicates when they are equal, or when their edit distance is at most TAU
and at most a tenth of the longer one's characters (so the shorter one has LEAST - 1 or
more).  Lines of only white space are never duplicates.  A line split into TAU + 1 segments keeps at least one of them unchanged
under TAU edits, so:

1. Every distinct line gets, from its first place, a key for each substring that can be an
   unchanged segment: for every length it can match, the positions that the
   multi-match-aware bound allows (12 keys for TAU = 2, its own segments among them).  A key
   is a hash of the segment's number, the matched line's length and the characters.
2. One shuffle on the key leaves the members of keys that two or more lines share; only
   their texts are read again.
3. Members meet on the key under conditions that every pair within TAU edits satisfies: the
   lengths differ by at most TAU, and as an edit changes the parity of at most two letter
   counts, at most 2 TAU parities differ.  Pairs are taken once, sieved by Spark's own
   thresholded distance and verified by a banded bit-parallel automaton: one bit for each
   diagonal of the band and one word for each number of errors.
4. Components of the links are the classes; the first line (smallest document id, then line
   number) of a class stays.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, free, identity, materialise, small

TAU = 2
LEAST = 10  # characters for each allowed edit
BLANK = " \t\r\x0b\x0c"
#: Line hashes (a few dozen bytes each) that may be broadcast; more are joined.
BROADCAST_ROWS = 1_000_000


def _segment(n: Column, i: int, tau: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of a line of n characters."""
    base, longer = F.floor(n / (tau + 1)), n % (tau + 1)
    first = tau + 1 - longer  # the last `longer` segments have one character more
    start = i * base + F.greatest(F.lit(i) - first, F.lit(0)) + 1
    return start.cast("int"), (base + F.when(F.lit(i) >= first, 1).otherwise(0)).cast("int")


def _parities(line: str) -> Column:
    """One bit for each Latin letter: whether the line has an odd number of it."""
    n, out = F.length(line), F.lit(0)
    for i, letter in enumerate("abcdefghijklmnopqrstuvwxyz"):
        odd = (n - F.length(F.replace(F.col(line), F.lit(letter), F.lit("")))) % 2
        out = out.bitwiseOR(F.shiftleft(odd, i))
    return out


def _keyed(rows: DataFrame, tau: int) -> DataFrame:
    """(lid, key): all keys of each line (lid, line, n).

    The substrings that can be an unchanged segment i are those of a line that is `less`
    characters shorter, at `move` characters from where that line has it.  They are listed
    once and the line is cut for one after the other: one array of all keys would be too
    large a piece of generated code for the JVM to compile.
    """
    listed = [f"named_struct('i', {i}, 'less', {less}, 'move', {move})" for i in range(tau + 1) for less in range(tau + 1)
              for move in range(max(-i, less - (tau - i)), min(i, less + (tau - i)) + 1)]
    probes = rows.select("lid", "line", "n", F.inline(F.expr(f"array({', '.join(listed)})"))).withColumn("m", F.col("n") - F.col("less"))
    base, first = F.expr(f"cast(m div {tau + 1} AS int)"), tau + 1 - F.col("m") % (tau + 1)  # the last segments have one character more
    start = F.col("i") * base + F.greatest(F.col("i") - first, F.lit(0)) + 1 + F.col("move")
    size = base + (F.col("i") >= first).cast("int")
    return probes.select("lid", F.xxhash64("i", "m", F.col("line").substr(start, size)).alias("key"))


def edit_distance(a: str, b: str, tau: int = TAU) -> Column:
    """The edit distance of two string columns if it is at most tau, else null: a banded
    bit-parallel automaton over the 2 tau + 1 diagonals."""
    band = (1 << (2 * tau + 1)) - 1
    names = [f"r{e}" for e in range(tau + 1)]
    start = F.struct(*[F.lit((((1 << (e + 1)) - 1) << tau) & band).alias(names[e]) for e in range(tau + 1)])

    def matches(chars: Column) -> Column:
        """Of each character of b: which diagonals have the same character in a."""
        def one(c: Column, j: Column) -> Column:
            bits = [F.when(F.get(chars, j + (d - tau)) == c, 1 << d).otherwise(0) for d in range(2 * tau + 1)]
            return reduce(Column.__add__, bits)

        return F.transform(F.filter(F.split(b, ""), lambda c: c != ""), one)

    def step(state: Column, match: Column) -> Column:
        new = [state[names[0]].bitwiseAND(match)]
        for e in range(1, tau + 1):
            old = state[names[e - 1]]
            r = state[names[e]].bitwiseAND(match).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[e - 1], 1))
            new.append(r.bitwiseAND(band))
        return F.struct(*[r.alias(n) for n, r in zip(names, new)])

    def end(state: Column) -> Column:
        at = F.length(a) - F.length(b) + tau
        hits = [F.when(F.getbit(state[names[e]], at) == 1, e) for e in range(tau + 1)]
        return F.when(at.between(0, 2 * tau), F.coalesce(*hits))

    # a one-element array binds the characters of a, so that they are split once
    return F.get(F.transform(F.array(F.split(a, "")), lambda chars: F.aggregate(matches(chars), start, step, end)), F.lit(0))


def members(rows: DataFrame, tau: int = TAU) -> DataFrame:
    """(key, lid) of keys that two or more lines share; rows: (lid, line, n), each line once."""
    keyed = _keyed(rows, tau)
    w = Window.partitionBy("key")
    shared = keyed.withColumn("low", F.min("lid").over(w)).withColumn("high", F.max("lid").over(w)).filter("low <> high")
    return shared.select("key", "lid").distinct()


def links(found: DataFrame, texts: DataFrame, tau: int = TAU) -> DataFrame:
    """Verified pairs (a, b) of lines; found: (key, lid); texts: (lid, node, line), node naming the line."""
    texts = materialise(texts.select("lid", "node", "line", F.length("line").alias("n"), _parities("line").alias("odd")))
    rows = found.join(texts.drop("line"), "lid").select("key", "node", "n", "odd")
    # the shorter line of a pair (of equal ones the smaller node) meets the other on its own segments
    own = F.array(*[F.xxhash64(F.lit(i), "n", F.col("line").substr(*_segment(F.col("n"), i, tau))) for i in range(tau + 1)])
    left = texts.select(F.explode(own).alias("ka"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
    longer = (F.col("n") > F.col("na")) | ((F.col("n") == F.col("na")) & (F.col("a") < F.col("node")))
    meet = (F.col("ka") == F.col("key")) & longer & (F.col("n") - F.col("na") <= tau)
    near = F.bit_count(F.col("oa").bitwiseXOR(F.col("odd"))) <= 2 * tau
    pairs = left.join(rows, meet & near).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("x")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
    # Spark's compiled thresholded distance sieves the false pairs; the automaton, which runs
    # interpreted, verifies what is left
    close = both.filter(F.levenshtein("x", "y", tau) >= 0).withColumn("d", edit_distance("x", "y", tau))
    return close.filter(LEAST * F.col("d") <= F.greatest(F.length("x"), F.length("y"))).select("a", "b")


def _lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    # th is made before the lines are, once a text; in one select Spark would make it for each line
    rows = docs.select(F.col(id_col).alias("id"), identity(text).alias("th"), F.col(text).alias("text"))
    rows = rows.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.filter(F.length(F.btrim("line", F.lit(BLANK))) > 0)


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tau: int = TAU, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, th, line_no, class_id, class_line_no, removed) of every line whose class has two or
    more places: the class is named by its first place, all others are removed.

    th is a hash of the text: rows that repeat an id with another text are told apart, rows
    that repeat id and text are one document.  First means smallest id (null last), then th,
    then line number.  Null texts have no lines.
    """
    lines = _lines(docs, id_col, text)
    digest, lid = F.unhex(F.md5(F.col("line").cast("binary"))), F.xxhash64("line")
    # texts are split once; what needs only keys does not read the lines' column
    places = materialise(lines.select("id", "th", "line_no", "line", digest.alias("digest"), lid.alias("lid"), F.length("line").alias("n")))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th", "line_no")
    by_line = materialise(places.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("lid").alias("lid"), F.min("n").alias("n")))
    # each distinct line once, from its first place: lines of one place need no look-up
    again = materialise(by_line.filter((F.col("first") != F.col("last")) & (F.col("n") >= LEAST - 1)).select(
        F.col("digest").alias("again"), F.col("first.id").alias("fi"), F.col("first.th").alias("ft"), F.col("first.line_no").alias("fl")))
    long = places.filter(F.col("n") >= LEAST - 1)
    once = long.join(small(again, broadcast_rows), F.col("digest") == F.col("again"), "left").filter(
        F.col("again").isNull() | (F.col("fi").eqNullSafe(F.col("id")) & (F.col("ft") == F.col("th")) & (F.col("fl") == F.col("line_no"))))
    found = materialise(members(once.select("lid", "line", "n"), tau))
    need = materialise(found.select(F.col("lid").alias("need")).distinct())
    texts = long.join(small(need, broadcast_rows), F.col("lid") == F.col("need"), "left_semi").select("lid", F.col("digest").alias("node"), "line").distinct()
    roots = components(links(found, texts, tau))
    placed = by_line.join(roots, by_line["digest"] == roots["node"], "left").select("digest", F.coalesce("root", "digest").alias("head"), "first", "last")
    heads = placed.groupBy("head").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter(F.col("first") != F.col("last")).select("head", "first")
    of_line = placed.select("digest", "head").join(heads, "head").select("digest", "first")
    joined = places.select("id", "th", "line_no", "digest").join(of_line, "digest").drop("digest").distinct()
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("line_no") == F.col("first.line_no"))
    return joined.select(F.col("id").alias(id_col), "th", "line_no", F.col("first.id").alias("class_id"), F.col("first.line_no").alias("class_line_no"), (~own).alias("removed"))


def clean(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tau: int = TAU) -> DataFrame:
    """docs with the removed lines taken out of their texts; every row and column stays.  A
    null text stays null; a text whose lines all repeat becomes empty."""
    wid, wth, gone_col, key = free(docs, "llm_id", "llm_th", "llm_gone", "llm_key")
    gone = classes(docs.select(id_col, text), id_col, text, tau).filter("removed").groupBy(F.col(id_col).alias(wid), F.col("th").alias(wth)).agg(
        F.collect_set("line_no").alias(gone_col))
    joined = docs.withColumn(key, identity(text)).join(gone, F.col(id_col).eqNullSafe(F.col(wid)) & (F.col(key) == F.col(wth)), "left")
    parts = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone_col))
    kept = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    new = F.when(F.col(gone_col).isNull(), F.col(text)).otherwise(kept)
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
