"""Vector codes, packing and periodic runs against brute force, and their odd inputs."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import bpe, packing, queries, runs, vectors
from tests.compare import connect, same

VECTORS = "vec_id long, embedding array<float>, label int, v string, to_pivots int, code string"
DOCS = "doc_id long, text string, start int, length string, llm_text string"


# ---- vector codes ----

def rows_of(given):
    return [(i, e, label, "x", 1, "y") for i, e, label in given]


def brute_codes(given, parts=8, entries=16, rounds=6):
    """Plain Lloyd rounds over every pair of part and entry, in Python integers."""
    rows = [(i, [math.floor(4096 * x) for x in e], label) for i, e, label in given if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not rows:
        return [], None
    width = max(1, -(-max(len(v) for _, v, _ in rows) // parts))
    rows = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in rows]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in rows]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            new.append([[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])])
        books = new
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(rows, errors):
        labels[label] = labels.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, labels[label], digest) for (i, _, label), f, e in zip(rows, found, errors)), key=str), books


def test_codes_equal_plain_rounds(spark):
    rng = random.Random(5)
    given = [(i, [rng.gauss(0, 0.2) for _ in range(24)], rng.choice([None, 1, 2])) for i in range(150)]
    given = [(i, [float(np.float32(x)) for x in e], label) for i, e, label in given]
    given += given[:20]  # repeated rows
    given += [(None, given[3][1], 1), (200, None, 1), (201, [], None), (202, [0.5, None] + [0.0] * 22, 1), (203, [math.nan] * 24, 1), (204, [math.inf] + [0.0] * 23, 1),
              (205, [0.25] * 24, 1), (206, [0.25] * 24, 2), (207, [1.0] * 5, 2), (208, [-100.0] * 24, 2)]
    df = spark.createDataFrame(rows_of(given), VECTORS).repartition(5)
    got = vectors.digests(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want, books = brute_codes(given)
    assert sorted(map(tuple, got.collect()), key=str) == want
    codes, found = vectors.compress(df)
    assert found.tolist() == books
    decoded = vectors.decode(codes, found).filter("id = 205").select("code", "vector").first()
    assert decoded.vector == [x / 4096 for p in range(8) for x in books[p][int(decoded.code[2 * p:2 * p + 2], 16)]]


@pytest.mark.parametrize("given", [[], [(1, None, 1)], [(1, [0.5] * 16, None)], [(i, [0.5] * 8, 1) for i in range(40)], [(1, [], 1), (2, [], 1)]])
def test_codes_of_few_and_equal_vectors(spark, given):
    got = vectors.digests(spark.createDataFrame(rows_of(given), VECTORS))
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(given)[0]


def test_pivots_prune_and_keep_the_nearest():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    parts = centres[rng.integers(0, 16, 3000)] + rng.integers(-60, 60, (3000, 8))
    fixed = vectors.pivots(centres[:, None])[0]
    near = np.sqrt(((parts[:, None] - fixed) ** 2).sum(-1))
    made = []
    index, d = vectors.nearest(parts, near, centres, np.sqrt(((fixed[:, None] - centres) ** 2).sum(-1)), made)
    every = ((parts[:, None] - centres) ** 2).sum(-1)
    assert (index == every.argmin(1)).all() and (d == every.min(1)).all()
    assert sum(made) < 0.4 * every.size


def test_codes_refuse_what_sums_cannot_hold(spark):
    with pytest.raises(Exception, match="scale the vectors"):
        vectors.digests(spark.createDataFrame(rows_of([(1, [1e30] * 8, 1)]), VECTORS)).collect()


def test_codes_against_sql(spark, sf_dir):
    same(queries.QUERIES["op11_vector_codes"](spark, sf_dir), queries.ORACLES["op11_vector_codes"], connect(sf_dir))


# ---- packing ----

def plain_best_fit(lengths, window):
    """One piece after the other into the tightest window: the room left in each window."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(window - n)
    return sorted(rooms)


def places(steps, counts):
    """Every piece's (sequence, offset, length) by the steps."""
    for length, count in counts.items():
        own = [s for s in steps.tolist() if s[0] == length]
        for k in range(count):
            _, first, each, sequence, offset = [s for s in own if s[1] <= k][-1]
            yield sequence + (k - first) // each, offset + (k - first) % each * length, length


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 2, 7, 16, 40, 100])
    lengths = [rng.randint(1, window) if rng.random() < 0.8 else rng.choice([1, window]) for _ in range(rng.randint(0, 250))]
    counts = {n: lengths.count(n) for n in lengths}
    filled = {}
    for sequence, offset, length in places(packing.plan(counts, window), counts):
        filled.setdefault(sequence, []).append((offset, length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    assert sorted(filled) == list(range(len(filled)))
    assert sorted(window - sum(n for _, n in p) for p in filled.values()) == plain_best_fit(lengths, window)


ODD = [None, "", "", "x", "two words", "two words", "<|endoftext|> inside <|endoftext|>", "long " * 3000, "x" * 200_000, "ünï 😀\n\n  "]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(bpe.default_path()), packing.encoder(bpe.default_path())
    rng = random.Random(3)
    pool = list(" \t\n\r\x0b\x0c\x1c\x85\xa0'sdtreve.,!?aZé漢😀१5") + ["<|endoftext|>", "  ", "\n\n", "'re", "ing", "tion"]
    for text in [t or "" for t in ODD[:-2]] + ODD[-1:] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(2000)]:
        assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_packing_whole(spark):
    rng = random.Random(9)
    texts = ODD + [" ".join(rng.choice("one two three four".split()) for _ in range(rng.choice([3, 3, 3, 40, 700]))) for _ in range(150)]
    rows = [(None if i == 3 else i // 2 if i in (8, 9) else i, t, 1, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    got = [tuple(r) for r in packing.pack(df).collect()]
    coder, want = packing.encoder(bpe.default_path()), {}
    for i, text, *_ in rows:
        ids = coder.encode(text or "").tolist() + [0]
        for start in range(0, len(ids), 1024):
            part = np.array(ids[start:start + 1024], "<u4")
            key = (i, start, len(part), zlib.crc32(part.tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
    seen, filled = {}, {}
    for *key, sequence, offset in got:
        seen[tuple(key)] = seen.get(tuple(key), 0) + 1
        filled.setdefault(sequence, []).append((offset, key[2]))
    assert seen == want
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(1024 - sum(n for _, n in p) for p in filled.values()) == plain_best_fit([k[2] for k, n in want.items() for _ in range(n)], 1024)


def test_packed_sequences_hold_the_tokens(spark):
    texts = ["first text", "second text " * 400, None, "third"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coder = packing.encoder(bpe.default_path())
    got = packing.sequences(df, window=64).collect()
    assert all(len(r.ids) == 4 * r.n_tokens and r.n_tokens <= 64 for r in got)
    want = sorted(x for t in texts for x in [*coder.encode(t or "").tolist(), 0])
    assert sorted(x for r in got for x in np.frombuffer(r.ids, "<u4").tolist()) == want


def test_packing_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack(empty).count() == 0 and packing.sequences(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty.withColumnRenamed("doc_id", "number").drop("start"), id_col="number")


# ---- runs ----

def brute_runs(w):
    out = []
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n, s = j - i + p, w[i:j + p]
            if j > i and n >= max(24, 3 * p) and not any(all(s[k] == s[k + q] for k in range(n - q)) for q in range(1, p)):
                out.append((i, n, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts(seed, n=6):
    rng = random.Random(seed)
    for _ in range(n):
        w = []
        while rng.random() < 0.8 and len(w) < 250:
            size = rng.randint(1, 12)
            base = [f"{rng.randint(0, rng.choice([1, 2, 30]))}" for _ in range(size)]
            w += [base[i % size] for i in range(rng.randint(1, 60))]
            if rng.random() < 0.3:
                w += w[-rng.randint(1, 40):] * rng.randint(1, 4)
        yield w


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    texts = [[x.encode() for x in w] for w in periodic_texts(seed)]
    assert runs.find(texts) == [brute_runs(w) for w in texts]


def test_runs_of_long_texts():
    n = 60_000
    for period in (1, 2, 777):
        assert runs.find([[b"%d" % (i % period) for i in range(n)]]) == [[(0, n, period)]]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 1500:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    word = fibonacci[-1][:1500]
    assert runs.find([[c.encode() for c in word]]) == [brute_runs(word)]


def test_run_digests(spark):
    texts = [" ".join(w) for seed in range(6) for w in periodic_texts(seed, 20)]
    rows = [(None if i == 5 else 7 if i in (8, 9) else i, t, 1, "x", "y") for i, t in enumerate([None, "", " \t\r\n\x0b\x0c", "a b\x1cc " * 30, *texts])]
    got = runs.digests(spark.createDataFrame(rows, DOCS).repartition(3))
    want = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        found = brute_runs(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(),
                     hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(x[1] > 1 for x in want)


def test_runs_and_collapse(spark):
    df = spark.createDataFrame([(1, "a b " * 20 + "end", 1, "x", "y"), (2, "plain  text\nhere", 1, "x", "y"), (3, None, 1, "x", "y")], DOCS)
    found = {r.doc_id: r.runs for r in runs.runs(df).collect()}
    assert [tuple(x) for x in found[1]] == [(0, 40, 2)] and found[2] == [] and found[3] == []
    short = runs.collapse(df)
    assert short.columns == df.columns
    assert {r.doc_id: r.text for r in short.collect()} == {1: "a b end", 2: "plain  text\nhere", 3: None}
    empty = df.limit(0)
    assert runs.digests(empty).count() == runs.runs(empty).count() == runs.collapse(empty).count() == 0
    assert runs.runs(df.withColumn("runs", F.lit(1))).columns == [*df.columns, "runs"]


# ---- mended cases ----

def test_lines_of_nine_and_ten_characters(spark):
    from shelfspark.llm import lines

    texts = ["Read more\nWith and.\nabcdefghi", "Read more.\nWith, and.\nabcdefghj\n12345678", "123456789"]
    got = {(r.doc_id, r.line_no): (r.class_id, r.class_line_no, r.removed) for r in lines.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {(0, 0): (0, 0, False), (1, 0): (0, 0, True), (0, 1): (0, 1, False), (1, 1): (0, 1, True)}


def test_trigrams_that_a_model_lacks(spark):
    from shelfspark.llm import rules

    given = spark.createDataFrame([(1, "abcabc abc", "en"), (2, "zzzz qqq", "en"), (3, "abc", "xx"), (4, "abc zq", "en"), (5, "", "en")], "doc_id long, text string, lang string")
    table = rules.model(rules.count_trigrams(given.filter("doc_id = 1"), "text", "lang"))
    near, far = ({r.doc_id: r.log_ppl for r in rules.score(given, table, broadcast_rows=n).collect()} for n in (10**6, 0))
    rarest = -min(r.logp for r in table.collect())
    assert near[3] is None and far[3] is None and near[5] is None and far[5] is None
    for i in (1, 2, 4):
        assert abs(near[i] - far[i]) < 1e-9
    assert abs(near[2] - rarest) < 1e-9 and near[1] < near[4] < near[2]
