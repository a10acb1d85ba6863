"""Operators on pairs and groups: SimHash, lines, passages, mixing, URLs and the pipeline."""

import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfspark.llm import common, lines, mixing, passages, queries, simhash, urls
from tests.compare import connect, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def roots_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    path = rng.sample(range(1_000, 9_000), 60)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + list(zip(path, path[1:])) + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots_of(edges, {x for e in edges for x in e})
    least = {}
    for n, r in want.items():
        least[r] = min(least.get(r, n), n)
    assert got == {n: least[r] for n, r in want.items()}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(seed=2):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.choice((1, 2, 5, 120, 400)))] for _ in range(25)]
    out = [None, "", " ", "É one TWO", "é one two"]
    for b in base:
        for _ in range(4):
            w = list(b)
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out


def test_simhash_against_all_pairs(spark):
    texts = near_texts()
    rows = [(None if i == 8 else i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(9, texts[9], "en", "s", 0)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    values = sorted({f for _, f in fps})
    root = roots_of([(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3], values)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component) for r in got) == sorted((str(i), f, least[root[f]]) for i, f in fps)


def test_ball_links_cover_every_distance(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        values.add(x)
        for d in (1, 2, 3, 4):
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            values.add(y)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    got = roots_of([(r.a, r.b) for r in edges], [v for v, in signed])
    want = roots_of([(a, b) for a, in signed for b, in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3], [v for v, in signed])
    assert len(set(got.values())) == len(set(want.values())) and Counter(Counter(got.values()).values()) == Counter(Counter(want.values()).values())


def test_keep_one(spark):
    rows = [(1, "same text here now", "en", "s", 1), (2, "same text here now", "en", "s", 1), (3, "other words are here", "en", "s", 1), (3, "other words are here", "en", "s", 1), (4, None, "en", "s", 1), (None, "", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 4]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_edit_distance_automaton(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(800):
        a = [rng.choice("abé ") for _ in range(rng.randint(0, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(("", "a", "é", " "))
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for tau in (0, 1, 2, 3):
        bad = df.filter(~F.when(F.levenshtein("a", "b") <= tau, F.levenshtein("a", "b")).eqNullSafe(lines.edit_distance("a", "b", tau)))
        assert bad.isEmpty()


def test_lines_against_all_pairs(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (3, 9, 10, 12, 25, 25, 60, 200)]

    def variant(x):
        x = list(x)
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(x))
            x[i : i + rng.randint(0, 1)] = rng.choice(("", "z", "é"))
        return "".join(x)

    texts = ["\n".join([variant(rng.choice(pool)) for _ in range(rng.randint(0, 5))] + [" ", ""]) for _ in range(40)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[3], "en", "s", 0), (4, texts[4], "en", "s", 0), (50, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.line_no): (r.class_id, r.class_line_no) for r in lines.classes(df).collect()}
    places = {(i, n): x for i, t, *_ in rows if t is not None for n, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")}
    texts_ = sorted(set(places.values()))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    pairs = [(a, b) for k, a in enumerate(texts_) for b in texts_[:k] if abs(len(a) - len(b)) <= 2 and (d := distance(a, b)) <= 2 and 10 * d <= max(len(a), len(b))]
    root = roots_of(pairs, texts_)
    classes = {}
    for p, x in places.items():
        classes.setdefault(root[x], []).append(p)
    order = lambda p: (p[0] is None, p[0] or 0, p[1])
    want = {p: min(c, key=order) for c in classes.values() if len(c) > 1 for p in c}
    assert got == want
    cleaned = lines.clean(df.withColumn("th", F.lit(1)))
    assert cleaned.count() == len(rows) and cleaned.filter("doc_id = 50 and text is null").count() == 1
    kept = [x for r in cleaned.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect() for x in (r.text or "").split("\n") if x.strip()]
    assert len(kept) == len(set(root[x] for x in kept))
    assert lines.classes(df.limit(0)).count() == 0


def test_passages_planted(spark):
    rng = random.Random(6)
    voc = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(4_000)]

    def some(k):
        return [rng.choice(voc) for _ in range(k)]

    rows, planted = [], set()
    edited = set()
    for g in range(60):
        shared = some(rng.randint(55, 90))
        for _ in range(3):
            mine = list(shared)
            if g >= 40:  # each copy with a word of its own
                mine[rng.randrange(len(mine))] = "edited"
                edited.add(len(rows))
            else:
                planted.add(len(rows))
            rows.append((len(rows), " ".join(some(rng.randint(10, 100)) + mine + some(rng.randint(10, 100))), "en", "s", 0))
    for _ in range(100):
        rows.append((len(rows), " ".join(some(rng.randint(50, 200))), "en", "s", 0))
    rows += [(None, None, "en", "s", 0), (9_000, "", "en", "s", 0), (rows[0][0], rows[0][1], "en", "s", 0)]
    got = passages.repeats(spark.createDataFrame(rows, DOCS).withColumn("h", F.lit(0))).collect()
    found = {r.doc_id for r in got}
    assert len(found & planted) >= 0.95 * len(planted) and not found - planted - edited
    assert len(found & edited) >= 0.75 * len(edited)
    text = dict((r[0], r[1]) for r in rows)
    assert all(text[r.doc_id][r.start : r.end].split() and len(text[r.doc_id][r.start : r.end].split()) == r.words for r in got)
    assert passages.repeats(spark.createDataFrame(rows, DOCS).limit(0)).count() == 0


def test_links_in_a_band_of_many_families(spark):
    """All similar pairs of one band that mixes families are connected, as by brute force."""
    rng = random.Random(9)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(4):
            mine = list(base)
            for at in rng.sample(range(60), rng.randint(0, 2)):
                mine[at] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(mine), "en", "s", 0))
    df = spark.createDataFrame(rows, DOCS)
    table = common.materialise(passages.paragraphs(df, "doc_id", "text").withColumn("keys", F.array(F.lit(1).cast("long"))))
    sets = {}
    for _, text, *_ in rows:
        p = passages.Paragraphs(text.encode())
        for h, a, b in zip(p.hashes(), p.a, p.b):
            sets[h - (1 << 64) if h >> 63 else h] = set(p.shingles[a : b - passages.SHINGLE + 1].tolist())
    nodes = sorted(sets)
    similar = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = passages.links(df, table).collect()
    assert len(similar) >= 10 and {(r.b, r.a) for r in got} <= set(similar)
    assert len(set(roots_of([(r.a, r.b) for r in got], nodes).values())) == len(set(roots_of(similar, nodes).values()))


@pytest.mark.parametrize("few", [2, 32])
def test_links_in_a_large_group_of_unlike_variants(spark, monkeypatch, few):
    """Variants of one paragraph, most of them unlike each other: all similar pairs are connected, and
    the pairs that are compared grow with the variants, not with the square of their number."""
    monkeypatch.setattr(passages, "FEW", few)
    rng = random.Random(19)
    core = [f"w{i}" for i in range(30)]
    while len(passages.Paragraphs(" ".join(core).encode())) > 1:  # one paragraph, so that every variant is in one group
        core = [f"w{rng.randrange(10**6)}" for _ in range(30)]
    real, compared, seen = passages._verified, [], {}

    def counted(pairs, sets):
        pairs = common.materialise(pairs)
        compared.append(pairs.count())
        return real(pairs, sets)

    monkeypatch.setattr(passages, "_verified", counted)
    for n in (150, 300):
        compared.clear()
        rows = []
        while len(rows) < n:
            mine = list(core[rng.choice((0, 0, 0, 1, 3)) :])
            for at in rng.choice([(2,), (27,), (3, 26), (2, 25), (1, 9), (25,)]):
                if at < len(mine):
                    mine[at] = f"e{rng.randrange(10**6 if at % 2 else 6)}"
            if len(passages.Paragraphs(" ".join(mine).encode())) == 1:
                rows.append((len(rows), " ".join(mine), "en", "s", 0))
        df = spark.createDataFrame(rows, DOCS)
        table = common.materialise(passages.paragraphs(df, "doc_id", "text").withColumn("keys", F.array(F.lit(1).cast("long"))))
        sets = {}
        for _, text, *_ in rows:
            p = passages.Paragraphs(text.encode())
            sets[p.hashes()[0] - (1 << 64) if p.hashes()[0] >> 63 else p.hashes()[0]] = set(p.shingles[p.a[0] : p.b[0] - passages.SHINGLE + 1].tolist())
        nodes = sorted(sets)
        similar = {(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
        got = [(r.a, r.b) for r in passages.links(df, table).collect()]
        assert {(min(e), max(e)) for e in got} <= similar
        want = roots_of(similar, nodes)
        assert len(set(want.values())) > n / 10 and len(set(roots_of(got, nodes).values())) == len(set(want.values()))
        seen[n] = sum(compared)
    assert seen[300] < 12 * 300 and seen[300] < 3 * seen[150], seen


def test_every_exact_passage_to_its_ends(spark):
    rng = random.Random(8)

    def some(k):
        return [f"{rng.choice('abcdé')}{rng.randrange(10**6)}" for _ in range(k)]

    rows, want = [], {}
    for n in [*range(51, 91), 200]:
        shared = some(n)
        for copy in range(2):
            head, tail = some(rng.randint(0, 60)), some(rng.randint(0, 60))
            mark = "\n" if copy else " "
            gaps = [mark if i % 4 == 3 and n % 2 else " " for i in range(n - 1)] + [""]
            body = "".join(x + g for x, g in zip(shared, gaps))
            text = " ".join([*head, body, *tail])
            start = len(" ".join([*head, ""]))
            want[len(rows)] = (start, start + len(body), n, bool(copy))
            rows.append((len(rows), text, "en", "s", 0))
    periodic = len(rows)
    rows.append((periodic, "same " * 70, "en", "s", 0))
    rows += [(None, None, "en", "s", 0), rows[0], (9_000, " ".join(some(50)), "en", "s", 0)]
    got = passages.repeats(spark.createDataFrame(rows, DOCS)).collect()
    for i, (a, b, n, removed) in want.items():
        assert [(r.start, r.end, r.words, r.removed, r.class_id) for r in got if r.doc_id == i and r.run_words == r.words == n and r.end - r.start == b - a] == [(a, b, n, removed, i - i % 2)]
    assert not [r for r in got if r.doc_id is None or r.doc_id == 9_000]
    lapped = sorted((r.start, r.end, r.words, r.removed) for r in got if r.doc_id == periodic and r.words in (51, 19))
    assert lapped == [(0, 254, 51, False), (255, 349, 19, True)]


def test_schedule_keeps_within_a_block(spark):
    quota = mixing.quotas(mixing.WEIGHTS, mixing.REST)
    plan = mixing.brute_schedule(quota)
    assert [(r.slot, r["class"], r.k) for r in mixing.schedule(spark, quota).orderBy("slot").collect()] == plan
    had, period = Counter(), sum(quota.values())
    for t, c, _ in plan:
        had[c] += 1
        assert all(abs(had[x] - q * (t + 1) / period) < 1 for x, q in quota.items())


def test_mixing_places_every_row(spark):
    rng = random.Random(7)
    rows = [(None if i % 97 == 0 else i % 800, "t", "en", rng.choice((None, "a", "a", "a", "b", "zzz")), 0) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS).withColumn("block", F.lit("own"))
    got = mixing.place(df, {"a": 3, "b": 1}, 1, period=10, block=7, prefix="m_").collect()
    assert sorted(r.m_position for r in got) == list(range(900))
    assert all(r.m_release <= r.m_slot < r.m_deadline for r in got)
    mixed = mixing.interleave(df, {"a": 3, "b": 1}, 1, period=10, block=7)
    assert mixed.columns == df.columns and mixed.count() == 900
    assert mixing.place(df.limit(0).drop("block")).count() == 0
    with pytest.raises(ValueError):
        mixing.place(df, {"a": 0})


def test_url_rules(spark):
    rows = [(1, "HTTP://WWW.Example.ORG/es/x?q#f"), (2, "http://example.org/en/12"), (3, "http://example.org/fr"), (4, "x.com/fr/1"), (5, None), (6, "http://a.com/de/"), (7, "http://com/fr/"), (8, "http://notexample.org/es/"), (None, "http://É.net"), (8, "http://notexample.org/es/")]
    none = spark.createDataFrame([], "page_id long, good boolean")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)), none, urls.default_rules(spark)).collect()), key=str)
    assert got == sorted([(1, "www.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "example.org", "/fr", "org/", "allow"), (4, "", "", None, "allow"),
                          (5, "", "", None, "allow"), (6, "a.com", "/de/", "com/de/", "block"), (7, "com", "/fr/", "com/fr/", "allow"), (8, "notexample.org", "/es/", "org/", "allow"), (8, "notexample.org", "/es/", "org/", "allow"), (None, "É.net", "", None, "allow")], key=str)


def test_url_reputation_blocks_bad_hosts(spark):
    rows = [(i, f"http://{'bad' if i % 2 else f'good{i % 5}'}.site{i % 2}.net/{i}") for i in range(400)]
    marks = [(i, i % 2 == 0) for i in range(300)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, good boolean"), urls.default_rules(spark)).collect()
    assert {r.verdict for r in got if r.host.startswith("bad")} == {"block"} and {r.verdict for r in got if r.host.startswith("good")} == {"allow"}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(marks, "page_id long, good boolean"), urls.default_rules(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], connect(sf_dir))


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[3] == counts[4] == counts[5]
