"""Edge cases: clashing names, repeated ids, one-grade labels, empty tables, recall by brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import bpe, lines, mixing, mpegts, passages, pii, quality, rules, simhash
from tests.llm.test_groups import DOCS, roots_of

CLASH = ("llm_text", "llm_key", "llm_id", "llm_win", "llm_th", "llm_gone", "llm_grade", "llm_tail", "mix_position", "__llm_text", "__mix_h")


def clashing(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


def test_names_that_clash_pass_through(spark):
    df = clashing(spark, ["a line of text here\nanother line of text", None, "a line of text here", ""])
    marks = spark.createDataFrame([(0, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")  # good: all are kept
    for out in (simhash.keep_one(df), lines.clean(df), mixing.interleave(df), quality.select(df, marks), bpe.encode(df).drop("ids"), mpegts.store(df).drop("media"), pii.redact(df)):
        assert out.columns == df.columns
        assert {tuple(r[c] for c in CLASH) for r in out.collect()} == {tuple(range(len(CLASH)))}
    with pytest.raises(ValueError):
        mixing.place(df.withColumn("slot", F.lit(1)))
    with pytest.raises(ValueError):
        mpegts.read(mpegts.store(df).withColumn("payload", F.lit(1)))
    with pytest.raises(ValueError):
        quality.rate(df.withColumn("expected_grade", F.lit(1)), quality.fit([], quality.np.zeros(0, int), 3), 2)


def test_empty_tables(spark):
    df = clashing(spark, ["x"]).limit(0)
    for out in (simhash.keep_one(df), lines.clean(df), mixing.interleave(df), bpe.encode(df), mpegts.store(df), pii.redact(df), bpe.decode(bpe.encode(df))):
        assert out.count() == 0


def test_keep_one_tells_unlike_texts_of_one_id_apart(spark):
    rows = [(1, "one text about a river and its banks"), (1, "wholly other words on tax law of late"), (2, "one text about a river and its banks"), (None, "wholly other words on tax law of late")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows[:2])


@pytest.mark.parametrize("few", [1, 4, simhash.FEW])
def test_ball_links_between_components(spark, monkeypatch, few):
    """Clouds of fingerprints that only pairs at distance 3 connect, dense and sparse ones; by
    balls, by pairs in small groups and by both."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(11)
    values = set()
    for size in (40, 3, 1):
        x = rng.getrandbits(64)
        for hop in range(3):  # three clouds in a row, each three bits from the one before
            values.add(x)
            for _ in range(size):
                values.add(x ^ (1 << rng.randrange(64)))
            for b in rng.sample(range(64), 3):
                x ^= 1 << b
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    got = roots_of([(r.a, r.b) for r in edges], signed)
    want = roots_of([(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3], signed)
    pairs = lambda root: {(a, b) for a in signed for b in signed if a < b and root[a] == root[b]}
    assert pairs(got) == pairs(want)


def test_labels_of_one_grade(spark):
    df = spark.createDataFrame([(i, f"text number {i} of these") for i in range(60)], "doc_id long, text string")
    toxic = spark.createDataFrame([(i, 1, 1) for i in range(60)], "doc_id long, quality int, toxic int")
    good = toxic.withColumn("toxic", F.lit(0))
    assert quality.select(df, toxic).count() == 0 and quality.select(df, good).count() == 60
    assert quality.select(df, toxic.withColumn("toxic", F.lit(None).cast("int")).withColumn("quality", F.lit(None).cast("int"))).count() == 60


def test_kneser_ney_by_hand(spark):
    """Text 'ab': every count is one and the discounts are one half at each order.  Characters
    have 1/2 each; pairs 1/2 + 1/2 * 1/2; trigrams 1/2 + 1/2 * 3/4."""
    df = spark.createDataFrame([(1, "ab", "en")], "doc_id long, text string, lang string")
    table = rules.model(rules.count_trigrams(df))
    assert sorted(round(math.exp(r.logp), 12) for r in table.collect()) == [0.875, 0.875]
    for bound in (10**6, 0):
        assert abs(rules.score(df, table, broadcast_rows=bound).first().log_ppl + math.log(0.875)) < 1e-12


def test_lines_of_every_short_length(spark):
    """Lengths of 10 to 31, where the tenth allows one, two or three edits, against all pairs."""
    rng = random.Random(12)
    pool = []
    for n in range(9, 32):
        base = "".join(rng.choice("abcdefgh ") for _ in range(n - 2)) + "xy"
        pool.append(base)
        for _ in range(3):
            x = list(base)
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(x))
                x[i : i + rng.randint(0, 1)] = rng.choice(("", "q", "é"))
            pool.append("".join(x))
    pool = sorted({p for p in pool if p.strip()})
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pool)], "doc_id long, text string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    links = [(i, j) for i, a in enumerate(pool) for j, b in enumerate(pool[:i]) if (d := distance(a, b)) <= 2 and 10 * d <= max(len(a), len(b))]
    root = roots_of(links, range(len(pool)))
    want = {i: min(j for j in root if root[j] == root[i]) for i in root if sum(r == root[i] for r in root.values()) > 1}
    assert {r.doc_id: r.class_id for r in lines.classes(df).collect()} == want


def test_passages_of_short_lines_and_edited_copies(spark):
    rng = random.Random(13)

    def some(k):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(k)]

    rows, short, edited = [], set(), set()
    block = "\n".join(" ".join(some(6)) for _ in range(40))
    for _ in range(5):
        short.add(len(rows))
        rows.append((len(rows), "\n".join([" ".join(some(30)), block, " ".join(some(30))])))
    for _ in range(40):
        shared = some(rng.randint(55, 90))
        for _ in range(3):
            mine = list(shared)
            mine[rng.randrange(len(mine))] = "edited"
            edited.add(len(rows))
            rows.append((len(rows), " ".join(some(40) + mine + some(40))))
    for _ in range(60):
        rows.append((len(rows), " ".join(some(150))))
    got = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string"), run=1).collect()
    found = {r.doc_id for r in got}
    assert short <= found and not found - short - edited
    assert all(sum(r.words for r in got if r.doc_id == i and r.run_words == r.words) >= 240 for i in short)
    assert len(found & edited) >= 0.9 * len(edited)


def test_pairs_of_paragraphs_against_all_pairs(spark):
    """Of all pairs of paragraphs with a Jaccard similarity of 0.8 or more, 95 per cent are connected."""
    rng = random.Random(14)
    rows = []
    for _ in range(150):
        base = [f"w{rng.randrange(10**5)}" for _ in range(200)]
        for _ in range(3):
            mine = list(base)
            for at in rng.sample(range(200), 4):
                mine[at] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(mine)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, by = {}, {}
    for _, text in rows:
        p = passages.Paragraphs(text.encode())
        for h, a, b in zip(p.hashes(), p.a, p.b):
            sets[h] = frozenset(p.shingles[a : b - passages.SHINGLE + 1].tolist())
    for h, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(h)
    near = {(a, b) for hs in by.values() for a in hs for b in hs if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    table = passages.paragraphs(df, "doc_id", "text")
    edges = [(r.a % 2**64, r.b % 2**64) for r in passages.links(df, table).collect()]
    assert all((min(e), max(e)) in near for e in edges)
    root = roots_of(edges, sets)
    assert len(near) >= 30 and sum(root[a] == root[b] for a, b in near) >= 0.95 * len(near)


ADDED = {
    "ssn": (r"(?i)\bssn: *([0-9]{3}-[0-9]{2}-[0-9]{4})\b", "SSN: 123-45-{:04d}"), "iban": (r"\b(DE89370400440532013000)\b", "IBAN DE89370400440532013000"),
    "account": (r"(?i)account number: *([0-9]{8})\b", "account number: 1234{:04d}"), "secret": (r'token = "([0-9a-f]{40})"', 'token = "{:040x}"')}


def test_added_kinds_by_patterns(spark):
    rng = random.Random(15)
    for _ in range(300):
        parts = [rng.choice(["plain words", "a sum of 42.", "é", *(f.format(rng.randrange(1000, 9999)) for _, f in ADDED.values())]) for _ in range(rng.randint(1, 5))]
        text = " and then ".join(parts)
        want = sorted((m.start(1), m.end(1), k) for k, (p, _) in ADDED.items() for m in re.finditer(p, text))
        assert sorted((a, b, k) for k, a, b in pii.spans(text)[1]) == want, text
    df = spark.createDataFrame([(1, "nothing here"), (2, None), (3, "SSN: 123-45-6789"), (4, "x@y.org")], "doc_id long, text string")
    assert {r.doc_id: r.has_pii for r in pii.digests(pii.find(df)).collect()} == {1: False, 2: False, 3: True, 4: True}


def test_quotas_are_the_weights(spark):
    assert mixing.quotas({"a": 1}, 999) == {"a": 1, "*": 999}
    assert mixing.quotas({"a": 0.25, "b": 0.5}, 0.25) == {"a": 1, "b": 2, "*": 1}
    with pytest.raises(ValueError):
        mixing.quotas({"a": 1}, 1_000_003)
    rows = spark.createDataFrame([(i % 3, "abc"[i % 3]) for i in range(300)], "doc_id long, source string")
    once, again = ([tuple(r) for r in mixing.place(rows.repartition(n), {"a": 3, "b": 1}, 1).orderBy("position").collect()] for n in (2, 5))
    assert once == again


def test_pipeline_on_nothing(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
