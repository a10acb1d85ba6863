"""Per-document operators: BPE, transport streams, personal data, quality rules and classifier."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import bpe, mpegts, pii, quality, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __llm_fp string, extra int"


def docs(spark, texts):
    rows = [(None if i == 3 else i, t, None if i == 1 else "en", "src0", None, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = ["", None, "a", "repeated row", "repeated row", " \n\t ", "x" * 50_000, "ünïcödé 😀 ' don't  \n\n", "<|endoftext|>a<|endoftext|>", "word " * 9_000]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    pool = list(" \t\n\r\x0b\x0c\x1c\x85\xa0'sdtreve.,!?aZé漢😀१5") + ["<|endoftext|>", "  ", "\n\n", "'re"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(bpe.default_path()), bpe.vocabulary(bpe.default_path())
    texts = [t or "" for t in ODD] + random_texts(600)
    for text, ids in zip(texts, ours.encode(texts)):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert ours.decode(ids).decode() == theirs.decode(want, skip_special_tokens=False)


def test_bpe_digests_and_round_trip(spark):
    df = docs(spark, ODD)
    got = bpe.digests(df).collect()
    assert len(got) == len(ODD)
    texts = sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in ODD)
    assert sorted(r.decoded_sha256 for r in got) == texts
    back = bpe.decode(bpe.encode(df)).collect()
    assert all(r.decoded == (r.text or "") for r in back) and set(df.columns) < set(back[0].asDict())
    assert bpe.digests(df.limit(0)).count() == 0


def test_transport_stream_round_trip():
    rng = random.Random(2)
    for n in (0, 1, 191, 192, 193, 9_599, 9_600, 9_601, 30_000):
        payload = mpegts.padded(rng.randbytes(n))
        media = mpegts.mux(payload)
        found = mpegts.demux(media)
        assert found.payload == payload and found.errors == 0 and len(media) % 188 == 0
        assert len(found.times) == len(found.points) == len(found.clocks) == found.elementary
        assert found.times == [i * mpegts.PES_TICKS for i in range(found.elementary)] == found.clocks


def test_transport_stream_faults():
    media = bytearray(mpegts.mux(bytes(20_000)))
    lost = bytes(media[: 188 * 10] + media[188 * 11 :])
    assert mpegts.demux(lost).errors == 1
    twice = bytes(media[: 188 * 11] + media[188 * 10 :])
    assert mpegts.demux(twice).payload == mpegts.demux(bytes(media)).payload
    media[188 + 20] ^= 1
    with pytest.raises(ValueError):
        mpegts.demux(bytes(media))
    with pytest.raises(ValueError):
        mpegts.demux(b"x" * 188)


def test_transport_digests(spark):
    df = docs(spark, ODD)
    for r in mpegts.digests(df.withColumn("t", F.col("text"))).join(df.select("doc_id", "text"), "doc_id").collect():
        payload = mpegts.padded((r.text or "").encode())
        assert (r.payload_sha256, r.tail_crc32) in {(hashlib.sha256(mpegts.padded((t or "").encode())).hexdigest(), zlib.crc32(mpegts.padded((t or "").encode())[-16:])) for t in ODD}
        assert r.payload_bytes % 192 == 0 and len(payload) >= 192
    read = mpegts.read(mpegts.store(df)).collect()
    assert all(r.problem is None and r.errors == 0 and bytes(r.payload) == mpegts.padded((r.text or "").encode()) for r in read)
    assert mpegts.digests(df.limit(0)).count() == 0
    assert mpegts.read(spark.createDataFrame([(None,), (b"no",)], "media binary")).filter("problem is null").count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute_spans(t):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m.group())]


def test_pii_base_equals_the_patterns():
    rng = random.Random(3)
    pool = list("0123456789") * 2 + list(" -.+()@ab.%é") + ["4111 1111 1111 1111", "1.2.3.4", "a@b.c", "+1 (323) 555-9830", "@@", "000012."]
    for _ in range(15_000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 50)))
        assert pii.spans(t)[0] == brute_spans(t), t


def test_pii_added_kinds_and_digest(spark):
    text = 'é mail http://u:p@h.example/x SSN: 123-45-6789, IBAN DE89 3704 0044 0532 0130 00. account number: 12345678 token = "3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1"'
    assert [k for k, _, _ in pii.spans(text)[1]] == ["url", "ssn", "iban", "account", "secret"]
    assert pii.spans("an account of the SSN and a token for all")[1] == []
    df = docs(spark, [*ODD, text])
    got = pii.digests(pii.find(df)).collect()
    assert len(got) == len(ODD) + 1
    want = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(text)).encode()).hexdigest()
    last = next(r for r in got if r.doc_id == len(ODD))
    assert last.base_sha256 == want and last.n_email == 1 and last.spans.startswith("email:16:")
    shown = pii.redact(df).filter(F.col("extra") == len(ODD)).first().text
    assert "123-45-6789" not in shown and "[ssn]" in shown
    assert pii.find(df.limit(0)).count() == 0


def test_pii_cues_in_any_case():
    secret = "3fdf5a35c7b8d733c0b5c7d364eda8ac"
    cases = {f'TOKEN = "{secret.upper()}"': secret.upper(), f"Api_Key: {secret}": secret, f"SECRET={secret}": secret, "PASSWORD: hunter2x": "hunter2x",
             "Social Security Number: 123-45-6789": "123-45-6789", "social security number 123-45-6789": "123-45-6789", "SOCIAL SECURITY NO. 123-45-6789": "123-45-6789",
             "Iban No.: DE89370400440532013000": "DE89370400440532013000", "ACCOUNT NO. 12345678": "12345678", "İ É Passport Number: X1234567": "X1234567"}
    for text, value in cases.items():
        assert [text[a:b] for _, a, b in pii.spans(text)[1]] == [value], text
    assert pii.spans("PASSWORD: hunter2 and the Token, number 5")[1] == []


def brute_counts(t):
    words = re.findall(r"[^\x20\x09-\x0d]+", t)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_rule_counts():
    rng = random.Random(4)
    for _ in range(800):
        t = "".join(rng.choice(["a ", "b ", "é#\n", "\n", "\x0b", "c|d ", "\x85", "a b c "]) for _ in range(rng.randint(0, 60)))
        assert rules.base_counts(t.encode()) == brute_counts(t), repr(t)


def test_perplexity_by_hand_and_by_join(spark):
    """The joined way of scoring equals the broadcast one, and the model is a distribution."""
    df = docs(spark, ["abc abd abc", "abd", None, "", "xyz" * 400, "abcabc abd"])
    table = rules.model(rules.count_trigrams(df))
    near = {r.doc_id: r.log_ppl for r in rules.score(df, table).collect()}
    far = {r.doc_id: r.log_ppl for r in rules.score(df, table, broadcast_rows=0).collect()}
    assert near.keys() == far.keys() and near[2] is None
    assert all((near[k] is None) == (far[k] is None) and (near[k] is None or abs(near[k] - far[k]) < 1e-6) for k in near)
    mass = table.groupBy("lang", F.shiftright("g", 21)).agg(F.sum(F.exp("logp")).alias("p")).agg(F.max("p")).first()[0]
    assert mass <= 1 + 1e-9


def test_perplexity_of_repeated_ids(spark):
    """Rows of one id are scored each on its own text, and alike in both ways."""
    texts = ["abc abd abc", "zzzz q", "abd", None, "", "xyz" * 400, "abc abd abc"]
    df = spark.createDataFrame([(i, t, "en") for i in (None, 7) for t in texts], "doc_id long, text string, lang string")
    table = rules.model(rules.count_trigrams(df))
    near, far = (sorted(((str(r.doc_id), r.n_words, r.word_chars, r.log_ppl) for r in rules.score(df, table, broadcast_rows=n).collect()), key=str) for n in (10**6, 0))
    assert len(near) == len(far) == 2 * len(texts) and len({r[3] for r in near}) == 5
    assert all(a[:3] == b[:3] and (a[3] is None) == (b[3] is None) and (a[3] is None or abs(a[3] - b[3]) < 1e-12) for a, b in zip(near, far))


def test_rules_on_odd_rows(spark):
    got = rules.judge(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert rules.judge(docs(spark, ODD).limit(0)).count() == 0


def test_band_rejects_noise(spark):
    rng = random.Random(5)
    words = ["ta", "ko", "mi", "ra", "se"]
    clean = [" ".join("".join(rng.choice(words) for _ in range(3)) for _ in range(80)) for _ in range(150)]
    noise = " ".join("".join(rng.choice("qxzwvjk#@") for _ in range(6)) for _ in range(80))
    rows = [(i, t, "en") for i, t in enumerate([*clean, noise])]
    got = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[150] and sum(got.values()) >= 148


def test_classifier_held_out(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1_200):
        t = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        grade = rng.choice((0, 1, 2, 2, 2))
        if grade == 0:
            t.insert(rng.randrange(len(t)), rng.choice(("scum", "moron")))
        if grade == 1:
            t = [w + "%%%" for w in t]
        rows.append((i, " ".join(t), "x"))
        if i < 900:
            labels.append((i, int(grade != 1), int(grade == 0)))
        else:
            labels.append((i, None, None))
        rows[-1] = (*rows[-1], grade)
    df = spark.createDataFrame(rows, "doc_id long, text string, tail_probability string, grade int")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5_000, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(df, marks).join(df.select("doc_id", "grade"), "doc_id").filter("doc_id >= 900").collect()
    assert len(got) == 300
    share = {g: np.mean([r.kept for r in got if r.grade == g]) for g in range(3)}
    assert share[2] > 0.97 and share[0] < 0.1 and share[1] < 0.1
    kept = quality.select(df, marks)
    assert kept.columns == df.columns and kept.count() < 1_200


def test_classifier_without_labels_keeps_all(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(docs(spark, ODD), marks).collect()
    assert len(got) == len(ODD) and all(r.kept for r in got)
    assert quality.judge(docs(spark, ODD).limit(0), marks).count() == 0


def test_ordinal_probabilities_sum_to_one():
    m = quality.fit([np.array([1, 2]), np.array([3])] * 20, np.array([0, 2] * 20), 3, buckets=8)
    p = m.probabilities(np.array([-3.0, 0.0, 3.0]))
    assert np.allclose(p.sum(1), 1) and (np.diff(m.thresholds) >= 0).all() and p[2, 2] > p[0, 2]
