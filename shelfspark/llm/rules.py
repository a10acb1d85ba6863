"""Quality rules with an n-gram perplexity band.

Base rules are counts over a document's words and lines.  The method is a character trigram
language model of each language with modified Kneser-Ney smoothing: Spark counts every
trigram of every document, the probabilities are computed with joins and aggregates, and
scoring looks trigrams up in sorted arrays of packed keys (three code points of 21 bits, so
the keys are exact).  The model is broadcast while its size, which is checked, stays under
BROADCAST_ROWS; a larger one is joined instead.  Each language's perplexity band is its
median of log perplexity plus and minus WIDTH median absolute deviations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import added, identity, materialise, small, utf8

MIN_WORDS = 50
REPEAT_SHARE = 50  # per cent
SYMBOLS = b"#*$%&|<>"
BITS, MASK = 21, (1 << 21) - 1
START = 0x110000  # stands before a text, twice; above all code points
CHUNK = 1 << 19  # code points handled at once
FLUSH = 2_000_000  # distinct trigrams a task holds before it passes them on
BROADCAST_ROWS = 4_000_000  # 16 bytes each on an executor's Python worker
LANGUAGES = 10_000  # one row each, broadcast so that rows of a common language stay where they are
WIDTH, LEAST, BIN = 8.0, 0.2, 0.002  # band: deviations, least half width and bins of log perplexity


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    n = len(words)
    chars = len(text) - sum(text.count(bytes([c])) for c in b"\x20\x09\x0a\x0b\x0c\x0d")
    chars -= int((np.frombuffer(text, np.uint8) & 0xC0 == 0x80).sum())
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        v = len(number)
        _, pair = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)
        _, where, seen = np.unique(pair * v + ids[2:], return_inverse=True, return_counts=True)
        twice = seen[where] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= twice
        repeated = int(cover.sum())
    return n, chars, symbols, dup, repeated


def trigrams(text: str):
    """Packed trigrams of a text in pieces of CHUNK code points, two START before it."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    for at in range(0, len(codes), CHUNK):
        part = codes[max(0, at - 2) : at + CHUNK].astype(np.int64)
        if at == 0:
            part = np.concatenate([[START, START], part])
        yield part[:-2] << 2 * BITS | part[1:-1] << BITS | part[2:]


def _count(batches):
    """Partial trigram counts of a task: (lang, g, n)."""
    held: dict[str, list] = {}
    size = 0

    def merged(parts):
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        keys, where = np.unique(keys, return_inverse=True)
        return keys, np.bincount(where, counts, len(keys)).astype(np.int64)

    def out():
        for lang, parts in held.items():
            keys, counts = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], names=["lang", "g", "n"])

    waiting: dict[str, list] = {}
    for batch in batches:
        for lang, value in zip(batch.column("lang").to_pylist(), batch.column("text")):
            wait = waiting.setdefault(lang, [])
            for grams in trigrams(value.as_buffer().to_pybytes().decode("utf-8", "replace")):
                wait.append(grams)
            if sum(map(len, wait)) >= 4 * CHUNK:
                held.setdefault(lang, []).append(np.unique(np.concatenate(wait), return_counts=True))
                waiting[lang] = []
                if len(held[lang]) >= 8:
                    held[lang] = [merged(held[lang])]
                size = sum(len(k) for parts in held.values() for k, _ in parts)
                if size > FLUSH:
                    yield from out()
                    held.clear()
    for lang, wait in waiting.items():
        if wait:
            held.setdefault(lang, []).append(np.unique(np.concatenate(wait), return_counts=True))
    yield from out()


def count_trigrams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, g, n): all trigrams of all documents; a null language is ''."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), utf8(text).alias("text"))
    parts = rows.mapInArrow(_count, "lang string, g long, n long")
    return parts.groupBy("lang", "g").agg(F.sum("n").alias("n"))


def _interpolated(counts: DataFrame, history: Column, lower: DataFrame, low_key: Column) -> DataFrame:
    """Modified Kneser-Ney at one order.

    counts: (lang, g, n); history and low_key: columns of g's history and of its lower-order
    key; lower: (lang, low, p).  Returns (lang, g, p).  Where too few counts exist for a
    discount, one half, one and one and a half are taken.
    """
    def at(k: int) -> Column:
        return F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"t{k}")

    t = counts.groupBy("lang").agg(at(1), at(2), at(3), at(4))
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))

    def discount(k: int) -> Column:
        value = k - F.try_divide((k + 1) * y * F.col(f"t{k + 1}"), F.col(f"t{k}"))
        good = (F.col(f"t{k}") > 0) & (F.col("t1") > 0) & (value > 0) & (value < k)
        return F.when(good, value).otherwise(k / 2).alias(f"d{k}")

    t = small(materialise(t.select("lang", discount(1), discount(2), discount(3))), LANGUAGES)
    rows = counts.withColumn("h", history).withColumn("low", low_key)
    held = rows.groupBy("lang", "h").agg(
        F.sum("n").alias("s"), *(F.sum(F.when(test, 1).otherwise(0)).alias(f"k{k}") for k, test in
                                 ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") > 2))))
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    left = (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("s")
    return (rows.join(held, ["lang", "h"]).join(lower, ["lang", "low"]).join(t, "lang")
            .select("lang", "g", ((F.col("n") - cut) / F.col("s") + left * F.col("p")).alias("p")))


def model(counts: DataFrame) -> DataFrame:
    """(lang, g, logp): natural log probability of each counted trigram's last character."""
    pairs = counts.select("lang", F.col("g").bitwiseAND((1 << 2 * BITS) - 1).alias("g")).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("n"))
    pairs = materialise(pairs)
    single = pairs.select("lang", F.col("g").bitwiseAND(MASK).alias("g")).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("n"))
    total = single.groupBy("lang").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("v"))
    first = single.join(total, "lang").select("lang", F.col("g").alias("low"), ((F.col("n") + 0.5) / (F.col("s") + 0.5 * F.col("v"))).alias("p"))
    second = _interpolated(pairs, F.shiftright("g", BITS), first, F.col("g").bitwiseAND(MASK))
    second = second.select("lang", F.col("g").alias("low"), "p")
    third = _interpolated(counts, F.shiftright("g", BITS), second, F.col("g").bitwiseAND((1 << 2 * BITS) - 1))
    return third.select("lang", "g", F.log("p").alias("logp"))


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _arrays(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """Of each language: sorted trigrams, their log probabilities and the least of these."""
    table = rows.toArrow()
    out, names = {}, np.array(table["lang"].to_pylist(), object)
    keys, logs = table["g"].to_numpy(), table["logp"].to_numpy()
    for lang in set(names):
        mine = names == lang
        order = np.argsort(keys[mine])
        out[lang] = keys[mine][order], logs[mine][order], logs[mine].min()
    return out


def score(docs: DataFrame, probabilities: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
          broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, __llm_lang, base counts, log_ppl) of every document; log_ppl is null for an empty text
    and for a language that the model lacks.

    A trigram that the model lacks counts as the rarest one of its language.

    Null text: no words, no log_ppl.  Null language: a language of its own.  Null and repeated
    ids stay, each row scored on its own text.  Up to broadcast_rows trigrams the workers hold
    the sorted arrays; beyond, the trigrams of each distinct text are joined with the model,
    with the same result.  Empty table: empty.
    """
    spark = docs.sparkSession
    probabilities = materialise(probabilities)
    held = probabilities.count() <= broadcast_rows
    tables = spark.sparkContext.broadcast(_arrays(probabilities)) if held else None
    rows = docs.select(id_col, F.coalesce(F.col(lang), F.lit("")).alias("__llm_lang"), utf8(text).alias("__llm_text"))

    def run(batches):
        known = tables.value if tables else None
        for batch in batches:
            langs, counts, logs = batch.column("__llm_lang").to_pylist(), [], []
            for name, value in zip(langs, batch.column("__llm_text")):
                raw = value.as_buffer().to_pybytes()
                counts.append(base_counts(raw))
                if known is None:
                    logs.append(None)
                    continue
                if name not in known:
                    logs.append(None)
                    continue
                g, p, rarest = known[name]
                total, n = 0.0, 0
                for grams in trigrams(raw.decode("utf-8", "replace")):
                    at = np.minimum(np.searchsorted(g, grams), len(g) - 1)
                    total += float(np.where(g[at] == grams, p[at], rarest).sum(dtype=np.float64))
                    n += len(grams)
                logs.append(-total / n if n else None)
            columns = [pa.array(list(c), pa.int64()) for c in zip(*counts)] if counts else [pa.array([], pa.int64())] * 5
            keys = [] if held else [batch.column("__llm_key")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(logs, pa.float64()), *keys], names=out.names)

    out = added(docs.select(id_col), f"__llm_lang string, {FEATURES}, log_ppl double")
    if held:
        return rows.mapInArrow(run, out)
    # beyond the bound: trigrams of each text are joined with the model; repeated texts of a
    # language double both sums of their key and so share their mean
    rows = rows.withColumn("__llm_key", identity("__llm_text"))
    out = added(docs.select(id_col), f"__llm_lang string, {FEATURES}, log_ppl double, __llm_key binary")

    def grams_of(batches):
        for batch in batches:
            for i, value in enumerate(batch.column("__llm_text")):
                for grams in trigrams(value.as_buffer().to_pybytes().decode("utf-8", "replace")):
                    g, n = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([batch.column("__llm_lang")[i].as_py()] * len(g)), pa.array([batch.column("__llm_key")[i].as_py()] * len(g), pa.binary()),
                        pa.array(g), pa.array(n, pa.int64())], names=["lang", "key", "g", "n"])

    grams = rows.select("__llm_lang", "__llm_key", "__llm_text").mapInArrow(grams_of, "lang string, key binary, g long, n long")
    # a row a language; one that the model lacks has none
    least = small(materialise(probabilities.groupBy("lang").agg(F.min("logp").alias("rarest"))), LANGUAGES)
    met = grams.join(least, "lang").join(probabilities, ["lang", "g"], "left").withColumn("logp", F.coalesce("logp", "rarest"))
    means = met.groupBy("lang", "key").agg((-F.sum(F.col("n") * F.col("logp")) / F.sum("n")).alias("mean"))
    base = rows.mapInArrow(run, out)
    joined = base.join(means, (F.col("__llm_lang") == means["lang"]) & (F.col("__llm_key") == means["key"]), "left")
    return joined.select(id_col, "__llm_lang", *(x.split(" ")[0] for x in FEATURES.split(", ")), F.col("mean").alias("log_ppl"))


def _median(bins: DataFrame, value: str) -> DataFrame:
    """Per language the value at which half of the weight n is reached."""
    w = Window.partitionBy("lang").orderBy(value)
    run = bins.withColumn("run", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    return run.filter(2 * F.col("run") >= F.col("all")).groupBy("lang").agg(F.min(value).alias("median"))


def bands(scored: DataFrame) -> DataFrame:
    """(lang, lower, upper) of log perplexity, from counts in bins of it."""
    bins = scored.filter(F.col("log_ppl").isNotNull() & (F.col("n_words") >= MIN_WORDS)).groupBy(
        F.col("__llm_lang").alias("lang"), F.round(F.col("log_ppl") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = bins.select("lang", (F.col("bin") * BIN).alias("x"), "n")
    middle = _median(bins, "x")
    away = bins.join(middle, "lang").groupBy("lang", F.abs(F.col("x") - F.col("median")).alias("d")).agg(F.sum("n").alias("n"))
    spread = _median(away, "d").withColumnRenamed("median", "mad")
    half = F.greatest(F.lit(LEAST), WIDTH * F.col("mad"))
    return middle.join(spread, "lang").select("lang", (F.col("median") - half).alias("lower"), (F.col("median") + half).alias("upper"))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: id, the base counts, base_failed, kept, perplexity and its band.

    kept is false where a base rule fails or the perplexity leaves its language's band; a
    text without a perplexity or band is judged by the base rules alone.  Null text: no
    words.  Null language: a language of its own.  Null and repeated ids stay.
    """
    probabilities = model(materialise(count_trigrams(docs, text, lang)))
    scored = materialise(score(docs, probabilities, id_col, text, lang))
    limits = small(materialise(bands(scored).withColumnRenamed("lang", "__llm_of")), LANGUAGES)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(True))
    return scored.join(limits, scored["__llm_lang"] == limits["__llm_of"], "left").select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & inside).alias("kept"), F.exp("log_ppl").alias("perplexity"), F.exp("lower").alias("lower_bound"), F.exp("upper").alias("upper_bound"))
