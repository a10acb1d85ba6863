"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lines, mixing, mpegts, packing, passages, pii, quality, rules, runs, simhash, urls, vectors

ROOT = str(Path(__file__).resolve().parents[2])
PACKAGE = "shelfspark-llm.zip"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _importable(spark: SparkSession) -> None:
    """Ship the package to the Python workers of this session, where they cannot import it."""
    context = spark.sparkContext
    if ROOT in context.environment.get("PYTHONPATH", "").split(":"):
        return
    if PACKAGE not in {os.path.basename(f) for f in context.listFiles}:
        folder = tempfile.mkdtemp()  # the driver's copy: Spark serves it to the executors
        path = os.path.join(folder, PACKAGE)
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(Path(ROOT, "shelfspark").rglob("*.py")):
                z.write(f, f.relative_to(ROOT))
        context.addPyFile(path)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table labels pages: the outcome of a page is taken from the row of labels that has its
    number, which is about a document, so these reputations show the method, not the hosts."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    out = urls.judge(_table(spark, sf_dir, "pages"), outcomes, urls.default_rules(spark))
    return out.select("page_id", "host", "path", "rule", "verdict", *(F.round(c, 6).alias(c) for c in ("reputation", "lower_bound", "upper_bound")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.place(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(_table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "words", "run_words", F.col("class_id").alias("class_doc_id"), "class_start", "removed")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_no", F.col("class_id").alias("class_doc_id"), "class_line_no", "removed")


def op8_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.digests(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.digests(_table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(_table(spark, sf_dir, "documents"))


def with_path(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _importable(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: with_path(f) for f in (
    op1_url_filter, op2_quality_classifier, op3_mixing, op4_pii, op5_simhash, op6_substring_dedup, op7_line_dedup, op8_mpegts, op9_bpe, op10_quality_rules,
    op11_vector_codes, op12_packing, op13_periodic_runs)}


def _url_sql() -> str:
    listed = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in urls.RULES)
    two = "|".join(x.replace(".", "[.]") for x in urls.TWO_LABELS)

    def strength(rows: str) -> str:
        return f"""(SELECT 1 / least(greatest(coalesce(CASE WHEN total - squares / total - (k - 1) > 0 AND scale > 0
            THEN (spread / scale - (k - 1)) / (total - squares / total - (k - 1)) END, {urls.LEAST_RHO}), {urls.LEAST_RHO}), {urls.MOST_RHO}) - 1
          FROM (SELECT sum(n * (s / n - parent) * (s / n - parent)) AS spread, sum(n * parent * (1 - parent)) / sum(n) AS scale,
                       sum(n)::DOUBLE AS total, sum(n * n)::DOUBLE AS squares, count(*) AS k FROM {rows} WHERE n > 0))"""

    return f"""
WITH rules(action, rh, rp) AS (VALUES {listed}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{urls.UPPER}', '{urls.LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
marks AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels
          WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS s FROM p LEFT JOIN marks ON page_id = doc_id GROUP BY host),
bare AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS b FROM hosts),
named AS (SELECT *, regexp_extract(b, '([^.]+[.])?({two}|[^.]+)$', 0) AS domain, regexp_extract(b, '([^.]+[.])?({two}|[^.]+)$', 2) AS suffix FROM bare),
h0 AS (SELECT b, domain, suffix, sum(n) AS n, sum(s) AS s FROM named GROUP BY ALL),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(s) AS s FROM h0 GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM d0 GROUP BY ALL),
s1 AS (SELECT *, (SELECT coalesce((sum(s) + 1) / (sum(n) + 2), 0.5) FROM s0) AS parent FROM s0),
s2 AS (SELECT suffix, (m * parent + s) / (m + n) AS parent FROM s1, (SELECT {strength('s1')} AS m)),
d1 AS (SELECT d0.*, parent FROM d0 JOIN s2 USING (suffix)),
d2 AS (SELECT domain, suffix, (m * parent + s) / (m + n) AS parent FROM d1, (SELECT {strength('d1')} AS m)),
h1 AS (SELECT h0.*, parent FROM h0 JOIN d2 USING (domain, suffix)),
h2 AS (SELECT b, (m * parent + s) / (m + n) AS mean, m + n AS size FROM h1, (SELECT {strength('h1')} AS m)),
h3 AS (SELECT named.host, mean, greatest(mean - {urls.Z} * sqrt(mean * (1 - mean) / (size + 1)), 0) AS lo,
              least(mean + {urls.Z} * sqrt(mean * (1 - mean) / (size + 1)), 1) AS hi FROM named JOIN h2 USING (b)),
paths AS (SELECT DISTINCT host, path FROM p),
fit AS (SELECT host, path, arg_max(rh || rp, (length(rh) + length(rp)) * 1000 + length(rh)) AS rule, arg_max(action, (length(rh) + length(rp)) * 1000 + length(rh)) AS action
        FROM paths JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN hi < {urls.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS reputation, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound
FROM p JOIN h3 USING (host) LEFT JOIN fit USING (host, path)"""


LINE_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
kept AS (SELECT * FROM l WHERE length(trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) > 0),
d AS (SELECT line, length(line) AS n, row_number() OVER (ORDER BY line) AS i FROM (SELECT DISTINCT line FROM kept)),
d3 AS (SELECT *, left(line, n // 3) AS s1, substr(line, n // 3 + 1, n // 3) AS s2, right(line, n // 3) AS s3 FROM d WHERE n >= {lines.LEAST - 1}),
near AS (SELECT a.i AS x, b.i AS y, a.line AS s, b.line AS t FROM d3 a JOIN d3 b ON b.n BETWEEN a.n AND a.n + {lines.TAU} AND a.i <> b.i
         WHERE contains(b.line, a.s1) OR contains(b.line, a.s2) OR contains(b.line, a.s3)),
links AS (SELECT x, y FROM (SELECT x, y, levenshtein(s, t) AS e, greatest(length(s), length(t)) AS n FROM near) WHERE e <= {lines.TAU} AND e * {lines.LEAST} <= n),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(i, j) AS (SELECT i, i FROM d WHERE i IN (SELECT x FROM sym) UNION SELECT r.i, b.y FROM reach r JOIN sym b ON b.x = r.j),
root AS (SELECT i, min(j) AS root FROM reach GROUP BY i),
placed AS (SELECT doc_id, line_no, coalesce(root, d.i) AS class FROM kept JOIN d USING (line) LEFT JOIN root ON root.i = d.i),
named AS (SELECT doc_id, line_no, min((doc_id, line_no)) OVER (PARTITION BY class) AS head, count(*) OVER (PARTITION BY class) AS size FROM placed)
SELECT doc_id, line_no::INTEGER AS line_no, head[1] AS class_doc_id, head[2]::INTEGER AS class_line_no, (doc_id, line_no) <> head AS removed
FROM named WHERE size > 1"""


def _vector_sql() -> str:
    rounds = "".join(f"""
d{r} AS MATERIALIZED (SELECT p.row, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM parts p JOIN b{r} b USING (part, i) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{r} GROUP BY row, part),
m{r} AS (SELECT part, entry, i, sum(x)::BIGINT AS s, count(*) AS n FROM parts JOIN a{r} USING (row, part) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, entry, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM b{r} LEFT JOIN m{r} USING (part, entry, i)),"""
                     for r in range(vectors.ROUNDS + 1))
    last = vectors.ROUNDS
    return f"""
WITH good AS (SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
size AS (SELECT greatest(1, ceil(max(len(e)) / {vectors.PARTS})::BIGINT) AS w FROM good),
flat AS (SELECT row, unnest(range(w * {vectors.PARTS})) AS k, e, w FROM good, size),
parts AS MATERIALIZED (SELECT row, k // w AS part, k % w AS i, floor(coalesce(e[k + 1], 0)::DOUBLE * {vectors.SCALE})::BIGINT AS x FROM flat),
b0 AS (SELECT part, row AS entry, i, x FROM parts WHERE row < {vectors.ENTRIES}),{rounds}
book AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM b{last}),
codes AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM good JOIN codes USING (row), book"""


ORACLES = {"op7_line_dedup": LINE_SQL, "op1_url_filter": _url_sql(), "op3_mixing": mixing.oracle(), "op11_vector_codes": _vector_sql()}
