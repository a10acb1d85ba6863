"""Probes of the tables, the contracts and the ranges of values."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import contracts, windows
from shelfspark.sources import tables


def test_read_only_runs_no_command(spark, tmp_path):
    given = {"sales_view": spark.range(5)}
    folder = f"{tmp_path}/out"
    for sql in (f"WITH q AS (SELECT 1 AS a) INSERT OVERWRITE DIRECTORY '{folder}' USING parquet SELECT * FROM q", "INSERT INTO t SELECT 1", "CREATE TABLE t AS SELECT 1", "DELETE FROM t",
                "WITH q AS (SELECT 1) DELETE FROM t", "DROP TABLE t", "SELECT 1) x; DROP TABLE t; SELECT * FROM (SELECT 1", "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM sales_view",
                "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.Math', 'abs', -1)", "/* SELECT */ CREATE VIEW v AS SELECT 1"):
        with pytest.raises(Exception):
            tables.read_only(spark, sql, given, 10).collect()
    assert not (tmp_path / "out").exists()


def test_read_only_reads(spark):
    given = {"sales_view": spark.range(5)}
    spark.range(2).createOrReplaceTempView("sales_view")
    got = tables.read_only(spark, "WITH q AS (SELECT id, 'insert ) -- into' AS x FROM sales_view) SELECT id, x FROM q ORDER BY id DESC -- last;", given, 3).collect()
    assert [(r.id, r.x) for r in got] == [(4, "insert ) -- into"), (3, "insert ) -- into"), (2, "insert ) -- into")]
    assert spark.table("sales_view").count() == 2  # the caller's own view
    spark.catalog.dropTempView("sales_view")
    tables.read_only(spark, "select 1 from sales_view;", given, 3)
    assert not spark.catalog.tableExists("sales_view")


def test_names_must_be_identifiers(spark, sf_dir):
    for bad in ("units; drop", "a b", "units`", "x.y", "1a", ""):
        with pytest.raises(ValueError):
            tables.read(spark, sf_dir, "sales_daily", columns=[bad])
        with pytest.raises(ValueError):
            tables.read(spark, sf_dir, "sales_daily", equal={bad: 1})


def test_fingerprint_tells_rows_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), ("a", "-"), ("a", "∅"), (None, "a"), ("", "a"), ("1:a", ""), ("", "1:a")]
    digests = [tables.fingerprint(spark.createDataFrame([r], "x string, y string")).first().digest for r in rows]
    assert len(set(digests)) == len(rows)
    both = tables.fingerprint(spark.createDataFrame(rows, "x string, y string")).first()
    assert both == tables.fingerprint(spark.createDataFrame(rows[::-1], "x string, y string").repartition(3)).first() and both.rows == len(rows)


def test_repeated_ids_count_as_surplus_rows(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")], "promotion_id string, promotion_type string")
    got = {r.rule: r.failing for r in contracts.promotion_suite(df).collect()}
    assert got == {"duplicate_id": 2, "few_types": 0}
    assert contracts.surplus(spark.createDataFrame([(None,), (None,), (1,), (1,)], "k int"), "k").first()[0] == 3


def test_primary_key_without_its_columns(spark):
    got = {r.problem: r.failing for r in contracts.primary_key(spark.range(3), "t", ["x", "y"]).collect()}
    assert got == {"absent_columns": 2, "null_component": 0, "duplicate_rows": 0}


def test_an_outlier_does_not_fill_a_range(spark):
    rng = random.Random(2)
    values = [rng.random() for _ in range(20_000)] + [1e12, -1e15]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    sizes = [r[1] for r in df.groupBy(windows.value_range(df, F.col("v"))).count().collect()]
    assert max(sizes) <= 0.01 * len(values)
    ordered, n = sorted(values), len(values)
    got = windows.quantiles(df, F.col("v"), [0, 0.25, 0.5, 0.999, 1]).first()
    for share, q in zip([0, 0.25, 0.5, 0.999, 1], got.q):
        at = share * (n - 1)
        low, high = ordered[int(at)], ordered[min(int(at) + 1, n - 1)]
        assert abs(q - (low + (high - low) * (at - int(at)))) <= 1e-9 * max(1, abs(q))


def test_running_sums_over_ranges(spark):
    values = [None, *(i * i for i in range(300)), 10**9]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, w long")
    got = {r.v: r.run_w for r in windows.running(df, "v", ["w"], 20).collect()}
    total, want = 0, {}
    for v, i in sorted(((v, i) for i, v in enumerate(values) if v is not None), reverse=True):
        total += i
        want[v] = total
    want[None] = total
    assert got == want
    assert windows.running(df.limit(0), "v", ["w"]).count() == 0
    assert windows.quantiles(df.limit(0), F.col("v"), [0.5]).count() == 0


def test_candidate_pairs_take_the_first_of_a_category(spark):
    from shelfspark.operators import joins

    products = spark.createDataFrame([(f"p{i:03d}", "c") for i in range(60)], "product_id string, category string")
    declared = spark.createDataFrame([("p005", "p050", "substitute"), ("p005", "p002", "complement"), ("p001", "p059", "unrelated")], "product_a string, product_b string, relationship_type string")
    got = {}
    for r in joins.candidate_pairs(products, declared, 5).orderBy("focal", "rank").collect():
        got.setdefault(r.focal, []).append(r.other)
    assert got["p005"] == ["p002", "p050", "p000", "p001", "p003"] and got["p001"] == ["p000", "p002", "p003", "p004", "p005"]
    assert got["p059"] == ["p000", "p001", "p002", "p003", "p004"] and len(got) == 60
