"""Reading, writing and describing tables, and the retail tables derived from the raw ones.

The derivations are portable SQL text, so that Spark and the checking SQL share them.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RAW = ("region", "nation", "supplier", "part", "orders", "lineitem", "customer", "events")

#: Retail tables in terms of raw tables ({name}) and one another; DAYS(a, b) is a - b in days.
DERIVED = {
    "sales_daily": """
        SELECT date, product_id, store_id, units, round(gross / units, 4) AS regular_price, round(revenue / units, 4) AS selling_price,
               round(100 * (1 - revenue / gross), 4) AS discount_percentage, round(revenue, 4) AS revenue, round(0.6 * gross, 4) AS cost,
               round(revenue - 0.6 * gross, 4) AS gross_profit,
               (top_discount >= 0.08 AND cast(substr(product_id, 7) AS int) % 3 <> 0 AND date >= DATE '1996-01-01') AS promotion_flag,
               (first_flag = 'R' AND first_status = 'O') AS stockout_flag
        FROM (SELECT cast(l_shipdate AS date) AS date, p_brand AS product_id, r_name AS store_id, cast(sum(l_quantity) AS bigint) AS units,
                     sum(l_extendedprice) AS gross, sum(l_extendedprice * (1 - l_discount)) AS revenue, max(l_discount) AS top_discount,
                     min(l_returnflag) AS first_flag, min(l_linestatus) AS first_status
              FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey
              JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey
              GROUP BY cast(l_shipdate AS date), p_brand, r_name) t
        WHERE units > 0""",
    "products": """
        SELECT p_brand AS product_id, concat('cat', cast(cast(substr(p_brand, 7) AS int) % 5 AS varchar(8))) AS category,
               round(avg(p_retailprice), 4) AS base_price, round(0.6 * avg(p_retailprice), 4) AS unit_cost,
               CASE WHEN cast(substr(p_brand, 7) AS int) % 7 = 0 THEN 'Discontinued' ELSE 'Active' END AS product_status
        FROM {part} GROUP BY p_brand""",
    "stores": """
        SELECT r_name AS store_id, concat('channel', cast(min(n_nationkey) % 3 AS varchar(8))) AS channel, concat('R', cast(r_regionkey % 2 AS varchar(8))) AS region
        FROM {region} JOIN {nation} ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey""",
    "promotions": """
        SELECT concat(product_id, '|', store_id, '|', cast(min(date) AS varchar(10))) AS promotion_id, product_id, store_id, min(date) AS start_date, max(date) AS end_date,
               DAYS(max(date), min(date)) + 1 AS duration_days, max(discount_percentage) AS discount_percentage, sum(units) AS promotion_units,
               round(0.05 * sum(revenue), 4) AS promotion_spend,
               CASE WHEN max(discount_percentage) >= 9 THEN 'deep' WHEN max(discount_percentage) >= 8 THEN 'middle' ELSE 'light' END AS promotion_type
        FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY date)
                       - row_number() OVER (PARTITION BY product_id, store_id, promotion_flag ORDER BY date) AS island FROM sales_daily) t
        WHERE promotion_flag GROUP BY product_id, store_id, island""",
    "competitor_pricing": """
        SELECT s.date, s.product_id, o.store_id AS competitor_id, o.regular_price AS competitor_price, o.selling_price AS competitor_effective_price,
               o.discount_percentage AS competitor_discount, o.promotion_flag AS competitor_promotion_flag
        FROM (SELECT date, product_id FROM sales_daily GROUP BY date, product_id) s JOIN sales_daily o ON o.date = s.date AND o.product_id = s.product_id""",
    "inventory": """
        SELECT date, product_id, store_id, opening_inventory, received_units, units AS sold_units, opening_inventory + received_units - units AS closing_inventory,
               stockout_flag FROM (SELECT *, units % 7 AS opening_inventory, units + (units * 3) % 11 AS received_units FROM sales_daily) t""",
    "relationships": """
        SELECT a.product_id AS product_a, b.product_id AS product_b,
               CASE WHEN a.product_id < b.product_id THEN 'substitute' ELSE 'complement' END AS relationship_type,
               CASE WHEN a.product_id < b.product_id THEN 0.2 ELSE -0.1 END AS cross_elasticity
        FROM products a JOIN products b ON a.category = b.category AND a.product_id <> b.product_id""",
    "dated_products": """
        SELECT p.product_id, p.category, p.product_status, p.unit_cost, f.launch_date
        FROM products p JOIN (SELECT product_id, min(date) AS launch_date FROM sales_daily GROUP BY product_id) f ON f.product_id = p.product_id""",
    "dated_stores": """
        SELECT s.store_id, s.channel, s.region, f.opening_date
        FROM stores s JOIN (SELECT store_id, min(date) AS opening_date FROM sales_daily GROUP BY store_id) f ON f.store_id = s.store_id""",
}
DERIVED = {n: re.sub(r"round\((.*?), 4\)", r"floor((\1) * 10000 + 0.5001) / 10000", sql) for n, sql in DERIVED.items()}
NEEDS = {"promotions": ("sales_daily",), "competitor_pricing": ("sales_daily",), "inventory": ("sales_daily",), "relationships": ("products",),
         "dated_products": ("sales_daily", "products"), "dated_stores": ("sales_daily", "stores")}


def _chain(names) -> list[str]:
    out: list[str] = []
    for name in names:
        for need in (*NEEDS.get(name, ()), name):
            if need not in out:
                out.append(need)
    return out


def _days(sql: str, pattern: str) -> str:
    return re.sub(r"DAYS\(((?:[^(),]|\([^()]*\))+),\s*((?:[^(),]|\([^()]*\))+)\)", pattern, sql)


def with_tables(sql: str, *names: str) -> str:
    """sql with the derived tables `names` as common table expressions, for the checking SQL."""
    ctes = [f"{n} AS ({DERIVED[n]})" for n in _chain(names)]
    body = sql.strip()
    joined = ",\n".join(ctes) + (",\n" + body[5:] if body[:5].upper() == "WITH " else "\n" + body)
    return _days(re.sub(r"\{(\w+)\}", r"\1", f"WITH {joined}"), r"date_diff('day', \2, \1)")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A retail table by name; unknown names are raw tables."""
    if name not in DERIVED:
        return raw(spark, sf_dir, name)
    ctes = ",\n".join(f"{n} AS ({DERIVED[n]})" for n in _chain([name]))
    used = [t for t in RAW if "{" + t + "}" in ctes]
    return spark.sql(_days(f"WITH {ctes} SELECT * FROM {name}", r"datediff(\1, \2)"), **{t: raw(spark, sf_dir, t) for t in used})


def write_table(df: DataFrame, path: str) -> int:
    """The whole table as zstd Parquet; returns the number of rows written, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return seen.get["rows"]


def write_monthly(df: DataFrame, path: str, date: str = "date") -> None:
    """Month-partitioned Parquet; only the months in df are replaced."""
    (df.withColumn("part", F.date_format(date, "yyyyMM")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy("part").parquet(path))


def read_dir(spark: SparkSession, path: str) -> DataFrame:
    """A table directory: columns united by name, the partition column dropped."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df.drop("part")


def write_sample(df: DataFrame, path: str, key: list[str], rows: int) -> None:
    """The first rows by key as CSV with a header; an empty table writes nothing."""
    head = df.orderBy(*key).limit(rows)
    if not head.isEmpty():
        head.write.mode("overwrite").option("header", True).csv(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, digest): an order-insensitive content hash of all columns, the sum of 60
    bits of each row's md5 over the columns by name.  A value goes in after its length and a
    colon, null as a dash, so that no two rows read alike."""
    def counted(c: str) -> Column:
        v = F.col(f"`{c}`").cast("string")
        return F.coalesce(F.concat(F.char_length(v), F.lit(":"), v), F.lit("-"))

    text = F.concat(F.lit(""), *[counted(c) for c in sorted(df.columns)])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("digest"))


def dataset_version(version: str, config: dict, day: str) -> str:
    """version+hash@day: the hash of the configuration, whatever the order of its entries."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
    return f"{version}+{digest[:8]}@{day}"


def manifest(tables: dict[str, DataFrame], date: str = "date") -> DataFrame:
    """(table, part, rows): row counts by month ('' where a table has no date)."""
    out = None
    for name, df in tables.items():
        part = F.date_format(date, "yyyyMM") if date in df.columns else F.lit("")
        rows = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "part", "rows")
        out = rows if out is None else out.unionByName(rows)
    return out


def describe(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, kind) of every column."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(n, i, c, k) for n, df in tables.items() for i, (c, k) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, kind string")


def read_only(spark: SparkSession, sql: str, tables: dict[str, DataFrame], most: int) -> DataFrame:
    """A SELECT or WITH statement over the given tables as views, at most `most` rows.

    It runs as a subquery, where any command is a syntax error, so nothing that writes, creates
    or drops is run, behind WITH neither.  Scripts and calls of Java methods are refused.  The views
    last for the analysis only; views of the same names are there again afterwards.
    """
    bare = _without_texts(sql)
    if not re.match(r"\s*(select|with)\b", bare, re.I):
        raise ValueError("only SELECT or WITH statements are run")
    if found := re.search(r"\b(insert|overwrite|merge|delete|drop|truncate|transform\s*\(.*\)\s*using|map\s.*\susing|reduce\s.*\susing|(try_)?reflect\s*\(|java_method\s*\()", bare, re.I | re.S):
        raise ValueError(f"not in a read-only statement: {found[0].split('(')[0].strip()}")
    if bare.count("(") != bare.count(")") or min(_depths(bare)) < 0:
        raise ValueError("brackets do not match")
    there = {v.name for v in spark.catalog.listTables() if v.isTemporary}
    before = {name: spark.table(name) for name in tables if name in there}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(_identifier(name))
        return spark.sql(f"SELECT * FROM (\n{sql.rstrip().rstrip(';')}\n)").limit(most)
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def _without_texts(sql: str) -> str:
    """sql without comments, string literals and quoted names."""
    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", " ", sql, flags=re.S)


def _depths(sql: str) -> list[int]:
    return list(accumulate((1 if c == "(" else -1 for c in sql if c in "()"), initial=0))


def _identifier(name: str) -> str:
    """A plain name, or an error: no dots, quotes or expressions."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a name: {name!r}")
    return name


#: Availability of each table: observed rows end at the as-of date, known ones do not.
AVAILABILITY = {"pricing": "known", "promotions": "known", "calendar": "known", "products": "static", "stores": "static", "customers": "static", "relationships": "static"}
DATE_OF = {"promotions": "start_date", "trade_promotions": "start_date"}
ACTUALS = ("promotion_spend", "promotion_units")


def as_of(df: DataFrame, name: str, day: Column | str) -> DataFrame:
    """The table as known at the end of `day`: observed tables (unknown names too) are cut;
    tables known in advance keep future rows, with their actuals blank."""
    day = F.to_date(F.lit(day)) if isinstance(day, str) else day
    kind, date = AVAILABILITY.get(name, "observed"), DATE_OF.get(name, "date")
    if kind == "observed":
        return df.filter(F.col(date) <= day)
    if kind == "known":
        return df.withColumns({c: F.when(F.col(date) <= day, F.col(c)) for c in ACTUALS if c in df.columns})
    return df


def read(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, equal: dict | None = None, among: dict | None = None,
         start: str | None = None, end: str | None = None, day: str | None = None, most: int | None = None) -> DataFrame:
    """One typed reader for every table: projection, equality and list filters (an empty list
    is no filter), inclusive dates (overlap for event tables), as-of cut and a row cap.  Names that
    are no identifiers are refused."""
    for c in [name, *(columns or []), *(equal or {}), *(among or {})]:
        _identifier(c)
    df = table(spark, sf_dir, name)
    for c, v in (equal or {}).items():
        df = df.filter(F.col(c) == v)
    for c, vs in (among or {}).items():
        df = df.filter(F.col(c).isin(*vs)) if vs else df
    date, last = DATE_OF.get(name, "date"), "end_date" if name in DATE_OF else "date"
    if start:
        df = df.filter(F.col(last) >= F.to_date(F.lit(start)))
    if end:
        df = df.filter(F.col(date) <= F.to_date(F.lit(end)))
    if day:
        df = as_of(df, name, day)
    if columns:
        df = df.select(*columns)
    return capped(df, most) if most else df


def capped(df: DataFrame, most: int) -> DataFrame:
    """df, or an error when it has more than `most` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: narrow the filters or raise the cap")
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.  A local session
    without one uses its warehouse; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"


def written(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back, for a table that several results use."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
