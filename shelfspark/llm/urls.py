"""URL filter: allow and block rules, and empirical-Bayes reputation of hosts.

Labelled page outcomes (good or not) are counted by host.  Rates shrink from host to
registered domain to suffix to the whole: each level's beta prior is centred on its parent's
posterior mean, with a strength found from the data by the beta-binomial method of moments.
A page without a rule is blocked when the upper bound of its host's posterior lies under a
threshold.  DataFrame functions only; pages are joined once, with one row for each host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules as action, host, path; and suffixes of two labels.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
TWO_LABELS = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
THRESHOLD, Z = 0.5, 1.6448536269514722
LEAST_RHO, MOST_RHO = 0.001, 0.5
#: Hosts (about 200 bytes each) that may be broadcast to the pages; more are joined.
BROADCAST_ROWS = 500_000


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty for null or no '://'."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def default_rules(spark: SparkSession, rules=RULES) -> DataFrame:
    """(action, host, path) rows of a short list."""
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def _levels(host: Column) -> tuple[Column, Column, Column]:
    """Bare host, registered domain and suffix."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")
    suffixes = "|".join(x.replace(".", "[.]") for x in TWO_LABELS)
    pattern = f"([^.]+[.])?({suffixes}|[^.]+)$"
    return bare, F.regexp_extract(bare, pattern, 0), F.regexp_extract(bare, pattern, 2)


def _strength(children: DataFrame, mean: str) -> DataFrame:
    """One row (m): strength of the prior that children (n, s) share round their parent's
    mean, by the method of moments for the intra-class correlation."""
    rate = F.col("s") / F.col("n")
    spread = F.sum(F.col("n") * (rate - F.col(mean)) * (rate - F.col(mean)))
    scale = F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))) / F.sum("n")
    rows = children.filter("n > 0").agg(
        spread.alias("spread"), scale.alias("scale"), F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("k"))
    room = F.col("total") - F.col("squares") / F.col("total") - (F.col("k") - 1)
    rho = F.when((room > 0) & (F.col("scale") > 0), (F.col("spread") / F.col("scale") - (F.col("k") - 1)) / room)
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(LEAST_RHO)), F.lit(LEAST_RHO)), F.lit(MOST_RHO))
    return rows.select((1 / rho - 1).alias("m"))


def _posterior(rows: DataFrame, prior: str) -> DataFrame:
    a = F.col("m") * F.col(prior) + F.col("s")
    return rows.withColumn("size", F.col("m") + F.col("n")).withColumn("mean", a / F.col("size")).drop("m")


def reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """hosts: (host, n, s) of labelled pages and good ones, one row a host.

    Returns (host, reputation, lower_bound, upper_bound): posterior mean and its normal
    bounds.  Hosts without labels get their domain's posterior.  No labels at all: one half
    as the rate of the whole.  Each level's counts are written once, so that the strengths of
    the levels do not count the hosts again.
    """
    bare, domain, suffix = _levels(F.col("host"))
    named = materialise(hosts.select("host", "n", "s", bare.alias("bare"), domain.alias("domain"), suffix.alias("suffix")))
    rows = materialise(named.groupBy("bare", "domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    domains = materialise(rows.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    suffixes = materialise(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    whole = suffixes.agg(F.coalesce((F.sum("s") + 1) / (F.sum("n") + 2), F.lit(0.5)).alias("parent"))
    suffixes = suffixes.crossJoin(F.broadcast(whole))  # one row
    suffixes = _posterior(suffixes.crossJoin(F.broadcast(_strength(suffixes, "parent"))), "parent").select("suffix", F.col("mean").alias("parent"))
    domains = materialise(domains.join(suffixes, "suffix"))
    domains = _posterior(domains.crossJoin(F.broadcast(_strength(domains, "parent"))), "parent").select("domain", "suffix", F.col("mean").alias("parent"))
    rows = materialise(rows.join(domains, ["domain", "suffix"]))
    rows = _posterior(rows.crossJoin(F.broadcast(_strength(rows, "parent"))), "parent")
    half = z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    bounds = rows.select("bare", F.col("mean").alias("reputation"), F.greatest(F.col("mean") - half, F.lit(0.0)).alias("lower_bound"), F.least(F.col("mean") + half, F.lit(1.0)).alias("upper_bound"))
    return named.select("host", "bare").join(bounds, "bare").drop("bare")


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): of each host the rules on it or a parent of it, as sortable structs."""
    labels = F.split("host", "[.]")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "action")
    one = F.struct((F.length("__h") + F.length("__p")).alias("size"), F.length("__h").alias("host_size"),
                   F.col("__h").alias("host"), F.col("__p").alias("path"), F.col("action"))
    return hosts.select("host", F.explode(ends).alias("end")).join(r, F.col("end") == F.col("__h")).groupBy("host").agg(F.collect_set(one).alias("rules"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url",
          threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """(id, host, path, rule, verdict, reputation, lower_bound, upper_bound) of every page.

    outcomes: (id, good boolean) of pages, several for one id count as good only if all are; null ids
    and null outcomes are left out.  Of the rules that fit, the longest (host and path) wins,
    of those the one with the longer host.  Null urls and urls without '://' have an empty
    host, no rule, and the verdict of that host.  Null and repeated ids stay.
    """
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    marks = outcomes.filter(F.col(id_col).isNotNull() & F.col("good").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(F.col("good").cast("int")).alias("good"))
    counted = rows.join(marks, rows[id_col] == marks["__id"], "left").groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("s"))
    counted = materialise(counted)
    known = reputation(counted, z).join(rules_of_hosts(counted.select("host"), rules), "host", "left")
    known = small(materialise(known), BROADCAST_ROWS)  # a hot host's pages stay where they are
    joined = rows.join(known.withColumnRenamed("host", "__host"), F.col("host") == F.col("__host"), "left")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    found = joined.withColumn("__best", best)
    verdict = F.coalesce(F.col("__best.action"), F.when(F.col("upper_bound") < threshold, "block").otherwise("allow"))
    return found.select(id_col, "host", "path", F.concat(F.col("__best.host"), F.col("__best.path")).alias("rule"), verdict.alias("verdict"),
                        "reputation", "lower_bound", "upper_bound")
