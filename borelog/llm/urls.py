"""URL rules by a sort-merge range join, in DataFrame functions only.

A host's canonical key is its labels in reverse, each followed by a dot, so a rule for a host and its subdomains covers an
interval of keys, and such intervals nest or are apart. Interval borders and host keys are dealt into key ranges by
sampled splitters and sorted; a sweep carries the stack of rules that are active at each place. A URL's rule is the
longest of its host's stack whose path its own begins with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STACK = "array<struct<size:int,rule:string,key:string,path:string,verdict:string>>"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(after_scheme(url), "^([^/?#]*)([^?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^([^/?#]*)([^?#]*)", 2)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """For each rule host's key: the rules of the host and of the hosts above it, longest first (ties: by rule, then verdict)."""
    rules = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''").distinct()
    rules = rules.select(host_key(F.col("host")).alias("key"), F.concat("host", "path").alias("rule"), "path", "verdict")
    rules = rules.withColumn("size", F.length("rule"))
    labels = F.split(F.regexp_replace("key", r"\.$", ""), r"\.")
    above = rules.select("key").distinct().withColumn("labels", labels)
    above = above.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.concat(F.array_join(F.slice("labels", 1, n), "."), F.lit(".")))).alias("up"))
    held = rules.select(F.col("key").alias("up"), F.struct((-F.col("size")).alias("size"), "rule", F.col("key").alias("key"), "path", "verdict").alias("r"))
    return above.join(held, "up").groupBy("key").agg(F.sort_array(F.collect_list("r")).alias("stack"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for every row.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the path begins with its own; the
    longest (host and path together) wins; no rule: null and ``default``. A null url, or one without ``://``, has an empty
    host and path. Repeated rows stay; an empty rule table leaves the default everywhere. Only distinct hosts are sorted
    and swept, so a host with many pages costs the sweep nothing; pages meet their host's stack by an equi-join, whose
    skew Spark can split."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url_col)), F.lit("")).alias("path"))
    hosts = rows.select("host").distinct().withColumn("at", host_key(F.col("host")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A bounded sample: it only places the splitters, any of which give the same result.
    sample = sorted(r["at"] for r in hosts.select("at").orderBy(F.xxhash64("at")).limit(20 * n).collect())
    splitters = sorted({sample[k * len(sample) // n] for k in range(1, n)}) if sample else []
    marks = F.array(*[F.lit(s) for s in splitters]) if splitters else F.array().cast("array<string>")

    def bucket(key: Column) -> Column:
        return F.size(F.filter(marks, lambda s: s <= key))

    stacks = rule_stacks(rules).withColumn("stop", F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")))
    stacks = stacks.withColumn("first", bucket(F.col("key"))).withColumn("last", bucket(F.col("stop")))
    opened = stacks.withColumn("bucket", F.explode(F.sequence("first", "last")))
    opened = opened.select("bucket", F.when(F.col("bucket") == F.col("first"), F.col("key")).otherwise("").alias("at"), F.length("key").alias("depth"), F.col("stack").cast(STACK).alias("stack"), F.lit(None).cast("string").alias("host"))
    closed = stacks.select(F.col("last").alias("bucket"), F.col("stop").alias("at"), F.length("key").alias("depth"), F.filter("stack", lambda r: r["key"] != F.col("key")).cast(STACK).alias("stack"), F.lit(None).cast("string").alias("host"))
    asked = hosts.select(bucket(F.col("at")).alias("bucket"), "at", F.lit(1 << 30).alias("depth"), F.lit(None).cast(STACK).alias("stack"), "host")
    sweep = Window.partitionBy("bucket").orderBy("at", "depth").rowsBetween(Window.unboundedPreceding, 0)
    swept = opened.unionByName(closed).unionByName(asked).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("host is not null").select("host", "active")
    fits = F.filter(F.coalesce("active", F.array().cast(STACK)), lambda r: F.startswith(F.col("path"), r["path"]))
    found = rows.join(swept, "host", "left").withColumn("best", F.get(fits, F.lit(0)))
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query, and DuckDB SQL for them over the table ``pages``.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
SQL = """
WITH rules(host, path, verdict) AS (VALUES %s),
u AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u
), m AS (
  SELECT p.r, rules.host || rules.path AS rule, rules.verdict, row_number() OVER (PARTITION BY p.r ORDER BY length(rules.host || rules.path) DESC) AS k
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.r = m.r AND m.k = 1
""" % ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
