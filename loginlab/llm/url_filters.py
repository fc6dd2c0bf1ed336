"""URL filters by hashed expressions.

Each URL is expanded into its host suffixes combined with the path prefixes of the lengths that
rules have. Expressions meet rules by an equi-join on a short prefix of their digest; a match counts
only if the full digest agrees. Of the rules that fit, the longest wins (host and path together;
then the one with the longer host; then ``block``).

A null URL, or one without ``://``, has an empty host and path and no rule. Repeated rows are judged
each. Other columns are kept; the result's own columns replace columns of the same name. An empty table
of rules leaves every URL to ``default``. Rules with a null host, path or verdict are ignored;
equal rules count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlab.llm.common import table

# fixed values: the rules of the stated query
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
SHORT = 8  # hexadecimal digits of the digest that the join compares
BROADCAST_RULES = 100_000  # up to so many rules go to every executor, about 20 MB
MOST_LENGTHS = 64  # lengths of rule paths up to which all of them are tried


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."),
    )


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, default="allow", url_col="url") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules`` has host, path and verdict."""
    rules = (
        rules.select("host", "path", "verdict")
        .dropna()
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block beats allow
        .withColumn("digest", digest(F.col("host"), F.col("path")))
        .select(
            F.substring("digest", 1, SHORT).alias("short"),
            F.col("digest").alias("rule_digest"),
            F.concat("host", "path").alias("rule"),
            F.length("host").alias("host_length"),
            F.length("path").alias("path_length"),
            F.col("verdict").alias("rule_verdict"),
        )
    )
    lengths = [r[0] for r in rules.select("path_length").distinct().limit(MOST_LENGTHS + 1).collect()]
    host, path = host_and_path(F.col("_url"))
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.withColumn("_url", F.col(url_col)).select(*keep, host.alias("host"), path.alias("path"))

    # every distinct host and beginning of a path is judged once
    longest = F.lit(max(lengths, default=0)) if len(lengths) <= MOST_LENGTHS else F.length("path")
    rows = rows.withColumn("_head", F.when(F.col("host") != "", F.substring("path", F.lit(1), longest)))
    asked = rows.where("_head IS NOT NULL").select("host", "_head").distinct()
    wanted = (
        F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")
        if len(lengths) <= MOST_LENGTHS
        else F.sequence(F.lit(0), F.length("_head"))
    )
    expressions = (
        asked.withColumn("_suffix", F.explode(suffixes(F.col("host"))))
        .withColumn("_length", F.explode(F.filter(wanted, lambda n: n <= F.length("_head"))))
        .withColumn("digest", digest(F.col("_suffix"), F.expr("substring(_head, 1, _length)")))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        met = expressions.join(F.broadcast(rules), "short")
    else:
        # a popular expression occurs once per distinct host: count it once before it meets the rules
        hits = expressions.select("short", "digest").distinct().join(rules, "short")
        hits = hits.where("digest = rule_digest").drop("short")
        met = expressions.drop("short").join(hits, "digest")
    best = F.struct(F.length("rule"), "host_length", "rule_verdict", "rule")
    found = (
        met.where("digest = rule_digest")
        .groupBy("host", "_head")
        .agg(F.max(best).alias("_best"))
        .select("host", "_head", "_best.rule", "_best.rule_verdict")
    )
    return rows.join(found, ["host", "_head"], "left").select(
        *keep, "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict")
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
ranked AS (
  SELECT s.*, r.rule_host || r.rule_path AS rule, r.verdict
  FROM split s LEFT JOIN rules r
    ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM ranked
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""
