"""Line deduplication by site-relative frequency.

Lines are counted per host: a line is boilerplate if it stands on at least ``min_pages`` pages of
its host and on more than ``ratio`` of the host's pages. Boilerplate is taken out of every page of
that host and of no other. A page counts once for a line, however often it has it.

Pages without a host, and null texts, keep what they have (null gives no lines). Repeated rows count and
are returned each. Ties do not occur: a line at exactly ``ratio`` stays. Other columns of the input are
ignored. An empty table gives an empty result. Lines are compared by two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlab.llm.common import kept, table

RATIO = 0.3
MIN_PAGES = 2  # what stands on one page only is no boilerplate
SALTS = 32  # parts of a host's lines, and of a line's pages, in the joins

HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
TAG = r"<[^>]*>"


def html_lines(html: Column) -> Column:
    """Text between tags, line by line, trimmed, without empty lines, scripts and comments."""
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), TAG, "\n")
    return lines_of(text)


def lines_of(text: Column) -> Column:
    lines = F.split(text, r"[ \t\r]*\n\s*")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))


def _hashes(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(pages: DataFrame, ratio=RATIO, min_pages=MIN_PAGES) -> DataFrame:
    """⟨host, line, n_pages, host_pages⟩ of ⟨host, marks⟩, with the hashes of a page's lines in
    ``marks``; ``line`` is the hash of a boilerplate line."""
    counts = (
        pages.select("host", F.explode(F.array_distinct("marks")).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n_pages"))
        .where(F.col("n_pages") >= min_pages)
    )
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    # a host with a large part of all lines is spread over SALTS keys
    counts = counts.withColumn("salt", F.pmod(F.col("line.a"), F.lit(SALTS)))
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return counts.join(totals, ["host", "salt"]).where(F.col("n_pages") > F.col("host_pages") * ratio).drop("salt")


def drop_lines(pages: DataFrame, ratio=RATIO, min_pages=MIN_PAGES) -> DataFrame:
    """⟨id, host, lines⟩ to ⟨id, host, n_lines, n_dropped, text⟩."""
    marked = pages.select(
        "id",
        "host",
        F.coalesce("lines", F.array().cast("array<string>")).alias("lines"),
    )
    marked = kept(marked.withColumn("page", F.monotonically_increasing_id()))
    hosted = marked.where("host != ''").select("page", "host", F.transform("lines", _hashes).alias("marks"))
    bad = boilerplate(hosted.select("host", "marks"), ratio, min_pages).select("host", "line")
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = (
        hosted.select("page", "host", F.explode(F.array_distinct("marks")).alias("line"))
        .withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)))
        .join(bad, ["host", "line", "salt"], "left_semi")
        .groupBy("page")
        .agg(F.collect_set("line").alias("bad"))
    )
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    joined = marked.join(found, "page", "left").withColumn("bad", F.coalesce("bad", none))
    stay = F.filter("lines", lambda x: ~F.array_contains(F.col("bad"), _hashes(x)))
    joined = joined.withColumn("stay", F.when(F.size("bad") > 0, stay).otherwise(F.col("lines")))
    return joined.select(
        "id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"),
        F.array_join("stay", "\n").alias("text"),
    )


def op10_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    lines = pages.select(
        F.col("page_id").alias("id"),
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        html_lines(F.col("html")).alias("lines"),
    )
    return drop_lines(lines).withColumnRenamed("id", "page_id")


ORACLE_SQL = rf"""
WITH cut AS (
  SELECT row_number() OVER () AS r, page_id, lower(coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')) AS host,
    regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->',
      chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS text
  FROM pages),
split AS (
  SELECT r, page_id, host,
    list_filter(list_transform(regexp_split_to_array(text, '[ \t\r]*\n\s*'), lambda x: trim(x)), lambda x: x != '') AS lines
  FROM cut),
totals AS (SELECT host, count(*) AS host_pages FROM split GROUP BY host),
counts AS (
  SELECT host, line, count(*) AS n_pages
  FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM split) GROUP BY host, line),
bad AS (
  SELECT host, list(line) AS bad FROM counts JOIN totals USING (host)
  WHERE host != '' AND n_pages >= {MIN_PAGES} AND n_pages > host_pages * {RATIO} GROUP BY host),
stay AS (
  SELECT page_id, split.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS stay
  FROM split LEFT JOIN bad USING (host))
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(stay) AS n_dropped,
  coalesce(array_to_string(stay, chr(10)), '') AS text
FROM stay
"""
