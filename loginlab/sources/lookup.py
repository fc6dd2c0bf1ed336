"""A stored log in which the attempts of one IP, or of one user, are found without reading the whole of it.

The log is partitioned by day and sorted by IP within it, an IP with very many attempts lying in several files.
A table of the range of IPs in each file tells which files can hold an IP. Users are scattered
over the files, so a second table has a row per user and file, in buckets; a lookup reads one bucket. Inside
the files, bloom filters and statistics pass over row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 1_000_000
BUCKETS = 256
BLOOM = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("client_ip", "username")}


def write_log(attempts: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes the log to ``path`` and its tables of files to ``path``-files."""
    spark = attempts.sparkSession
    dealt = attempts.repartitionByRange("d", "client_ip", "id").sortWithinPartitions("d", "client_ip", "timestamp", "id")
    dealt.write.partitionBy("d").options(maxRecordsPerFile=rows_per_file, **BLOOM).parquet(path)
    stored = spark.read.parquet(path).select("d", "client_ip", "username", F.col("_metadata.file_path").alias("file"))
    ranges = stored.groupBy("file", "d").agg(
        F.min("client_ip").alias("first"), F.max("client_ip").alias("last"), F.count("*").alias("attempts")
    )
    ranges.write.parquet(f"{path}-files/ranges")
    users = stored.groupBy("username", "d", "file").agg(F.count("*").alias("attempts"))
    users = users.withColumn("bucket", F.pmod(F.xxhash64("username"), F.lit(BUCKETS)))
    users.repartition("bucket").sortWithinPartitions("username").write.partitionBy("bucket").parquet(f"{path}-files/users")


def _in_days(files: DataFrame, start, end) -> DataFrame:
    if start is not None:
        files = files.where(F.col("d") >= F.lit(str(start)).cast("date"))
    return files if end is None else files.where(F.col("d") <= F.lit(str(end)).cast("date"))


def files_of_ip(spark: SparkSession, path: str, ip: str, start=None, end=None) -> list[str]:
    """The files that can hold attempts of an IP on the given days."""
    ranges = _in_days(spark.read.parquet(f"{path}-files/ranges"), start, end)
    found = ranges.where((F.col("first") <= ip) & (F.col("last") >= ip)).select("file")
    return sorted(r.file for r in found.collect())


def files_of_user(spark: SparkSession, path: str, username: str, start=None, end=None) -> list[str]:
    """The files that hold attempts of a user on the given days."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(username)), F.lit(BUCKETS))).scalar()
    users = _in_days(spark.read.parquet(f"{path}-files/users").where(F.col("bucket") == bucket), start, end)
    return sorted(r.file for r in users.where(F.col("username") == username).select("file").collect())


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    schema = spark.read.parquet(path).schema
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*files)


def attempts_of_ip(spark: SparkSession, path: str, ip: str, start=None, end=None) -> DataFrame:
    return _read(spark, path, files_of_ip(spark, path, ip, start, end)).where(F.col("client_ip") == ip)


def attempts_of_user(spark: SparkSession, path: str, username: str, start=None, end=None) -> DataFrame:
    return _read(spark, path, files_of_user(spark, path, username, start, end)).where(F.col("username") == username)
