"""Reading the attempt log and writing the derived tables."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlab.functions.predicates import attempt_filter

NAME_LISTS = ("usernames", "successful_usernames")
COUNT_MAPS = ("os_json_cnt", "app_json_cnt", "browser_json_cnt")


def scan_attempts(df: DataFrame, start=None, end=None, floor=None) -> DataFrame:
    """Attempts of a date range; on a log partitioned by ``d`` this prunes files."""
    return df.where(attempt_filter(start=start, end=end, floor=floor))


def read_attempts(spark: SparkSession, path: str, start=None, end=None, floor=None) -> DataFrame:
    return scan_attempts(spark.read.parquet(path), start, end, floor)


def read_attempts_jdbc(
    spark: SparkSession, url: str, table: str, lower: int, upper: int, partitions: int, **options
) -> DataFrame:
    """The log from a database, read in parallel over ranges of ``id``."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn="id", **options)
        .options(lowerBound=lower, upperBound=upper, numPartitions=partitions)
        .load()
        .withColumn("d", F.to_date("timestamp"))
    )


def time_extent(attempts: DataFrame) -> DataFrame:
    return attempts.agg(
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end")
    )


def with_defaults(attempts: DataFrame, start=None, end=None) -> DataFrame:
    """One row ``start, end``: the given bounds, missing ones from the log."""
    extent = time_extent(attempts)
    given = {"start": start, "end": end}
    return extent.select(
        *[
            (F.col(c) if v is None else F.lit(str(v)).cast("timestamp_ntz")).alias(c)
            for c, v in given.items()
        ]
    )


def write_features(features: DataFrame, path: str) -> None:
    """Replaces exactly the days present in ``features``, so a day can be rerun.
    Rows are gathered per day first: small days share a task and have a file each, large ones are split."""
    (
        features.hint("rebalance", "d")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("d")
        .parquet(path)
    )


def write_lsets(lsets: DataFrame, path: str, usernames: DataFrame | None = None) -> None:
    """Feature rows under ``path``; their usernames, one row each, under ``path-usernames``."""
    lsets.write.mode("overwrite").parquet(path)
    if usernames is not None:
        write_usernames(usernames, f"{path}-usernames")


def write_usernames(usernames: DataFrame, path: str) -> None:
    """``id, username, attempts, successes``: what clustering and campaign summaries need
    beside the feature rows."""
    columns = [c for c in ("id", "username", "attempts", "successes") if c in usernames.columns]
    usernames.select(*columns).write.mode("overwrite").parquet(path)


def write_lsets_csv(lsets: DataFrame, path: str) -> None:
    """bzip2 CSV; maps and lists become JSON text."""
    complex_ = [n for n, t in lsets.dtypes if t.startswith(("map", "array"))]
    lsets.withColumns({n: F.to_json(n) for n in complex_}).write.mode("overwrite").option(
        "compression", "bzip2"
    ).csv(path, header=True)


def read_lsets_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def parse_lset_columns(text: DataFrame) -> DataFrame:
    """Text columns of an exchanged Lset file to typed ones: the date, count maps
    and username lists (lists of lists are flattened and made distinct)."""
    typed = {}
    for c in text.columns:
        if c in ("d", "DATE"):
            typed[c] = F.to_date(c)
        elif c in COUNT_MAPS:
            typed[c] = F.from_json(c, "map<string,bigint>")
        elif c in NAME_LISTS:
            nested = F.flatten(F.from_json(c, "array<array<string>>"))
            typed[c] = F.array_distinct(F.coalesce(nested, F.from_json(c, "array<string>")))
    return text.withColumns(typed)


def write_results(
    lsets: DataFrame, stats: DataFrame, path: str, usernames: DataFrame | None = None
) -> None:
    if usernames is not None:
        write_usernames(usernames, f"{path}/usernames")
    lsets.write.mode("overwrite").parquet(f"{path}/lsets")
    stats.write.mode("overwrite").parquet(f"{path}/campaign_stats")


def compromised_users(credentials: DataFrame) -> DataFrame:
    return credentials.select("netid").distinct()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without that setting a folder in the warehouse."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    return folder or posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")


def scratch_table(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate result to the shared folder and reads it back: later
    steps start from the files, whatever happens to executors."""
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Removes the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
