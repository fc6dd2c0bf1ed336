"""Feature building on a stream of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loginlab.functions.columns import epoch_seconds
from loginlab.operators.features import ip_day_features
from loginlab.operators.selection import MIN_ATTEMPTS, MIN_FAILURES
from loginlab.sources.attempts import write_features


def daily_counts(attempts: DataFrame, late: str | None = None) -> DataFrame:
    """Attempts, failure share and approximate distinct users per IP and day of a
    streaming log, to be written in update mode: a day is reported while it is open, and again
    whenever attempts arrive. Without ``late`` they are counted however late they are, and
    the state keeps a row per ⟨IP, day⟩; with it days go from the state, and attempts are
    dropped, that much after the end of the day."""
    # the wall clock of the log, whatever the session time zone is
    clock = F.timestamp_seconds(epoch_seconds("timestamp"))
    start = F.unix_seconds("day.start") / F.lit(86400)
    rows = attempts.withColumn("clock", clock)
    return (
        (rows.withWatermark("clock", late) if late else rows)
        .groupBy(F.window("clock", "1 day").alias("day"), "client_ip")
        .agg(
            F.count("*").alias("NR"),
            (1 - F.avg("result")).alias("FF"),
            F.approx_count_distinct("username").alias("NU_approx"),
        )
        .select(
            "client_ip", F.date_from_unix_date(start.cast("int")).alias("d"), "NR", "FF", "NU_approx"
        )
    )


def store_counts(
    counts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Writes what each batch changes to a folder of its own; a repeated batch replaces it."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_counts(stored: DataFrame) -> DataFrame:
    """The newest counts of each IP and day."""
    values = [c for c in stored.columns if c not in ("client_ip", "d", "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("newest")
    return stored.groupBy("client_ip", "d").agg(newest).select("client_ip", "d", "newest.*")


def alerts(counts: DataFrame, min_attempts=MIN_ATTEMPTS, min_failures=MIN_FAILURES) -> DataFrame:
    return counts.where((F.col("NR") > min_attempts) & (F.col("FF") > min_failures))


def keep_features_current(
    attempts: DataFrame,
    log_path: str,
    features_path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Stores every batch and recomputes the exact feature rows of the days it
    touches. Both writes replace their target, so a repeated batch changes nothing."""

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        (
            batch.withColumn("batch", F.lit(batch_id))
            .hint("rebalance", "d")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("d", "batch")
            .parquet(log_path)
        )
        stored = spark.read.parquet(log_path)
        # the days of the batch prune the stored partitions
        touched = stored.where(F.col("batch") == batch_id).select("d").distinct()
        days = stored.join(F.broadcast(touched), "d", "left_semi").drop("batch")
        write_features(ip_day_features(days), features_path)

    return (
        attempts.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
