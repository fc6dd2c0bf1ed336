"""Second-factor events matched with login attempts while both logs arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loginlab.functions.columns import epoch_seconds


def match_streams(
    mfa_log: DataFrame, attempts: DataFrame, shift_seconds=6 * 3600, reach_seconds=120, late: str = "1 hour"
) -> DataFrame:
    """The rows of :func:`loginlab.operators.enrich.mfa_attempt_matches` for two streaming logs: an event with each of
    the user's successful attempts in ``[t - reach, t + reach)``, or once without one.

    Either log may be out of order by ``late``; both watermarks together say when an event has no match and
    when state can go. State is kept for the width of the interval and the lateness only.
    """
    moment = F.col("timestamp") + shift_seconds
    events = mfa_log.select(
        F.col("id").alias("duo_id"),
        "username",
        F.col("result").alias("mfa_result"),
        F.date_from_unix_date(F.floor(F.col("timestamp") / 86400).cast("int")).alias("date"),
        F.timestamp_seconds(moment).alias("moment"),
    ).withWatermark("moment", late)
    successes = attempts.where("result = 1").select(
        F.col("username").alias("_username"),
        F.timestamp_seconds(epoch_seconds("timestamp")).alias("at"),
        F.col("id").alias("attempt_id"),
        "client_ip",
        "d",
    )
    reach = F.expr(f"INTERVAL {int(reach_seconds)} SECONDS")
    near = (F.col("at") >= F.col("moment") - reach) & (F.col("at") < F.col("moment") + reach)
    return (
        events.join(successes.withWatermark("at", late), (F.col("username") == F.col("_username")) & near, "leftOuter")
        .select("duo_id", "username", "mfa_result", "date", "attempt_id", "client_ip", "d")
    )


def store_matches(matches: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes each batch of matches to a folder of its own; a repeated batch replaces it."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        matches.writeStream.outputMode("append")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
