"""Credential-stuffing scores while the log arrives.

Two streams are kept. One gives, for every attempt with a breached password, whether its IP, and its user agent, had no
success of the user before: state per ⟨user, IP⟩ and ⟨user, agent⟩ holds the first success, and the
attempts that wait until the watermark says that nothing earlier can come. The other keeps each user's totals.
A busy user is spread over its IPs and agents. :func:`current_scores` puts both together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loginlab.functions.columns import epoch_seconds

FIELDS = "id long, username string, kind string, is_new boolean, no_agent boolean"
# fixed value: the state store that processors with timers need
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSuccess(StatefulProcessor):
    """State of one ⟨user, IP⟩ or ⟨user, agent⟩. ``idle_days`` without an attempt clear it (None: never)."""

    def __init__(self, idle_days: float | None = None):
        self.idle = None if idle_days is None else int(idle_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at long, id long")
        self.waiting = handle.getListState("waiting", "at long, id long, result int, breached int, no_agent boolean")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest, latest = sys.maxsize, 0
        for part in rows:
            columns = [part[c].tolist() for c in ("at", "id", "result", "breached", "no_agent")]
            self.waiting.appendList(list(zip(*columns)))
            earliest, latest = min(earliest, *columns[0]), max(latest, *columns[0])
        # one timer for all of them: whatever has come due by then is judged with it
        self.handle.registerTimer((earliest + 999) // 1000)
        if self.idle is not None:
            if self.last.exists():
                latest = max(latest, self.last.get()[0])
            self.last.update((latest,))
            self.handle.registerTimer((latest + 999) // 1000 + self.idle)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # nothing up to the watermark can come any more
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        due, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        username, kind, _ = key
        out = []
        if due:
            known = tuple(self.first.get()) if self.first.exists() else None
            first = known
            for at, id_, result, breached, no_agent in due:
                if breached:
                    out.append((id_, username, kind, first is None or first >= (at, id_), no_agent))
                if result and first is None:
                    first = (at, id_)
            if first != known:
                self.first.update(first)
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer((rest[0][0] + 999) // 1000)
            else:
                self.waiting.clear()
        if self.idle is not None and not rest and self.last.exists():
            if (self.last.get()[0] + 999) // 1000 + self.idle <= now // 1000:
                for state in (self.first, self.last):
                    state.clear()
        if not out:
            return iter(())
        return iter([pd.DataFrame(out, columns=["id", "username", "kind", "is_new", "no_agent"])])

    def close(self) -> None:
        pass


def first_uses(attempts: DataFrame, late: str = "1 hour", idle_days: float | None = None) -> DataFrame:
    """⟨id, username, kind, is_new, no_agent⟩ of a streaming log: for every attempt with a breached password a row of
    kind ``ip`` and, if it has a user agent, one of kind ``agent``. The log may be out of order by ``late``."""
    clock = F.timestamp_seconds(epoch_seconds("timestamp"))
    fraction = F.round(F.extract(F.lit("SECOND"), F.col("timestamp")) * 1_000_000).cast("long") % 1_000_000
    micros = F.unix_micros(clock) + fraction
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    rows = attempts.where("username IS NOT NULL").select(
        "id",
        "username",
        clock.alias("clock"),
        micros.alias("at"),
        F.col("result").cast("int").alias("result"),
        F.col("password_appeared_in_breach").cast("int").alias("breached"),
        F.col("user_agent").isNull().alias("no_agent"),
        F.inline(F.array(pair("ip", F.col("client_ip")), pair("agent", F.col("user_agent")))),
    )
    return (
        rows.where("value IS NOT NULL")
        .withWatermark("clock", late)
        .groupBy("username", "kind", "value")
        .transformWithStateInPandas(FirstSuccess(idle_days), FIELDS, "Append", "EventTime")
    )


def user_totals(attempts: DataFrame) -> DataFrame:
    """What decides whether a user's attempts are scored; to be written in update mode."""
    breached = F.col("password_appeared_in_breach")
    return attempts.groupBy("username").agg(
        F.sum("result").alias("s"),
        F.sum(breached).alias("b"),
        F.count("*").alias("c"),
        F.max(F.col("result") * breached).alias("breached_success"),
    )


@contextmanager
def _store(spark: SparkSession):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(rows: DataFrame, path: str, checkpoint: str, mode: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes each batch to a folder of its own; a repeated batch replaces it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with _store(rows.sparkSession):
        return (
            rows.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def current_scores(uses: DataFrame, totals: DataFrame) -> DataFrame:
    """⟨id, username, score⟩ as :func:`loginlab.operators.detectors.stuffing_scores` gives them, of the stored rows of
    both streams. Of a user's totals the newest count."""
    values = [c for c in totals.columns if c not in ("username", "batch")]
    newest = totals.groupBy("username").agg(F.max_by(F.struct(*values), "batch").alias("t")).select("username", "t.*")
    users = newest.where("b >= 1 AND s >= 1 AND c - b >= 1")
    is_new = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("is_new").cast("int")))
    parts = uses.groupBy("id", "username").agg(
        is_new("ip").alias("ip"), is_new("agent").alias("agent"), F.max("no_agent").alias("no_agent")
    )
    score = (
        F.col("ip") * 2
        + F.when(F.col("no_agent"), 2).otherwise(F.coalesce("agent", F.lit(0)))
        + F.when(F.col("breached_success") == 1, 0).otherwise(2)
    )
    return parts.join(users, "username").select("id", "username", score.alias("score"))
