"""Work that grows with the number of days or attempts no faster than the log."""

import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from loginlab.operators import features, flags
from loginlab.sources import attempts as source
from loginlab.sources import backfill, derived
from loginlab.streaming import daily
from loginlab.streaming.stuffing import FirstSuccess


def files_by_day(path, spark):
    return Counter(f.split("/d=")[1][:10] for f in spark.read.parquet(path).inputFiles())


def test_second_factor_events_are_chosen_before_their_text_is_parsed(spark, tmp_path):
    rows = spark.range(20).selectExpr(
        "id AS event_id", "id % 4 AS user_id", "'click' AS event_type", "0.0 + id AS value", """'{"k": 70}' AS props"""
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    found = derived.mfa_log(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    chosen = next(line for line in plan.splitlines() if "Filter" in line)
    assert re.search(r"event_id#\d+L % 3", chosen).start() < chosen.index("get_json_object")
    assert all(r.id % 3 == 0 and int(r.username[1:]) % 2 == 0 for r in found.collect())


def test_the_derived_log_has_a_folder_a_month(spark, tmp_path):
    events = spark.range(0, 60_000, 50).select(
        F.col("id").alias("event_id"),
        (F.col("id") % 37).alias("user_id"),
        F.lit("signup").alias("event_type"),
        (F.col("id") % 1013 / 10.0).alias("value"),
        F.concat(F.lit('{"k": '), (F.col("id") / 50 % 100).cast("int"), F.lit("}")).alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    stored, direct = derived.attempts_table(spark, str(tmp_path)), derived.attempts(spark, str(tmp_path))
    folders = backfill.Folder(spark, derived.attempts_path(spark, str(tmp_path))).names()
    assert [n for n, _, _ in folders if "=" in n] == ["month=2024-01", "month=2024-02", "month=2024-03"]
    rows = lambda df: sorted(str(r) for r in df.select(*sorted(direct.columns)).collect())
    assert sorted(stored.columns) == sorted(direct.columns) and rows(stored) == rows(direct)


def test_a_backfill_takes_months(spark, log, tmp_path):
    rows = log([{"at": k * 86400 * 9, "pw": k % 3} for k in range(12)])
    path, out = str(tmp_path / "log"), str(tmp_path / "flags")
    rows.withColumn("month", F.date_format("d", "yyyy-MM")).write.partitionBy("month").parquet(path)
    found = lambda df: sorted(map(tuple, df.select("id", "d", "is_unique_pws_by_ip").collect()))
    seen = []

    def compute(part):
        seen.append({f.split("month=")[1][:7] for f in part.inputFiles()})
        return flags.unique_password_flags(part).select("id", "d", "is_unique_pws_by_ip")

    months = ["2024-01", "2024-02", "2024-03", "2024-04"]
    assert backfill.backfill(path, out, compute, spark, days_at_once=3) == months
    # a step lists the folders of its own months
    assert seen == [set(months[:3]), set(months[3:])]
    assert found(backfill.read_backfill(spark, out)) == found(flags.unique_password_flags(rows))
    assert backfill.backfill(path, out, compute, spark) == []


def test_a_small_day_is_one_file(spark, log, tmp_path):
    rows = log([{"at": 86400 * (k % 5) + k, "client_ip": f"10.0.0.{k % 30}"} for k in range(300)])
    path = str(tmp_path / "features")
    source.write_features(features.ip_day_features(rows.repartition(8)), path)
    assert len(files_by_day(path, spark)) == 5 and set(files_by_day(path, spark).values()) == {1}


def test_a_refresh_writes_a_small_day_to_one_file(spark, log, tmp_path):
    rows = log([{"at": 86400 * (k % 5) + k, "client_ip": f"10.0.0.{k % 30}"} for k in range(300)])
    rows.repartition(8).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    daily.keep_features_current(
        arriving, str(tmp_path / "log"), str(tmp_path / "features"), str(tmp_path / "state")
    ).awaitTermination()
    assert set(files_by_day(str(tmp_path / "log"), spark).values()) == {1}
    got = spark.read.parquet(str(tmp_path / "features")).select("client_ip", "d", "NR", "NU")
    want = features.ip_day_features(rows).select("client_ip", "d", "NR", "NU")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Rows(Value):
    def get(self):
        return iter(self.value or [])

    def appendList(self, rows):
        self.value = (self.value or []) + rows

    put = Value.update

    def clear(self):
        self.value = None


class Handle:
    """A state store of one key that remembers its timers."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return Value()

    def getListState(self, *_):
        return Rows()

    def registerTimer(self, moment):
        self.timers.add(moment)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_attempts_share_a_timer():
    handle, state = Handle(), FirstSuccess()
    state.init(handle)
    at = [(k + 1) * 1_000_000 for k in range(50)]
    part = pd.DataFrame({"at": at, "id": range(50), "result": [int(k == 20) for k in range(50)], "breached": 1, "no_agent": False})
    list(state.handleInputRows(("u", "ip", "x"), iter([part]), Watermark(0)))
    assert handle.timers == {1000}
    first = list(state.handleExpiredTimer(("u", "ip", "x"), Watermark(30_000), None))
    assert handle.timers == {1000, 31_000}
    last = list(state.handleExpiredTimer(("u", "ip", "x"), Watermark(90_000), None))
    assert handle.timers == {1000, 31_000}
    found = pd.concat(first + last)
    assert list(found["id"]) == list(range(50)) and list(found["is_new"]) == [k <= 20 for k in range(50)]
