"""Back-filled columns, the indexed log, and second-factor events matched on streams."""

import random

import pytest
from pyspark.sql import functions as F

from loginlab.operators import detectors, enrich, flags
from loginlab.sources import backfill, lookup
from loginlab.streaming import second_factor, stuffing


@pytest.fixture(scope="module")
def days(spark, log, random_attempts, tmp_path_factory):
    """A log of three days, stored by day."""
    path = str(tmp_path_factory.mktemp("log"))
    rows = log(random_attempts(300, 4))
    rows.write.mode("overwrite").partitionBy("d").parquet(path)
    return path, rows


def flagged(rows):
    return flags.unique_password_flags(rows).select("id", "d", "is_unique_pws_by_ip", "is_unique_pws_by_username")


def values(df):
    return sorted(map(tuple, df.select("id", "is_unique_pws_by_ip", "is_unique_pws_by_username").collect()))


def test_a_stopped_backfill_goes_on(spark, days, tmp_path):
    path, rows = days
    out = str(tmp_path / "flags")
    seen = []

    def compute(part):
        seen.append(sorted(str(r.d) for r in part.select("d").distinct().collect()))
        if len(seen) == 2:
            flagged(part).limit(3).write.parquet(f"{out}/data/half-written/day=2024-01-02")
            raise KeyboardInterrupt
        return flagged(part)

    with pytest.raises(KeyboardInterrupt):
        backfill.backfill(path, out, compute, spark, days_at_once=1)
    first = backfill.read_backfill(spark, out)
    assert values(first) == values(flagged(rows.where("d = '2024-01-01'")))
    assert backfill.backfill(path, out, compute, spark, days_at_once=1) == ["2024-01-02", "2024-01-03"]
    assert seen == [["2024-01-01"], ["2024-01-02"], ["2024-01-02"], ["2024-01-03"]]
    assert "half-written" not in [n for n, _, _ in backfill.Folder(spark, out).names("data")]
    assert values(backfill.read_backfill(spark, out)) == values(flagged(rows))
    # again: nothing to do, nothing changes
    before = backfill.manifest(spark, out)
    assert backfill.backfill(path, out, compute, spark) == [] and backfill.manifest(spark, out) == before


def test_a_changed_day_is_computed_again(spark, log, random_attempts, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "flags")
    rows = log(random_attempts(200, 5))
    rows.write.partitionBy("d").parquet(path)
    backfill.backfill(path, out, flagged, spark)
    more = log([a | {"id": a["id"] + 1000} for a in random_attempts(40, 6) if a["at"] < 86400])
    more.write.mode("append").partitionBy("d").parquet(path)
    assert backfill.backfill(path, out, flagged, spark) == ["2024-01-01"]
    assert values(backfill.read_backfill(spark, out)) == values(flagged(rows.unionByName(more)))
    assert {e["entry"] for e in backfill.manifest(spark, out).values()} == {1, 2}


def test_lookups_read_few_files(spark, log, tmp_path):
    r = random.Random(2)
    attempts = [
        {"id": i, "at": r.randrange(4 * 86400), "client_ip": "10.0.0.1" if r.random() < 0.4 else f"10.9.{r.randrange(40)}.{r.randrange(9)}",
         "username": r.choice(["hot", f"u{r.randrange(300)}"])} for i in range(3000)
    ]
    rows = log(attempts)
    path = str(tmp_path / "log")
    lookup.write_log(rows.repartition(4), path, rows_per_file=50)
    every = len(spark.read.parquet(path).inputFiles())
    ids = lambda df: sorted(x.id for x in df.select("id").collect())
    for ip in ("10.9.7.3", "10.0.0.1", "10.9.39.8", "1.1.1.1"):
        files = lookup.files_of_ip(spark, path, ip)
        want = rows.where(F.col("client_ip") == ip)
        assert ids(lookup.attempts_of_ip(spark, path, ip)) == ids(want)
        holding = spark.read.parquet(path).where(F.col("client_ip") == ip).select("_metadata.file_path").distinct().count()
        # at most one more file a day than hold the IP
        assert len(files) <= holding + 4
    assert every > 60 and len(lookup.files_of_ip(spark, path, "10.9.7.3")) <= 8
    assert len(lookup.files_of_ip(spark, path, "10.9.7.3", "2024-01-02", "2024-01-02")) <= 2
    for user in ("u17", "hot", "nobody"):
        want = rows.where(F.col("username") == user)
        assert ids(lookup.attempts_of_user(spark, path, user)) == ids(want)
        assert len(lookup.files_of_user(spark, path, user)) <= want.count()
    got = lookup.attempts_of_user(spark, path, "hot", "2024-01-03", "2024-01-04")
    assert ids(got) == ids(rows.where("username = 'hot' AND d >= '2024-01-03'"))


def test_second_factor_on_shuffled_batches(spark, log, tmp_path):
    r = random.Random(9)
    attempts = [{"id": i, "at": 22_000 + r.randrange(9000), "username": f"u{r.randrange(6)}", "result": int(r.random() < 0.6)} for i in range(400)]
    rows = log(attempts).select("id", "username", "client_ip", "timestamp", "d", "result")
    start = 1704067200
    events = [(i, f"u{r.randrange(8)}", start + 22_000 + r.randrange(9000) - 6 * 3600, r.choice(["success", "denied"])) for i in range(150)]
    mfa = spark.createDataFrame(events, "id long, username string, timestamp long, result string")
    want = sorted(map(str, enrich.mfa_attempt_matches(mfa, rows).select("duo_id", "attempt_id", "client_ip", "mfa_result").collect()))
    far = 4_000_000_000
    end = log([{"id": -1, "username": "end", "result": 1, "at": far - start}]).select(*rows.columns)
    last = spark.createDataFrame([(-1, "end", far, "x")], mfa.schema)
    # three parts in time, rows of neighbouring parts mixed: late by up to two parts
    part = lambda c: F.floor((c - start - 22_000) / 3000)
    seconds = F.unix_timestamp(F.col("timestamp").cast("timestamp"))
    jitter = F.pmod(F.xxhash64("id"), F.lit(2))
    stages = []
    for k in range(4):
        stages.append((
            mfa.where(F.least(part(F.col("timestamp") + 6 * 3600) + jitter, F.lit(3)) == k),
            rows.where(F.least(part(seconds) + jitter, F.lit(3)) == k),
        ))
    for events_, attempts_ in [*stages, (last, end)]:
        events_.repartition(1).write.mode("append").parquet(str(tmp_path / "mfa"))
        attempts_.repartition(1).write.mode("append").parquet(str(tmp_path / "log"))
        streams = [spark.readStream.schema(x.schema).parquet(str(tmp_path / n)) for x, n in ((mfa, "mfa"), (rows, "log"))]
        found = second_factor.match_streams(*streams, late="2 hours")
        second_factor.store_matches(found, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("duo_id >= 0")
    assert sorted(map(str, got.select("duo_id", "attempt_id", "client_ip", "mfa_result").collect())) == want
    assert any("attempt_id=None" in w for w in want)


@pytest.mark.parametrize("seed", [1, 2])
def test_stuffing_scores_on_shuffled_batches(spark, log, tmp_path, seed):
    """Equal to the scores of the whole log, over several runs that each start from the stored state."""
    r = random.Random(seed)
    attempts = [
        {"id": i, "at": r.randrange(3) * 3600 + r.choice([r.randrange(5), r.randrange(3600)]), "username": r.choice(["hot", "hot", "a", "b", "c"]),
         "client_ip": f"10.0.0.{r.randrange(5)}", "user_agent": r.choice([None, "x", "y", "z"]), "result": int(r.random() < 0.15),
         "password_appeared_in_breach": int(r.random() < 0.4)} for i in range(300)
    ]
    columns = ["id", "username", "client_ip", "timestamp", "d", "result", "user_agent", "password_appeared_in_breach"]
    rows = log(attempts).select(*columns)
    want = sorted(map(tuple, detectors.stuffing_scores(rows).select("id", "username", "score").collect()))
    end = log([{"id": -1, "username": "end", "at": 10**8}]).select(*columns)
    # an attempt comes with the part of its hour or with the next one
    hour = F.floor((F.unix_timestamp(F.col("timestamp").cast("timestamp")) - 1704067200) / 3600) + F.pmod(F.xxhash64("id"), F.lit(2))
    for part in [*(rows.where(hour == k) for k in range(4)), end]:
        part.repartition(1).write.mode("append").parquet(str(tmp_path / "log"))
        arriving = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log"))
        for made, name, mode in ((stuffing.first_uses(arriving, "3 hours"), "uses", "append"), (stuffing.user_totals(arriving), "totals", "update")):
            stuffing.store(made, str(tmp_path / name), str(tmp_path / f"{name}-state"), mode).awaitTermination()
    uses, totals = (spark.read.parquet(str(tmp_path / n)) for n in ("uses", "totals"))
    got = sorted(map(tuple, stuffing.current_scores(uses, totals).select("id", "username", "score").collect()))
    assert got == want and len({s for _, _, s in want}) > 2


def test_idle_state_is_cleared(spark, log, tmp_path):
    one = {"username": "a", "client_ip": "1.1.1.1", "user_agent": "x", "password_appeared_in_breach": 1}
    parts = [
        [one | {"id": 1, "at": 0, "result": 1}],
        [one | {"id": 2, "at": 86400, "result": 0}],
        [one | {"id": 3, "at": 40 * 86400, "result": 0, "username": "other"}],
        [one | {"id": 4, "at": 60 * 86400, "result": 0}],
        [one | {"id": 5, "at": 90 * 86400, "result": 0, "username": "end"}],
    ]
    for part in parts:
        log(part).write.mode("append").parquet(str(tmp_path / "log"))
        arriving = spark.readStream.schema(log(part).schema).parquet(str(tmp_path / "log"))
        uses = stuffing.first_uses(arriving, "1 hour", idle_days=10)
        stuffing.store(uses, str(tmp_path / "uses"), str(tmp_path / "state"), "append").awaitTermination()
    found = spark.read.parquet(str(tmp_path / "uses")).where("username = 'a'").collect()
    # after ten idle days the success of the first day is forgotten
    assert {(r.id, r.kind): r.is_new for r in found} == {(n, k): n in (1, 4) for n in (1, 2, 4) for k in ("ip", "agent")}
