import json
from datetime import date

from loginlab.operators import detectors, features
from loginlab.sources import attempts as source
from loginlab.streaming import daily


def test_days_can_be_rerun(spark, log, tmp_path):
    a = log([{"at": 86400 * (k // 4) + k, "client_ip": f"{k % 2}"} for k in range(8)])
    f = features.ip_day_features(a)
    path = str(tmp_path / "features")
    source.write_features(f, path)
    first = sorted(map(str, spark.read.parquet(path).collect()))
    source.write_features(f.where("d = DATE'2024-01-02'"), path)
    assert sorted(map(str, spark.read.parquet(path).collect())) == first
    days = spark.read.parquet(path).where("d = DATE'2024-01-02'")
    assert "PartitionFilters: [isnotnull(d" in days._jdf.queryExecution().toString()


def test_exchange_file_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", date(2024, 1, 1), {"Linux": 2}, ["x", "y"])], "id string, DATE date, os_json_cnt map<string,bigint>, usernames array<string>")
    path = str(tmp_path / "lsets")
    source.write_lsets_csv(rows, path)
    text = source.read_lsets_csv(spark, path, "id string, DATE string, os_json_cnt string, usernames string")
    assert source.parse_lset_columns(text).collect() == rows.collect()
    nested = spark.createDataFrame([(json.dumps([["x", "y"], ["x"]]),)], "usernames string")
    assert source.parse_lset_columns(nested).first().usernames == ["x", "y"]


def test_time_extent_defaults(log):
    a = log([{"at": 5}, {"at": 9}])
    got = source.with_defaults(a, start="2024-01-01 00:00:00").first()
    assert str(got.start) == "2024-01-01 00:00:00" and str(got.end) == "2024-01-01 00:00:09"


def test_tagged_attacks_are_found_again(spark, log):
    a = log([{"appeared_in_breach": 1}, {}, {"username": "w", "at": 90000}])
    tagged = detectors.tag_attack(detectors.credential_stuffing_attempts(a), 1, attempt_id="id")
    days = detectors.tag_attack(a.where("id = 2").select("username", "d"), 5, username="username", date="d")
    sessions = spark.createDataFrame([(4,)], "id long")
    marked = detectors.tag_attack(sessions, 4, ip_session_id="id")
    mappings = tagged.unionByName(days).unionByName(marked)
    found = {k: [r.id for r in detectors.attacks_matching(mappings, k, a, sessions).collect()] for k in (1, 4, 5)}
    assert found == {1: [0], 4: [4], 5: [2]}


def _stream(spark, log, tmp_path, files_per_batch=1):
    a = log([{"at": 86400 * (k // 10) + k, "client_ip": "hot", "username": f"u{k % 3}"} for k in range(30)])
    path = str(tmp_path / "log")
    a.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return a, stream


def test_refresh_matches_the_batch(spark, log, tmp_path):
    a, stream = _stream(spark, log, tmp_path)
    out = str(tmp_path / "features")
    daily.keep_features_current(stream, str(tmp_path / "stored"), out, str(tmp_path / "state")).awaitTermination()
    cols = ["client_ip", "d", "NR", "NU", "MIT_Mean"]
    got = sorted(map(tuple, spark.read.parquet(out).select(cols).collect()))
    assert got == sorted(map(tuple, features.ip_day_features(a).select(cols).collect()))


def test_alerts_whatever_the_order_of_the_files(spark, log, tmp_path):
    # a file per batch; some batches bring days that others have passed long ago
    a, stream = _stream(spark, log, tmp_path, 1)
    counts, state = str(tmp_path / "counts"), str(tmp_path / "state")
    daily.store_counts(daily.daily_counts(stream), counts, state).awaitTermination()
    stored = spark.read.parquet(counts)
    assert stored.select("batch").distinct().count() >= 3
    got = daily.alerts(daily.current_counts(stored)).collect()
    want = a.groupBy("client_ip", "d").count().collect()
    assert {(r.client_ip, r.d, r.NR, r.FF) for r in got} == {(r.client_ip, r.d, r["count"], 1.0) for r in want}


def test_results_can_be_clustered_again(spark, tmp_path):
    from loginlab.operators import pairs
    from loginlab.plans import campaigns as plan
    from tests.test_campaigns import FIELDS, LSET, make_lsets

    lsets = make_lsets(25, 8, close=True)
    rows = spark.createDataFrame([tuple(p[c] for c in FIELDS) for p in lsets], LSET)
    names = spark.createDataFrame(
        [(p["id"], u, 2, 0) for p in lsets for u in p["names"]], "id string, username string, attempts int, successes int"
    )
    source.write_results(rows, rows.select("id"), str(tmp_path / "out"), names)
    source.write_lsets(rows, str(tmp_path / "lsets"), names)
    want = {r.id: r.cluster_id for r in plan.cluster(rows, names, 0.3, 0.25).collect()}
    for lsets_at, names_at in (("out/lsets", "out/usernames"), ("lsets", "lsets-usernames")):
        stored = spark.read.parquet(str(tmp_path / lsets_at)), spark.read.parquet(str(tmp_path / names_at))
        assert {r.id: r.cluster_id for r in plan.cluster(*stored, 0.3, 0.25).collect()} == want
    assert pairs.MAX_DISTANCE > 0.3 and len(set(want.values())) < len(want)


def test_rules_of_another_institution(spark):
    from loginlab.operators import selection

    rows = spark.createDataFrame(
        [("10.1.2.3", "Acme", 9, 0.9, 1.0, 9, '{"success":0}'), ("128.104.0.1", "x", 9, 0.9, 1.0, 9, '{"success":0}'), ("9.9.9.9", "Acme Corp", 3, 0.6, 1.0, 3, '{"success":0}')],
        "client_ip string, ISP string, NR long, FF double, AUPPU double, NU long, duo_responses string",
    )
    rules = selection.Rules(min_attempts=2, min_failures=0.5, networks=["10.0.0.0/8"], isp_patterns=["corp$"])
    assert [r.client_ip for r in selection.filtered_lsets(rows, rules).collect()] == ["128.104.0.1"]
    report = selection.filter_report(rows, rules).first()
    assert (report.selected, report.after_networks, report.after_isp) == (3, 2, 1)
    assert [r.client_ip for r in selection.filtered_lsets(rows).collect()] == ["10.1.2.3"]
