import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loginlab.operators import enrich, features, flags, selection


def sequential_labels(rows, key):
    """Follows each key's attempts in order and hands out labels one by one."""
    out, days, counter = {}, defaultdict(list), defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
        today = days[r[key], r["at"] // 86400]
        distances = [abs(r["pw"] - pw) for pw, _ in today]
        if not today:
            label = "unknown"
        elif 0 in distances:
            label = today[distances.index(0)][1]
        else:
            label = f"password{counter[r[key]]}"
            counter[r[key]] += 1
        today.append((r["pw"], label))
        out[r["id"]] = label
    return out


@pytest.mark.parametrize("key", ["username", "client_ip"])
@pytest.mark.parametrize("slice_seconds", [11, 1800])
def test_password_labels(log, random_attempts, key, slice_seconds, monkeypatch):
    rows = random_attempts(seed=4)
    monkeypatch.setattr(flags.password_origins, "__defaults__", ("username", slice_seconds))
    got = {r.id: r.label for r in flags.password_labels(log(rows), key).collect()}
    assert got == sequential_labels(rows, key)


def test_unique_passwords_per_user(log, random_attempts):
    rows = random_attempts(seed=5)
    unique, users = defaultdict(int), defaultdict(set)
    for r in rows:
        day = r["at"] // 86400
        users[r["client_ip"], day].add(r["username"])
        same = ("username", "client_ip", "pw")
        unique[r["client_ip"], day] += not any(
            all(o[k] == r[k] for k in same) and o["at"] // 86400 == day and o["at"] < r["at"]
            for o in rows
        )
    got = {(r.client_ip, r.d.day - 1): r.AUPPU for r in features.unique_passwords_per_user(log(rows)).collect()}
    assert got == {k: pytest.approx(unique[k] / len(users[k])) for k in users}


def test_sentinels(log):
    a = log(
        [
            {"client_ip": "1.1.1.1", "at": 5},
            {"client_ip": "2.2.2.2", "at": 5, "user_agent": None, "is_unique_pws_by_ip": 0},
            {"client_ip": "2.2.2.2", "at": 5, "user_agent": None, "is_unique_pws_by_ip": 0},
            {"client_ip": "3.3.3.3", "at": 1, "result": 1},
            {"client_ip": "3.3.3.3", "at": 2, "result": 1},
            {"client_ip": "4.4.4.4", "at": 1, "password_appeared_in_breach": 1, "zxcvbn_score": 1},
            {"client_ip": "4.4.4.4", "at": 4, "password_appeared_in_breach": 1},
            {"client_ip": "4.4.4.4", "at": 6, "result": 1, "username": "v"},
        ]
    )
    f = {r.client_ip: r for r in features.ip_day_features(a).collect()}
    assert set(f) == {"2.2.2.2", "4.4.4.4"}  # one attempt, or no failure: not a candidate
    two, four = f["2.2.2.2"], f["4.4.4.4"]
    assert (two.MIT_Mean, two.MIT_Median, two.SIT) == (0, 0, 0)
    assert (two.FSPIB, two.UWR, two.NP, two.NUA, two.FNUA) == (-1, -1, 0, 0, 1)
    assert (four.FSPIB, four.FPIB) == (0.5, pytest.approx(2 / 3))
    assert (four.MIT_Mean, four.MIT_Median, four.SIT) == (2.5, 2.5, 0.5)
    assert json.loads(four.RCJ) == {
        "AccountError": [0, 0],
        "InvalidCredentials": [1, 2],
        "Success": [1, 1],
        "UnknownUsername": [0, 0],
    }
    stats = {r.client_ip: r for r in features.interarrival_stats(a).collect()}
    assert (stats["1.1.1.1"].gap_mean, stats["1.1.1.1"].gap_std) == (-1, -1)
    agents = {r.client_ip: r.user_agent for r in features.most_common_user_agent(a).collect()}
    assert agents["2.2.2.2"] is None
    window = {r.client_ip: r for r in features.ip_features_window(a).collect()}
    assert window["2.2.2.2"].NUA == 2 and window["4.4.4.4"].FSPIB == pytest.approx(1 / 3)


def test_other_result_codes_are_kept(log):
    a = log([{"result_code": "Locked"}, {"result_code": "Locked", "username": "w"}])
    codes = json.loads(features.result_code_map(a).first().RCJ)
    assert codes["Locked"] == [2, 2] and len(codes) == 5


def test_longest_prefix(spark):
    ips = spark.createDataFrame([("10.1.2.3",), ("10.1.9.9",), ("10.9.9.9",), ("11.0.0.1",), ("bad",)], "client_ip string")
    table = [("10.1.2.0/24", "a"), ("10.1.0.0/16", "b"), ("10.0.0.0/8", None), ("10.1.2.3/32", "host")]
    prefixes = spark.createDataFrame([(n, i, "x", "y", "z") for n, i in table], "network string, isp string, asn_org string, country string, city string")
    got = {r.client_ip: (r.network, r.isp) for r in enrich.ip_networks(ips, prefixes).collect()}
    assert got == {
        "10.1.2.3": ("10.1.2.3/32", "host"),
        "10.1.9.9": ("10.1.0.0/16", "b"),
        "10.9.9.9": ("10.0.0.0/8", "NA"),
        "11.0.0.1": ("NA", "NA"),
        "bad": ("NA", "NA"),
    }


def test_mfa_interval_is_half_open(spark, log):
    at = 1704067200 + 3600
    a = log([{"at": 3600 + s, "result": 1} for s in (-121, -120, 119, 120)] + [{"at": 3600}])
    events = spark.createDataFrame([(7, "u", at - 21600, "success"), (8, "x", at, "fraud")], "id long, username string, timestamp long, result string")
    m = enrich.mfa_attempt_matches(events, a)
    assert sorted((r.duo_id, r.attempt_id) for r in m.where("attempt_id IS NOT NULL").collect()) == [(7, 1), (7, 2)]
    assert m.where("duo_id = 8").first().attempt_id is None
    counts = enrich.mfa_counts(m).first()
    assert (counts.success, counts.denied, counts.fraud) == (2, 0, 0)


def test_user_agents(log):
    agents = [
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0.0.0 Safari/537.36 Edg/120.0",
        "Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) Version/16.6 Mobile/15E148 Safari/604.1",
        "Mozilla/5.0 (Linux; Android 13; Pixel 7) Chrome/120.1 Mobile Safari/537.36",
        "curl/8.0",
    ]
    a = log([{"user_agent": u} for u in agents] + [{"user_agent": None}])
    got = {r.user_agent: (r.os, r.app, r.browser, r.browser_version) for r in enrich.user_agent_dimension(a).collect()}
    assert [got[u] for u in agents] == [
        ("Windows", "desktop", "Edge", "120.0"),
        ("iOS", "unknown", "Mobile Safari", "16.6"),
        ("Android", "mobileweb", "Chrome Mobile", "120.1"),
        ("Other", "unknown", "curl", "8.0"),
    ]
    maps = enrich.user_agent_counts(a).first()
    assert maps.app_json_cnt == {"desktop": 1, "mobileweb": 1, "unknown": 2}


def test_selection_steps(spark):
    rows = [
        ("72.33.255.255", None, 0, 5.0, 10, 10),
        ("72.34.0.0", None, 0, 5.0, 10, 10),
        ("9.9.9.9", "Some ACADEMY", 0, 5.0, 10, 10),
        ("9.9.9.8", "Institute-of-Technology", 0, 5.0, 10, 10),
        ("9.9.9.7", "Plain", 1, 5.0, 10, 10),
        ("9.9.9.6", "Plain", 0, 0.1, 1, 10),  # one password in ten attempts
        ("9.9.9.5", "Plain", 0, 5.0, 10, 7),  # too few attempts
        ("9.9.9.4", "Plain", 0, 5.0, 10, 10),
    ]
    df = spark.createDataFrame(rows, "client_ip string, ISP string, s int, AUPPU double, NU int, NR int")
    df = df.withColumn("duo_responses", F.to_json(F.struct(F.col("s").alias("success")))).withColumn("FF", F.lit(0.9))
    assert [r.client_ip for r in selection.filtered_lsets(df).orderBy("client_ip").collect()] == ["72.34.0.0", "9.9.9.4"]
    assert tuple(selection.filter_report(df).first()) == (7, 6, 5, 3, 2)


def test_thresholds(spark):
    rows = [(2, 1.0)] * 85 + [(10, 0.5)] * 15 + [(1, 1.0), (5, 0.0)]
    df = spark.createDataFrame(rows, "NR int, FF double")
    got = {r.feature: (r.mode, r.threshold) for r in selection.threshold_percentiles(df).collect()}
    # the 85th percentile lies between the two values
    assert got == {"NR": (2.0, pytest.approx(3.2)), "FF": (1.0, 0.5)}
