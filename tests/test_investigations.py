from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loginlab.operators import detectors, investigate, statistics


def ordered(rows):
    return sorted(rows, key=lambda r: (r["at"], r["id"]))


def test_stuffing_scores(log, random_attempts):
    rows = random_attempts(300, seed=6)
    for k, r in enumerate(rows):
        r["password_appeared_in_breach"] = int(r["pw"] % 3 == 0)
        r["user_agent"] = [None, "x", "y"][k % 3]
    rows += [{"id": 900, "username": "only-breached", "result": 1, "password_appeared_in_breach": 1, "at": 5, "pw": 0, "client_ip": "9"}]
    want = {}
    for user in {r["username"] for r in rows}:
        mine = ordered([r for r in rows if r["username"] == user])
        breached = [r for r in mine if r["password_appeared_in_breach"]]
        if not breached or len(breached) == len(mine) or not any(r["result"] for r in mine):
            continue
        lucky = any(r["result"] for r in breached)
        ips, agents = set(), set()
        for r in mine:
            if r["password_appeared_in_breach"]:
                agent = 2 if r["user_agent"] is None else r["user_agent"] not in agents
                want[r["id"]] = 2 * (r["client_ip"] not in ips) + agent + 2 * (not lucky)
            if r["result"]:
                ips.add(r["client_ip"])
                agents.add(r["user_agent"])
    assert want and 900 not in want
    assert {r.id: r.score for r in detectors.stuffing_scores(log(rows)).collect()} == want


def test_password_reuse_across_ips(log, random_attempts):
    rows = random_attempts(250, seed=7)
    chosen = ["10.0.0.2", "10.0.1.1"]
    days = defaultdict(list)
    for r in ordered(rows):
        days[r["username"], r["at"] // 86400].append(r)
    reused = total = 0
    for mine in days.values():
        if len({r["client_ip"] for r in mine} & set(chosen)) < 2:
            continue
        for k, r in enumerate(mine):
            total += 1
            reused += any(o["pw"] == r["pw"] and o["client_ip"] != r["client_ip"] for o in mine[:k])
    got = investigate.password_reuse_across_ips(log(rows), chosen).first()
    assert (got.reused, got.total) == (reused, total)


def test_password_runs(log):
    # per day: first attempt has no distances, then runs of equal passwords
    pws = [1, 1, 1, 2, 2, 3, 3, 3, 3, 4]
    a = log([{"at": 60 * k, "pw": p} for k, p in enumerate(pws)])
    runs, same = [], 1
    for k in range(1, len(pws)):
        if pws[k] == pws[k - 1]:
            same += 1
        else:
            runs.append(same)
            same = 1
    got = {r.run_length: r.runs for r in investigate.ip_password_runs(a).collect()}
    assert got == {n: runs.count(n) for n in set(runs)}
    day = investigate.ip_unique_passwords_per_day(a).first()
    assert (day.unique_count, day.total) == (3, 9)


def test_reachability_follows_directed_cycles(log):
    def tried(ip, user, n, ok=0):
        return [{"client_ip": ip, "username": user, "result": int(k < ok)} for k in range(n)]

    rows = (
        tried("a", "u1", 1) + tried("b", "u1", 5) + tried("b", "u2", 1) + tried("c", "u2", 5)
        + tried("c", "u3", 5) + tried("b", "u3", 5) + tried("d", "u3", 5, ok=5) + tried("e", "u3", 1)
        + tried("far", "u9", 9)
    )
    got = {r.client_ip: r.hop for r in investigate.ip_reachability(log(rows), "a", 5, 0.5).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    plain = {r.client_ip: r.attempts for r in investigate.connecting_ips(log(rows), "b").collect()}
    assert plain == {"a": 1, "b": 11, "c": 10, "d": 5, "e": 1}


def test_targeted_and_breached_user_days(log):
    rows = [{"at": k, "username": "t", "pw": k, "client_ip": f"{k % 3}"} for k in range(6)]
    rows += [{"at": k, "username": "s", "pw": 7, "client_ip": f"{k % 3}"} for k in range(6)]
    a = log(rows)
    literal = {r.username: r.counted for r in detectors.targeted_attack_user_days(a).collect()}
    assert literal == {"t": 5, "s": 5}  # the closing 0 counts, the first attempt has none
    assert [r.username for r in detectors.targeted_attack_user_days(a, unique_only=True).collect()] == ["t"]
    assert [r.username for r in detectors.breached_pair_candidates(a).collect()] == ["s"]


def test_breached_usernames_options(log):
    rows = [{"username": "x", "user_agent": "a"}] * 3 + [{"username": "x", "user_agent": None}]
    a = log(rows)
    assert [r.c for r in detectors.breached_usernames(a, 2).collect()] == [3]
    assert [r.c for r in detectors.breached_usernames(a, 1, by="pairs").collect()] == [2]


def test_top_suspicious(log):
    rows = [{"client_ip": "f"}] * 6 + [{"client_ip": "g"}] * 4 + [{"client_ip": "g", "result": 1}]
    rows += [{"client_ip": "h", "result": 1}] * 6
    by_count = detectors.top_suspicious(log(rows), "client_ip", min_attempts=5, max_ratio=0.5).collect()
    assert [(r.client_ip, r.c, r.fts) for r in by_count] == [("f", 6, None), ("g", 5, 4.0)]
    by_ratio = detectors.top_suspicious(log(rows), "client_ip", 1, 5, 0.5, "ratio").collect()
    assert [r.client_ip for r in by_ratio] == ["g"]


def test_low_and_slow(log):
    window = ("2024-01-01 00:00:00", "2024-01-01 01:00:00")
    rows = [{"at": 10 * k + 1, "username": f"n{k}", "client_ip": "s"} for k in range(5)]
    rows += [{"at": 0, "username": "z", "client_ip": "s"}, {"at": 3600, "username": "z", "client_ip": "s"}]
    rows += [{"at": 5, "username": "one", "client_ip": "t"}] * 6
    a = log(rows)
    found = detectors.low_and_slow_ips(a, *window).collect()
    assert [(r.client_ip, r.attempts, r.users, r.mit) for r in found] == [("s", 5, 5, 8.0)]
    assert detectors.low_and_slow_summary(a, *window).first().attempts == 5
    detail = detectors.low_and_slow_detail(a, *window, user_agent="nobody").first()
    assert (detail.unknown_usernames, detail.matching_attempts) == (0, 0)


def test_last_success_and_newest_arrays(log):
    a = log(
        [
            {"at": 1, "pw": 5},
            {"at": 2, "pw": 6},
            {"at": 3, "pw": 8, "result": 1},
            {"at": 4, "pw": 8},
        ]
    )
    hist = {r.distance: r.n for r in statistics.edit_distance_from_valid(a).collect()}
    assert hist == {3: 1, 2: 1}
    assert statistics.typo_requests(a).first().typos == 1
    assert statistics.unique_passwords_per_user_day(a).first().unique_passwords == 4
    last = investigate.user_last_distances(a).first()
    assert last.distances == [3, 2, 0, 0]


@pytest.mark.parametrize("start", [None, "2024-01-01 00:00:00"])
def test_attempt_statistics_per_day(log, start):
    rows = [{"at": s, "result": r} for s, r in ((0, 1), (43200, 0), (86400, 1))]
    a = log(rows)
    for c in set(statistics.SUMMED) - set(a.columns):
        a = a.withColumn(c, F.lit(1))
    for c in statistics.INTERARRIVALS:
        a = a.withColumn(c, F.when(F.col("id") == 0, -1.0).when(F.col("id") == 1, 300.0).otherwise(10.0))
    got = statistics.attempt_statistics(a, start=start, end="2024-01-03 00:00:00" if start else None).first()
    days = 2 if start else 1
    assert (got["count"], got.result, got.interarrival_time_by_ip) == (3 / days, 2 / days, 10 / days)
