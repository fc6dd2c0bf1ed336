import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loginlab.functions import predicates, ranks, tweaks
from loginlab.functions.columns import ipv4_number, is_new_password, prior
from loginlab.functions.ordering import gaps, previous_in_day, slot_in_day


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_attempt_filter_edges(log):
    a = log([{"at": 0}, {"at": 10}, {"at": 20, "result": 1}])
    window = predicates.attempt_filter("2024-01-01 00:00:00", "2024-01-01 00:00:20")
    assert ids(a.where(window)) == [0, 1]
    assert ids(a.where(predicates.attempt_filter(floor="2024-01-01 00:00:00"))) == [1, 2]
    assert ids(a.where(predicates.attempt_filter(result=1))) == [2]
    assert ids(a.where(predicates.open_window("2024-01-01 00:00:00", "2024-01-01 00:00:20"))) == [1]
    with pytest.raises(TypeError):
        predicates.attempt_filter(nothing=1)


def test_session_filter(spark):
    s = spark.createDataFrame([(1, 3, 1.0), (2, 2, 1.0), (3, 3, 2.0)], "id long, num_attempts long, average_interarrival_time double")
    assert ids(s.where(predicates.session_filter(automated=True))) == [1]
    assert ids(s.where(predicates.session_filter())) == [1, 2, 3]


def test_distance_arrays(spark):
    rows = [(1, None), (2, []), (3, [0]), (4, [3, 0]), (5, [0, 2, 0]), (6, [None, 0])]
    df = spark.createDataFrame(rows, "id long, a array<int>")
    out = {r.id: (r.p, r.n) for r in df.select("id", prior("a").alias("p"), is_new_password("a").alias("n")).collect()}
    assert out == {1: (None, 1), 2: ([], 1), 3: ([], 1), 4: ([3], 1), 5: ([0, 2], 0), 6: ([None], 1)}


def test_tweak_rules(spark):
    none = [None, None, None]
    rows = [
        (1, [[1.0, 0.0, 5.0]]),  # nothing breached to compare with
        (2, [[9.0, 9.0, None], [2.0, 9.0, 9999.0]]),
        (3, [[9.0, 9.0, None], [0.0, 0.0, 1.0]]),
        (4, [none, none]),
        (5, [[9.0, 9.0, None], [None, None, 1000.0]]),
        (6, [[9.0, 9.0, None], [7.0, 1.0, None]]),
        (7, [[9.0, 9.0, None], [7.0, None, None]]),
        (8, [[1.0, 9.0, None], [9.0, 9.0, None]]),  # the valid password counts for the flag
        (9, [[9.0, 9.0, None], [None, None, 99.0]]),
    ]
    df = spark.createDataFrame(rows, "id long, c array<array<double>>")
    pick = lambda cond: ids(df.where(cond))
    assert pick(tweaks.is_tweaked("c")) == [2, 5, 8, 9]
    assert pick(tweaks.is_tweaking_attempt("c")) == [2, 3, 6]
    assert pick(tweaks.any_match("c", tweaks.INTERESTING_RULE)) == [2, 8, 9]
    assert pick(tweaks.any_match("c", tweaks.INTERESTING_WITH_EXACT_RULE)) == [2, 3, 8, 9]
    assert pick(tweaks.any_match("c", tweaks.USER_RULE)) == [2, 3, 8]
    counts = {r.id: r.n for r in df.select("id", tweaks.num_matches("c", tweaks.HEURISTIC_EDIT).alias("n")).collect()}
    assert counts == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0, 8: 1, 9: 0}
    text = spark.createDataFrame([("[[1, null, 3.5]]",)], "t string")
    assert text.select(tweaks.parse_measurements("t").alias("m")).first().m == [[1.0, None, 3.5]]


def test_ipv4_number(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("255.255.255.255",), ("256.1.1.1",), ("::1",), (None,), ("1.2.3",)], "ip string")
    assert [r.n for r in df.select(ipv4_number("ip").alias("n")).collect()] == [16909060, 4294967295, None, None, None, None]


@pytest.mark.parametrize("slice_seconds", [7, 3600])
def test_order_inside_hot_groups(log, random_attempts, slice_seconds):
    rows = random_attempts()
    a = log(rows)
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
        groups[r["client_ip"], r["at"] // 86400].append(r)
    want_slot = {r["id"]: k + 1 for g in groups.values() for k, r in enumerate(g)}
    want_gap = {r["id"]: (r["at"] - g[k - 1]["at"] if k else None) for g in groups.values() for k, r in enumerate(g)}
    slots = slot_in_day(a, ["client_ip"], slice_seconds=slice_seconds)
    assert {r.id: r.slot for r in slots.collect()} == want_slot
    prev = previous_in_day(a, ["client_ip"], "gap", slice_seconds)
    assert {r.id: r.gap for r in prev.collect()} == want_gap
    found = gaps(a, ["client_ip", "d"], slice_seconds)
    found = found.withColumn("gap", F.explode(F.array_repeat("gap", F.col("n").cast("int"))))
    found = found.groupBy("client_ip", "d").agg(F.sort_array(F.collect_list("gap")).alias("g"))
    got = {(r.client_ip, (r.d - r.d.replace(day=1)).days): r.g for r in found.collect()}
    assert got == {k: sorted(b["at"] - x["at"] for x, b in zip(g, g[1:])) for k, g in groups.items() if len(g) > 1}


@pytest.mark.parametrize("values", [[5.0], [1.0, 1.0, 1.0], None])
def test_order_statistics(spark, values):
    r = random.Random(3)
    values = values or [r.choice([r.random(), float(r.randrange(4)), r.random() * 1e6]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {p.pct: p.value for p in ranks.percentiles(df, F.col("v"), [1, 37, 50, 99, 100]).collect()}
    for pct, value in got.items():
        assert value == pytest.approx(np.percentile(values, pct))
    want = sorted(values, reverse=True)[int((len(values) - 1) * 0.01)]
    assert ranks.descending_element(df, F.col("v"), 0.01, "p").first().p == want


def test_an_outlier_does_not_crowd_the_ranges(spark):
    values = [float(k) for k in range(3000)] + [1e12, -1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = ranks.ranked_values(df, F.col("v")).collect()
    assert sorted((r.value, r.lo, r.hi) for r in rows) == [(v, k, k) for k, v in enumerate(sorted(values))]
    hist = df.select(F.col("v").alias("value"))
    bounds = hist.agg(F.percentile_approx("value", [k / ranks.RANGES for k in range(1, ranks.RANGES)], 10 * ranks.RANGES)).first()[0]
    assert ranks._ranged(hist, bounds).groupBy("rng").count().agg(F.max("count")).first()[0] < 30


def test_a_log_before_any_floor_is_read(spark, log, tmp_path):
    from loginlab.sources import attempts as source

    a = log([{"at": 0}, {"at": 9}]).withColumn("timestamp", F.expr("TIMESTAMP_NTZ'2019-05-01 00:00:00'"))
    a.withColumn("d", F.to_date("timestamp")).write.parquet(str(tmp_path / "old"))
    assert source.read_attempts(spark, str(tmp_path / "old")).count() == 2
    assert source.read_attempts(spark, str(tmp_path / "old"), floor=predicates.LOG_FLOOR).count() == 0


def test_addresses_of_both_families(spark):
    import ipaddress

    from loginlab.functions.columns import address, network_of

    good = ["1.2.3.4", "255.255.255.255", "::", "::1", "2001:db8::ff00:42:8329", "fe80:0:0:0:1:2:3:4", "FFFF:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "::ffff:1.2.3.4", "1::"]
    bad = ["", "1.2.3", "1:2", ":::", "1::2::3", "g::1", "12345::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8:9", None, "::1.2.3"]
    df = spark.createDataFrame([(x, n) for x in good + bad for n in (0, 1, 31, 32, 33, 63, 64, 65, 127, 128)], "ip string, n int")
    bits = address("ip")
    for r in df.select("ip", "n", bits.alias("b"), network_of(bits, F.col("n")).alias("net")).collect():
        if r.ip in bad:
            assert r.b is None
            continue
        x = ipaddress.ip_address(r.ip)
        value = int(x) << (96 if x.version == 4 else 0)
        joined = lambda b: (b.hi % 2**64 << 64) + b.lo % 2**64
        assert (r.b.family, joined(r.b)) == (x.version, value)
        assert joined(r.net) == value >> (128 - r.n) << (128 - r.n)


def test_networks_of_both_families(spark):
    from loginlab.operators import enrich, selection

    ips = ["10.1.2.3", "10.9.9.9", "2001:db8:1::5", "2001:db8:2::5", "fe80::1", "no address", None]
    rows = spark.createDataFrame([(x,) for x in ips], "client_ip string")
    nets = [("10.0.0.0/8", "a"), ("10.1.0.0/17", "b"), ("2001:db8::/32", "c"), ("2001:db8:1::/48", "d"), ("::/0", "e"), ("bad/8", "f")]
    prefixes = spark.createDataFrame([(n, i, "o", "x", "y") for n, i in nets], "network string, isp string, asn_org string, country string, city string")
    got = {r.client_ip: r.isp for r in enrich.ip_networks(rows, prefixes).collect()}
    assert got == dict(zip(ips, ["b", "a", "d", "c", "e", "NA", "NA"]))
    inside = rows.where(selection.in_networks(networks=["10.1.0.0/16", "2001:db8:2::/47"])).collect()
    assert [r.client_ip for r in inside] == ["10.1.2.3", "2001:db8:2::5"]
