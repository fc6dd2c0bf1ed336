import math
import random
from datetime import date, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loginlab.functions import distance
from loginlab.operators import campaigns, clustering, pairs

LSET = """id string, client_ip string, network string, ISP string, DATE date, MIT_Mean double, SIT double,
FPIB double, FTP double, FNUA double, NUA long, FF double, FVU double, zxcvbn_0 long, zxcvbn_1 long,
NR long, NU long, AUPPU double, os_json_cnt map<string,bigint>, app_json_cnt map<string,bigint>,
browser_json_cnt map<string,bigint>"""
FIELDS = [c.split()[0] for c in LSET.replace("\n", " ").split(", ")]


def make_lsets(n, seed, close=False):
    r = random.Random(seed)
    out = []
    for k in range(n):
        # two thirds share one ISP and day range: a hot block
        net = r.choice([0, 0, 0, 0, 1, 2])
        day = r.randrange(2 if close else 6)
        names = {f"u{r.randrange(8)}" for _ in range(r.randrange(1, 6))}
        os_ = {o: r.randrange(1, 5) for o in r.sample(["Linux", "iOS", "Windows"], r.randrange(3))}
        out.append(
            dict(
                id=f"10.{net}.0.{k % 7}|{k:03d}",
                client_ip=f"10.{net}.0.{k % 7}",
                network=f"10.{net}.0.0/24" if net else "NA",
                ISP=r.choice(["A", "B"]) if net else "NA",
                DATE=date(2024, 1, 1) + timedelta(days=day),
                MIT_Mean=float(r.randrange(4)),
                SIT=float(r.randrange(3)),
                FPIB=r.choice([-1.0, 0.0, 0.2, 0.7]),
                FTP=r.choice([0.0, 0.5]),
                FNUA=r.choice([0.0, 0.3]),
                NUA=r.randrange(3),
                FF=r.choice([0.9, 1.0]),
                FVU=r.random(),
                zxcvbn_0=r.randrange(3),
                zxcvbn_1=r.randrange(3),
                NR=r.choice([10, 12, 500]),
                NU=len(names),
                AUPPU=r.choice([0.0, 1.0, 2.5]),
                os_json_cnt=os_,
                app_json_cnt={},
                browser_json_cnt=os_,
                names=names,
            )
        )
    return out


def ratio(x, y):
    return (x - y) / (x + y) if x + y else 0.0


def plain_distance(p, q):
    ip = next(
        (v for c, v in (("client_ip", 0.0), ("network", 1 - math.exp(-1)), ("ISP", 1 - math.exp(-2))) if p[c] == q[c]),
        1.0,
    )
    day = 1 - math.exp(-abs((p["DATE"] - q["DATE"]).days))
    agents = 0.0
    for m in ("os_json_cnt", "app_json_cnt", "browser_json_cnt"):
        keys = set(p[m]) | set(q[m])
        if keys:
            agents += sum(
                abs(p[m].get(k, 0) - q[m].get(k, 0)) / max(p[m].get(k, 0), q[m].get(k, 0)) for k in keys
            ) / len(keys)
    agents = (agents + abs(ratio(p["FNUA"], q["FNUA"])) + abs(ratio(p["NUA"], q["NUA"]))) / 5
    breach = sum(ratio(max(p[c], 0), max(q[c], 0)) for c in ("FPIB", "FTP")) / 2
    weak = [x["zxcvbn_0"] / (x["zxcvbn_0"] + x["zxcvbn_1"]) if x["zxcvbn_0"] + x["zxcvbn_1"] else 0 for x in (p, q)]
    inner = (
        sum(abs(ratio(p[c], q[c])) for c in ("MIT_Mean", "SIT")) / 2
        + breach
        + agents
        + sum(abs(ratio(p[c], q[c])) for c in ("FF", "FVU")) / 2
        + 1 - len(p["names"] & q["names"]) / len(p["names"] | q["names"])
        + abs(ratio(*weak))
        + sum(abs(ratio(p[c], q[c])) for c in ("NR", "NU", "AUPPU"))
    )
    return 0.25 * ip + 0.25 * day + 0.5 / 9 * inner


@pytest.fixture(scope="module")
def frames(spark):
    def build(lsets):
        rows = spark.createDataFrame([tuple(p[c] for c in FIELDS) for p in lsets], LSET)
        names = spark.createDataFrame([(p["id"], u) for p in lsets for u in p["names"]], "id string, username string")
        return rows, names

    return build


@pytest.mark.parametrize("limit,seed", [(0.4, 1), (0.3, 2), (0.2, 3)])
def test_near_pairs_miss_nothing(frames, limit, seed):
    lsets = make_lsets(60, seed, close=limit < 0.4)
    rows, names = frames(lsets)
    want = {}
    for p, q in combinations(sorted(lsets, key=lambda x: x["id"]), 2):
        dist = plain_distance(p, q)
        if dist < limit:
            want[p["id"], q["id"]] = dist
    # a few rows per block: every hot key is split
    found = pairs.near_pairs(rows, names, limit, rows_per_block=3).collect()
    assert len(found) == len({(r.i, r.j) for r in found})
    assert {(r.i, r.j): pytest.approx(r.dist) for r in found} == want
    assert want


def test_large_limits_are_refused(frames):
    rows, names = frames(make_lsets(3, 1))
    with pytest.raises(ValueError):
        pairs.near_pairs(rows, names, 0.49)
    with pytest.raises(ValueError):
        pairs.near_pairs(rows, names, 0.9)


def test_distance_of_equal_rows(frames):
    p = make_lsets(1, 9)[0] | {"MIT_Mean": 0.0, "SIT": 0.0, "zxcvbn_0": 0, "zxcvbn_1": 0}
    rows, _ = frames([p])
    both = rows.alias("a").join(rows.alias("b"), F.col("a.id") == F.col("b.id"))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    parts = both.select(*[c.alias(n) for n, c in distance.parts(a, b).items()]).first()
    assert all(v == 0 for v in parts)


def test_parts_are_symmetric_but_for_breach(frames):
    rows, _ = frames(make_lsets(12, 10))
    both = rows.alias("a").join(rows.alias("b"), F.col("a.id") < F.col("b.id"))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    for x, y in zip(
        both.select(*[c.alias(n) for n, c in distance.parts(a, b).items()]).collect(),
        both.select(*[c.alias(n) for n, c in distance.parts(b, a).items()]).collect(),
    ):
        for name, value in x.asDict().items():
            sign = -1 if name == "dist_breach" else 1
            assert value == pytest.approx(sign * y[name])
            assert -1 <= value <= (3 if name == "dist_volume" else 1)


def test_unknown_networks(frames):
    p, q = make_lsets(2, 11)
    rows, _ = frames([p | {"client_ip": "1.1.1.1", "network": "NA", "ISP": "x"}, q | {"client_ip": "2.2.2.2", "network": "NA", "ISP": "y"}])
    both = rows.alias("a").join(rows.alias("b"), F.col("a.id") < F.col("b.id"))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    got = both.select(distance.dist_ip(a, b).alias("x"), distance.dist_ip(a, b, missing_matches=False).alias("y")).first()
    assert (got.x, got.y) == (pytest.approx(1 - math.exp(-1)), 1.0)


def sequential_linkage(names, dist, threshold):
    """Merges the closest two clusters until none is below the threshold."""
    clusters = {n: [n] for n in names}
    heights = []
    while len(clusters) > 1:
        def mean(x, y):
            d = [dist[min(p, q), max(p, q)] for p in clusters[x] for q in clusters[y]]
            return sum(d) / len(d)

        h, x, y = min((mean(x, y), x, y) for x, y in combinations(sorted(clusters), 2))
        if h >= threshold - 1e-12:
            break
        clusters[x] += clusters.pop(y)
        heights.append(h)
    return {m: x for x, ms in clusters.items() for m in ms}, heights


def linkage_of(spark, dist, limit, threshold=None):
    """Linkage that is told the distances under the limit and looks the others up."""
    every = spark.createDataFrame([(*k, v) for k, v in dist.items()], "i string, j string, dist double")
    return clustering.average_linkage(
        every.where(F.col("dist") < limit), limit, lambda asked: asked.join(every, ["i", "j"]), threshold
    )


@pytest.mark.parametrize("limit,threshold,seed", [(1.0, 1.0, 1), (0.45, 0.4, 2), (0.35, 0.35, 3), (0.25, 0.2, 4)])
def test_average_linkage_counts_true_distances(spark, limit, threshold, seed):
    r = random.Random(seed)
    names = [f"n{k:02d}" for k in range(24)]
    spots = {n: (r.random(), r.random()) for n in names}
    # no metric: far pairs inside near groups
    dist = {(x, y): min(math.dist(spots[x], spots[y]) / 1.5 + r.choice([0, 0, 0.3]), 0.99) for x, y in combinations(names, 2)}
    want, heights = sequential_linkage(names, dist, threshold)
    ids = spark.createDataFrame([(n,) for n in names], "id string")
    history = linkage_of(spark, dist, limit, threshold)
    got = {m.id: m.cluster for m in clustering.members(history, ids).collect()}
    assert got == want
    assert sorted(h.height for h in history.collect()) == pytest.approx(sorted(heights))
    # the tree up to the limit, cut at the threshold, gives the same clusters
    tree = linkage_of(spark, dist, limit)
    assert {m.id: m.cluster for m in clustering.members(tree, ids, threshold).collect()} == want


def test_thresholds_above_the_limit_are_refused(spark):
    with pytest.raises(ValueError):
        linkage_of(spark, {("a", "b"): 0.1}, 0.3, 0.4)
    near = spark.createDataFrame([("a", "b", 0.1)], "i string, j string, dist double")
    with pytest.raises(ValueError):
        clustering.connected_campaigns(near, near.selectExpr("i AS id"), 0.4, 0.3)


def test_equal_distances_take_few_rounds(spark):
    names = [f"n{k:03d}" for k in range(80)]
    history = linkage_of(spark, {p: 0.25 for p in combinations(names, 2)}, 0.4).collect()
    assert len(history) == 79 and len({h.round for h in history}) < 25


@pytest.mark.parametrize("passwords,missing", [(False, True), (True, False)])
def test_near_pairs_variants(frames, passwords, missing):
    lsets = make_lsets(40, 5, close=True)
    rows, names = frames(lsets)
    ids = sorted(p["id"] for p in lsets)
    all_pairs = rows.sparkSession.createDataFrame(list(combinations(ids, 2)), "i string, j string")
    true = {(r.i, r.j): r.dist for r in pairs.distances_of(all_pairs, rows, names, passwords, missing).collect()}
    found = pairs.near_pairs(rows, names, 0.3, passwords, 3, missing).collect()
    assert {(r.i, r.j): pytest.approx(r.dist) for r in found} == {k: v for k, v in true.items() if v < 0.3}
    assert found


def test_true_distances(frames):
    lsets = make_lsets(20, 6)
    rows, names = frames(lsets)
    want = {(p["id"], q["id"]): plain_distance(p, q) for p, q in combinations(sorted(lsets, key=lambda x: x["id"]), 2)}
    asked = rows.sparkSession.createDataFrame(list(want), "i string, j string")
    assert {(r.i, r.j): pytest.approx(r.dist) for r in pairs.distances_of(asked, rows, names).collect()} == want


def test_connected_campaigns(spark):
    # a long chain, a star and a loner; the far link does not count
    links = [(f"c{k:02d}", f"c{k + 1:02d}", 0.1) for k in range(30)]
    links += [("h0", f"h{k}", 0.2) for k in range(1, 6)] + [("c00", "h0", 0.9)]
    names = sorted({x for i, j, _ in links for x in (i, j)} | {"lone"})
    df = spark.createDataFrame(links, "i string, j string, dist double")
    ids = spark.createDataFrame([(n,) for n in names], "id string")
    got = {r.id: r.cluster for r in clustering.connected_campaigns(df, ids, 0.5).collect()}
    assert got == {n: "lone" if n == "lone" else ("c00" if n[0] == "c" else "h0") for n in names}


def test_knee_of_a_convex_curve(spark):
    heights = [0.01 * k for k in range(1, 41)] + [0.4 + 0.15 * k for k in range(1, 5)]
    rows = [(0, "a", f"b{k}", h, 2) for k, h in enumerate(heights)]
    history = spark.createDataFrame(rows, "round int, a string, b string, height double, size long")
    ids = spark.createDataFrame([(f"x{k}",) for k in range(45)], "id string")
    knee = clustering.cut_threshold(history, ids).first()
    assert 0.3 < knee.threshold < 0.6
    assert knee.clusters == 45 - sum(h < knee.threshold - 1e-9 for h in heights)
    # a curve that only bends at its end has no knee there
    straight = spark.createDataFrame([(0, "a", f"b{k}", 0.01 * k, 2) for k in range(1, 40)], history.schema)
    assert clustering.cut_threshold(straight, ids).count() == 0
    flat = history.where("height < 0.015")
    assert clustering.cut_threshold(flat, ids).count() == 0


def test_campaign_statistics(spark):
    labelled = spark.createDataFrame(
        [
            ("a", "x", "1.1.1.1", "I", date(2024, 1, 1), 10, 2, 0.5, 1.0, -1.0, 3.0),
            ("b", "x", "1.1.1.1", "I", date(2024, 1, 2), 30, 2, 1.0, 0.0, 0.5, 1.0),
            ("c", "y", "2.2.2.2", None, date(2024, 1, 2), 5000, 1, 0.9, 0.0, -1.0, 24.0),
            ("e", "z", "2.2.2.2", None, date(2024, 1, 2), 4999, 1, 0.9, 0.0, -1.0, 24.0),
        ],
        "id string, cluster_id string, client_ip string, ISP string, DATE date, NR long, NU long, FF double, FPIB double, FSPIB double, AUPPU double",
    )
    for c in ("FVU", "FTP", "FUIB", "FCIB", "FICIB", "FNUA"):
        labelled = labelled.withColumn(c, F.lit(0.25))
    labelled = labelled.withColumn("zxcvbn_0", F.lit(1)).withColumn("zxcvbn_1", F.lit(2))
    names = spark.createDataFrame(
        [("a", "p", 1), ("a", "q", 0), ("b", "p", 0), ("b", "r", 1), ("c", "p", 0), ("e", "p", 0)],
        "id string, username string, successes long",
    )
    known = spark.createDataFrame([("p",), ("p",), ("s",)], "netid string")
    stats = {r.cluster_id: r for r in campaigns.campaign_stats(labelled, names, known).collect()}
    x = stats["x"]
    assert (x.NR, x.NU, x.IPs, x.ISPs, x.DATES_active, x.num_lsets) == (40, 3, 1, 1, 2, 2)
    assert (x.comp_users, x.uniq_comp_users) == (2, 1)
    assert (x.FPIB, x.FSPIB, x.AUPPU, x.FF) == (0.25, 0.375, 2.0, 0.75)
    assert stats["y"].uniq_comp_users == 0
    flagged = {r.cluster_id: r.uniq_comp_users for r in campaigns.flagged_users(labelled, names, known).collect()}
    assert flagged == {"x": 1, "y": 0, "z": 0}
    # exactly 5000 attempts count, exactly 24 passwords per user do not
    big = campaigns.attack_campaigns(campaigns.campaign_stats(labelled, names, known)).collect()
    assert [r.cluster_id for r in big] == ["y"]
