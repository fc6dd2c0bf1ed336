"""Components, networks, agent rules and blocks of near rows, each against a plain version."""

import ipaddress
import math
import random
import re
from datetime import date

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loginlab.operators import agents, clustering, components, enrich, pairs
from tests.test_campaigns import FIELDS, LSET, linkage_of, make_lsets, sequential_linkage


def plain_components(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def links_of(kind):
    r = random.Random(4)
    names = [f"n{k:05d}" for k in range(12_000)]
    if kind == "chains":  # in no order
        chain = r.sample(names, 10_000)
        return list(zip(chain, chain[1:])) + list(zip(names[:5], names[:5]))
    if kind == "half in one star":
        return [("n00777", n) for n in names[:6000] if n != "n00777"] + [(n, names[k + 1]) for k, n in enumerate(names[6000:-1:2], 6000)]
    return [tuple(r.sample(names, 2)) for _ in range(5000)] * 2


@pytest.mark.parametrize("kind", ["chains", "half in one star", "random"])
@pytest.mark.parametrize("per_task", [1_000_000, 3000])
def test_components(spark, kind, per_task):
    links = links_of(kind)
    df = spark.createDataFrame([*links, (None, "n00001")], "a string, b string").repartition(6)
    got = {r.node: r.component for r in components.components(df, per_task).collect()}
    want = plain_components([(a, b) for a, b in links if a != b])
    assert got == want


def test_components_of_nothing_and_of_numbers(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert components.components(none).isEmpty()
    some = spark.createDataFrame([(5, 3), (3, 5), (7, 7), (-1, 8)], "a long, b long")
    assert {tuple(r) for r in components.components(some, 1).collect()} == {(5, 3), (3, 3), (-1, -1), (8, -1)}


@pytest.mark.parametrize("most_members", [0, 5, 2000])
def test_whole_components_and_rounds_agree(spark, most_members):
    """Two groups apart, one of them small; no equal distances."""
    r = random.Random(11)
    names = [f"n{k:02d}" for k in range(20)]
    group = {n: int(k < 4) for k, n in enumerate(names)}
    dist = {}
    for k, x in enumerate(names):
        for y in names[k + 1 :]:
            dist[x, y] = r.uniform(0.05, 0.6) if group[x] == group[y] else 0.9
    want, heights = sequential_linkage(names, dist, 0.35)
    every = spark.createDataFrame([(*k, v) for k, v in dist.items()], "i string, j string, dist double")
    asked = []

    def distances(missing):
        asked.append(missing.count())
        return missing.join(every, ["i", "j"])

    history = clustering.average_linkage(every.where("dist < 0.4"), 0.4, distances, 0.35, most_members)
    ids = spark.createDataFrame([(n,) for n in names], "id string")
    assert {m.id: m.cluster for m in clustering.members(history, ids).collect()} == want
    assert sorted(h.height for h in history.collect()) == pytest.approx(sorted(heights))
    assert asked and max(asked) < len(dist)


def test_ties_merge_by_name(spark):
    names = [f"n{k}" for k in range(6)]
    dist = {(x, y): 0.25 for k, x in enumerate(names) for y in names[k + 1 :]}
    history = linkage_of(spark, dist, 0.4)
    assert [(h.a, h.b, h.size) for h in history.orderBy("size").collect()] == [("n0", f"n{k}", k + 1) for k in range(1, 6)]


def test_networks_against_trying_all(spark):
    r = random.Random(8)

    def some(bits, family):
        base = r.choice([10 << (bits - 8), 203 << (bits - 8), 0x2001 << max(0, bits - 16) if family == 6 else 7 << 24])
        return (base + r.getrandbits(r.choice([bits // 4, bits // 2, bits - 8]))) % 2**bits

    rows = [("0.0.0.0/0", "all"), ("10.0.0.0/8", "b"), ("10.0.0.0/8", "a"), ("10.0.0.0/16", "c"), ("255.255.255.255/32", "last")]
    for family, bits in ((4, 32), (6, 128)):
        for k in range(60):
            n = r.randrange(1, bits + 1)
            net = ipaddress.ip_network((some(bits, family), n), strict=False)
            rows.append((str(net), f"isp{family}{k}"))
    ips = [str(ipaddress.ip_address(some(b, f))) if f == 4 else str(ipaddress.IPv6Address(some(b, f))) for f, b in ((4, 32), (6, 128)) for _ in range(150)]
    inside = [ipaddress.ip_network(n) for n, _ in rows]
    ips += [str(n[r.randrange(min(n.num_addresses, 2**20))]) for n in inside] + [str(n[-1]) for n in inside] + ["10.0.0.1", "no address", "255.255.255.255"]
    prefixes = spark.createDataFrame([(n, i, "o", "c", "t") for n, i in rows] + [("bad/99", "x", "o", "c", "t")], "network string, isp string, asn_org string, country string, city string")
    got = {x.client_ip: (x.network, x.isp) for x in enrich.ip_networks(spark.createDataFrame([(i,) for i in ips] + [(None,)], "client_ip string").repartition(5), prefixes).collect()}
    for ip in set(ips):
        want = ("NA", "NA")
        if ip != "no address":
            a = ipaddress.ip_address(ip)
            fits = [(-ipaddress.ip_network(n).prefixlen, n, i) for n, i in rows if ipaddress.ip_network(n).version == a.version and a in ipaddress.ip_network(n)]
            if fits:
                want = min(fits)[1:]
        assert got[ip] == want, ip
    assert got[None] == ("NA", "NA")
    none = enrich.ip_networks(spark.createDataFrame([("10.0.0.1",)], "client_ip string"), prefixes.limit(0)).first()
    assert none.network == "NA"


def random_rules(n, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgXYZ/ ", k=r.randrange(2, 7)))
    out = []
    for _ in range(n):
        a, b = re.escape(word()), re.escape(word())
        pattern = r.choice([a, f"{a}.*{b}", f"(?:{a}|{b})", f"(?i){a}", f"{a}([0-9.]+)?", f"[{word()[0]}x]{a}+", f"^{a}", f"({a})?{b}"])
        out.append((r.choice(["os", "browser", "device"]), r.randrange(n // 2), pattern, word(), r.choice([None, f"{a}([0-9]+)"])))
    out.append(("os", n, "[0-9]", "digits", None))  # no literal
    return out


def first_matches(rules, agent):
    out = {}
    for kind, _, pattern, name, version in sorted(rules, key=lambda r: (r[0], r[1], r[2], r[3])):
        if kind not in out and re.search(pattern, agent):
            found = re.search(version, agent) if version else None
            out[kind] = (name, found[1] if found else "")
    return out


def test_a_thousand_rules_against_trying_all(spark, monkeypatch):
    rules = random_rules(1000)
    r = random.Random(6)
    made = [re.sub(r"[\\^$.*+?()|\[\]]", "", x[2]).replace("?i", "") for x in rules]
    texts = ["".join(r.sample(made, r.randrange(1, 6))) + str(r.randrange(99)) for _ in range(120)] + ["", "Kſ 7"]
    matcher = agents.Matcher(rules)
    for t in texts:
        assert {m[0]: m[3:] for m in matcher.match(t)} == first_matches(rules, t)
    assert matcher.tried < 0.2 * len(rules) * len(texts)
    monkeypatch.setattr(agents, "RULES_AT_ONCE", 300)
    table = spark.createDataFrame(rules + rules[:5] + [(None, 1, "a", "b", None)], agents.FIELDS)
    logs = spark.createDataFrame([(t,) for t in texts] * 2 + [(None,)], "user_agent string")
    got: dict = {}
    for x in agents.classify(logs, table).collect():
        got.setdefault(x.user_agent, {})[x.kind] = (x.name, x.version)
    assert got == {t: m for t in texts if (m := first_matches(rules, t))}


@pytest.mark.parametrize(
    "pattern, needed",
    [("Chrome/", {"chrome/"}), ("Edg(?:e|A|iOS)?/", {"edg"}), ("Windows NT|X11", {"windows nt", "x11"}), ("a?b*", set()), ("(?:abc)+d", {"abc"}), ("x{0,3}", set()), ("É", set())],
)
def test_needed_literals(pattern, needed):
    assert agents.needed_literals(pattern) == needed


def test_rules_and_missing_agents(spark):
    logs = spark.createDataFrame([("curl/8.0",), ("strange",), (None,)], "user_agent string")
    got = {r.user_agent: tuple(r)[1:] for r in agents.user_agent_dimension(logs, agents.rule_table(spark)).collect()}
    assert got == {"curl/8.0": ("Other", "unknown", "curl", "8.0"), "strange": ("Other", "unknown", "Other", "")}
    with pytest.raises(re.error):
        agents.classify(logs, spark.createDataFrame([("os", 1, "(", "x", None)], agents.FIELDS))


def campaign_day(n, seed=1):
    """Rows of one day: campaigns of 20 rows that are alike, of very different sizes, from different places."""
    out = []
    for k, row in enumerate(make_lsets(n, seed)):
        g = random.Random(k // 20)
        scale = 10 ** g.uniform(1, 6)
        out.append(
            row
            | dict(
                id=f"r{k:06d}", client_ip=f"ip{k}", network=f"net{k}", ISP=f"isp{k}", DATE=date(2024, 1, 1), NR=int(scale * 10),
                NU=int(10 ** g.uniform(0, 5)) + 1, AUPPU=10 ** g.uniform(0, 4), MIT_Mean=10 ** g.uniform(0, 5), SIT=10 ** g.uniform(0, 5),
                zxcvbn_0=g.randrange(1, 100), zxcvbn_1=g.randrange(1, 10**6), FPIB=0.0, FTP=0.0, FF=1.0, FVU=g.random(),
                FNUA=0.0, NUA=1, os_json_cnt={"Linux": 1}, browser_json_cnt={"Firefox": 1},
            )
        )
    return out


def test_compared_pairs_do_not_grow_with_the_square_of_a_day(spark):
    compared, near = {}, {}
    for n in (2000, 20_000):
        rows = spark.createDataFrame([tuple(p[c] for c in FIELDS) for p in campaign_day(n)], LSET)
        home = pairs.in_blocks(rows, 0.28, True, 100)
        met = pairs.block_pairs(home, 0.28, True)
        compared[n] = met.where("_kind = 3").agg(F.sum(F.col("_rows") * F.col("_other_rows"))).first()[0]
        near[n] = n // 20 * (20 * 19 // 2)
    # ten times the rows: ten times the near pairs, a hundred times all pairs
    assert compared[20_000] < 40 * compared[2000]
    assert compared[20_000] < 0.1 * 20_000**2


def test_small_blocks_are_compared_together(spark, monkeypatch):
    from loginlab.operators import blocks

    lsets = campaign_day(60)
    rows = spark.createDataFrame([tuple(p[c] for c in FIELDS) for p in lsets], LSET)
    names = spark.createDataFrame([(p["id"], u) for p in lsets for u in p["names"]], "id string, username string")
    home = pairs.in_blocks(rows, 0.4, True, 4)
    met = pairs.block_pairs(home, 0.4, True).select("_kind", "_rows", "_other_rows").collect()
    lists = lambda c: pa.array([[{"id": ""}] * r[c] for r in met])
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r._kind for r in met], pa.int32()), lists("_rows"), lists("_other_rows")], ["_kind", "_rows_a", "_rows_b"]
    )
    together = list(blocks._together(batch))
    assert len(met) > 20 and len(together) == len({r._kind for r in met})
    assert sorted(n for _, chosen in together for n in chosen) == list(range(len(met)))
    near = {(r.i, r.j): r.dist for r in pairs.near_pairs(rows, names, 0.4, rows_per_block=4).collect()}
    one = {(r.i, r.j): r.dist for r in pairs.near_pairs(rows, names, 0.4, rows_per_block=10_000).collect()}
    assert near.keys() == one.keys() and len(one) > 10
    assert all(abs(near[k] - one[k]) < 1e-12 for k in one)


def test_blocks_lose_no_pair(spark):
    lsets = campaign_day(300)
    rows = spark.createDataFrame([tuple(p[c] for c in FIELDS) for p in lsets], LSET)
    names = spark.createDataFrame([(p["id"], u) for p in lsets for u in p["names"]], "id string, username string")
    few = {(r.i, r.j) for r in pairs.near_pairs(rows, names, 0.3, rows_per_block=10).collect()}
    one = {(r.i, r.j) for r in pairs.near_pairs(rows, names, 0.3, rows_per_block=10_000).collect()}
    assert few == one and len(one) > 1000


def test_rows_of_one_address_are_compared_in_blocks_with_their_usernames(spark, monkeypatch):
    """Blocks and long lists of usernames change nothing, and no row per pair and username is made."""
    lsets = [p | dict(client_ip="one", NU=len(p["names"])) for p in make_lsets(60, 5)]
    for k, p in enumerate(lsets):
        p["id"] = f"r{k:03d}"
    rows = spark.createDataFrame([tuple(p[c] for c in FIELDS) for p in lsets], LSET)
    names = spark.createDataFrame([(p["id"], u) for p in lsets for u in p["names"]] + [("r000", None)], "id string, username string")

    def found(**given):
        near = pairs.near_pairs(rows, names, 0.4, **given)
        return {(r.i, r.j): (r.shared_usernames, round(r.dist, 9)) for r in near.collect()}

    asked = spark.createDataFrame([(f"r{i:03d}", f"r{j:03d}") for j in range(60) for i in range(j)], "i string, j string")
    every = {(r.i, r.j): round(r.dist, 9) for r in pairs.distances_of(asked, rows, names).collect()}
    sets = {p["id"]: set(p["names"]) for p in lsets}
    expected = {k: (len(sets[k[0]] & sets[k[1]]), d) for k, d in every.items() if d < 0.4}
    joined = []
    real = pairs._with_usernames
    monkeypatch.setattr(pairs, "_with_usernames", lambda c, *a: joined.append(c.count()) or real(c, *a))
    assert found() == found(rows_per_block=7) == expected and len(expected) > 20
    assert joined == [0, 0]
    monkeypatch.setattr(pairs, "MOST_NAMES", 3)
    assert found(rows_per_block=7) == expected and joined[-1] > 0


def test_near_pairs_get_their_parts_where_they_are_compared(spark, monkeypatch):
    """The wide feature rows are not joined to the pairs; null and infinite values count as in the column expressions."""
    lsets = make_lsets(50, 7, close=True)
    for k, p in enumerate(lsets):
        if k % 7 == 0:
            p.update(os_json_cnt=None, MIT_Mean=None, NUA=None)
        if k % 11 == 0:
            p.update(SIT=math.inf, browser_json_cnt=None)
        if k % 13 == 0:
            p.update(FTP=None, AUPPU=None, ISP=None, zxcvbn_0=None)
    rows = spark.createDataFrame([tuple(p[c] for c in FIELDS) for p in lsets], LSET)
    names = spark.createDataFrame([(p["id"], u) for p in lsets for u in p["names"]], "id string, username string")
    real, joined = pairs._with_parts, []
    for passwords in (True, False):
        ids = sorted(p["id"] for p in lsets)
        asked = [(i, j) for j in ids for i in ids if i < j]
        asked = spark.createDataFrame(asked, "i string, j string")
        every = pairs._with_usernames(real(asked, rows, passwords, True), names, passwords).where("dist < 0.35").collect()
        monkeypatch.setattr(pairs, "_with_parts", lambda p, *a: joined.append(p.count()) or real(p, *a))
        found = pairs.near_pairs(rows, names, 0.35, passwords, 7).collect()
        monkeypatch.setattr(pairs, "_with_parts", real)
        plain = lambda r: {c: v if isinstance(v, str) else pytest.approx(v) for c, v in r.asDict().items()}
        assert {(r.i, r.j): r.asDict() for r in found} == {(r.i, r.j): plain(r) for r in every}
        assert len(every) > 20
    assert joined == [0, 0]
