"""Figures from daily partials and reachability over heavy usernames."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loginlab.operators import investigate, partials, statistics


@pytest.fixture(scope="module")
def year(spark):
    """A log of a year: 400,000 attempts of some 20,000 users, few of them very busy."""
    n = 400_000
    h = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    rows = spark.range(n).select(
        "id",
        F.concat(F.lit("u"), F.when(h(0, 3) == 0, h(1, 50)).otherwise(h(2, 20_000))).alias("username"),
        F.concat(F.lit("ip"), h(3, 4000)).alias("client_ip"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, pmod(xxhash64(id, 9), 365L * 86400))").alias("timestamp"),
        F.when(h(4, 4) > 0, F.concat(F.lit("agent"), h(5, 7))).alias("user_agent"),
        (h(6, 5) == 0).cast("int").alias("result"),
        *[(h(100 + k, 3) == 0).cast("int").alias(c) for k, c in enumerate(statistics.SUMMED) if c != "result"],
        *[(h(200 + k, 60_000) / 100.0 - 1).alias(c) for k, c in enumerate(statistics.INTERARRIVALS)],
    )
    return rows.withColumn("d", F.to_date("timestamp"))


@pytest.fixture(scope="module")
def stored(year, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("partials"))
    partials.daily(year).write.mode("overwrite").parquet(path)
    return year.sparkSession.read.parquet(path)


def test_counts_sums_and_means_of_a_year_are_exact(year, stored):
    assert stored.count() == 366 or stored.count() == 365
    for start, end in ((None, None), ("2024-03-01", "2024-05-31")):
        part = partials.in_period(stored, start, end)
        rows = partials.in_period(year, start, end)
        assert partials.period_statistics(part).first() == statistics.attempt_statistics(rows).first()
        avg = partials.period_averages(part).first()
        assert avg.avg_attempts == pytest.approx(statistics.average_attempts_per_user_day(rows).first()[0])
        ips = statistics.unique_ips_per_user_day(rows).agg(F.avg("unique_ips")).first()[0]
        assert avg.avg_unique_ips == pytest.approx(ips)
    assert partials.period_averages(partials.in_period(stored, "2030-01-01")).first().avg_attempts is None


@pytest.mark.parametrize("rank", [0.5, 0.9, 0.99])
def test_quantiles_keep_their_bound(year, stored, rank):
    got = partials.period_quantiles(stored, rank).first()
    groups = statistics.attempts_per_user_day(year)
    values = {
        "attempts": groups.select(F.col("attempts").alias("v")),
        "unique_ips": statistics.unique_ips_per_user_day(year).select(F.col("unique_ips").alias("v")),
        **{c: year.where(statistics.short_gap(c)).select(F.col(c).alias("v")) for c in statistics.INTERARRIVALS},
    }
    for name, df in values.items():
        n, below, upto = df.agg(F.count("*"), F.count_if(F.col("v") < got[name]), F.count_if(F.col("v") <= got[name])).first()
        # the ranks that the value takes come within the error of the rank asked for
        assert below / n <= rank + partials.RANK_ERROR and upto / n >= rank - partials.RANK_ERROR, name


def test_distinct_counts_keep_their_bound(year, stored):
    got = partials.period_distinct(stored).first()
    want = year.agg(
        F.count_distinct("username").alias("users"),
        F.count_distinct(F.when(F.col("result") == 1, F.col("username"))).alias("successful_users"),
        F.count_distinct("client_ip").alias("ips"),
    ).first()
    for name in want.asDict():
        assert got[name] == pytest.approx(want[name], rel=partials.COUNT_ERROR), name
    by_ip = partials.period_users_by_ip(partials.daily_by_ip(year))
    true = year.groupBy("client_ip").agg(F.count_distinct("username").alias("true"), F.count("*").alias("n"))
    off = by_ip.join(true, "client_ip").agg(
        F.max(F.abs(F.col("users") / F.col("true") - 1)), F.max(F.abs(F.col("attempts") - F.col("n")))
    ).first()
    assert off[0] <= partials.IP_COUNT_ERROR and off[1] == 0


def plain_reach(tried, start, least, ratio):
    names = defaultdict(dict)
    for ip, user, c, s in tried:
        names[ip][user] = (c, s)
    hops, frontier = {start: 0}, [start]
    while frontier:
        new = set()
        for source in frontier:
            for ip, users in names.items():
                both = [users[u] for u in names[source] if u in users]
                c, s = sum(x for x, _ in both), sum(x for _, x in both)
                if ip not in hops and c >= least and s / c <= ratio:
                    new.add(ip)
        for ip in new:
            hops[ip] = hops[frontier[0]] + 1
        frontier = list(new)
    return hops


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("heavy_from", [3, 8, 1000])
def test_reachability_over_heavy_names(spark, seed, heavy_from):
    r = random.Random(seed)
    tried = {}
    for k in range(60):
        for _ in range(r.randrange(1, 5)):
            user = r.choice(["star", "star", "moon", f"u{r.randrange(30)}"])
            tried[f"ip{k}", user] = (r.randrange(1, 9), 0)
    tried = [(ip, u, c, r.randrange(0, c + 1) if r.random() < 0.4 else 0) for (ip, u), (c, _) in tried.items()]
    rows = [(ip, u, int(k < s)) for ip, u, c, s in tried for k in range(c)]
    attempts = spark.createDataFrame(rows, "client_ip string, username string, result int")
    for least, ratio in ((6, 0.3), (9, 0.2)):
        got = {x.client_ip: x.hop for x in investigate.ip_reachability(attempts, "ip0", least, ratio, heavy_from).collect()}
        assert got == plain_reach(tried, "ip0", least, ratio)


def test_one_username_on_very_many_ips(spark):
    """Every IP tries the same name, and each one that only its neighbour tries too."""
    n = 100_000
    rows = spark.range(n).select("id", F.concat(F.lit("ip"), "id").alias("client_ip"))
    names = F.array(F.lit("star"), F.concat(F.lit("n"), F.col("id")), F.concat(F.lit("n"), F.col("id") + 1))
    attempts = rows.select("client_ip", F.explode(names).alias("username"), F.lit(0).alias("result"))
    few = attempts.where("username = 'star' OR client_ip IN ('ip0', 'ip1', 'ip2')")
    found = investigate.ip_reachability(few, "ip0", 2, 0.5).collect()
    assert {(r.client_ip, r.hop) for r in found} == {("ip0", 0), ("ip1", 1), ("ip2", 2)}
    everyone = attempts.unionByName(attempts.where("username = 'star'"))
    reached = investigate.ip_reachability(everyone, "ip0", 2, 0.5).groupBy("hop").count().collect()
    assert {r.hop: r["count"] for r in reached} == {0: 1, 1: n - 1}
