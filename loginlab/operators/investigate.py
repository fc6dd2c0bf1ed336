"""Tables for looking into single IPs, users and groups of IPs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loginlab.functions.columns import is_new_password, prior, share
from loginlab.functions.ordering import slot_in_day
from loginlab.operators import detectors, features, statistics
from loginlab.operators.enrich import NETWORK_COLUMNS, ip_networks
from loginlab.operators.flags import password_labels, password_origins
from loginlab.sources.attempts import materialize

IP_DAY = ["client_ip", "d"]


def usernames_for_ip(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("client_ip", "username").agg(F.count("*").alias("attempts"))


def successful_usernames_for_ip(attempts: DataFrame) -> DataFrame:
    """Distinct successful users of every IP with their successes, as rows."""
    return (
        attempts.where("result = 1")
        .groupBy("client_ip", "username")
        .agg(F.count("*").alias("successes"))
    )


def _ip_users(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("client_ip", "username").agg(
        F.count("*").alias("c"), F.sum("result").alias("s")
    )


def connecting_ips(
    attempts: DataFrame, ip: str, min_attempts: int | None = None, max_ratio: float | None = None
) -> DataFrame:
    """IPs that tried a username this IP tried, with attempts and successes on the
    shared usernames."""
    pairs = _ip_users(attempts)
    names = pairs.where(F.col("client_ip") == ip).select("username")
    found = (
        pairs.join(names, "username", "left_semi")
        .groupBy("client_ip")
        .agg(F.sum("c").alias("attempts"), F.sum("s").alias("successes"))
    )
    if min_attempts is None and max_ratio is None:
        return found
    return found.where(
        (F.col("attempts") >= (min_attempts or 0))
        & (share(F.col("successes"), F.col("attempts")) <= (1.0 if max_ratio is None else max_ratio))
    )


HEAVY = 1000  # IPs of a username from which it is not paired IP by IP


def ip_reachability(
    attempts: DataFrame, ip: str, min_attempts: int = 100, max_ratio: float = 0.1, heavy_from: int = HEAVY
) -> DataFrame:
    """IPs reachable from ``ip`` by following :func:`connecting_ips`, with the hop
    at which each was reached.

    Only IPs with enough attempts overall can be reached, so the others are left
    out first. Each round looks at new IPs only and is written out. Usernames tried from more than
    ``heavy_from`` IPs give no row per pair of IPs: IPs that share the same of them are looked at as one.
    """
    spark = attempts.sparkSession
    pairs = materialize(_ip_users(attempts), "ip_users")
    large = pairs.groupBy("client_ip").agg(F.sum("c").alias("n")).where(F.col("n") >= min_attempts)
    targets = materialize(
        pairs.join(large.select("client_ip"), "client_ip", "left_semi"), "targets"
    )
    heavy = pairs.groupBy("username").agg(F.count("*").alias("n")).where(F.col("n") > heavy_from)
    heavy = materialize(heavy.select("username"), "heavy")
    some_heavy = not heavy.isEmpty()
    visited = spark.createDataFrame([(ip, 0)], "client_ip string, hop int")
    frontier, hop = visited.select("client_ip"), 0
    while True:
        hop += 1
        names = pairs.join(frontier, "client_ip", "left_semi").select(
            F.col("client_ip").alias("source"), "username"
        )
        unseen = targets.join(visited, "client_ip", "left_anti")
        # the attempts on the names of all new IPs together bound those of each one
        possible = (
            unseen.join(names.select("username").distinct(), "username", "left_semi")
            .groupBy("client_ip")
            .agg(F.sum("c").alias("c"))
            .where(F.col("c") >= min_attempts)
            .select("client_ip")
        )
        unseen = unseen.join(possible, "client_ip", "left_semi")
        sums = _shared_sums(unseen, names, heavy) if some_heavy else _pair_sums(unseen, names)
        found = (
            sums.where(F.col("c") >= min_attempts)
            .where(share(F.col("s"), F.col("c")) <= max_ratio)
            .select("client_ip")
            .distinct()
        )
        found = materialize(found, "found")
        if found.isEmpty():
            return visited
        visited = visited.unionByName(found.withColumn("hop", F.lit(hop)))
        frontier = found


def _pair_sums(targets: DataFrame, names: DataFrame) -> DataFrame:
    """Attempts ``c`` and successes ``s`` of every target on the names of each source, as far as they share any."""
    return (
        targets.join(names, "username")
        .groupBy("source", "client_ip")
        .agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    )


def _shared_sums(targets: DataFrame, names: DataFrame, heavy: DataFrame) -> DataFrame:
    """The different values of :func:`_pair_sums` for each target.

    What two IPs share of heavy names depends on the set of heavy names of the source only, so it is summed once for
    every such set. Pairs that share light names are listed and get the sum of their set added. A target has the sum
    of a set alone if more sources have the set than share light names with it.
    """
    is_heavy = lambda df, how: df.join(heavy, "username", how)
    of_source = materialize(is_heavy(names, "left_semi"), "heavy_names")
    # a set is recognised by its size and two sums of hashes
    hashes = [F.xxhash64("username", F.lit(k)).cast("decimal(20,0)") for k in range(2)]
    sets = of_source.groupBy("source").agg(
        F.struct(F.count("*").alias("n"), *[F.sum(h).alias(f"h{k}") for k, h in enumerate(hashes)]).alias("set")
    )
    sets = materialize(sets, "sets")
    kinds = sets.groupBy("set").agg(F.min("source").alias("source"), F.count("*").alias("sources"))
    in_set = of_source.join(kinds, "source").select("set", "username")
    by_set = is_heavy(targets, "left_semi").join(in_set, "username").groupBy("set", "client_ip")
    by_set = by_set.agg(F.sum("c").alias("hc"), F.sum("s").alias("hs"))
    by_set = materialize(by_set.join(kinds.select("set", "sources"), "set"), "by_set")
    light = _pair_sums(is_heavy(targets, "left_anti"), is_heavy(names, "left_anti"))
    light = materialize(light.join(sets, "source", "left"), "light")
    both = light.join(by_set, ["set", "client_ip"], "left").select(
        "client_ip",
        (F.col("c") + F.coalesce("hc", F.lit(0))).alias("c"),
        (F.col("s") + F.coalesce("hs", F.lit(0))).alias("s"),
    )
    met = light.where("set IS NOT NULL").groupBy("set", "client_ip").agg(F.count("*").alias("met"))
    alone = by_set.join(met, ["set", "client_ip"], "left").where(F.col("sources") > F.coalesce("met", F.lit(0)))
    return both.unionByName(alone.select("client_ip", F.col("hc").alias("c"), F.col("hs").alias("s")))


def user_last_distances(attempts: DataFrame) -> DataFrame:
    """For users with several attempts from an IP on a day: the distances of the
    last one."""
    last = F.max_by("distance_from_submissions_by_username", F.struct("timestamp", "id"))
    return (
        attempts.groupBy(*IP_DAY, "username")
        .agg(F.count("*").alias("attempts"), last.alias("distances"))
        .where("attempts > 1")
        .drop("attempts")
    )


def ip_last_distances(attempts: DataFrame) -> DataFrame:
    last = F.max_by("distance_from_submissions_by_ip", F.struct("timestamp", "id"))
    return attempts.groupBy(*IP_DAY).agg(last.alias("distances"))


def ip_password_runs(attempts: DataFrame) -> DataFrame:
    """How often an IP sent the same password several times in a row: one row per
    ⟨IP, day, run length⟩ with the number of finished runs.

    A run ends when the next submission differs from the previous one; attempts
    without distances are passed over and the last, open run is not reported. The
    length is the distance between the positions of two consecutive ends, counted
    among the attempts with distances.
    """
    dist = F.col("distance_from_submissions_by_ip")
    same = F.coalesce(F.get(prior(dist), F.size(dist) - 2) == 0, F.lit(False))
    rows = attempts.where(dist.isNotNull()).select(
        *IP_DAY, "timestamp", "id", same.alias("same")
    )
    slots = slot_in_day(rows, ["client_ip"]).where(~F.col("same"))
    # positions of the ends, thinned to one row per slice to link the slices
    ends = slots.withColumn("_part", F.floor(F.col("slot") / 100_000))
    inside = Window.partitionBy(*IP_DAY, "_part").orderBy("slot")
    across = Window.partitionBy(*IP_DAY).orderBy("_part")
    before = (
        ends.groupBy(*IP_DAY, "_part")
        .agg(F.max("slot").alias("_last"))
        .withColumn("_before", F.lag("_last").over(across))
        .drop("_last")
    )
    previous = F.coalesce(F.lag("slot").over(inside), F.col("_before"), F.lit(0))
    return (
        ends.join(before, [*IP_DAY, "_part"])
        .withColumn("run_length", F.col("slot") - previous)
        .groupBy(*IP_DAY, "run_length")
        .agg(F.count("*").alias("runs"))
    )


def ip_unique_passwords_per_day(attempts: DataFrame) -> DataFrame:
    """Per ⟨IP, day⟩, over attempts with distances: submissions of a new password
    and all submissions."""
    dist = F.col("distance_from_submissions_by_ip")
    return attempts.groupBy(*IP_DAY).agg(
        F.count(F.when(dist.isNotNull() & (is_new_password(dist) == 1), 1)).alias("unique_count"),
        F.count(dist).alias("total"),
    )


def user_password_ratio_per_day(attempts: DataFrame) -> DataFrame:
    return (
        password_origins(attempts, "client_ip")
        .groupBy(*IP_DAY)
        .agg(
            F.count_distinct("username").alias("usernames"),
            F.count_distinct("origin").alias("passwords"),
        )
        .withColumn("ratio", share(F.col("usernames"), F.col("passwords")))
    )


def username_password_pairs(attempts: DataFrame) -> DataFrame:
    """⟨IP, username, password label⟩ with attempts: who was tried with what."""
    return (
        password_labels(attempts, "client_ip")
        .groupBy("client_ip", "username", "label")
        .agg(F.count("*").alias("attempts"))
    )


def username_password_groups(attempts: DataFrame) -> DataFrame:
    """Per IP: mean and median number of usernames per password and of passwords
    per username."""
    pairs = username_password_pairs(attempts)

    def spread(key, name):
        sizes = pairs.groupBy("client_ip", key).agg(F.count("*").alias("n"))
        return sizes.groupBy("client_ip").agg(
            F.avg("n").alias(f"mean_{name}"), F.median("n").alias(f"median_{name}")
        )

    return spread("label", "usernames_per_password").join(
        spread("username", "passwords_per_username"), "client_ip"
    )


def password_reuse_across_ips(attempts: DataFrame, ips) -> DataFrame:
    """One row ``reused, total`` over the days of users seen from several of the
    given IPs: attempts whose password came earlier that day from another IP.

    Equal passwords share an origin, so an attempt is reused when the first attempt
    with its origin, or the first one from a second IP, precedes it and has another
    IP.
    """
    day = ["username", "d"]
    seen = (
        attempts.where(F.col("client_ip").isin(list(ips)))
        .groupBy(*day)
        .agg(F.count_distinct("client_ip").alias("n"))
        .where("n > 1")
    )
    rows = attempts.join(seen, day, "left_semi")
    uses = password_origins(rows, "username").select(*day, "origin", "client_ip", "slot")
    uses = materialize(uses, "uses")
    first_use = (
        uses.groupBy(*day, "origin", "client_ip")
        .agg(F.min("slot").alias("first"), F.count("*").alias("n"))
    )
    by_ip = F.struct("first", "client_ip")
    # the IP that used a password first, and the first use from any other IP
    opener = first_use.groupBy(*day, "origin").agg(
        F.min(by_ip).alias("o"), F.sum("n").alias("total")
    )
    second = (
        first_use.join(opener.select(*day, "origin", "o"), [*day, "origin"])
        .where(F.col("client_ip") != F.col("o.client_ip"))
        .groupBy(*day, "origin")
        .agg(F.min("first").alias("second"))
    )
    after_second = (
        uses.join(opener.select(*day, "origin", "o"), [*day, "origin"])
        .join(second, [*day, "origin"])
        .where(
            (F.col("client_ip") != F.col("o.client_ip")) | (F.col("slot") > F.col("second"))
        )
    )
    total = uses.agg(F.count("*").alias("total"))
    return after_second.agg(F.count("*").alias("reused")).withColumn("total", total.scalar())


def compare_with_compromised(attempts: DataFrame, compromised: DataFrame) -> DataFrame:
    """Successful users among the given attempts, how many are known to be
    compromised, their share, and all successes."""
    users = (
        attempts.where("result = 1").groupBy("username").agg(F.count("*").alias("successes"))
    )
    known = compromised.select(F.col("netid").alias("username")).distinct()
    flagged = users.join(known.withColumn("known", F.lit(1)), "username", "left")
    return flagged.agg(
        F.count("known").alias("compromised"),
        F.count("*").alias("usernames"),
        F.coalesce(F.sum("successes"), F.lit(0)).alias("total_successes"),
    ).withColumn("fraction", share(F.col("compromised"), F.col("usernames")))


def short_case_study(attempts: DataFrame, ip: str) -> DataFrame:
    """Eight figures about one IP."""
    one = attempts.where(F.col("client_ip") == ip)
    figures = features.metrics(
        one, "num_attempts", "num_successes", "num_password_in_breach", "num_unique_usernames",
        "first_seen", "last_seen", by=["client_ip"],
    )
    gap = features.average_interarrival(one, by=["client_ip"]).select(
        "client_ip", "ave_interarrival"
    )
    near = connecting_ips(attempts, ip).agg(F.count("*").alias("num_connecting_ips"))
    return figures.join(gap, "client_ip").withColumn("num_connecting_ips", near.scalar())


def case_study(attempts: DataFrame, ip: str, prefixes: DataFrame | None = None) -> DataFrame:
    """The figures of a full case study as ``figure, detail, value`` rows: single
    numbers, the network (with a prefix table), connecting IPs and their number, usernames and
    the passwords of each day."""
    one = attempts.where(F.col("client_ip") == ip)
    names = [
        "num_attempts", "num_successes", "num_successes_in_breach", "num_unique_usernames",
        "num_unique_usernames_success", "num_password_in_breach", "num_pair_in_breach",
        "num_password_in_hashcat", "null_user_agents", "first_seen", "last_seen",
    ]
    figures = features.metrics(one, *names, by=["client_ip"])
    gap = features.average_interarrival(one, by=["client_ip"]).select(
        "client_ip", "ave_interarrival"
    )
    agent = features.most_common_user_agent(one, by=["client_ip"]).select(
        "client_ip", F.col("user_agent").alias("common_user_agent")
    )
    wide = figures.join(gap, "client_ip").join(agent, "client_ip")
    single = wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("figure"),
                        F.lit("").alias("detail"),
                        F.col(c).cast("string").alias("value"),
                    )
                    for c in [*names, "ave_interarrival", "common_user_agent"]
                ]
            )
        )
    )

    def rows(df, figure, detail, value):
        return df.select(
            F.lit(figure).alias("figure"),
            detail.cast("string").alias("detail"),
            value.cast("string").alias("value"),
        )

    day_user = F.concat_ws(" ", F.col("d"), F.col("username"))
    near = connecting_ips(attempts, ip).agg(F.count("*").alias("n"))
    single = single.unionByName(rows(near, "num_connecting_ips", F.lit(""), F.col("n")))
    if prefixes is not None:
        network = ip_networks(one, prefixes)
        for c in NETWORK_COLUMNS:
            single = single.unionByName(rows(network, c, F.lit(""), F.col(c)))
    return (
        single.unionByName(
            rows(connecting_ips(attempts, ip), "connecting_ip", F.col("client_ip"), F.col("attempts"))
        )
        .unionByName(rows(usernames_for_ip(one), "username", F.col("username"), F.col("attempts")))
        .unionByName(
            rows(password_labels(one, "client_ip"), "password",
                 F.concat_ws(" ", F.col("d"), F.col("slot"), F.col("username")), F.col("label"))
        )
        .unionByName(
            rows(user_last_distances(one), "last_distances", day_user,
                 F.concat_ws(",", F.col("distances").cast("array<string>")))
        )
    )


def investigate_username(attempts: DataFrame, username: str) -> DataFrame:
    """Passwords per day of one user, with the user's tweak counts."""
    one = attempts.where(F.col("username") == username)
    tweaks = detectors.interesting_tweaks_by_user(one).withColumnsRenamed(
        {"total": "tweak_total", "close": "tweak_close"}
    )
    return statistics.distinct_passwords_per_day(one, "username").join(tweaks, "username")
