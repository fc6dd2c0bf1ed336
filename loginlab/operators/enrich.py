"""Network, user-agent and second-factor information for the feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loginlab.functions.columns import address, epoch_seconds, network_of
from loginlab.sources.attempts import materialize

NETWORK_COLUMNS = ["network", "isp", "asn_org", "country", "city"]
NOT_FOUND = "NA"


def ip_networks(ips: DataFrame, prefixes: DataFrame, ip: str = "client_ip") -> DataFrame:
    """Longest matching prefix for every distinct IPv4 or IPv6 address, ``NA`` when there is none.
    Of equal prefixes the one with the first values counts, in the order of the columns.

    Prefixes and addresses are put in one order, dealt out by ranges, and every address takes the last
    prefix that begins at or before it. Prefixes are nested or apart, so it lies in this one or in one of those
    that enclose it, whose lengths that prefix carries along. Ranges are even whatever the
    addresses are; what precedes a range is one row for each.
    """
    distinct = ips.select(ip).distinct()
    proxy = F.col("is_proxy") if "is_proxy" in prefixes.columns else F.lit(False)
    length = F.substring_index("network", "/", -1).cast("int")
    table = (
        prefixes.withColumn("len", length)
        .withColumn("bits", address(F.substring_index("network", "/", 1)))
        .where("bits IS NOT NULL AND len BETWEEN 0 AND IF(bits.family = 4, 32, 128)")
        .withColumn("net", network_of(F.col("bits"), F.col("len")))
        .groupBy("len", "net")
        .agg(F.min(F.struct(*NETWORK_COLUMNS, proxy.alias("is_proxy"))).alias("hit"))
    )
    table = materialize(table, "prefixes")
    numbers = distinct.withColumn("bits", address(ip)).where("bits IS NOT NULL")
    placed = _last_starts(_enclosing(table), numbers, ip)
    fits = lambda n: network_of(F.col("bits"), n) == network_of(F.col("start"), n)
    placed = placed.where("bits.family = start.family").withColumn("len", F.get(F.filter("lengths", fits), F.lit(0)))
    best = placed.where("len IS NOT NULL").withColumn("net", network_of(F.col("bits"), F.col("len")))
    best = best.join(table, ["len", "net"]).select(ip, "hit")
    return distinct.join(best, ip, "left").select(
        ip,
        *[F.coalesce(F.col(f"hit.{c}"), F.lit(NOT_FOUND)).alias(c) for c in NETWORK_COLUMNS],
        F.coalesce("hit.is_proxy", F.lit(False)).alias("is_proxy"),
    )


def _enclosing(table: DataFrame) -> DataFrame:
    """⟨start, lengths⟩: where prefixes begin, and the lengths of all prefixes that hold this address, longest first."""
    # at most 33 + 129 rows
    lengths = table.select(F.col("net.family").alias("family"), F.col("len").alias("other")).distinct()
    starts = table.select(F.col("net").alias("start"), "len")
    shorter = (F.col("start.family") == F.col("family")) & (F.col("other") < F.col("len"))
    asked = starts.join(F.broadcast(lengths), shorter).select(
        "start", F.col("other").alias("len"), network_of(F.col("start"), F.col("other")).alias("net")
    )
    above = asked.join(table.select("len", "net"), ["len", "net"]).select("start", "len")
    return (
        starts.unionByName(above)
        .groupBy("start")
        .agg(F.sort_array(F.collect_set("len"), asc=False).alias("lengths"))
    )


def _last_starts(starts: DataFrame, numbers: DataFrame, ip: str) -> DataFrame:
    """⟨ip, bits, start, lengths⟩: the last start at or before each address."""
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(2**63)))
    order = ["family", "hi", "lo", "is_ip"]

    def lined_up(df, bits, is_ip, lengths, name):
        return df.select(
            F.col(f"{bits}.family").alias("family"),
            unsigned(f"{bits}.hi").alias("hi"),
            unsigned(f"{bits}.lo").alias("lo"),
            F.lit(is_ip).alias("is_ip"),
            F.col(bits).alias("bits"),
            lengths.alias("lengths"),
            name.alias("_ip"),
        )

    both = lined_up(starts, "start", 0, F.col("lengths"), F.lit(None).cast("string")).unionByName(
        lined_up(numbers, "bits", 1, F.lit(None).cast("array<int>"), F.col(ip))
    )
    both = materialize(both.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    start = F.when(F.col("is_ip") == 0, F.struct(F.col("bits").alias("start"), "lengths"))
    # one row for each range: the last start in those before it
    ends = both.groupBy("part").agg(F.max_by(start, F.when(F.col("is_ip") == 0, F.struct(*order))).alias("end"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", F.last("end", ignorenulls=True).over(earlier).alias("before"))
    so_far = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("own", F.last(start, ignorenulls=True).over(so_far)).where("is_ip = 1")
    found = found.join(F.broadcast(ends), "part").withColumn("own", F.coalesce("own", "before"))
    return found.select(F.col("_ip").alias(ip), "bits", "own.start", "own.lengths")


# fixed values: first matching pattern decides
OS_PATTERNS = [
    (r"Windows Phone", "Windows Phone"),
    (r"Windows", "Windows"),
    (r"iPhone|iPad|iPod", "iOS"),
    (r"Mac OS X|Macintosh", "Mac OS X"),
    (r"Android", "Android"),
    (r"CrOS", "Chrome OS"),
    (r"Ubuntu", "Ubuntu"),
    (r"Fedora", "Fedora"),
    (r"Linux|X11", "Linux"),
]
BROWSER_PATTERNS = [
    (r"Edg(?:e|A|iOS)?/", "Edge", r"Edg(?:e|A|iOS)?/([0-9.]+)"),
    (r"OPR/|Opera", "Opera", r"(?:OPR|Opera)/([0-9.]+)"),
    (r"SamsungBrowser/", "Samsung Internet", r"SamsungBrowser/([0-9.]+)"),
    (r"CriOS/", "Chrome Mobile iOS", r"CriOS/([0-9.]+)"),
    (r"FxiOS/", "Firefox iOS", r"FxiOS/([0-9.]+)"),
    (r"Mobile.*Firefox/", "Firefox Mobile", r"Firefox/([0-9.]+)"),
    (r"Firefox/", "Firefox", r"Firefox/([0-9.]+)"),
    (r"Chrome/.*Mobile", "Chrome Mobile", r"Chrome/([0-9.]+)"),
    (r"Chrome/", "Chrome", r"Chrome/([0-9.]+)"),
    (r"Version/.*Mobile.*Safari/", "Mobile Safari", r"Version/([0-9.]+)"),
    (r"Version/.*Safari/", "Safari", r"Version/([0-9.]+)"),
    (r"MSIE |Trident/", "IE", r"(?:MSIE |rv:)([0-9.]+)"),
    (r"python-requests/", "Python Requests", r"python-requests/([0-9.]+)"),
    (r"curl/", "curl", r"curl/([0-9.]+)"),
]
DESKTOP = r"Windows NT|Macintosh|X11|CrOS"
PHONE = r"iPhone|iPod|Android.*Mobile|Windows Phone|BlackBerry"
OTHER = "Other"


def _first_match(text: Column, choices, otherwise: Column) -> Column:
    out = otherwise
    for pattern, value in reversed(choices):
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return out


def os_family(ua: Column) -> Column:
    return _first_match(ua, [(p, F.lit(n)) for p, n in OS_PATTERNS], F.lit(OTHER))


def app_kind(ua: Column) -> Column:
    return (
        F.when(ua.rlike(DESKTOP), "desktop").when(ua.rlike(PHONE), "mobileweb").otherwise("unknown")
    )


def browser_family(ua: Column) -> Column:
    return _first_match(ua, [(p, F.lit(n)) for p, n, _ in BROWSER_PATTERNS], F.lit(OTHER))


def browser_version(ua: Column) -> Column:
    versions = [(p, F.regexp_extract(ua, v, 1)) for p, _, v in BROWSER_PATTERNS]
    return _first_match(ua, versions, F.lit(""))


def user_agent_dimension(attempts: DataFrame) -> DataFrame:
    """One row per distinct user agent with its families."""
    ua = F.col("user_agent")
    return (
        attempts.where(ua.isNotNull())
        .select("user_agent")
        .distinct()
        .select(
            "user_agent",
            os_family(ua).alias("os"),
            app_kind(ua).alias("app"),
            browser_family(ua).alias("browser"),
            browser_version(ua).alias("browser_version"),
        )
    )


def _user_agent_names(attempts: DataFrame, by) -> DataFrame:
    """Group, kind (os / app / browser), name, attempts; counted per user agent
    before anything is parsed."""
    ua = F.col("user_agent")
    counted = (
        attempts.where(ua.isNotNull()).groupBy(*by, "user_agent").agg(F.count("*").alias("n"))
    )
    named = F.create_map(
        F.lit("os"), os_family(ua), F.lit("app"), app_kind(ua), F.lit("browser"), browser_family(ua)
    )
    return (
        counted.select(*by, "n", F.explode(named).alias("kind", "name"))
        .groupBy(*by, "kind", "name")
        .agg(F.sum("n").alias("n"))
    )


def user_agent_counts(attempts: DataFrame, by=("client_ip", "d")) -> DataFrame:
    """Maps os / app / browser family -> attempts for every group. The families are
    a fixed list, so a map stays short."""

    def as_map(kind):
        pair = F.when(F.col("kind") == kind, F.struct("name", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(pair)))

    return (
        _user_agent_names(attempts, by)
        .groupBy(*by)
        .agg(
            as_map("os").alias("os_json_cnt"),
            as_map("app").alias("app_json_cnt"),
            as_map("browser").alias("browser_json_cnt"),
        )
    )


def user_agent_vocabulary(attempts: DataFrame) -> DataFrame:
    return _user_agent_names(attempts, []).select("name").distinct()


MFA_RESULTS = ["success", "denied", "fraud"]


def mfa_attempt_matches(
    mfa_log: DataFrame, attempts: DataFrame, shift_seconds=6 * 3600, reach_seconds=120
) -> DataFrame:
    """Second-factor events with the same user's successful attempts in
    ``[t - reach, t + reach)``: one row per match with the attempt's id, IP and day,
    NULL when there is none.

    Attempts are keyed by user and a time bucket as wide as the interval, so an
    event looks into at most two buckets and a busy user is spread over time.
    """
    width = 2 * reach_seconds
    moment = F.col("timestamp") + shift_seconds
    events = mfa_log.select(
        F.col("id").alias("duo_id"),
        "username",
        F.col("result").alias("mfa_result"),
        F.date_from_unix_date((F.floor(F.col("timestamp") / 86400)).cast("int")).alias("date"),
        moment.alias("moment"),
    )
    first, last = F.col("moment") - reach_seconds, F.col("moment") + reach_seconds - 1
    probes = events.withColumn(
        "bucket", F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))
    )
    successes = (
        attempts.where(F.col("result") == 1)
        .select(
            "username",
            epoch_seconds("timestamp").alias("at"),
            F.col("id").alias("attempt_id"),
            "client_ip",
            "d",
        )
        .withColumn("bucket", F.floor(F.col("at") / width))
    )
    hits = probes.join(successes, ["username", "bucket"]).where(F.col("at").between(first, last))
    hits = hits.select("duo_id", "attempt_id", "client_ip", "d")
    return events.drop("moment").join(hits, "duo_id", "left")


def mfa_counts(matches: DataFrame) -> DataFrame:
    """Second-factor outcomes per ⟨IP, day⟩ of the matched attempts."""
    return (
        matches.where(F.col("attempt_id").isNotNull())
        .groupBy("client_ip", "d")
        .agg(*[F.count(F.when(F.col("mfa_result") == r, 1)).alias(r) for r in MFA_RESULTS])
        .withColumn("duo_responses", F.to_json(F.struct(*MFA_RESULTS)))
    )
