"""Rules that point out suspicious attempts, sessions, users and IPs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlab.functions import tweaks
from loginlab.functions.columns import epoch_seconds, repeats_earlier, share
from loginlab.functions.predicates import open_window, session_filter
from loginlab.operators.flags import tweak_flags

CTM = "credential_tweaking_measurements"
USER_DAY = ["username", "d"]
# fixed value: result codes that stand for an unknown user
UNKNOWN_USER_CODES = ["UnknownUsername", "-1765328378"]


def non_standard_user_agents(attempts: DataFrame) -> DataFrame:
    return attempts.where(~F.col("user_agent").contains("Mozilla")).select("id", "user_agent")


def credential_stuffing_attempts(attempts: DataFrame) -> DataFrame:
    return attempts.where(
        "appeared_in_breach = 1 OR password_appeared_in_breach = 1"
    ).select("id", "username", "client_ip")


def credential_tweaking_attempts(attempts: DataFrame) -> DataFrame:
    return attempts.where(tweaks.is_tweaking_attempt(CTM)).select("id", "username")


def password_spraying_sessions(ip_sessions: DataFrame, start=None, end=None) -> DataFrame:
    return (
        ip_sessions.where(session_filter(start, end))
        .where("num_unique_usernames >= 5 AND num_unique_user_agents = 1")
        .select("id", "ip", "timestamp_start", "timestamp_end")
    )


def breached_pair_candidates(attempts: DataFrame) -> DataFrame:
    """User-days seen from more than two IPs whose last distances repeat some value
    more than twice."""
    days = attempts.groupBy(*USER_DAY).agg(
        F.count_distinct("client_ip").alias("unique_ips"),
        F.max_by(
            "distance_from_submissions_by_username", F.struct("timestamp", "id")
        ).alias("distances"),
    )
    # sorted, a value occurs three times when it equals the one two places on
    ordered = F.array_sort("distances")
    thrice = F.exists(
        F.arrays_zip(
            ordered.alias("x"),
            F.slice(ordered, F.lit(3), F.greatest(F.size(ordered) - 2, F.lit(0))).alias("y"),
        ),
        lambda p: F.coalesce(p["x"] == p["y"], F.lit(False)),
    )
    return days.where((F.col("unique_ips") > 2) & F.coalesce(thrice, F.lit(False))).select(
        *USER_DAY, "unique_ips"
    )


def breached_usernames(attempts: DataFrame, threshold: int = 4, by: str = "attempts") -> DataFrame:
    """Users and days with more than ``threshold`` attempts from one IP and user
    agent; with ``by="pairs"`` more than ``threshold`` such pairs."""
    groups = attempts.groupBy("client_ip", "user_agent", *USER_DAY).agg(F.count("*").alias("c"))
    if by == "pairs":
        groups = groups.groupBy(*USER_DAY).agg(F.count("*").alias("c"))
    return groups.where(F.col("c") > threshold).select(*USER_DAY, "c")


def targeted_attack_user_days(
    attempts: DataFrame, threshold: int = 5, unique_only: bool = False
) -> DataFrame:
    """User-days with at least ``threshold`` attempts whose distances are empty or
    contain a 0. ``unique_only`` counts submissions of new passwords instead."""
    dist = F.col("distance_from_submissions_by_username")
    if unique_only:
        counted = ~repeats_earlier(dist)
    else:
        counted = F.coalesce((F.size(dist) == 0) | F.array_contains(dist, 0), F.lit(False))
    return (
        attempts.groupBy(*USER_DAY)
        .agg(F.count("*").alias("attempts"), F.count(F.when(counted, 1)).alias("counted"))
        .where((F.col("attempts") >= threshold) & (F.col("counted") >= threshold))
        .select(*USER_DAY, "attempts", "counted")
    )


MAPPING_COLUMNS = {
    "attempt_id": "bigint",
    "username": "string",
    "date": "date",
    "username_session_id": "bigint",
    "ip_session_id": "bigint",
    "username_ip_session_id": "bigint",
}


def tag_attack(found: DataFrame, attack_id: int, **source) -> DataFrame:
    """A detector's output as rows of the attack table; ``source`` names the column
    each field comes from, the others stay NULL."""
    return found.select(
        F.lit(attack_id).alias("attack_id"),
        *[
            (F.col(source[c]) if c in source else F.lit(None)).cast(t).alias(c)
            for c, t in MAPPING_COLUMNS.items()
        ],
    )


def attacks_matching(
    mappings: DataFrame, attack_id: int, attempts: DataFrame, ip_sessions: DataFrame
) -> DataFrame:
    """Ids of the tagged attempts (1, 2, 7), IP sessions (4) or of the attempts on
    tagged user-days (5, 6)."""
    tagged = mappings.where(F.col("attack_id") == attack_id)
    if attack_id in (1, 2, 7):
        keys = tagged.select(F.col("attempt_id").alias("id"))
        return attempts.select("id").join(keys, "id")
    if attack_id == 4:
        keys = tagged.select(F.col("ip_session_id").alias("id"))
        return ip_sessions.select("id").join(keys, "id")
    if attack_id in (5, 6):
        keys = tagged.select("username", F.col("date").alias("d"))
        return attempts.join(keys, USER_DAY, "left_semi").select("id")
    raise ValueError(f"unknown attack {attack_id}")


def stuffing_scores(attempts: DataFrame) -> DataFrame:
    """Score of every attempt with a breached password, for users who also had a
    success and a non-breached password: +2 from an IP without an earlier success
    of the user, +2 without user agent or +1 for one without an earlier success,
    +2 when the user never succeeded with a breached password.

    The moment of the first success per ⟨user, IP⟩ and ⟨user, user agent⟩ decides
    what came earlier, so no user's history is walked in order.
    """
    at = F.struct("timestamp", "id")
    breached = F.col("password_appeared_in_breach")
    users = (
        attempts.groupBy("username")
        .agg(
            F.sum("result").alias("s"),
            F.sum(breached).alias("b"),
            F.count("*").alias("c"),
            F.max(F.col("result") * breached).alias("breached_success"),
        )
        .where("b >= 1 AND s >= 1 AND c - b >= 1")
        .select("username", "breached_success")
    )
    successes = attempts.where("result = 1")
    first_by_ip = successes.groupBy("username", "client_ip").agg(F.min(at).alias("ip_since"))
    first_by_agent = (
        successes.where("user_agent IS NOT NULL")
        .groupBy("username", "user_agent")
        .agg(F.min(at).alias("agent_since"))
    )

    def is_new(since):
        return ~F.coalesce(F.col(since) < F.col("at"), F.lit(False))

    return (
        attempts.where(breached == 1)
        .select("id", "username", "client_ip", "user_agent", at.alias("at"))
        .join(users, "username")
        .join(first_by_ip, ["username", "client_ip"], "left")
        .join(first_by_agent, ["username", "user_agent"], "left")
        .select(
            "id",
            "username",
            (
                F.when(is_new("ip_since"), 2).otherwise(0)
                + F.when(F.col("user_agent").isNull(), 2)
                .when(is_new("agent_since"), 1)
                .otherwise(0)
                + F.when(F.col("breached_success") == 1, 0).otherwise(2)
            ).alias("score"),
        )
    )


def stuffing_score_histogram(attempts: DataFrame) -> DataFrame:
    return stuffing_scores(attempts).groupBy("score").agg(F.count("*").alias("n"))


def top_suspicious(
    attempts: DataFrame,
    key: str,
    n: int = 10,
    min_attempts: int = 100,
    max_ratio: float = 0.1,
    order_by: str = "count",
) -> DataFrame:
    """Keys with many attempts and few successes per failure, the top ``n`` by
    attempts or by failures per success."""
    c, s = F.col("c"), F.col("s")
    order = {"count": "c", "ratio": "fts"}[order_by]
    return (
        attempts.groupBy(key)
        .agg(F.count("*").alias("c"), F.sum("result").alias("s"))
        .where(c >= min_attempts)
        .select(key, "c", share(s, c - s).alias("stf"), share(c - s, s).alias("fts"))
        .where(F.col("stf") <= max_ratio)
        .orderBy(F.col(order).desc_nulls_last(), key)
        .limit(n)
    )


def _interesting(attempts: DataFrame, include_exact: bool) -> DataFrame:
    rule = tweaks.INTERESTING_WITH_EXACT_RULE if include_exact else tweaks.INTERESTING_RULE
    return attempts.where(tweaks.any_match(CTM, rule))


def interesting_tweaks(attempts: DataFrame, include_exact: bool = False) -> DataFrame:
    """Totals over the attempts close to a breached password."""
    return _interesting(attempts, include_exact).agg(
        F.count("*").alias("total"),
        F.count(F.when(F.col("result") == 1, 1)).alias("total_successful"),
        F.count_distinct("username").alias("unique_usernames"),
        F.count_distinct(F.when(F.col("result") == 1, F.col("username"))).alias(
            "unique_successful_usernames"
        ),
    )


def interesting_tweak_ips(
    attempts: DataFrame, n: int = 10, order_by: str = "usernames", include_exact: bool = False
) -> DataFrame:
    """Top IPs by failing usernames or by failures among those attempts."""
    order = {"usernames": "failing_usernames", "failures": "failures"}[order_by]
    return (
        _interesting(attempts, include_exact)
        .where("result = 0")
        .groupBy("client_ip")
        .agg(F.count("*").alias("failures"), F.count_distinct("username").alias("failing_usernames"))
        .orderBy(F.desc(order), "client_ip")
        .limit(n)
    )


def interesting_tweaks_by_user(attempts: DataFrame) -> DataFrame:
    """Per user: attempts with breached passwords to compare, and the close ones."""
    return attempts.groupBy("username").agg(
        F.count(F.when(tweaks.has_breached(CTM), 1)).alias("total"),
        F.count(F.when(tweaks.any_match(CTM, tweaks.USER_RULE), 1)).alias("close"),
    )


def low_and_slow_ips(
    attempts: DataFrame,
    start,
    end,
    user_agent=None,
    min_attempts=5,
    max_attempts=50,
    max_success=0.25,
    min_users=0.8,
) -> DataFrame:
    """IPs with few attempts in the window, mostly failing, mostly one per user."""
    c = F.col("attempts")
    return (
        attempts.where(open_window(start, end, user_agent))
        .groupBy("client_ip")
        .agg(
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            F.count("*").alias("attempts"),
            F.sum("result").alias("successes"),
            F.sum("password_appeared_in_breach").alias("password_in_breach"),
            F.sum("username_appeared_in_breach").alias("username_in_breach"),
            F.sum("appeared_in_breach").alias("pair_in_breach"),
            F.count_distinct("username").alias("users"),
        )
        .where(
            (c >= min_attempts)
            & (c < max_attempts)
            & (share(F.col("successes"), c) < max_success)
            & (share(F.col("users"), c) >= min_users)
        )
        .withColumn(
            "mit",
            F.round((epoch_seconds("last_seen") - epoch_seconds("first_seen")) / c, 2),
        )
    )


def low_and_slow_summary(attempts: DataFrame, start, end, user_agent=None, **limits) -> DataFrame:
    """Totals over all attempts of those IPs in the window."""
    ips = low_and_slow_ips(attempts, start, end, user_agent, **limits).select("client_ip")
    return (
        attempts.where(open_window(start, end))
        .join(ips, "client_ip", "left_semi")
        .agg(
            F.count_distinct("username").alias("users"),
            F.count("*").alias("attempts"),
            F.sum("result").alias("successes"),
            F.sum("username_appeared_in_breach").alias("username_in_breach"),
            F.sum("password_appeared_in_breach").alias("password_in_breach"),
        )
    )


def tweak_matches_in_window(attempts: DataFrame, start, end, user_agent=None) -> DataFrame:
    """Per IP: attempts matching the tweak heuristic, and the elements matching by
    edit distance, strength score and rank."""
    return (
        tweak_flags(attempts.where(open_window(start, end, user_agent)))
        .groupBy("client_ip")
        .agg(
            F.sum("heuristic_any").alias("matching_attempts"),
            *[
                F.sum(f"heuristic_{k}").alias(f"by_{k}") for k in ("edit", "strength", "rank")
            ],
        )
    )


def unknown_usernames_in_window(attempts: DataFrame, start, end, user_agent=None) -> DataFrame:
    unknown = F.col("result_code").isin(UNKNOWN_USER_CODES)
    return (
        attempts.where(open_window(start, end, user_agent))
        .groupBy("client_ip")
        .agg(F.count(F.when(unknown, 1)).alias("unknown_usernames"))
    )


def pair_in_breach_in_window(attempts: DataFrame, start, end, user_agent=None) -> DataFrame:
    return (
        attempts.where(open_window(start, end, user_agent))
        .groupBy("client_ip")
        .agg(F.sum("appeared_in_breach").alias("pair_in_breach"))
    )


def low_and_slow_detail(attempts: DataFrame, start, end, user_agent=None, **limits) -> DataFrame:
    """Low-and-slow IPs with their unknown users and tweak matches; the user agent
    narrows the latter two."""
    return (
        low_and_slow_ips(attempts, start, end, **limits)
        .join(unknown_usernames_in_window(attempts, start, end, user_agent), "client_ip", "left")
        .join(tweak_matches_in_window(attempts, start, end, user_agent), "client_ip", "left")
        .na.fill(0)
    )


def min_edit_distance_histogram(
    attempts: DataFrame, start, end, user_agent=None, filtered=True, include_zero=False, **limits
) -> DataFrame:
    """Smallest edit distance to a breached password per attempt, counted over all
    attempts of the low-and-slow IPs (or of every IP seen in the window)."""
    if filtered:
        ips = low_and_slow_ips(attempts, start, end, user_agent, **limits)
    else:
        ips = attempts.where(open_window(start, end, user_agent))
    edits = F.transform(tweaks.breached_part(CTM), lambda m: tweaks.part(m, tweaks.EDIT))
    if not include_zero:
        edits = F.filter(edits, lambda e: e != 0)
    return (
        attempts.join(ips.select("client_ip").distinct(), "client_ip", "left_semi")
        .select(F.array_min(edits).alias("min_edit"))
        .where("min_edit IS NOT NULL")
        .groupBy("min_edit")
        .agg(F.count("*").alias("n"))
    )
