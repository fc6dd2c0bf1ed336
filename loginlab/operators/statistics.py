"""Statistics over the whole attempt log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loginlab.functions.columns import epoch_seconds, share
from loginlab.functions.ranks import descending_element
from loginlab.functions.tweaks import EDIT, STRENGTH, breached_part, part
from loginlab.operators.features import RESULT_CODES
from loginlab.operators.flags import password_origins

SUMMED = [
    "result", "appeared_in_breach", "username_appeared_in_breach", "password_appeared_in_breach",
    "frequently_submitted_password_today", "frequently_submitted_username_today", "zxcvbn_score",
    "in_top_5k_hashcat", "in_top_5k_rockyou", "in_top_10_passwords", "in_top_100_passwords",
    "in_top_1000_passwords", "in_top_2k_hashcat", "in_top_2k_rockyou",
]
INTERARRIVALS = [
    "interarrival_time_by_username",
    "interarrival_time_by_ip",
    "interarrival_time_by_username_ip",
]
SHORT_GAP_SECONDS = 300
USER_DAY = ["username", "d"]


def short_gap(column: str) -> Column:
    return (F.col(column) >= 0) & (F.col(column) < SHORT_GAP_SECONDS)


def days_between(start, end) -> Column:
    return (epoch_seconds(end) - epoch_seconds(start)) / F.lit(86400.0)


def attempt_statistics(attempts: DataFrame, start=None, end=None) -> DataFrame:
    """One row: count, sums and mean short gaps, each per day and rounded to 2.
    The period runs from ``start`` to ``end``; missing bounds come from the data."""

    def moment(value, default):
        return default if value is None else F.lit(str(value)).cast("timestamp_ntz")

    first, last = moment(start, F.col("_first")), moment(end, F.col("_last"))
    totals = attempts.agg(
        F.min("timestamp").alias("_first"),
        F.max("timestamp").alias("_last"),
        F.count("*").alias("count"),
        *[F.sum(c).alias(c) for c in SUMMED],
        *[F.avg(F.when(short_gap(c), F.col(c))).alias(c) for c in INTERARRIVALS],
    ).withColumn("_days", days_between(first, last))
    return totals.select(
        *[
            F.round(share(F.col(c), F.col("_days")), 2).alias(c)
            for c in ["count", *SUMMED, *INTERARRIVALS]
        ]
    )


def attempts_per_user_day(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy(*USER_DAY).agg(F.count("*").alias("attempts"))


def average_attempts_per_user_day(attempts: DataFrame) -> DataFrame:
    return attempts_per_user_day(attempts).agg(F.avg("attempts").alias("avg_attempts"))


def p99_attempts_per_user_day(attempts: DataFrame) -> DataFrame:
    return descending_element(attempts_per_user_day(attempts), F.col("attempts"), 0.01, "p99")


def p99_field(table: DataFrame, field: str) -> DataFrame:
    """99th percentile of any numeric column; interarrival columns only over
    ``[0, 300)``."""
    rows = table.where(short_gap(field)) if "interarrival" in field else table
    return descending_element(rows, F.col(field), 0.01, "p99")


def interarrival_values(attempts: DataFrame, by: str) -> DataFrame:
    return attempts.select(F.col(f"interarrival_time_by_{by}").alias("interarrival"))


def unique_ips_per_user_day(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy(*USER_DAY).agg(F.count_distinct("client_ip").alias("unique_ips"))


def ip_agent_pairs(attempts: DataFrame, per_day: bool = True) -> DataFrame:
    keys = ["client_ip", "user_agent", "username"] + (["d"] if per_day else [])
    return attempts.groupBy(*keys).agg(F.count("*").alias("attempts"))


def tweak_values(attempts: DataFrame, which: int = EDIT) -> DataFrame:
    """Every known measurement against a breached password: ``id, username, value``."""
    return (
        attempts.select(
            "id", "username", F.explode(breached_part("credential_tweaking_measurements")).alias("m")
        )
        .select("id", "username", part(F.col("m"), which).alias("value"))
        .where("value IS NOT NULL")
    )


def tweak_distribution(attempts: DataFrame, which: int = EDIT) -> DataFrame:
    """How often each measurement value occurs."""
    return tweak_values(attempts, which).groupBy("value").agg(F.count("*").alias("n"))


def tweak_totals(attempts: DataFrame, which: int = EDIT) -> DataFrame:
    return tweak_values(attempts, which).agg(
        F.count("*").alias("num_values"),
        F.count_distinct("id").alias("num_attempts"),
        F.count_distinct("username").alias("num_users"),
    )


def tweak_from_valid(attempts: DataFrame, which: int = EDIT) -> DataFrame:
    """Measurement against the user's valid password: ``username, value``."""
    c = F.col("credential_tweaking_measurements")
    first = F.get(c, F.lit(0))
    return attempts.where(F.size(c) > 0).select("username", part(first, which).alias("value"))


def password_reset_users(attempts: DataFrame, which: int = EDIT) -> DataFrame:
    """Users with a non-zero measurement against their valid password."""
    return (
        tweak_from_valid(attempts, which)
        .where("value IS NOT NULL AND value <> 0")
        .agg(F.count_distinct("username").alias("num_users"))
    )


def tweaks_per_session(attempts: DataFrame, which: int, kind: str) -> DataFrame:
    """Close measurements per session: edit distance at most 3 or strength score
    at most 1."""
    limit = {EDIT: 3, STRENGTH: 1}.get(which)
    breached = breached_part("credential_tweaking_measurements")
    if limit is None:
        hits = F.lit(0)
    else:
        hits = F.size(F.filter(breached, lambda m: F.coalesce(part(m, which) <= limit, F.lit(False))))
    return attempts.groupBy(F.col(f"{kind}_session_id").alias("session_id")).agg(
        F.sum(hits).alias("num_tweaks")
    )


def unique_passwords_per_user_day(attempts: DataFrame) -> DataFrame:
    """From the newest attempt (greatest id) of each user-day: distinct distances
    plus one; days whose newest attempt has no distances are left out."""
    newest = attempts.groupBy(*USER_DAY).agg(
        F.max_by("distance_from_submissions_by_username", "id").alias("distances")
    )
    return newest.where("distances IS NOT NULL").select(
        *USER_DAY, (F.size(F.array_distinct("distances")) + 1).alias("unique_passwords")
    )


def _last_success_distances(attempts: DataFrame) -> DataFrame:
    return (
        attempts.where("result = 1")
        .groupBy(*USER_DAY)
        .agg(
            F.max_by(
                "distance_from_submissions_by_username", F.struct("timestamp", "id")
            ).alias("distances")
        )
    )


def edit_distance_from_valid(attempts: DataFrame) -> DataFrame:
    """Histogram of the non-zero distances of the last success of each user-day."""
    return (
        _last_success_distances(attempts)
        .select(F.explode("distances").alias("distance"))
        .where("distance <> 0")
        .groupBy("distance")
        .agg(F.count("*").alias("n"))
    )


def typo_requests(attempts: DataFrame) -> DataFrame:
    """How many of those distances are 1 or 2."""
    typos = F.size(F.filter("distances", lambda x: x.isin(1, 2)))
    return _last_success_distances(attempts).agg(
        F.coalesce(F.sum(F.when(F.col("distances").isNotNull(), typos)), F.lit(0)).alias("typos")
    )


def top_failing_usernames(attempts: DataFrame, n: int) -> DataFrame:
    return (
        attempts.where("result = 0")
        .groupBy("username")
        .agg(F.count("*").alias("failures"))
        .orderBy(F.desc("failures"), "username")
        .limit(n)
    )


def result_codes_for_user(attempts: DataFrame) -> DataFrame:
    """Attempts per user for each of the default result codes."""
    return attempts.groupBy("username").agg(
        *[F.count(F.when(F.col("result_code") == c, 1)).alias(c) for c in RESULT_CODES]
    )


def unsuccessful_ips_for_user(attempts: DataFrame) -> DataFrame:
    failed = F.when(F.col("result") == 0, F.col("client_ip"))
    return attempts.groupBy("username").agg(F.count_distinct(failed).alias("unsuccessful_ips"))


def distinct_passwords_per_day(attempts: DataFrame, by: str) -> DataFrame:
    """Distinct and total passwords per key and day."""
    return (
        password_origins(attempts, by)
        .groupBy(by, "d")
        .agg(
            F.count_distinct("origin").alias("distinct_passwords"),
            F.count("*").alias("total_passwords"),
        )
    )
