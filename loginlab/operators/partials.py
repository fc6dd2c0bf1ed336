"""Figures of long periods from one stored row per day.

Counts, sums and means of a period follow exactly from those of its days. Order statistics and distinct counts do not;
for them a day keeps sketches that merge. With ``K`` a quantile is off by at most ``RANK_ERROR`` of all values in
rank (with 99 % confidence), with ``LG_USERS`` and ``LG_IP`` distinct counts by ``COUNT_ERROR`` and ``IP_COUNT_ERROR``
of their value (two standard errors). Sketches that are not full are exact. The exact ways over
attempts are in ``statistics`` and ``features``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlab.functions.columns import share
from loginlab.operators.statistics import INTERARRIVALS, SUMMED, days_between, short_gap

K = 4096
RANK_ERROR = 2.296 / K**0.9723
LG_USERS, LG_IP = 14, 12
COUNT_ERROR = 2 / 2 ** (LG_USERS / 2)
IP_COUNT_ERROR = 2 * 1.04 / 2 ** (LG_IP / 2)

# what is known of every user and day: name -> values of an attempt
PER_USER_DAY = {
    "attempts": lambda: F.count("*"),
    "unique_ips": lambda: F.count_distinct("client_ip"),
    "ip_agent_pairs": lambda: F.count_distinct(
        F.struct("client_ip", F.coalesce("user_agent", F.lit("")), F.col("user_agent").isNull())
    ),
}


def daily(attempts: DataFrame) -> DataFrame:
    """One row per day."""
    gaps = {c: F.when(short_gap(c), F.col(c)) for c in INTERARRIVALS}
    plain = attempts.groupBy("d").agg(
        F.count("*").alias("attempts"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        *[F.sum(c).alias(f"sum_{c}") for c in SUMMED],
        *[F.sum(g).alias(f"sum_{c}") for c, g in gaps.items()],
        *[F.count(g).alias(f"n_{c}") for c, g in gaps.items()],
        *[F.kll_sketch_agg_double(g.cast("double"), F.lit(K)).alias(f"kll_{c}") for c, g in gaps.items()],
        F.theta_sketch_agg("username", F.lit(LG_USERS)).alias("users"),
        F.theta_sketch_agg(F.when(F.col("result") == 1, F.col("username")), F.lit(LG_USERS)).alias("successful_users"),
        F.theta_sketch_agg("client_ip", F.lit(LG_USERS)).alias("ips"),
    )
    groups = attempts.groupBy("username", "d").agg(*[value().alias(n) for n, value in PER_USER_DAY.items()])
    of_users = groups.groupBy("d").agg(
        F.count("*").alias("user_days"),
        *[F.sum(n).alias(f"sum_{n}") for n in PER_USER_DAY],
        *[F.kll_sketch_agg_bigint(n, F.lit(K)).alias(f"kll_{n}") for n in PER_USER_DAY],
    )
    return plain.join(of_users, "d")


def daily_by_ip(attempts: DataFrame) -> DataFrame:
    """One row per IP and day, with a sketch of its usernames."""
    return attempts.groupBy("client_ip", "d").agg(
        F.count("*").alias("attempts"),
        F.sum("result").alias("successes"),
        F.hll_sketch_agg("username", F.lit(LG_IP)).alias("users"),
    )


def in_period(partials: DataFrame, start=None, end=None) -> DataFrame:
    """The days from ``start`` to ``end``, both included."""
    if start is not None:
        partials = partials.where(F.col("d") >= F.lit(str(start)).cast("date"))
    return partials if end is None else partials.where(F.col("d") <= F.lit(str(end)).cast("date"))


def period_statistics(partials: DataFrame) -> DataFrame:
    """What :func:`loginlab.operators.statistics.attempt_statistics` gives for these days, exactly."""
    totals = partials.agg(
        F.sum("attempts").alias("count"),
        days_between(F.min("first_seen"), F.max("last_seen")).alias("_days"),
        *[F.sum(f"sum_{c}").alias(c) for c in SUMMED],
        *[share(F.sum(f"sum_{c}"), F.sum(f"n_{c}")).alias(c) for c in INTERARRIVALS],
    )
    names = ["count", *SUMMED, *INTERARRIVALS]
    return totals.select(*[F.round(share(F.col(c), F.col("_days")), 2).alias(c) for c in names])


def period_averages(partials: DataFrame) -> DataFrame:
    """Means per user and day over the period, exactly."""
    return partials.agg(*[share(F.sum(f"sum_{n}"), F.sum("user_days")).alias(f"avg_{n}") for n in PER_USER_DAY])


def period_quantiles(partials: DataFrame, rank: float = 0.99) -> DataFrame:
    """The value at a rank, of the figures per user and day and of the short gaps; within RANK_ERROR in rank."""
    merged = partials.agg(
        *[F.kll_merge_agg_bigint(f"kll_{n}", F.lit(K)).alias(n) for n in PER_USER_DAY],
        *[F.kll_merge_agg_double(f"kll_{c}", F.lit(K)).alias(c) for c in INTERARRIVALS],
    )
    some = lambda n, value, size: F.when(size(F.col(n)) > 0, value(F.col(n), F.lit(float(rank)))).alias(n)
    return merged.select(
        *[some(n, F.kll_sketch_get_quantile_bigint, F.kll_sketch_get_n_bigint) for n in PER_USER_DAY],
        *[some(c, F.kll_sketch_get_quantile_double, F.kll_sketch_get_n_double) for c in INTERARRIVALS],
    )


def period_distinct(partials: DataFrame) -> DataFrame:
    """Distinct users, successful users and IPs of the period, within COUNT_ERROR."""
    names = ["users", "successful_users", "ips"]
    return partials.agg(*[F.theta_sketch_estimate(F.theta_union_agg(n, F.lit(LG_USERS))).alias(n) for n in names])


def period_users_by_ip(partials: DataFrame) -> DataFrame:
    """Attempts and distinct users of every IP over the period; users within IP_COUNT_ERROR."""
    return partials.groupBy("client_ip").agg(
        F.sum("attempts").alias("attempts"),
        F.sum("successes").alias("successes"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"),
    )
