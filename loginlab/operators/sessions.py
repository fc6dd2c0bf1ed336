"""Statistics over the session tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlab.functions.columns import share
from loginlab.functions.predicates import session_filter

UNIQUE = {
    "username": ["num_unique_ips"],
    "ip": ["num_unique_usernames"],
    "username_ip": [],
}
AVERAGED = [
    "num_unique_user_agents", "num_unique_devices", "num_attempts_username_in_breach",
    "num_attempts_password_in_breach", "num_attempts_password_in_hashcat",
    "num_attempts_password_in_rockyou", "num_attempts_zxcvbn_score_0", "average_zxcvbn_score",
]


def session_stats(sessions: DataFrame, extent: DataFrame, kind: str, start=None, end=None):
    """One row: sessions per day (rounded to 2), averages and the number ending in
    a success. ``extent`` is the one-row ``start, end`` of the period."""
    from loginlab.operators.statistics import days_between

    days = extent.select(days_between("start", "end")).scalar()
    averaged = ["num_attempts", *UNIQUE[kind], *AVERAGED]
    return (
        sessions.where(session_filter(start, end))
        .agg(
            F.count("*").alias("_n"),
            *[F.avg(c).alias(f"avg_{c}") for c in averaged],
            F.sum("ended_with_success").alias("ended_with_success"),
        )
        .withColumn("sessions_per_day", F.round(share(F.col("_n"), days), 2))
        .drop("_n")
    )


def session_column(sessions: DataFrame, column: str, start=None, end=None, automated=None):
    """One column of the selected sessions."""
    return sessions.where(session_filter(start, end, automated)).select(column)


def username_ratio(sessions: DataFrame, start=None, end=None, automated=None) -> DataFrame:
    """Unique usernames per attempt for IP sessions with several attempts."""
    return (
        sessions.where(session_filter(start, end, automated))
        .where("num_attempts > 1")
        .select(share(F.col("num_unique_usernames"), F.col("num_attempts")).alias("ratio"))
    )
