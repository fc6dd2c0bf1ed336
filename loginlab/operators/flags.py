"""Columns derived for every attempt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loginlab.functions import tweaks
from loginlab.functions.columns import is_new_password, prior
from loginlab.functions.ordering import SLICE_SECONDS, previous_in_day, slots_and_totals

DISTANCES = {
    "client_ip": "distance_from_submissions_by_ip",
    "username": "distance_from_submissions_by_username",
}
FIRST_OF_DAY = "unknown"


def unique_password_flags(attempts: DataFrame) -> DataFrame:
    """``is_unique_pws_by_ip`` and ``is_unique_pws_by_username`` for every attempt."""
    return attempts.withColumns(
        {
            "is_unique_pws_by_ip": is_new_password(DISTANCES["client_ip"]),
            "is_unique_pws_by_username": is_new_password(DISTANCES["username"]),
        }
    )


def prior_distances(attempts: DataFrame) -> DataFrame:
    return attempts.withColumns(
        {
            "prior_by_ip": prior(DISTANCES["client_ip"]),
            "prior_by_username": prior(DISTANCES["username"]),
        }
    )


def tweak_flags(attempts: DataFrame) -> DataFrame:
    """``is_tweaked`` plus the counts of the narrower heuristic."""
    c = F.col("credential_tweaking_measurements")
    edit = tweaks.num_matches(c, tweaks.HEURISTIC_EDIT)
    strength = tweaks.num_matches(c, tweaks.HEURISTIC_STRENGTH)
    rank = tweaks.num_matches(c, tweaks.HEURISTIC_RANK)
    return attempts.withColumns(
        {
            "is_tweaked": tweaks.is_tweaked(c).cast("int"),
            "heuristic_edit": edit,
            "heuristic_strength": strength,
            "heuristic_rank": rank,
            "heuristic_any": (edit + strength + rank > 0).cast("int"),
        }
    )


def interarrival_by_ip_day(attempts: DataFrame) -> DataFrame:
    return previous_in_day(attempts, ["client_ip"], "gap_seconds")


def password_origins(
    attempts: DataFrame, by: str = "username", slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """One row per attempt with its ``slot`` among the key's attempts of the day and
    the slot ``origin`` of the day's first submission of the same password.

    Distance 0 means equal text, so the first zero of an attempt's distances points
    at that first submission, and ``⟨key, day, origin⟩`` identifies the password.
    The day's first attempt has no distances. ``number`` counts the new passwords
    of the key over all its days, from 0; only first submissions have one. Whole
    days are expected, because distances refer to all attempts of the day.
    """
    other = "client_ip" if by == "username" else "username"
    rows = attempts.select(
        by,
        other,
        "d",
        "timestamp",
        "id",
        F.array_position(prior(DISTANCES[by]), 0).alias("_first_zero"),
    ).withColumn("_new", F.coalesce(F.col("_first_zero") == 0, F.lit(False)).cast("int"))
    counted = slots_and_totals(rows, [by], "_new", slice_seconds)
    # one row per day connects the days of a key
    days = Window.partitionBy(by).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy(by, "d")
        .agg(F.sum("_new").alias("_m"))
        .select(
            F.col(by).alias("_by"), F.col("d").alias("_d"), F.coalesce(F.sum("_m").over(days), F.lit(0)).alias("_new_before")
        )
    )
    zero = F.col("_first_zero")
    return (
        counted.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("d") == F.col("_d")))
        .select(
            by,
            other,
            "d",
            "timestamp",
            "id",
            "slot",
            F.when(zero.isNull(), 1).when(zero > 0, zero).otherwise(F.col("slot")).alias("origin"),
            F.when(F.col("_new") == 1, F.col("_new_before") + F.col("total") - 1).alias("number"),
        )
    )


def password_labels(attempts: DataFrame, by: str = "username") -> DataFrame:
    """One row per attempt with a readable password ``label``: ``unknown`` for the
    day's first password, ``password<number>`` for the others."""
    rows = password_origins(attempts, by)
    named = rows.where("number IS NOT NULL").select(
        by, "d", F.col("slot").alias("origin"), F.concat(F.lit("password"), "number").alias("label")
    )
    return (
        rows.drop("number")
        .join(named, [by, "d", "origin"], "left")
        .withColumn("label", F.coalesce("label", F.lit(FIRST_OF_DAY)))
    )
