"""Statistics of the campaigns (clusters of feature rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: a campaign counts as an attack from these sizes on
ATTACK_ATTEMPTS = 5000
ATTACK_USERS = 5000
ATTACK_PASSWORDS_PER_USER = 24

SHARES = ["FPIB", "FTP", "FUIB", "FCIB", "FICIB"]


def weighted_mean(value: Column, weight: str) -> Column:
    return F.try_divide(F.sum(value * F.col(weight)), F.sum(F.col(weight)).cast("double"))


def basic_stats(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("cluster_id").agg(
        F.sum("NR").alias("NR"),
        F.count_distinct("client_ip").alias("IPs"),
        F.count_distinct("ISP").alias("ISPs"),
        F.count_distinct("DATE").alias("DATES_active"),
        F.sum("zxcvbn_0").alias("zxcvbn_0"),
        F.sum("zxcvbn_1").alias("zxcvbn_1"),
        F.avg("FF").alias("FF"),
        F.avg("FVU").alias("FVU"),
        F.count("*").alias("num_lsets"),
    )


def breach_stats(labelled: DataFrame) -> DataFrame:
    """Attempt-weighted breach shares; a missing strong share (-1) counts as 0."""
    strong = F.when(F.col("FSPIB") == -1, 0.0).otherwise(F.col("FSPIB"))
    return labelled.groupBy("cluster_id").agg(
        *[weighted_mean(F.col(c), "NR").alias(c) for c in SHARES],
        weighted_mean(strong, "NR").alias("FSPIB"),
    )


def weighted_means(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("cluster_id").agg(
        weighted_mean(F.col("AUPPU"), "NU").alias("AUPPU"),
        weighted_mean(F.col("FNUA"), "NR").alias("FNUA"),
    )


def campaign_usernames(labelled: DataFrame, usernames: DataFrame) -> DataFrame:
    """Distinct ⟨campaign, username⟩ with whether any attempt succeeded."""
    return (
        labelled.select("id", "cluster_id")
        .join(usernames, "id")
        .groupBy("cluster_id", "username")
        .agg((F.max("successes") > 0).alias("succeeded"))
    )


def user_stats(labelled: DataFrame, usernames: DataFrame, compromised: DataFrame) -> DataFrame:
    """Per campaign: distinct usernames, those with a success, and how many of the
    latter are known to be compromised."""
    names = campaign_usernames(labelled, usernames)
    known = compromised.select(F.col("netid").alias("username")).distinct()
    flagged = names.join(known.withColumn("known", F.lit(True)), "username", "left")
    return flagged.groupBy("cluster_id").agg(
        F.count("*").alias("NU"),
        F.count(F.when(F.col("succeeded"), 1)).alias("comp_users"),
        F.count(F.when(F.col("succeeded") & F.col("known"), 1)).alias("uniq_comp_users"),
    )


def total_usernames(labelled: DataFrame, usernames: DataFrame) -> DataFrame:
    return campaign_usernames(labelled, usernames).groupBy("cluster_id").agg(
        F.count("*").alias("NU")
    )


def compromised_users(labelled: DataFrame, usernames: DataFrame) -> DataFrame:
    return campaign_usernames(labelled, usernames).groupBy("cluster_id").agg(
        F.count(F.when(F.col("succeeded"), 1)).alias("comp_users")
    )


def flagged_users(labelled: DataFrame, usernames: DataFrame, compromised: DataFrame) -> DataFrame:
    known = compromised.select(F.col("netid").alias("username")).distinct()
    hits = (
        campaign_usernames(labelled, usernames)
        .where("succeeded")
        .join(known, "username", "left_semi")
        .groupBy("cluster_id")
        .agg(F.count("*").alias("n"))
    )
    return (
        labelled.select("cluster_id")
        .distinct()
        .join(hits, "cluster_id", "left")
        .select("cluster_id", F.coalesce("n", F.lit(0)).alias("uniq_comp_users"))
    )


def campaign_stats(labelled: DataFrame, usernames: DataFrame, compromised: DataFrame) -> DataFrame:
    """One row per campaign. All parts are grouped on ``cluster_id``."""
    return (
        basic_stats(labelled)
        .join(breach_stats(labelled), "cluster_id")
        .join(weighted_means(labelled), "cluster_id")
        .join(user_stats(labelled, usernames, compromised), "cluster_id")
    )


def attack_campaigns(
    stats: DataFrame,
    attempts=ATTACK_ATTEMPTS,
    users=ATTACK_USERS,
    passwords=ATTACK_PASSWORDS_PER_USER,
) -> DataFrame:
    big = (F.col("NR") >= attempts) | (F.col("NU") >= users) | (F.col("AUPPU") > passwords)
    return stats.where(big).orderBy(F.desc("NR"), "cluster_id")
