"""From the attempt log to attack campaigns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlab.functions.columns import share
from loginlab.operators import campaigns, clustering, features, pairs, selection
from loginlab.sources.attempts import materialize, release


@dataclass
class Inputs:
    attempts: DataFrame
    prefixes: DataFrame
    mfa_log: DataFrame
    compromised: DataFrame


def suspicious_lsets(inputs: Inputs, rules: selection.Rules | None = None) -> DataFrame:
    """The filtered feature rows, computed once and kept for the steps after. The high failure rate
    is decided on two counts, before anything else: the features are computed from the attempts of the
    rows that have it, and these attempts are read from the log once."""
    rules = rules or selection.Rules()
    counts = features.metrics(inputs.attempts, "num_attempts", "num_successes")
    failed = 1 - share(F.col("num_successes"), F.col("num_attempts"))
    keys = counts.select(*features.IP_DAY, F.col("num_attempts").alias("NR"), failed.alias("FF"))
    keys = keys.where(rules.selected()).select(*features.IP_DAY)
    mine = inputs.attempts.join(keys, list(features.IP_DAY), "left_semi")
    mine = materialize(mine.select(*selection.READ), "high_failure_attempts")
    high = materialize(features.ip_day_features(mine).where(rules.selected()), "high_failure")
    rows = selection.lsets(inputs.attempts, inputs.prefixes, inputs.mfa_log, high, mine)
    out = materialize(selection.filtered_lsets(rows, rules), "lsets")
    release(high)
    release(mine)
    return out


def usernames_of(lsets: DataFrame, attempts: DataFrame) -> DataFrame:
    """``id, username, attempts, successes`` of the given feature rows."""
    keys = lsets.select("id", "client_ip", "d")
    mine = attempts.join(keys.drop("id"), ["client_ip", "d"], "left_semi")
    return features.lset_usernames(mine).withColumn("id", F.concat_ws("|", "client_ip", "d"))


def find_near_pairs(
    lsets: DataFrame,
    attempts: DataFrame,
    max_distance=pairs.MAX_DISTANCE,
    passwords: bool = True,
    missing_matches: bool = True,
    columns: list[str] | None = None,
):
    names = usernames_of(lsets, attempts)
    return pairs.near_pairs(lsets, names, max_distance, passwords, missing_matches=missing_matches, columns=columns)


def true_distances(lsets, usernames, passwords: bool = True, missing_matches: bool = True):
    """What linkage calls for the pairs that are not listed."""
    return pairs.Distances(lsets, usernames, passwords, missing_matches)


def cluster(
    lsets: DataFrame,
    usernames: DataFrame,
    max_distance: float = pairs.MAX_DISTANCE,
    threshold: float | None = None,
    linkage: str = "average",
    passwords: bool = True,
    missing_matches: bool = True,
) -> DataFrame:
    """Feature rows with ``cluster_id``, also from stored rows and usernames. Without a
    threshold the knee of the merge heights is used, for either kind of linkage; it is searched
    among the heights up to ``max_distance``."""
    names = materialize(usernames.select("id", "username"), "usernames")
    near = pairs.near_pairs(lsets, names, max_distance, passwords, missing_matches=missing_matches, columns=["dist"])
    if linkage == "average" or threshold is None:
        distances = true_distances(lsets, names, passwords, missing_matches)
        history = clustering.average_linkage(near, max_distance, distances, threshold, ids=lsets)
    if threshold is None:
        knee = clustering.cut_threshold(history, lsets).first()
        threshold = knee["threshold"] if knee else max_distance
    if linkage == "average":
        members = clustering.members(history, lsets, threshold)
    else:
        members = clustering.connected_campaigns(near, lsets, threshold, max_distance)
    return lsets.join(members.withColumnRenamed("cluster", "cluster_id"), "id")


def find_campaigns(
    inputs: Inputs,
    max_distance: float = pairs.MAX_DISTANCE,
    threshold: float | None = None,
    linkage: str = "average",
    passwords: bool = True,
    missing_matches: bool = True,
    rules: selection.Rules | None = None,
):
    """``(labelled feature rows, campaign statistics)``."""
    lsets = suspicious_lsets(inputs, rules)
    names = materialize(usernames_of(lsets, inputs.attempts), "usernames")
    labelled = cluster(lsets, names, max_distance, threshold, linkage, passwords, missing_matches)
    return labelled, campaigns.campaign_stats(labelled, names, inputs.compromised)
