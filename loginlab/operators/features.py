"""One feature row per client IP and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loginlab.functions.columns import count_if, epoch_seconds, share
from loginlab.functions.ordering import gaps
from loginlab.functions.tweaks import is_tweaked
from loginlab.operators.flags import password_origins

IP_DAY = ("client_ip", "d")
# fixed values: result codes that are always reported
RESULT_CODES = ["AccountError", "InvalidCredentials", "Success", "UnknownUsername"]


def _is(name: str, value: int = 1) -> Column:
    return F.col(name) == value


def _valid_user() -> Column:
    return F.col("result_code").contains("InvalidCredentials") | _is("result")


# name -> aggregate over the attempts of a group
METRICS = {
    "num_attempts": lambda: F.count("*"),
    "num_successes": lambda: count_if(_is("result")),
    "num_successes_in_breach": lambda: count_if(
        _is("result") & _is("password_appeared_in_breach")
    ),
    "num_unique_usernames": lambda: F.count_distinct("username"),
    "num_unique_usernames_success": lambda: F.count_distinct(
        F.when(_is("result"), F.col("username"))
    ),
    "num_valid_users": lambda: F.count_distinct(F.when(_valid_user(), F.col("username"))),
    "num_password_in_breach": lambda: count_if(_is("password_appeared_in_breach")),
    "num_strong_password_in_breach": lambda: count_if(
        _is("password_appeared_in_breach") & _is("zxcvbn_score")
    ),
    "num_users_in_breach": lambda: count_if(_is("username_appeared_in_breach")),
    "num_password_in_hashcat": lambda: count_if(_is("in_top_5k_hashcat")),
    "num_pair_in_breach": lambda: count_if(_is("appeared_in_breach")),
    "num_failed_pair_in_breach": lambda: count_if(
        _is("appeared_in_breach") & _is("result", 0)
    ),
    "num_tweaked_passwords": lambda: count_if(
        is_tweaked("credential_tweaking_measurements")
    ),
    "zxcvbn_1": lambda: count_if(_is("zxcvbn_score", 1)),
    "zxcvbn_0": lambda: count_if(_is("zxcvbn_score", 0)),
    "null_user_agents": lambda: count_if(F.col("user_agent").isNull()),
    "num_unique_user_agents": lambda: F.count_distinct("user_agent"),
    "unique_passwords_for_ip": lambda: F.coalesce(F.sum("is_unique_pws_by_ip"), F.lit(-1)),
    "unique_passwords_for_username": lambda: F.coalesce(
        F.sum("is_unique_pws_by_username"), F.lit(-1)
    ),
    "first_seen": lambda: F.min("timestamp"),
    "last_seen": lambda: F.max("timestamp"),
    # users that form a group of their own, the missing name included
    "user_groups": lambda: F.count_distinct("username")
    + F.max(F.col("username").isNull().cast("int")),
}


def metrics(attempts: DataFrame, *names: str, by=IP_DAY) -> DataFrame:
    """The named counts for every group, from one aggregation."""
    return attempts.groupBy(*by).agg(*[METRICS[n]().alias(n) for n in names])


def num_unique_usernames(attempts: DataFrame, result=None, by=IP_DAY) -> DataFrame:
    rows = attempts if result is None else attempts.where(F.col("result") == result)
    return metrics(rows, "num_unique_usernames", by=by)


def num_invalid_users(attempts: DataFrame, by=IP_DAY) -> DataFrame:
    invalid = F.col("num_unique_usernames") - F.col("num_valid_users")
    return metrics(attempts, "num_unique_usernames", "num_valid_users", by=by).select(
        *by,
        invalid.alias("num_invalid_users"),
        share(invalid, F.col("num_unique_usernames")).alias("FIU"),
    )


def candidate_ips(attempts: DataFrame, by=IP_DAY) -> DataFrame:
    """Groups with at least two attempts of which at least one failed."""
    return metrics(attempts, "num_attempts", "num_successes", by=by).where(
        "num_attempts >= 2 AND num_attempts > num_successes"
    )


def interarrival_stats(attempts: DataFrame, by=IP_DAY) -> DataFrame:
    """Median, mean, max, min and population deviation of the gaps; -1 for mean,
    median and deviation when there is a single attempt."""
    groups = attempts.groupBy(*by).agg(F.count("*").alias("num_attempts"))
    return groups.join(_gap_stats(attempts, by), list(by), "left").select(
        *by,
        *[
            F.coalesce(F.col(c), F.lit(-1.0)).alias(c)
            for c in ("gap_median", "gap_mean", "gap_max", "gap_min", "gap_std")
        ],
    )


def _gap_stats(attempts: DataFrame, by) -> DataFrame:
    # gaps are whole seconds: one row per value, and exact sums
    gap, n = F.col("gap").cast("decimal(19,0)"), F.col("n")
    values = gaps(attempts, by).groupBy(*by, "gap").agg(F.sum("n").alias("n"))
    stats = values.groupBy(*by).agg(
        F.percentile("gap", F.lit(0.5), F.col("n")).alias("gap_median"),
        F.sum("n").cast("decimal(19,0)").alias("_n"),
        F.sum(gap * n).cast("decimal(19,0)").alias("_s"),
        F.sum(F.col("gap") * F.col("gap") * n).cast("decimal(19,0)").alias("_ss"),
        F.max("gap").cast("double").alias("gap_max"),
        F.min("gap").cast("double").alias("gap_min"),
    )
    spread = (F.col("_n") * F.col("_ss") - F.col("_s") * F.col("_s")).cast("double")
    count = F.col("_n").cast("double")
    return stats.select(
        *by,
        "gap_median",
        (F.col("_s").cast("double") / count).alias("gap_mean"),
        "gap_max",
        "gap_min",
        (F.sqrt(F.greatest(spread, F.lit(0.0))) / count).alias("gap_std"),
    )


def average_interarrival(attempts: DataFrame, by=IP_DAY) -> DataFrame:
    """(last - first) / attempts, with its inputs."""
    span = epoch_seconds("last_seen") - epoch_seconds("first_seen")
    return metrics(attempts, "num_attempts", "first_seen", "last_seen", by=by).withColumn(
        "ave_interarrival", span / F.col("num_attempts")
    )


def attempts_per_user(attempts: DataFrame, by=IP_DAY) -> DataFrame:
    """Mean attempts per username: attempts over distinct usernames."""
    return metrics(attempts, "num_attempts", "user_groups", by=by).select(
        *by, share(F.col("num_attempts"), F.col("user_groups")).alias("attempts_per_user")
    )


def result_code_counts(attempts: DataFrame, by=IP_DAY) -> DataFrame:
    """Rows of group, result code, distinct users, attempts."""
    return attempts.groupBy(*by, "result_code").agg(
        F.count_distinct("username").alias("users"), F.count("*").alias("attempts")
    )


def result_code_map(attempts: DataFrame, by=IP_DAY) -> DataFrame:
    """``RCJ``: JSON map result code -> [distinct users, attempts], keys sorted.
    The default codes appear with zeros; a group holds a handful of codes."""
    pairs = F.collect_list(
        F.struct("result_code", F.array(F.col("users"), F.col("attempts")).alias("n"))
    )
    found = result_code_counts(attempts, by).groupBy(*by).agg(pairs.alias("found"))
    zero = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    defaults = F.array(
        *[F.struct(F.lit(c).alias("result_code"), zero.alias("n")) for c in RESULT_CODES]
    )
    missing = F.filter(
        defaults,
        lambda x: ~F.exists("found", lambda y: y["result_code"] == x["result_code"]),
    )
    entries = F.array_sort(F.concat("found", missing))
    return found.select(*by, F.to_json(F.map_from_entries(entries)).alias("RCJ"))


def most_common_user_agent(attempts: DataFrame, by=IP_DAY) -> DataFrame:
    """The most frequent user agent; NULL counts as one, ties go to the greater text."""
    counted = attempts.groupBy(*by, "user_agent").agg(F.count("*").alias("uses"))
    top = F.max(F.struct("uses", "user_agent"))
    return counted.groupBy(*by).agg(top.alias("top")).select(*by, "top.user_agent", "top.uses")


def unique_passwords_per_user(attempts: DataFrame) -> DataFrame:
    """``AUPPU`` per ⟨IP, day⟩: an attempt counts unless the same user sent the
    same password from the same IP strictly earlier that day; mean over the users.

    Equal passwords share an origin, so the earliest moment per ⟨user, origin, IP⟩
    answers the question without comparing attempts pairwise.
    """
    key = ["client_ip", "d", "username"]
    # all attempts at the earliest moment count; later ones repeat
    submissions = (
        password_origins(attempts, "username")
        .groupBy(*key, "origin", "timestamp")
        .agg(F.count("*").alias("n"))
        .groupBy(*key, "origin")
        .agg(F.min_by("n", "timestamp").alias("n"))
    )
    users = submissions.groupBy(*key).agg(F.sum("n").alias("n"))
    return users.groupBy("client_ip", "d").agg(
        F.sum("n").alias("unique_submissions"), F.avg("n").alias("AUPPU")
    )


def lset_usernames(attempts: DataFrame) -> DataFrame:
    """The usernames of every ⟨IP, day⟩ as rows, with attempts and successes.

    Kept as rows instead of a list column: one IP may try any number of names.
    """
    return attempts.groupBy("client_ip", "d", "username").agg(
        F.count("*").alias("attempts"), F.sum("result").alias("successes")
    )


_ADDITIVE = [
    "num_attempts", "num_successes", "num_password_in_breach", "num_strong_password_in_breach",
    "num_users_in_breach", "num_pair_in_breach", "num_failed_pair_in_breach",
    "num_tweaked_passwords", "zxcvbn_1", "zxcvbn_0", "null_user_agents",
]


def _counts(attempts: DataFrame, by) -> DataFrame:
    """All counts of a feature row. Counting per user first makes the distinct
    users plain sums; only the user agents need a second, narrow pass."""
    per_user = attempts.groupBy(*by, "username").agg(
        *[METRICS[n]().alias(n) for n in _ADDITIVE],
        F.max(_valid_user().cast("int")).alias("_valid"),
        F.sum("is_unique_pws_by_ip").alias("_new"),
    )
    valid = F.when(F.col("username").isNotNull(), F.col("_valid"))
    counts = per_user.groupBy(*by).agg(
        *[F.sum(n).alias(n) for n in _ADDITIVE],
        F.count("username").alias("num_unique_usernames"),
        F.coalesce(F.sum(valid), F.lit(0)).alias("num_valid_users"),
        F.coalesce(F.sum("_new"), F.lit(-1)).alias("unique_passwords_for_ip"),
        F.count("*").alias("user_groups"),
    )
    agents = (
        attempts.where("user_agent IS NOT NULL")
        .select(*by, "user_agent")
        .distinct()
        .groupBy(*by)
        .agg(F.count("*").alias("_agents"))
    )
    return counts.join(agents, list(by), "left").withColumn(
        "num_unique_user_agents", F.coalesce("_agents", F.lit(0))
    )


def _with_gaps_and_codes(attempts: DataFrame, by) -> DataFrame:
    base = _counts(attempts, by).where("num_attempts >= 2 AND num_attempts > num_successes")
    return base.join(_gap_stats(attempts, by), list(by), "left").join(
        result_code_map(attempts, by), list(by)
    )


def _of_attempts(name: str) -> Column:
    return share(F.col(name), F.col("num_attempts"))


def _usernames_per_password() -> Column:
    np = F.col("unique_passwords_for_ip")
    return F.when(np < 1, -1.0).otherwise(share(F.col("num_unique_usernames"), np))


def ip_day_features(attempts: DataFrame) -> DataFrame:
    """Feature row for every ⟨IP, day⟩ with two or more attempts and a failure.

    All inputs are aggregated on the same ⟨IP, day⟩ key, so the joins reuse the
    partitioning of the aggregates.
    """
    breached = F.col("num_password_in_breach")
    strong = share(F.col("num_strong_password_in_breach"), breached)
    return _with_gaps_and_codes(attempts, IP_DAY).select(
        *IP_DAY,
        F.coalesce("gap_mean", F.lit(-1.0)).alias("MIT_Mean"),
        F.coalesce("gap_median", F.lit(-1.0)).alias("MIT_Median"),
        F.coalesce("gap_std", F.lit(-1.0)).alias("SIT"),
        F.col("num_attempts").alias("NR"),
        F.col("num_unique_usernames").alias("NU"),
        F.col("unique_passwords_for_ip").alias("NP"),
        F.col("num_unique_user_agents").alias("NUA"),
        share(F.col("num_valid_users"), F.col("num_unique_usernames")).alias("FVU"),
        (1 - _of_attempts("num_successes")).alias("FF"),
        _of_attempts("num_password_in_breach").alias("FPIB"),
        F.when(breached == 0, -1.0).otherwise(strong).alias("FSPIB"),
        _of_attempts("num_users_in_breach").alias("FUIB"),
        _of_attempts("num_pair_in_breach").alias("FCIB"),
        _of_attempts("num_failed_pair_in_breach").alias("FICIB"),
        _of_attempts("num_tweaked_passwords").alias("FTP"),
        _of_attempts("null_user_agents").alias("FNUA"),
        share(F.col("num_attempts"), F.col("user_groups")).alias("AUP"),
        _usernames_per_password().alias("UWR"),
        "RCJ",
        "zxcvbn_1",
        "zxcvbn_0",
        F.lit("No comments").alias("comments"),
        F.lit(0).alias("IR"),
        share(
            F.col("num_unique_usernames") - F.col("num_valid_users"),
            F.col("num_unique_usernames"),
        ).alias("FIU"),
    )


def ip_features_window(attempts: DataFrame) -> DataFrame:
    """Feature row per IP over the whole given window. ``NUA`` counts missing user
    agents here and ``FSPIB`` divides by all attempts."""
    return _with_gaps_and_codes(attempts, ("client_ip",)).select(
        "client_ip",
        F.col("num_attempts").alias("NR"),
        (1 - _of_attempts("num_successes")).alias("FF"),
        F.col("num_unique_usernames").alias("NU"),
        share(F.col("num_valid_users"), F.col("num_unique_usernames")).alias("FVU"),
        F.col("unique_passwords_for_ip").alias("NP"),
        _usernames_per_password().alias("UWR"),
        F.coalesce("gap_mean", F.lit(-1.0)).alias("MIT"),
        F.col("null_user_agents").alias("NUA"),
        _of_attempts("num_unique_user_agents").alias("FUA"),
        "RCJ",
        _of_attempts("num_password_in_breach").alias("FPIB"),
        _of_attempts("num_users_in_breach").alias("FUIB"),
        _of_attempts("num_pair_in_breach").alias("FCIB"),
        _of_attempts("num_failed_pair_in_breach").alias("FICIB"),
        _of_attempts("num_strong_password_in_breach").alias("FSPIB"),
        _of_attempts("num_tweaked_passwords").alias("FTP"),
        "zxcvbn_1",
        "zxcvbn_0",
        share(F.col("num_attempts"), F.col("user_groups")).alias("APU"),
    )
