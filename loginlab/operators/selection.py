"""Picking the suspicious feature rows: high failure rate, minus benign sources."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loginlab.functions.columns import address, any_of, network_of
from loginlab.functions.ranks import percentiles
from loginlab.operators import enrich, features

# fixed values: thresholds and institution sources
MIN_ATTEMPTS = 7
MIN_FAILURES = 0.8
MIN_PASSWORD_SHARE = 0.10
INSTITUTION_NETWORKS = [
    "72.33.0.0/16",
    "144.92.0.0/16",
    "128.104.0.0/16",
    "128.105.0.0/16",
    "146.151.0.0/17",
    "146.151.128.0/17",
    "198.133.224.0/24",
    "198.133.225.0/24",
    "198.51.254.0/24",
]
INSTITUTION_PATTERNS = [
    "(.*)university(.*)",
    "(.*)Wisc(.*)",
    "(.*)Institute(.*)",
    "(.*)of(.*)Technology(.*)",
    "(.*)School(.*)",
    "(.*)Academy(.*)",
]
LSET_COLUMNS = [
    "id", "client_ip", "ISP", "is_proxy", "DATE", "MIT_Mean", "MIT_Median", "SIT", "NR", "NU",
    "AUPPU", "FVU", "FF", "FPIB", "FSPIB", "FUIB", "FCIB", "FICIB", "FTP", "FNUA", "FIU",
    "zxcvbn_1", "zxcvbn_0", "os_json_cnt", "app_json_cnt", "browser_json_cnt", "NUA", "RCJ",
    "duo_responses",
]
# what the feature rows are computed from
READ = [
    "id", "username", "client_ip", "timestamp", "d", "result", "result_code", "user_agent",
    "appeared_in_breach", "username_appeared_in_breach", "password_appeared_in_breach", "zxcvbn_score",
    "credential_tweaking_measurements", "is_unique_pws_by_ip",
]


@dataclass
class Rules:
    """What the filters take for suspicious and for benign."""

    min_attempts: int = MIN_ATTEMPTS
    min_failures: float = MIN_FAILURES
    min_password_share: float = MIN_PASSWORD_SHARE
    networks: list[str] = field(default_factory=lambda: list(INSTITUTION_NETWORKS))
    isp_patterns: list[str] = field(default_factory=lambda: list(INSTITUTION_PATTERNS))

    def selected(self) -> Column:
        return high_failure_rate(self.min_attempts, self.min_failures)


def lsets(
    attempts: DataFrame,
    prefixes: DataFrame,
    mfa_log: DataFrame,
    chosen: DataFrame | None = None,
    mine: DataFrame | None = None,
) -> DataFrame:
    """Feature rows with network, user-agent, second-factor and password columns.

    ``chosen`` are feature rows already selected; then only their attempts, and the
    days of their users, are read for the added columns. ``mine`` are these attempts, where they are
    stored already. Usernames stay in :func:`loginlab.operators.features.lset_usernames`.
    """
    key = ["client_ip", "d"]
    f = features.ip_day_features(attempts) if chosen is None else chosen
    whole_days = attempts
    if chosen is None:
        mine = attempts
    else:
        mine = attempts.join(chosen.select(*key), key, "left_semi") if mine is None else mine
        users = mine.select("username", "d").distinct()
        whole_days = attempts.join(users, ["username", "d"], "left_semi")
    passwords = features.unique_passwords_per_user(whole_days).drop("unique_submissions")
    mfa = enrich.mfa_counts(enrich.mfa_attempt_matches(mfa_log, mine))
    empty = F.create_map().cast("map<string,bigint>")
    none = F.lit('{"success":0,"denied":0,"fraud":0}')
    return (
        f.join(passwords, key, "left")
        .join(enrich.user_agent_counts(mine), key, "left")
        .join(mfa.select(*key, "duo_responses"), key, "left")
        .join(enrich.ip_networks(attempts if chosen is None else chosen, prefixes), "client_ip", "left")
        .withColumns(
            {
                "id": F.concat_ws("|", "client_ip", "d"),
                "DATE": F.col("d"),
                "ISP": F.col("isp"),
                "duo_responses": F.coalesce("duo_responses", none),
                **{
                    c: F.coalesce(c, empty)
                    for c in ("os_json_cnt", "app_json_cnt", "browser_json_cnt")
                },
            }
        )
    )


def high_failure_rate(min_attempts=MIN_ATTEMPTS, min_failures=MIN_FAILURES) -> Column:
    return (F.col("NR") > min_attempts) & (F.col("FF") > min_failures)


def no_mfa_success() -> Column:
    return F.get_json_object("duo_responses", "$.success").cast("long") == 0


def in_networks(ip="client_ip", networks=INSTITUTION_NETWORKS) -> Column:
    """Membership in one of a few CIDR blocks of either family."""

    def inside(bits):
        tests = []
        for cidr in networks:
            net = ipaddress.ip_network(cidr)
            value = int(net.network_address) << (96 if net.version == 4 else 0)
            signed = [(v ^ 2**63) - 2**63 for v in (value >> 64, value & (2**64 - 1))]
            masked = network_of(bits, net.prefixlen)
            tests.append(
                (masked["family"] == net.version) & (masked["hi"] == signed[0]) & (masked["lo"] == signed[1])
            )
        return any_of(tests)

    return F.coalesce(F.exists(F.array(address(ip)), inside), F.lit(False))


def institution_isp(isp="ISP", patterns=INSTITUTION_PATTERNS) -> Column:
    return F.coalesce(any_of([F.col(isp).rlike("(?i)" + p) for p in patterns]), F.lit(False))


def plausible_client(share=MIN_PASSWORD_SHARE) -> Column:
    """Drops clients that resend one password over and over."""
    return F.col("AUPPU") * F.col("NU") / F.col("NR") > share


def steps(rules: Rules | None = None) -> dict[str, Column]:
    """The filters after the high-failure-rate selection, in order."""
    rules = rules or Rules()
    return {
        "after_mfa": no_mfa_success(),
        "after_networks": ~in_networks(networks=rules.networks),
        "after_isp": ~institution_isp(patterns=rules.isp_patterns),
        "after_malformed": plausible_client(rules.min_password_share),
    }


def filtered_lsets(all_lsets: DataFrame, rules: Rules | None = None) -> DataFrame:
    rules = rules or Rules()
    out = all_lsets.where(rules.selected())
    for keep in steps(rules).values():
        out = out.where(keep)
    return out


def filter_report(all_lsets: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Rows left after every step, from one pass."""
    rules = rules or Rules()
    failed_first = F.lit(len(steps(rules)))
    for i, keep in reversed(list(enumerate(steps(rules).values()))):
        failed_first = F.when(keep, failed_first).otherwise(i)
    reached = (
        all_lsets.where(rules.selected())
        .select(failed_first.alias("passed"))
        .groupBy("passed")
        .agg(F.count("*").alias("n"))
    )
    return reached.agg(
        F.sum("n").alias("selected"),
        *[
            F.sum(F.when(F.col("passed") > i, F.col("n")).otherwise(0)).alias(name)
            for i, name in enumerate(steps(rules))
        ],
    )


def threshold_percentiles(feature_rows: DataFrame) -> DataFrame:
    """Percentiles 1..100 of NR and FF, their most frequent value and the
    suggested threshold: the first percentile from the 80th on (upwards for NR,
    downwards for FF) that differs from the most frequent one by at least 0.1."""
    rows = feature_rows.where("NR > 1 AND FF > 0")
    return _with_threshold(rows, "NR", upwards=True).unionByName(
        _with_threshold(rows, "FF", upwards=False)
    )


def _with_threshold(rows: DataFrame, name: str, upwards: bool) -> DataFrame:
    # 100 percentiles, handled as one short array
    points = percentiles(rows, F.col(name), range(1, 101)).agg(
        F.array_sort(F.collect_list(F.struct("pct", "value"))).alias("points")
    )

    def copies(p):
        return F.size(F.filter("points", lambda q: q["value"] == p["value"]))

    def away(p):
        side = p["pct"] >= 80 if upwards else p["pct"] <= 80
        return side & (F.abs(p["value"] - F.col("mode")) >= 0.1)

    most = F.array_max(
        F.transform("points", lambda p: F.struct(copies(p).alias("n"), (-p["value"]).alias("v")))
    )
    hits = F.filter("points", away)
    return (
        points.withColumn("mode", -most["v"])
        .withColumn("threshold", F.get(hits, F.lit(0) if upwards else F.size(hits) - 1)["value"])
        .select(F.lit(name).alias("feature"), F.inline("points"), "mode", "threshold")
    )
