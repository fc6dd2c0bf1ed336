"""A login log derived from an ``events`` table, for tests and benchmarks.

Real deployments read the log with :mod:`loginlab.sources.attempts`. Here every
event becomes one attempt. The clock advances with ``event_id``, so a larger
table covers more days and no day holds more than about 864 attempts; that bounds
the per-day arrays of password distances. A day is too small for a folder of its own: the
stored log has one per month, with whole days in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loginlab.functions.columns import epoch_seconds, is_new_password
from loginlab.sources.attempts import scratch_table

SESSION_GAP_SECONDS = 1800
MONTH = "month"
HELPERS = ("user_id", "v", "k", "pw", "uan")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _base(spark: SparkSession, sf_dir: str, by_day: bool = False) -> DataFrame:
    """Plain attempt columns plus the helpers v, k, pw and uan; ``by_day`` deals the rows out by ranges of days."""
    e = events(spark, sf_dir).select(
        "event_id",
        "user_id",
        "event_type",
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("v"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    e = e.withColumn(
        "t",
        F.expr(
            """CASE WHEN k < 60 THEN (event_id div 288) * 28800 + (v * 7 + event_id) % 120
                    ELSE event_id * 100 + v % 60 END"""
        ),
    )
    e = e.withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, t)"))
    e = e.withColumn("d", F.col("timestamp").cast("date"))
    if by_day:
        e = e.repartitionByRange("d")
    e = e.selectExpr(
        "*",
        """CASE WHEN event_type = 'signup' AND v % 3 = 0 THEN 'UnknownUsername'
                WHEN (k >= 60 AND v % 5 <> 0) OR (k < 60 AND v % 13 = 0) THEN 'Success'
                WHEN v % 11 = 0 THEN 'AccountError'
                ELSE 'InvalidCredentials' END AS result_code""",
        """CASE WHEN k < 60 THEN v % 23 ELSE user_id % 5 + (v % 9) div 8 END AS pw""",
        """CASE WHEN k < 30 THEN v % 10 WHEN k < 38 THEN 3 WHEN k < 60 THEN user_id % 6
                ELSE user_id % 4 END AS uan""",
    )
    flag = "CAST({} AS INT)".format
    return e.selectExpr(
        "event_id AS id",
        "concat('u', user_id) AS username",
        """CASE WHEN k < 30 THEN '203.0.113.7'
                WHEN k < 34 THEN concat('203.0.113.', 1 + k % 2)
                WHEN k < 38 THEN concat('128.104.0.', 3 + k % 2)
                WHEN k < 60 THEN concat('198.18.', user_id % 16, '.', 1 + (t div 86400) % 200)
                ELSE concat('100.64.', user_id % 4, '.', user_id % 200) END AS client_ip""",
        "timestamp",
        "d",
        flag("result_code = 'Success'") + " AS result",
        "result_code",
        """CASE WHEN uan = 0 THEN NULL
                WHEN uan = 1 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36'
                WHEN uan = 2 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 16_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/16.6 Mobile/15E148 Safari/604.1'
                WHEN uan = 3 THEN 'python-requests/2.31.0'
                ELSE concat('Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/8', uan, '.0') END AS user_agent""",
        flag("user_id % 3 = 0 AND pw % 4 = 0 AND v % 2 = 0") + " AS appeared_in_breach",
        flag("user_id % 3 = 0") + " AS username_appeared_in_breach",
        flag("pw % 4 = 0") + " AS password_appeared_in_breach",
        flag("pw >= 12") + " AS zxcvbn_score",
        flag("pw = 3") + " AS in_top_5k_hashcat",
        flag("pw IN (2, 3)") + " AS in_top_5k_rockyou",
        flag("pw = 3") + " AS in_top_2k_hashcat",
        flag("pw = 3") + " AS in_top_2k_rockyou",
        flag("pw < 1") + " AS in_top_10_passwords",
        flag("pw < 2") + " AS in_top_100_passwords",
        flag("pw < 4") + " AS in_top_1000_passwords",
        flag("pw = 0") + " AS frequently_submitted_password_today",
        flag("user_id % 7 = 0") + " AS frequently_submitted_username_today",
        flag("v % 97 = 0") + " AS malformed_password",
        """CASE WHEN v % 5 = 0 THEN array(array(CAST(v % 6 AS DOUBLE), CAST(v % 4 AS DOUBLE), CAST(NULL AS DOUBLE)),
                                           array(CAST(v % 7 AS DOUBLE), CAST(v % 3 AS DOUBLE), CAST(v % 2000 AS DOUBLE)))
                WHEN v % 5 = 1 THEN array(array(CAST(v % 6 AS DOUBLE), CAST(v % 4 AS DOUBLE), CAST(NULL AS DOUBLE)),
                                          array(CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(v % 3000 AS DOUBLE)))
                ELSE array(array(CAST(v % 6 AS DOUBLE), CAST(v % 4 AS DOUBLE), CAST(NULL AS DOUBLE)))
           END AS credential_tweaking_measurements""",
        "user_id",
        "v",
        "k",
        "pw",
        "uan",
    )


def _with_history(base: DataFrame) -> DataFrame:
    """Adds what depends on earlier attempts of the same day. Rows dealt out by day are not shuffled again."""
    out = base
    for name, keys in (
        ("username", ["username"]),
        ("ip", ["client_ip"]),
        ("username_ip", ["username", "client_ip"]),
    ):
        # at most one day of one key: the clock bounds a day's attempts
        w = Window.partitionBy(*keys, "d").orderBy("timestamp", "id")
        gap = epoch_seconds("timestamp") - F.lag(epoch_seconds("timestamp")).over(w)
        out = out.withColumn(
            f"interarrival_time_by_{name}", F.coalesce(gap.cast("double"), F.lit(-1.0))
        )
        starts = ~F.col(f"interarrival_time_by_{name}").between(0, SESSION_GAP_SECONDS)
        out = out.withColumn(
            f"{name}_session_id",
            F.last(F.when(starts, F.col("id")), ignorenulls=True).over(
                w.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        if len(keys) > 1:
            continue
        earlier = F.collect_list("pw").over(w.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("_earlier", earlier)
        dist = F.transform("_earlier", lambda x: F.abs(F.col("pw") - x).cast("int"))
        out = out.withColumn(
            f"distance_from_submissions_by_{name}",
            F.when(F.size("_earlier") > 0, F.concat(dist, F.array(F.lit(0)))),
        ).drop("_earlier")
        out = out.withColumn(
            f"is_unique_pws_by_{name}",
            is_new_password(f"distance_from_submissions_by_{name}"),
        )
    return out


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt log, computed from the events on the fly."""
    return _with_history(_base(spark, sf_dir)).drop(*HELPERS)


_tables: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def _table(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        log = _with_history(_base(spark, sf_dir, by_day=True)).drop(*HELPERS)
        log = log.select(*[c for c in log.columns if c != "d"], "d", F.date_format("d", "yyyy-MM").alias(MONTH))
        path = scratch_table(spark, "attempts")
        log.write.partitionBy(MONTH).parquet(path)
        _tables[key] = path, spark.read.schema(log.schema).parquet(path).drop(MONTH)
    return _tables[key]


def attempts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt log as a Parquet table partitioned by month, written once per
    Spark application to the shared folder."""
    return _table(spark, sf_dir)[1]


def attempts_path(spark: SparkSession, sf_dir: str) -> str:
    """The folder of that table."""
    return _table(spark, sf_dir)[0]


def attempts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a stream of its files."""
    path, log = _table(spark, sf_dir)
    return spark.readStream.schema(log.schema.add(MONTH, "string")).parquet(path).drop(MONTH)


def _sessions(rows: DataFrame, sid: str, keys) -> DataFrame:
    span = F.max(epoch_seconds("timestamp")) - F.min(epoch_seconds("timestamp"))
    n = F.count("*")
    return (
        rows.withColumnRenamed(sid, "sid")
        .groupBy("sid")
        .agg(
            *[F.first(k).alias(k) for k in keys],
            F.min("timestamp").alias("timestamp_start"),
            F.max("timestamp").alias("timestamp_end"),
            n.alias("num_attempts"),
            F.when(n > 1, span / (n - 1)).otherwise(-1.0).alias("average_interarrival_time"),
            F.count_distinct("client_ip").alias("num_unique_ips"),
            F.count_distinct("username").alias("num_unique_usernames"),
            F.count_distinct("user_agent").alias("num_unique_user_agents"),
            F.count_distinct(F.coalesce("user_agent", F.lit("none"))).alias("num_unique_devices"),
            F.max_by("result", F.struct("timestamp", "id")).alias("ended_with_success"),
            F.sum("username_appeared_in_breach").alias("num_attempts_username_in_breach"),
            F.sum("password_appeared_in_breach").alias("num_attempts_password_in_breach"),
            F.sum("in_top_5k_hashcat").alias("num_attempts_password_in_hashcat"),
            F.sum("in_top_5k_rockyou").alias("num_attempts_password_in_rockyou"),
            F.sum(1 - F.col("zxcvbn_score")).alias("num_attempts_zxcvbn_score_0"),
            F.avg("zxcvbn_score").alias("average_zxcvbn_score"),
        )
        .withColumnRenamed("sid", "id")
    )


def sessions(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Session table of one kind: ``username``, ``ip`` or ``username_ip``."""
    keys = {"username": ["username"], "ip": ["client_ip"], "username_ip": ["username", "client_ip"]}
    rows = attempts_table(spark, sf_dir)
    return _sessions(rows, f"{kind}_session_id", keys[kind]).withColumnRenamed("client_ip", "ip")


def mfa_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-factor events: epoch seconds, six hours behind the attempt log."""
    return (
        _base(spark, sf_dir)
        .where("user_id % 2 = 0 AND id % 3 = 0 AND k >= 28 AND result = 1")  # what needs no parsing first
        .select(
            "id",
            "username",
            (epoch_seconds("timestamp") - 21600 + F.col("id") % 481 - 240).alias("timestamp"),
            F.expr(
                "CASE WHEN v % 5 = 0 THEN 'denied' WHEN v % 5 = 1 THEN 'fraud' ELSE 'success' END"
            ).alias("result"),
        )
    )


def compromised_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir)
        .where("user_id % 10 = 0")
        .select(F.concat(F.lit("u"), F.col("user_id")).alias("netid"))
    )


def ip_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix table built on the ``nation`` dimension."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(
        """CASE WHEN n_nationkey < 16 THEN concat('198.18.', n_nationkey, '.0/24')
                WHEN n_nationkey = 16 THEN '203.0.113.0/24'
                WHEN n_nationkey = 17 THEN '203.0.0.0/16'
                WHEN n_nationkey = 18 THEN '128.104.0.0/16'
                WHEN n_nationkey = 19 THEN '100.64.0.0/24'
                WHEN n_nationkey = 20 THEN '100.64.2.0/23'
                ELSE concat('100.65.', n_nationkey, '.0/24') END AS network""",
        """CASE WHEN n_nationkey < 16 THEN concat('Carrier ', n_nationkey % 5)
                WHEN n_nationkey = 18 THEN 'State University Network'
                WHEN n_nationkey = 19 THEN 'Lakeside School District'
                ELSE concat('Hosting ', n_nationkey) END AS isp""",
        "concat('AS ', n_nationkey % 3) AS asn_org",
        "n_name AS country",
        "concat('City ', n_nationkey) AS city",
        "n_nationkey % 7 = 0 AS is_proxy",
    )
