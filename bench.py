"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loginlab.plans.catalog import QUERIES  # noqa: E402
from loginlab.sources import derived  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "ip_day_features",
    "auppu",
    "threshold_percentiles",
    "filtered_lsets",
    "pairwise_distance",
    "average_linkage_clusters",
    "connected_campaigns",
    "campaign_stats",
    "password_identity_by_user",
    "attempt_statistics",
    "ip_session_stats",
    "cred_stuffing_score",
    "connecting_ips",
    "password_reuse_across_ips",
    "ip_reachability",
]


def main(work):
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", work)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    start = time.time()
    derived.attempts_table(spark, SF_DIR)
    seconds["ingest"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "total", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR}
        )
    )
    spark.stop()


if __name__ == "__main__":
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        main(folder)
