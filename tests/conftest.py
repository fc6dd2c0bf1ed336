import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCHEMA = """id long, username string, client_ip string, timestamp timestamp_ntz, d date, result int,
result_code string, user_agent string, appeared_in_breach int, username_appeared_in_breach int,
password_appeared_in_breach int, zxcvbn_score int, in_top_5k_hashcat int, in_top_5k_rockyou int,
malformed_password int, credential_tweaking_measurements array<array<double>>,
distance_from_submissions_by_username array<int>, distance_from_submissions_by_ip array<int>,
is_unique_pws_by_ip int, is_unique_pws_by_username int"""
NAMES = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")]
DEFAULTS = dict.fromkeys(NAMES, 0) | {
    "result_code": "InvalidCredentials",
    "user_agent": "Mozilla/5.0 (X11; Linux x86_64) Firefox/80.0",
    "credential_tweaking_measurements": [[5.0, 5.0, None]],
    "distance_from_submissions_by_username": None,
    "distance_from_submissions_by_ip": None,
    "is_unique_pws_by_ip": 1,
    "is_unique_pws_by_username": 1,
}
START = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def log(spark):
    """Builds an attempt log from dicts with ``at`` (seconds), ``username``,
    ``client_ip`` and optionally ``pw``, from which the distances are filled."""

    def build(attempts):
        rows = []
        for n, given in enumerate(attempts):
            row = DEFAULTS | {"id": n, "username": "u", "client_ip": "10.0.0.1"} | given
            row["timestamp"] = START + timedelta(seconds=row.pop("at", n))
            row["d"] = row["timestamp"].date()
            if row["result"] and row["result_code"] == "InvalidCredentials":
                row["result_code"] = "Success"
            rows.append(row)
        for key, name in (("username", "username"), ("client_ip", "ip")):
            seen = {}
            for row in sorted(rows, key=lambda r: (r["timestamp"], r["id"])):
                if "pw" not in row:
                    continue
                earlier = seen.setdefault((row[key], row["d"]), [])
                column = f"distance_from_submissions_by_{name}"
                row[column] = [abs(row["pw"] - p) for p in earlier] + [0] if earlier else None
                row[f"is_unique_pws_by_{name}"] = int(row["pw"] not in earlier)
                earlier.append(row["pw"])
        return spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA)

    return build


@pytest.fixture(scope="session")
def random_attempts():
    """A busy log: one hot IP and user, many ties, few passwords, several days."""
    import random

    def make(n=400, seed=1):
        r = random.Random(seed)
        return [
            {
                "id": i,
                "at": r.randrange(3) * 86400 + r.choice([r.randrange(20), r.randrange(86400)]),
                "username": r.choice(["hot", "hot", "a", "b", "c"]),
                "client_ip": r.choice(["10.0.0.1", "10.0.0.1", "10.0.0.2", "10.0.1.1"]),
                "pw": r.randrange(12),
                "result": int(r.random() < 0.2),
            }
            for i in range(n)
        ]

    return make
