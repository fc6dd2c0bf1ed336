"""Joins of rows with a table of groups in which few groups may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 200  # keys with more than this part of all rows are hot: there are fewer of them than this
SALTS = 32


def join_groups(
    rows: DataFrame, groups: DataFrame, on: list[str], size: str, spread: str, how: str = "left"
) -> DataFrame:
    """Join of ``rows`` with ``groups``, which is stored, has one row per key and the number of its
    rows in ``size``. The rows of hot keys are spread over SALTS parts by a hash of the column
    ``spread``; fewer than HOT_SHARE keys can be hot, so these are broadcast."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > total
    hot = groups.where(is_hot).select(*on, F.lit(True).alias("_is_hot"))
    salt = F.when(F.col("_is_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0))
    rows = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", salt.cast("int"))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread_groups = groups.withColumn("_salt", F.explode(every))
    return rows.drop("_is_hot").join(spread_groups, [*on, "_salt"], how).drop("_salt")
