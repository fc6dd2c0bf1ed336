"""Exact order statistics over a whole column without sorting it in one task.

The column is reduced to one row per distinct value. The values are split into ranges at
approximate quantiles of the distinct values, so outliers do not crowd the others into one
range; positions are counted inside each range and shifted by the (at most
``RANGES + 1``) range totals. Where the boundaries fall does not change a result.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1024


def ranked_values(df: DataFrame, value: Column) -> DataFrame:
    """``value, cnt, lo, hi, total``: each distinct non-NULL value with the
    0-based positions ``lo..hi`` its copies take in ascending order."""
    hist = (
        df.select(value.cast("double").alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count("*").alias("cnt"))
    )
    shares = [k / RANGES for k in range(1, RANGES)]
    bounds = hist.agg(F.percentile_approx("value", shares, 10 * RANGES)).first()[0]
    ranged = _ranged(hist, bounds)
    before = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("rng").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    # one row per range: never more than RANGES + 1 rows
    offsets = (
        ranged.groupBy("rng")
        .agg(F.sum("cnt").alias("_n"))
        .select(
            "rng",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.sum("_n").over(everything).alias("total"),
        )
    )
    inside = (
        Window.partitionBy("rng").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        ranged.withColumn("_upto", F.sum("cnt").over(inside))
        .join(F.broadcast(offsets), "rng")
        .select(
            "value",
            "cnt",
            (F.col("_offset") + F.col("_upto") - F.col("cnt")).alias("lo"),
            (F.col("_offset") + F.col("_upto") - 1).alias("hi"),
            "total",
        )
    )


def _ranged(hist: DataFrame, quantiles) -> DataFrame:
    """Adds the range that each value is in, found by bisection."""
    bounds = sorted({q for q in quantiles or [] if math.isfinite(q)})
    if not bounds:
        return hist.withColumn("rng", F.lit(0))
    splits = [-math.inf, *bounds, math.inf]
    cut = Bucketizer(splits=splits, inputCol="value", outputCol="rng", handleInvalid="keep")
    return cut.transform(hist).withColumn("rng", F.col("rng").cast("int"))


def descending_element(df: DataFrame, value: Column, share: float, out: str) -> DataFrame:
    """One row: the element at offset ``int((n - 1) * share)`` in descending order."""
    r = ranked_values(df, value)
    target = F.col("total") - 1 - F.floor((F.col("total") - 1) * F.lit(share))
    return r.where(target.between(F.col("lo"), F.col("hi"))).select(F.col("value").alias(out))


def percentiles(df: DataFrame, value: Column, points) -> DataFrame:
    """``pct, value``: linearly interpolated percentiles, as NumPy computes them."""
    r = ranked_values(df, value)
    last = F.col("total") - 1

    def reached(p, side):
        return side(last * p / F.lit(100.0)).between(F.col("lo"), F.col("hi"))

    wanted = F.filter(
        F.array(*[F.lit(p) for p in points]),
        lambda p: reached(p, F.floor) | reached(p, F.ceil),
    )
    # one or two values per point
    around = r.select("value", last.alias("last"), F.explode(wanted).alias("pct"))
    pos = F.max("last") * F.col("pct") / F.lit(100.0)
    return around.groupBy("pct").agg(
        (F.min("value") + (F.max("value") - F.min("value")) * (pos - F.floor(pos))).alias("value")
    )
