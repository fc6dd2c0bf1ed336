"""Time-ordered computations that stay parallel inside one hot group.

A window over ⟨IP, day⟩, or over some hours of it, would put a large part of a hot IP in one
task. Attempts are therefore counted per ⟨key, second⟩ first, with map-side combine. Windows
run over the seconds of a fixed time slice, which are at most ``SLICE_SECONDS``, and over
one row per slice; attempts are put in order only inside a second. Times count in whole
seconds: a log with finer times is ordered by them, but gaps drop the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loginlab.functions.columns import epoch_seconds

SLICE_SECONDS = 7200


def _sliced(df: DataFrame, slice_seconds: int) -> DataFrame:
    sec = epoch_seconds("timestamp")
    return df.withColumn("_sec", sec).withColumn(
        "_slice", F.floor(F.col("_sec") / slice_seconds)
    )


def per_second(rows: DataFrame, keys, **sums) -> DataFrame:
    """One row per ⟨key, second⟩ with the attempts ``_n``, sums of columns, and, from the seconds
    before it in the key: ``_prev``, the last second, and totals ``_n_before``, ``<sum>_before``.
    ``rows`` has ``_sec`` and ``_slice``."""
    keys = list(keys)
    totals = {"_n": F.count("*"), **{n: F.sum(c) for n, c in sums.items()}}
    seconds = rows.groupBy(*keys, "_slice", "_sec").agg(*[c.alias(n) for n, c in totals.items()])
    slices = seconds.groupBy(*keys, "_slice").agg(
        F.max("_sec").alias("_end"), *[F.sum(n).alias(n) for n in totals]
    )
    across = Window.partitionBy(*keys).orderBy("_slice")
    inside = Window.partitionBy(*keys, "_slice").orderBy("_sec")
    up_to_here = Window.unboundedPreceding, -1
    slices = slices.select(
        *keys,
        "_slice",
        F.lag("_end").over(across).alias("_end"),
        *[F.sum(n).over(across.rowsBetween(*up_to_here)).alias(f"{n}_s") for n in totals],
    )
    zero = F.lit(0)
    seconds = seconds.withColumn("_lag", F.lag("_sec").over(inside)).withColumns(
        {f"{n}_i": F.sum(n).over(inside.rowsBetween(*up_to_here)) for n in totals}
    )
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*keys, "_slice"]]
    return (
        seconds.alias("x")
        .join(slices.alias("y"), same)
        .select(
            *[F.col(f"x.{c}") for c in [*keys, "_sec", *totals]],
            F.coalesce("x._lag", "y._end").alias("_prev"),
            *[
                (F.coalesce(F.col(f"x.{n}_i"), zero) + F.coalesce(F.col(f"y.{n}_s"), zero)).alias(f"{n}_before")
                for n in totals
            ],
        )
    )


def gaps(attempts: DataFrame, keys, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """The gaps in seconds between consecutive attempts of a key: keys, ``gap``, and how
    often it follows in a row as ``n``. Equal gaps of a key can be in several rows."""
    keys = list(keys)
    rows = _sliced(attempts, slice_seconds).select(*keys, "_slice", "_sec")
    seconds = per_second(rows, keys)
    # n attempts in one second have n - 1 gaps of zero among them
    return seconds.select(
        *keys,
        F.inline(
            F.array(
                F.struct((F.col("_sec") - F.col("_prev")).alias("gap"), F.lit(1).cast("long").alias("n")),
                F.struct(F.lit(0).cast("long").alias("gap"), (F.col("_n") - 1).alias("n")),
            )
        ),
    ).where("gap IS NOT NULL AND n > 0")


def _with_seconds(attempts: DataFrame, keys, slice_seconds: int, **sums) -> DataFrame:
    """Attempts with their place inside their second, ``_place`` from 1, and the columns of
    :func:`per_second`; sums also have ``<sum>_upto``, counted inside the second."""
    rows = _sliced(attempts, slice_seconds)
    inside = Window.partitionBy(*keys, "_sec").orderBy("timestamp", "id")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_place", F.row_number().over(inside)).withColumns(
        {f"{n}_upto": F.sum(c).over(so_far) for n, c in sums.items()}
    )
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_sec"]]
    extra = ["_prev", "_n_before", *[f"{n}_before" for n in sums]]
    return (
        placed.alias("r")
        .join(per_second(rows, keys, **sums).alias("s"), same)
        .select("r.*", *[F.col(f"s.{c}") for c in extra])
        .drop("_slice")
    )


def previous_in_day(
    attempts: DataFrame, keys, out: str, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Adds the gap in seconds to the key's previous attempt of the day (NULL for
    the first one); attempts are ordered by timestamp, then id."""
    gap = F.when(F.col("_place") > 1, F.lit(0)).otherwise(F.col("_sec") - F.col("_prev"))
    rows = _with_seconds(attempts, [*keys, "d"], slice_seconds).withColumn(out, gap)
    return rows.drop("_sec", "_place", "_prev", "_n_before")


def slot_in_day(
    attempts: DataFrame, keys, out: str = "slot", slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Adds the 1-based position of an attempt among the key's attempts of the
    day, ordered by timestamp, then id."""
    rows = _with_seconds(attempts, [*keys, "d"], slice_seconds)
    rows = rows.withColumn(out, F.col("_n_before") + F.col("_place"))
    return rows.drop("_sec", "_place", "_prev", "_n_before")


def slots_and_totals(
    attempts: DataFrame, keys, flag: str, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Adds ``slot`` as :func:`slot_in_day`, and ``total``: the sum of a column over the
    key's attempts of the day up to this one."""
    rows = _with_seconds(attempts, [*keys, "d"], slice_seconds, _sum=F.col(flag))
    return rows.withColumns(
        {
            "slot": F.col("_n_before") + F.col("_place"),
            "total": F.col("_sum_before") + F.col("_sum_upto"),
        }
    ).drop("_sec", "_place", "_prev", "_n_before", "_sum_before", "_sum_upto")
