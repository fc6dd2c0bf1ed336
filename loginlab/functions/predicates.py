"""Filters over the attempt log and the session tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loginlab.functions.columns import all_of

# fixed value: the moment up to which a filter may ignore attempts, if told to by ``floor``
LOG_FLOOR = "2020-11-26 00:00:00"

# filter argument -> column of the attempt log
EQUALITY_FILTERS = {
    "username": "username",
    "result": "result",
    "pwd_in_breach": "password_appeared_in_breach",
    "username_in_breach": "username_appeared_in_breach",
    "pair_in_breach": "appeared_in_breach",
    "ip": "client_ip",
    "hashcat": "in_top_5k_hashcat",
    "rockyou": "in_top_5k_rockyou",
    "zxcvbn": "zxcvbn_score",
    "malformed_password": "malformed_password",
}


def _moment(value) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def attempt_filter(start=None, end=None, floor=None, **equal) -> Column:
    """Predicate for ``start <= timestamp < end``, ``timestamp > floor`` and any
    of the equality filters that is not None."""
    unknown = set(equal) - set(EQUALITY_FILTERS)
    if unknown:
        raise TypeError(f"unknown filters: {sorted(unknown)}")
    preds = [
        F.col(EQUALITY_FILTERS[name]) == F.lit(value)
        for name, value in equal.items()
        if value is not None
    ]
    if start is not None:
        preds += [F.col("timestamp") >= _moment(start), F.col("d") >= _moment(start).cast("date")]
    if end is not None:
        preds += [F.col("timestamp") < _moment(end), F.col("d") <= _moment(end).cast("date")]
    if floor is not None:
        preds.append(F.col("timestamp") > _moment(floor))
    return all_of(preds)


def open_window(start, end, user_agent=None) -> Column:
    """Predicate ``start < timestamp < end`` with an optional exact user agent."""
    preds = [
        F.col("timestamp") > _moment(start),
        F.col("timestamp") < _moment(end),
        F.col("d").between(_moment(start).cast("date"), _moment(end).cast("date")),
    ]
    if user_agent is not None:
        preds.append(F.col("user_agent") == user_agent)
    return all_of(preds)


def automated_predicate(max_gap_seconds=2, min_attempts=2) -> Column:
    """Sessions that look scripted: many attempts in quick succession."""
    return (F.col("num_attempts") > min_attempts) & (
        F.col("average_interarrival_time") < max_gap_seconds
    )


def session_filter(start=None, end=None, automated=None) -> Column:
    preds = []
    if start is not None:
        preds.append(F.col("timestamp_start") >= _moment(start))
    if end is not None:
        preds.append(F.col("timestamp_end") < _moment(end))
    if automated:
        preds.append(automated_predicate())
    return all_of(preds)
