"""Distances between two feature rows, as column expressions.

Every function takes two accessors, ``a`` and ``b``, that map a column name to
the column of either row.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SAME_NETWORK = 1 - math.exp(-1)
SAME_ISP = 1 - math.exp(-2)
# fixed values: weights of the parts
OUTER_WEIGHT = 0.5 / 2
INNER_WEIGHT = {True: 0.5 / 9, False: 0.5 / 6}  # with / without password features


def _ratio(x: Column, y: Column) -> Column:
    """(x - y) / (x + y), 0 when both are 0."""
    return F.coalesce(F.try_divide(x - y, x + y), F.lit(0.0))


def _total(terms) -> Column:
    return reduce(lambda p, q: p + q, terms)


def _mean(terms) -> Column:
    terms = list(terms)
    return _total(terms) / len(terms)


def _number(row, name) -> Column:
    return row(name).cast("double")


def dist_ip(a, b, missing_matches: bool = True) -> Column:
    """0 same address, then same network, same ISP, otherwise 1. Two unknown
    networks count as the same one unless ``missing_matches`` is False."""

    def same(name):
        eq = a(name) == b(name)
        return eq if missing_matches else eq & (a(name) != "NA")

    return (
        F.when(a("client_ip") == b("client_ip"), 0.0)
        .when(same("network"), SAME_NETWORK)
        .when(same("ISP"), SAME_ISP)
        .otherwise(1.0)
    )


def dist_date(a, b) -> Column:
    return 1 - F.exp(-F.abs(F.datediff(a("DATE"), b("DATE"))).cast("double"))


def dist_interarrival(a, b) -> Column:
    return _mean(
        F.abs(_ratio(_number(a, c), _number(b, c))) for c in ("MIT_Mean", "SIT")
    )


def dist_breach(a, b, absolute: bool = False) -> Column:
    """Mean of the signed ratios of the breach shares; order matters unless
    ``absolute``."""
    zero = F.lit(0.0)
    terms = [
        _ratio(F.greatest(_number(a, c), zero), F.greatest(_number(b, c), zero))
        for c in ("FPIB", "FTP")
    ]
    return _mean([F.abs(t) for t in terms] if absolute else terms)


def _map_distance(x: Column, y: Column) -> Column:
    """Mean over the keys of either map of |difference| / larger count."""

    def one(_, p, q):
        p, q = F.coalesce(p, F.lit(0)), F.coalesce(q, F.lit(0))
        return F.abs(q - p) / F.greatest(p, q).cast("double")

    values = F.map_values(F.map_zip_with(x, y, one))
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.coalesce(F.try_divide(total, F.size(values).cast("double")), F.lit(0.0))


def dist_user_agent(a, b) -> Column:
    maps = [_map_distance(a(c), b(c)) for c in ("os_json_cnt", "app_json_cnt", "browser_json_cnt")]
    plain = [F.abs(_ratio(_number(a, c), _number(b, c))) for c in ("FNUA", "NUA")]
    return _mean(maps + plain)


def dist_result(a, b) -> Column:
    return _mean(F.abs(_ratio(_number(a, c), _number(b, c))) for c in ("FF", "FVU"))


def dist_usernames(a, b, shared: Column) -> Column:
    """Jaccard distance from the number of usernames both rows have."""
    either = a("NU") + b("NU") - shared
    return 1 - F.coalesce(F.try_divide(shared.cast("double"), either.cast("double")), F.lit(0.0))


def weak_share(row) -> Column:
    z0, z1 = _number(row, "zxcvbn_0"), _number(row, "zxcvbn_1")
    return F.coalesce(F.try_divide(z0, z0 + z1), F.lit(0.0))


def dist_zxcvbn(a, b) -> Column:
    return F.abs(_ratio(weak_share(a), weak_share(b)))


def dist_volume(a, b, passwords: bool = True) -> Column:
    names = ["NR", "NU"] + (["AUPPU"] if passwords else [])
    return _total([F.abs(_ratio(_number(a, c), _number(b, c))) for c in names])


def parts(a, b, passwords: bool = True, missing_matches: bool = True) -> dict[str, Column]:
    """Every part but the usernames."""
    out = {
        "dist_ip": dist_ip(a, b, missing_matches),
        "dist_date": dist_date(a, b),
        "dist_interarrival": dist_interarrival(a, b),
        "dist_result": dist_result(a, b),
        "dist_user_agent": dist_user_agent(a, b),
        "dist_volume": dist_volume(a, b, passwords),
    }
    if passwords:
        out["dist_breach"] = dist_breach(a, b)
        out["dist_zxcvbn"] = dist_zxcvbn(a, b)
    return out


def weight(name: str, passwords: bool = True) -> float:
    return OUTER_WEIGHT if name in ("dist_ip", "dist_date") else INNER_WEIGHT[passwords]


def weighted_sum(columns: dict[str, Column], passwords: bool = True) -> Column:
    return _total([c * weight(n, passwords) for n, c in columns.items()])
