"""Pairs of feature rows that are close to each other.

All N * (N - 1) / 2 pairs cannot be written for millions of feature rows. The
join below returns every pair under a given distance, and only those. Its keys
follow from the distance itself: the address part and the date part alone decide
how many days two rows may lie apart when they share the address, the network,
the ISP, or nothing, so no pair under the limit is missed.

Rows under a key are put into blocks of similar rows: ordered by the classes of their volumes, on a scale on
which a ratio is a difference. From the smallest and largest values of two blocks follows the least
distance that rows of them can have; only blocks that may hold a near pair meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loginlab.functions import distance
from loginlab.functions.columns import all_of
from loginlab.operators import blocks, whole
from loginlab.sources.attempts import materialize

MAX_DISTANCE = 0.4
ROWS_PER_BLOCK = 500
MOST_NAMES = 1000  # usernames of a row that are compared inside blocks; longer lists are joined
COMPARED_IN_A_TASK = 5_000_000
PAIRS_IN_A_TASK = 50_000
TILE = 8  # blocks that are sent together: a block goes to as many tasks as its key has tiles
NEEDED = [
    "id", "client_ip", "network", "ISP", "DATE", "MIT_Mean", "SIT", "FPIB", "FTP", "FNUA", "NUA",
    "FF", "FVU", "zxcvbn_0", "zxcvbn_1", "NR", "NU", "AUPPU",
    "os_json_cnt", "app_json_cnt", "browser_json_cnt",
]

WEAK = "weak share"
# features whose ratio is part of the distance, with their weight in it
RATIOS = {
    "NR": 1.0, "NU": 1.0, WEAK: 1.0, "MIT_Mean": 1 / 2, "SIT": 1 / 2, "FF": 1 / 2, "FVU": 1 / 2, "FNUA": 1 / 5, "NUA": 1 / 5,
}
SIGNED = {"FPIB": 1 / 2, "FTP": 1 / 2}
# what rows are ordered by; at most 5 ** 5 classes of a key
ORDERED_BY = ["NR", "NU", "AUPPU", WEAK, "MIT_Mean"]

# what two rows share, closest kinship first, with the address part it gives
KINSHIP = [
    ("client_ip", 0.0),
    ("network", distance.SAME_NETWORK),
    ("ISP", distance.SAME_ISP),
    (None, 1.0),
]


def days_apart(address_distance: float, limit: float, slack: float) -> int | None:
    """Largest day difference a pair under the limit can have; None when any
    difference is possible, -1 when no pair can qualify. ``slack`` is what the
    signed breach part may subtract."""
    left = (limit + slack) / distance.OUTER_WEIGHT - address_distance
    if left > 1:
        return None
    if left <= 0:
        return -1
    return math.floor(-math.log(1 - left) + 1e-9) if left < 1 else None


def near_pairs(
    lsets: DataFrame,
    usernames: DataFrame,
    max_distance: float = MAX_DISTANCE,
    passwords: bool = True,
    rows_per_block: int = ROWS_PER_BLOCK,
    missing_matches: bool = True,
    columns: list[str] | None = None,
) -> DataFrame:
    """All pairs ``i < j`` of feature rows with distance under ``max_distance``,
    with every part of the distance, or the given ``columns`` of them. Without ``passwords`` the password features are left
    out; without ``missing_matches`` unknown networks and ISPs are no common ones. The pairs are computed as they are read
    and stored nowhere: what is stored are the blocks of rows they come from.

    ``usernames`` holds one row per feature row and username (``id, username``).
    """
    if not 0 < max_distance < 2 * distance.OUTER_WEIGHT:
        raise ValueError("max_distance must be between 0 and 0.5")
    rows = lsets.select(*NEEDED)
    names = materialize(usernames.select("id", "username").where(F.col("username").isNotNull()), "usernames")
    wanted = columns or [*_part_names(passwords), "shared_usernames", "dist_usernames", "dist"]
    known, others = _candidates(rows, names, max_distance, passwords, rows_per_block, missing_matches, wanted)
    # pairs of which a row has very many usernames; they come from few pairs of blocks
    others = materialize(others, "candidates")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, others.count() // PAIRS_IN_A_TASK)
    others = others.repartition(tasks)
    least = 1 - F.coalesce(F.try_divide(F.least("nu_i", "nu_j"), F.greatest("nu_i", "nu_j")), F.lit(0.0))
    least = least * distance.weight("dist_usernames", passwords)
    others = _with_parts(others, rows, passwords, missing_matches)
    others = others.where(_distance_without_usernames(passwords) + least < max_distance)
    others = _with_usernames(materialize(others, "many_usernames"), names, passwords)
    others = materialize(others.where(F.col("dist") < max_distance).select("i", "j", *wanted), "others")
    return known.unionByName(others)


def distances_of(
    pairs: DataFrame,
    lsets: DataFrame,
    usernames: DataFrame,
    passwords: bool = True,
    missing_matches: bool = True,
) -> DataFrame:
    """The given pairs ``i, j`` with their true distance, whatever it is."""
    both = _with_parts(pairs, lsets.select(*NEEDED), passwords, missing_matches)
    both = materialize(both, "asked")
    return _with_usernames(both, usernames, passwords).select("i", "j", "dist")


def _terms(passwords: bool) -> tuple[dict[str, float], dict[str, float]]:
    """The features whose ratio counts, and those whose signed ratio does, with their weights."""
    inner = distance.INNER_WEIGHT[passwords]
    ratios = {k: w * inner for k, w in RATIOS.items() if passwords or k != WEAK} | ({"AUPPU": inner} if passwords else {})
    return ratios, {k: w * inner for k, w in SIGNED.items()} if passwords else {}


class Distances:
    """True distances of pairs that are not listed: of given ones, of all pairs, or summed up by clusters."""

    def __init__(self, lsets: DataFrame, usernames: DataFrame, passwords: bool = True, missing_matches: bool = True):
        self.given = lsets, usernames, passwords, missing_matches
        self.rows: DataFrame | None = None

    def __call__(self, asked: DataFrame) -> DataFrame:
        return distances_of(asked, *self.given)

    def _met(self, labels: DataFrame) -> tuple[DataFrame, blocks.Weights]:
        lsets, usernames, passwords, missing_matches = self.given
        ratios, signed = _terms(passwords)
        if self.rows is None:
            numbers = {c: _value(c) for c in dict.fromkeys([*ratios, *signed, "NU"])}
            rows = whole.rows_of(lsets.select(*NEEDED), usernames, numbers, [s for s, _ in KINSHIP if s])
            self.rows = materialize(rows, "whole_rows")
        w = whole.weights(ratios, signed, passwords, missing_matches, KINSHIP, WEAK, _part_names(passwords))
        return whole.pairs_of_blocks(self.rows, labels), w

    def every(self) -> DataFrame:
        """⟨i, j, dist⟩ of all pairs ``i < j``. They are computed as they are read and stored nowhere."""
        labels = self.given[0].where("id IS NOT NULL").select("id", F.lit(0).cast("long").alias("group"))
        met, w = self._met(labels)
        return met.mapInArrow(whole.listing(w), "i string, j string, dist double")

    def sums(self, labels: DataFrame) -> DataFrame:
        """⟨group, a, b, total, n⟩ of the clusters ``a < b`` of a group, over their pairs of rows that are in different
        parts. ``labels`` are ⟨id, group, cluster, part⟩, all but the first numbers; a cluster lies in one part."""
        met, w = self._met(labels)
        out = met.mapInArrow(whole.summing(w), whole.SUMS)
        return out.groupBy("group", "a", "b").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _with_parts(pairs, rows, passwords, missing_matches) -> DataFrame:
    """The pairs ``i, j`` with the parts that two rows give by themselves."""
    a = lambda c: F.col(f"a.{c}")
    b = lambda c: F.col(f"b.{c}")
    return (
        pairs.alias("p")
        .join(rows.alias("a"), F.col("p.i") == a("id"))
        .join(rows.alias("b"), F.col("p.j") == b("id"))
        .select(
            F.col("p.i").alias("i"),
            F.col("p.j").alias("j"),
            a("NU").alias("nu_i"),
            b("NU").alias("nu_j"),
            *[c.alias(n) for n, c in distance.parts(a, b, passwords, missing_matches).items()],
        )
    )


def _meeting_keys(max_distance: float, passwords: bool, missing_matches: bool = True):
    """The keys under which a row meets others: ⟨kinship, shared value, day⟩."""
    slack = distance.INNER_WEIGHT[passwords] if passwords else 0.0
    any_day = F.lit("1970-01-01").cast("date")
    keys = []
    for kind, (shared, address) in enumerate(KINSHIP):
        days = days_apart(address, max_distance, slack)
        if days is None and shared is None:
            raise ValueError("max_distance is too large: unrelated rows of any day would qualify")
        if days != -1:
            keys.append(
                F.struct(
                    F.lit(kind).alias("_kind"),
                    (F.col(shared) if shared else F.lit("")).alias("_key"),
                    (any_day if days is None else F.col("DATE")).alias("_day"),
                )
            )
    keys = F.array(*keys)
    if missing_matches:
        return keys
    return F.filter(keys, lambda k: ~(k["_kind"].isin(1, 2) & (k["_key"] == "NA")))


def _value(name: str, row=F.col) -> Column:
    if name == WEAK:
        return distance.weak_share(row)
    value = row(name).cast("double")
    return F.greatest(value, F.lit(0.0)) if name in SIGNED else value


def _class(rows: DataFrame) -> Column:
    """The class of a row: for each of a few features zero, or the quarter of its other values."""
    cuts = rows.agg(
        *[
            F.percentile_approx(F.when(_value(c) > 0, _value(c)), [0.25, 0.5, 0.75], 1000).alias(f"_{k}")
            for k, c in enumerate(ORDERED_BY)
        ]
    ).first()
    out = F.lit(0)
    for c, values in zip(ORDERED_BY, cuts):
        place = F.when(_value(c) > 0, 1).otherwise(0)
        for v in values or ():
            place = place + F.when(_value(c) > v, 1).otherwise(0)
        out = out * 5 + place
    return out.cast("int")


KEY = ["_kind", "_key", "_day"]


def in_blocks(rows, max_distance, passwords, rows_per_block, missing_matches=True) -> DataFrame:
    """The rows under each of their keys, with the block they are in there: neighbours in the order of
    their classes, about ``rows_per_block`` of them."""
    keyed = rows.withColumn("_class", _class(rows)).select(
        "*", F.inline(_meeting_keys(max_distance, passwords, missing_matches))
    )
    sizes = keyed.groupBy(*KEY, "_class").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*KEY).orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *KEY,
        "_class",
        F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows_per_block).alias("_first"),
        F.ceil(F.col("_n") / F.lit(rows_per_block)).alias("_pieces"),
    )
    block = F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_pieces"))
    return keyed.join(sizes, [*KEY, "_class"]).withColumn("_block", block).drop("_class", "_first", "_pieces")


def _boxes(home: DataFrame, passwords: bool) -> DataFrame:
    """Per block the smallest and largest values, and its number of rows."""
    names = [*RATIOS, "AUPPU"] + (list(SIGNED) if passwords else [])
    return home.groupBy(*KEY, "_block").agg(
        F.count("*").alias("_rows"),
        F.min("DATE").alias("_from"),
        F.max("DATE").alias("_to"),
        *[f(_value(c)).alias(f"{n} {c}") for c in names for n, f in (("min", F.min), ("max", F.max))],
    )


def _least_distance(a, b, passwords: bool) -> Column:
    """The least distance that a row of box ``a`` and one of box ``b`` can have. A feature with missing or negative
    values says nothing."""

    def bounds(name):
        low = F.greatest(a(f"min {name}"), b(f"min {name}"))
        high = F.least(a(f"max {name}"), b(f"max {name}"))
        apart = (low > high) & (F.least(a(f"min {name}"), b(f"min {name}")) >= 0)
        return low, high, apart

    def ratio(name):
        low, high, apart = bounds(name)
        return F.when(apart, (low - high) / (low + high)).otherwise(0.0)

    def largest(name):
        one = F.try_divide(a(f"max {name}") - b(f"min {name}"), a(f"max {name}") + b(f"min {name}"))
        two = F.try_divide(b(f"max {name}") - a(f"min {name}"), b(f"max {name}") + a(f"min {name}"))
        return F.coalesce(F.greatest(one, two, F.lit(0.0)), F.lit(1.0))

    weights = {k: w for k, w in RATIOS.items() if passwords or k != WEAK} | ({"AUPPU": 1.0} if passwords else {})
    inner = F.lit(0.0)
    for name, w in weights.items():
        inner = inner + ratio(name) * w
    low, high, apart = bounds("NU")
    inner = inner + F.when(apart, 1 - high / low).otherwise(0.0)
    for name, w in SIGNED.items() if passwords else ():
        inner = inner - largest(name) * w
    days = F.greatest(F.datediff(a("_from"), b("_to")), F.datediff(b("_from"), a("_to")), F.lit(0))
    address = F.element_at(F.array(*[F.lit(v) for _, v in KINSHIP]), a("_kind") + 1)
    outer = address + 1 - F.exp(-days.cast("double"))
    return outer * distance.OUTER_WEIGHT + inner * distance.INNER_WEIGHT[passwords]


def block_pairs(home: DataFrame, max_distance, passwords: bool) -> DataFrame:
    """Pairs of blocks that may hold a near pair: the key and block of both, their numbers of rows and a number for
    the pair. The second one lies on a day that the distance allows."""
    boxes = _boxes(home, passwords)
    reach = []
    for _, address in KINSHIP:
        days = days_apart(address, max_distance, distance.INNER_WEIGHT[passwords] if passwords else 0.0)
        reach.append(F.lit(0 if days is None else max(days, 0)))
    days = F.element_at(F.array(*reach), F.col("_kind") + 1)
    visiting = boxes.withColumn("_own_day", F.col("_day")).withColumn(
        "_day", F.explode(F.transform(F.sequence(-days, days), lambda n: F.date_add("_own_day", n)))
    )
    a = lambda c: F.col(f"a.`{c}`")
    b = lambda c: F.col(f"b.`{c}`")
    # a little room, for the order in which the terms are added
    on = all_of([a(k) == b(k) for k in KEY] + [_least_distance(a, b, passwords) < max_distance + 1e-9])
    return (
        boxes.alias("a")
        .join(visiting.alias("b"), on)
        .select(
            *[a(k).alias(k) for k in KEY],
            a("_block").alias("_block"),
            b("_own_day").alias("_other_day"),
            b("_block").alias("_other"),
            a("_rows").alias("_rows"),
            b("_rows").alias("_other_rows"),
        )
    )


def _in_lists(home: DataFrame, names: DataFrame, ratios, signed) -> DataFrame:
    """One row per block: its rows with their numbers and usernames. Of rows with more than ``MOST_NAMES`` usernames
    these are left out."""
    counts = names.groupBy("id").agg(F.count("*").alias("_count"))
    few = names.join(counts.where(F.col("_count") <= MOST_NAMES).select("id"), "id", "left_semi")
    few = few.groupBy("id").agg(F.collect_list("username").alias("_names"))
    many = counts.where(F.col("_count") > MOST_NAMES).select("id", F.lit(1).alias("_long"))
    shared = [s for s, _ in KINSHIP if s]
    maps = [
        f(c).alias(f"_{c}_{n}") for c in blocks.COUNTS for n, f in (("keys", F.map_keys), ("counts", F.map_values))
    ]
    row = F.struct(
        "id",
        *shared,
        F.unix_date("DATE").alias("_date"),
        *[F.col(f"_{c}").alias(c) for c in dict.fromkeys([*ratios, *signed, "NU"])],
        F.coalesce("_names", F.array().cast("array<string>")).alias("_names"),
        F.coalesce("_long", F.lit(0)).alias("_long"),
        *maps,
    )
    numbers = [_value(c).alias(f"_{c}") for c in dict.fromkeys([*ratios, *signed, "NU"])]
    home = home.where(F.col("id").isNotNull()).select(*KEY, "_block", "id", *shared, "DATE", *blocks.COUNTS, *numbers)
    home = home.join(few, "id", "left").join(many, "id", "left")
    return home.groupBy(*KEY, "_block").agg(F.collect_list(row).alias("_rows"), F.max("_long").alias("_any_long"))


def _candidates(
    rows, names, max_distance, passwords, rows_per_block, missing_matches, wanted
) -> tuple[DataFrame, DataFrame]:
    """Pairs under the limit with the ``wanted`` columns; and the pairs ``i, j`` of rows with very many usernames, which
    are under the limit without user agents and with the least that usernames can add."""
    spark = rows.sparkSession
    home = in_blocks(rows, max_distance, passwords, rows_per_block, missing_matches)
    home = materialize(home, "blocks")
    met = materialize(block_pairs(home, max_distance, passwords), "block_pairs")
    # both orders of two blocks are listed
    same_day = F.col("_day") == F.col("_other_day")
    met = met.where((F.col("_day") < F.col("_other_day")) | (same_day & (F.col("_block") <= F.col("_other"))))
    compared = met.agg(F.sum(F.col("_rows") * F.col("_other_rows"))).first()[0]
    ratios, signed = _terms(passwords)
    inner, outer = distance.INNER_WEIGHT[passwords], distance.OUTER_WEIGHT
    weights = blocks.Weights(
        ratios, signed, inner, outer, KINSHIP, missing_matches, max_distance, WEAK, _part_names(passwords)
    )
    lists = materialize(_in_lists(home, names, ratios, signed), "block_lists")
    long = lists.where("_any_long = 1").select(*KEY, "_block")
    tile = lambda c: F.floor(F.col(c) / TILE)
    held = lists.groupBy(*KEY, tile("_block").alias("_tile")).agg(F.collect_list(F.struct("_block", "_rows")).alias("_blocks"))
    held = materialize(held, "tiles")
    tasks = max(spark.sparkContext.defaultParallelism, (compared or 0) // COMPARED_IN_A_TASK)

    def step(some: DataFrame, columns: list[str] | None) -> DataFrame:
        left = held.withColumnsRenamed({"_tile": "_left", "_blocks": "_tile_a"})
        right = held.withColumnsRenamed({"_day": "_other_day", "_tile": "_right", "_blocks": "_tile_b"})
        same = same_day & (F.col("_block") == F.col("_other"))
        some = some.groupBy(*KEY, "_other_day", tile("_block").alias("_left"), tile("_other").alias("_right"))
        some = some.agg(F.collect_list(F.struct("_block", "_other", same.alias("_same"))).alias("_pairs"))
        some = some.join(left, [*KEY, "_left"]).join(right, ["_kind", "_key", "_other_day", "_right"])
        some = some.select("_kind", "_pairs", "_tile_a", "_tile_b")
        # dealt out by comparisons, which are many for few bytes
        return some.repartition(tasks).mapInArrow(blocks.meeting(weights, columns), weights.fields(columns))

    if long.isEmpty():
        return step(met, wanted), spark.createDataFrame([], "i string, j string")
    mine = long.withColumnsRenamed({"_day": "_other_day", "_block": "_other"})
    either = met.join(long, [*KEY, "_block"], "left_semi").union(
        met.join(long, [*KEY, "_block"], "left_anti").join(mine, ["_kind", "_key", "_other_day", "_other"], "left_semi").select(*met.columns)
    )
    return step(met, wanted), step(either, None)


def _part_names(passwords: bool) -> list[str]:
    names = [
        "dist_ip", "dist_date", "dist_interarrival", "dist_result", "dist_user_agent", "dist_volume"
    ]
    return names + (["dist_breach", "dist_zxcvbn"] if passwords else [])


def _distance_without_usernames(passwords: bool):
    return distance.weighted_sum({n: F.col(n) for n in _part_names(passwords)}, passwords)


def _with_usernames(candidates, usernames, passwords) -> DataFrame:
    """Adds the username part. The shorter list is looked up in the longer one, as
    rows keyed by ⟨feature row, username⟩."""
    names = usernames.select("id", "username")
    shorter_is_i = F.col("nu_i") <= F.col("nu_j")
    probes = candidates.select(
        "i",
        "j",
        F.when(shorter_is_i, F.col("i")).otherwise(F.col("j")).alias("id"),
        F.when(shorter_is_i, F.col("j")).otherwise(F.col("i")).alias("longer"),
    ).join(names, "id")
    shared = (
        probes.join(
            names.withColumnRenamed("id", "longer"), ["longer", "username"], "left_semi"
        )
        .groupBy("i", "j")
        .agg(F.count("*").alias("shared_usernames"))
    )
    counted = candidates.join(shared, ["i", "j"], "left")
    return _with_distance(counted.withColumn("shared_usernames", F.coalesce("shared_usernames", F.lit(0))), passwords)


def _with_distance(counted: DataFrame, passwords: bool) -> DataFrame:
    row = {"a": "nu_i", "b": "nu_j"}
    jaccard = distance.dist_usernames(
        lambda _: F.col(row["a"]), lambda _: F.col(row["b"]), F.col("shared_usernames")
    )
    w = distance.weight("dist_usernames", passwords)
    total = _distance_without_usernames(passwords) + F.col("dist_usernames") * w
    return counted.withColumn("dist_usernames", jaccard).withColumn("dist", total).drop("nu_i", "nu_j")


def minmax_by_column(pairs: DataFrame, lsets: DataFrame, max_distance: float) -> DataFrame:
    """The distances seen from each row ``j``, scaled to [0, 1] by the largest one
    in its column. Pairs that are not listed are at least ``max_distance`` apart and count with it, so a
    column with such pairs is scaled by ``max_distance``, not by its true largest distance."""
    both = pairs.select("i", "j", "dist").unionByName(
        pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist")
    )
    total = lsets.agg(F.count("*")).scalar()
    largest = both.groupBy("j").agg(F.max("dist").alias("top"), F.count("*").alias("n"))
    largest = largest.select(
        "j", F.when(F.col("n") < total - 1, max_distance).otherwise(F.col("top")).alias("top")
    )
    scaled = F.coalesce(F.try_divide(F.col("dist"), F.col("top")), F.lit(0.0))
    # one row per feature row, where the pairs grow with its square
    return both.join(F.broadcast(largest), "j").select("i", "j", scaled.alias("scaled"))
