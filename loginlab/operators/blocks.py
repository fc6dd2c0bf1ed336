"""Comparison of the rows of two blocks, all with all, on columns of numbers inside a task.

A lower bound of the distance, the shared usernames included, leaves few pairs; these get their parts, user agents
too, and the distance in the same task. Pairs of rows with very many usernames are left open."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NAMES_AT_ONCE = 4096  # usernames in the matrices of two blocks
ROOM = 1e-9  # for the order in which the terms are added
COMPARED_AT_ONCE = 250_000  # pairs of rows, unless two blocks have more
CELLS_AT_ONCE = 2_000_000  # pairs x kinds of user agents that are compared together
COUNTS = ("os_json_cnt", "app_json_cnt", "browser_json_cnt")
MEANS = {"dist_interarrival": ("MIT_Mean", "SIT"), "dist_result": ("FF", "FVU")}
VOLUMES = ("NR", "NU", "AUPPU")


class Weights(NamedTuple):
    """What the terms of a distance count, and the address part of each kinship."""

    ratios: dict[str, float]
    signed: dict[str, float]
    usernames: float
    outer: float
    kinship: list[tuple[str | None, float]]
    missing_matches: bool
    limit: float
    weak: str  # the feature of weak passwords
    parts: list[str]  # in the order in which they are added

    def fields(self, columns: list[str] | None) -> str:
        kinds = {"shared_usernames": "long"}
        return ", ".join(["i string", "j string", *[f"{c} {kinds.get(c, 'double')}" for c in columns or []]])


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(x - y) / (x + y), 0 where that is no finite number."""
    with np.errstate(all="ignore"):
        out = (x - y) / (x + y)
    out[~np.isfinite(out)] = 0.0
    return out


def _codes(x: pa.Array, y: pa.Array):
    """Equal values of both as equal numbers; null is -1."""
    n = pa.concat_arrays([x, y]).dictionary_encode().indices.fill_null(-1).to_numpy()
    return n[: len(x)], n[len(x) :]


def _shared(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The number of usernames that a row of ``a`` and one of ``b`` have in common."""
    rows = [np.repeat(np.arange(len(x)), x.value_lengths().to_numpy()) for x in (a, b)]
    names = _codes(a.flatten(), b.flatten())
    common = np.logical_and(*(np.bincount(n, minlength=len(names[0]) + len(names[1])) > 0 for n in names))
    number, total = np.cumsum(common) - 1, int(common.sum())
    rows = [r[common[n]] for r, n in zip(rows, names)]
    names = [number[n[common[n]]] for n in names]
    out = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, total, NAMES_AT_ONCE):
        has = []
        for x, r, n in zip((a, b), rows, names):
            here = (n >= first) & (n < first + NAMES_AT_ONCE)
            m = np.zeros((len(x), min(NAMES_AT_ONCE, total - first)), np.float32)
            m[r[here], n[here] - first] = 1
            has.append(m)
        out += has[0] @ has[1].T
    return out


def _cells(sizes: list[np.ndarray]):
    """All pairs of rows of each pair of blocks, whose numbers of rows are given: places of both rows among all rows of
    their side, and the pair of blocks."""
    cells = sizes[0] * sizes[1]
    block = np.repeat(np.arange(len(cells)), cells)
    place = np.arange(len(block)) - np.repeat(np.cumsum(cells) - cells, cells)
    starts = [np.cumsum(n) - n for n in sizes]
    return starts[0][block] + place // sizes[1][block], starts[1][block] + place % sizes[1][block], block


def _near(a: dict[str, pa.Array], b: dict[str, pa.Array], kind: int, sizes, same: np.ndarray, w: Weights):
    """Places of the pairs that may be near, whether the first has the smaller id, and their shared usernames (-1:
    not counted). ``a`` and ``b`` hold the rows of several pairs of blocks, one after the other; ``sizes`` are the numbers
    of their rows, and ``same`` tells which pairs are a block with itself."""
    number = lambda rows, name: rows[name].to_numpy(zero_copy_only=False).astype(float)
    both = lambda name: (number(a, name)[x], number(b, name)[y])
    ids = pc.rank(pa.concat_arrays([a["id"], b["id"]]), tiebreaker="dense").to_numpy().astype(np.int64)
    ids = ids[: len(a["id"])], ids[len(a["id"]) :]
    x, y, block = _cells(sizes)
    wanted = np.where(same[block], ids[0][x] < ids[1][y], ids[0][x] != ids[1][y])
    for k, (column, _) in enumerate(w.kinship[:kind]):  # closer ones meet under another key
        p, q = _codes(a[column], b[column])
        equal = (p[x] == q[y]) & (p >= 0)[x]
        if k and not w.missing_matches:
            equal &= (a[column].fill_null("NA").to_numpy(zero_copy_only=False) != "NA")[x]
        wanted &= ~equal
    x, y, block = x[wanted], y[wanted], block[wanted]
    first = ids[0][x] < ids[1][y]
    days = both("_date")
    bound = w.outer * (w.kinship[kind][1] + 1 - np.exp(-np.nan_to_num(np.abs(days[0] - days[1]))))
    for name, weight in w.ratios.items():
        bound += weight * np.abs(_ratio(*both(name)))
    for name, weight in w.signed.items():
        r = _ratio(*both(name))
        bound += weight * np.where(first, r, -r)
    nu = both("NU")
    with np.errstate(all="ignore"):
        least = 1 - np.nan_to_num(np.minimum(*nu) / np.maximum(*nu), posinf=0.0, neginf=0.0)
    wanted = bound + w.usernames * least < w.limit + ROOM
    x, y, block, first, bound = (v[wanted] for v in (x, y, block, first, bound))
    nu = nu[0][wanted], nu[1][wanted]
    # usernames of the rows that are in a pair still; pairs of a block follow each other
    shared = np.zeros(len(x))
    ends = np.nonzero(np.diff(block, append=-1))[0] + 1
    for start, end in zip([0, *ends], ends):
        at = [np.unique(v[start:end], return_inverse=True) for v in (x, y)]
        names = [rows["_names"].take(pa.array(n)) for rows, (n, _) in zip((a, b), at)]
        shared[start:end] = _shared(*names)[at[0][1], at[1][1]]
    known = ~(number(a, "_long").astype(bool)[x] | number(b, "_long").astype(bool)[y])
    with np.errstate(all="ignore"):
        jaccard = 1 - np.nan_to_num(shared / (nu[0] + nu[1] - shared), posinf=0.0, neginf=0.0)
    wanted = ~known | (bound + w.usernames * jaccard < w.limit + ROOM)
    return x[wanted], y[wanted], first[wanted], np.where(known, shared, -1)[wanted].astype(np.int64)


def _exact_ratio(x: np.ndarray, y: np.ndarray, null: np.ndarray) -> np.ndarray:
    """(x - y) / (x + y), 0 when both are 0 or one is null; of infinite values no number."""
    total = x + y
    with np.errstate(all="ignore"):
        out = (x - y) / total
    return np.where(null | (total == 0), 0.0, out)


def _map_distances(a: dict[str, pa.Array], b: dict[str, pa.Array], name: str, x, y) -> np.ndarray:
    """Mean over the keys of either map of |difference| / larger count, for the pairs of rows at ``x`` and ``y``."""
    keys = [rows[f"_{name}_keys"] for rows in (a, b)]
    codes = _codes(*(k.flatten() for k in keys))
    kinds = max((int(n.max()) + 1 for n in codes if len(n)), default=0)
    if not kinds:
        return np.zeros(len(x))
    counts, has = [], []
    for rows, k, n in zip((a, b), keys, codes):
        at = np.repeat(np.arange(len(k)), k.value_lengths().fill_null(0).to_numpy()), n
        count, there = np.zeros((len(k), kinds)), np.zeros((len(k), kinds), bool)
        count[at] = rows[f"_{name}_counts"].flatten().fill_null(0).to_numpy(zero_copy_only=False)
        there[at] = True
        counts.append(count)
        has.append(there)
    out, step = np.zeros(len(x)), max(1, CELLS_AT_ONCE // kinds)
    for first in range(0, len(x), step):
        at = x[first : first + step], y[first : first + step]
        p, q = counts[0][at[0]], counts[1][at[1]]
        either = has[0][at[0]] | has[1][at[1]]
        with np.errstate(all="ignore"):
            each = np.where(either, np.abs(q - p) / np.maximum(p, q), 0.0)
            out[first : first + step] = np.nan_to_num(each.sum(1) / either.sum(1))
    missing = [k.is_null().to_numpy(zero_copy_only=False) for k in keys]
    return np.where(missing[0][x] | missing[1][y], 0.0, out)


def _parts(a: dict[str, pa.Array], b: dict[str, pa.Array], kind: int, w: Weights, x, y, first, shared) -> dict[str, np.ndarray]:
    """The parts of the distance and the distance of the pairs at ``x`` and ``y``, as in ``functions.distance``."""

    def ratio(name):
        values = [
            (rows[name].to_numpy(zero_copy_only=False).astype(float)[at], rows[name].is_null().to_numpy(zero_copy_only=False)[at])
            for rows, at in ((a, x), (b, y))
        ]
        return _exact_ratio(values[0][0], values[1][0], values[0][1] | values[1][1])

    def mean(terms):
        return sum(terms[1:], terms[0]) / len(terms)

    days = [rows["_date"].to_numpy(zero_copy_only=False).astype(float)[at] for rows, at in ((a, x), (b, y))]
    out = {"dist_ip": np.full(len(x), w.kinship[kind][1]), "dist_date": 1 - np.exp(-np.abs(days[0] - days[1]))}
    for part, names in MEANS.items():
        out[part] = mean([np.abs(ratio(n)) for n in names])
    agents = [_map_distances(a, b, n, x, y) for n in COUNTS]
    out["dist_user_agent"] = mean(agents + [np.abs(ratio(n)) for n in ("FNUA", "NUA")])
    volumes = [np.abs(ratio(n)) for n in VOLUMES if n in w.ratios]
    out["dist_volume"] = sum(volumes[1:], volumes[0])
    if w.signed:
        out["dist_breach"] = mean([np.where(first, r, -r) for r in map(ratio, w.signed)])
    if w.weak in w.ratios:
        out["dist_zxcvbn"] = np.abs(ratio(w.weak))
    total = 0.0
    for part in w.parts:
        total = total + out[part] * (w.outer if part in ("dist_ip", "dist_date") else w.usernames)
    nu = [rows["NU"].to_numpy(zero_copy_only=False).astype(float)[at] for rows, at in ((a, x), (b, y))]
    with np.errstate(all="ignore"):
        out["dist_usernames"] = 1 - np.nan_to_num(shared / (nu[0] + nu[1] - shared), posinf=0.0, neginf=0.0)
    out["dist"] = total + out["dist_usernames"] * w.usernames
    return out


def _together(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The pairs of blocks of a batch in groups of one kinship that are compared at once: most blocks are small,
    and a group costs as much as a pair of them, besides its comparisons."""
    rows = [batch[c].value_lengths().to_numpy().astype(np.int64) for c in ("_rows_a", "_rows_b")]
    yield from _in_groups(batch["_kind"].to_numpy(), rows)


def _in_groups(kinds: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    for kind in np.unique(kinds):
        chosen = np.nonzero(kinds == kind)[0]
        cells = np.cumsum((rows[0] * rows[1])[chosen])
        first = 0
        while first < len(chosen):
            done = cells[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(cells, done + COMPARED_AT_ONCE, side="right")))
            yield int(kind), chosen[first:end]
            first = end


def _of_tiles(batch: pa.RecordBatch):
    """The pairs of blocks of a batch of tiles: their kinships, whether it is a block with itself, and for either side
    the rows of all blocks and the places of the pairs' blocks among them."""
    pairs = batch["_pairs"].flatten()
    tile = np.repeat(np.arange(len(batch)), batch["_pairs"].value_lengths().to_numpy())
    sides = []
    for column, name in (("_tile_a", "_block"), ("_tile_b", "_other")):
        held = batch[column].flatten()
        key = np.repeat(np.arange(len(batch)), batch[column].value_lengths().to_numpy()) << 40
        key = key + held.field("_block").to_numpy()
        order = np.argsort(key)
        wanted = (tile << 40) + pairs.field(name).to_numpy()
        sides.append((held.field("_rows"), order[np.searchsorted(key, wanted, sorter=order)]))
    return batch["_kind"].to_numpy()[tile], pairs.field("_same").to_numpy(zero_copy_only=False), *sides


def meeting(w: Weights, columns: list[str] | None):
    """A step of ``mapInArrow``: from tiles, the ``_pairs`` of blocks of ``_tile_a`` and ``_tile_b``, to near pairs of
    rows with the given parts of their distance (``Weights.fields``). With ``None`` it gives the pairs whose shared usernames are not counted,
    which are left out otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, same, *sides = _of_tiles(batch)
            sizes = [rows.value_lengths().to_numpy().astype(np.int64)[at] for rows, at in sides]
            for kind, chosen in _in_groups(kinds, sizes):
                a, b = (
                    dict(zip([f.name for f in rows.type], rows.flatten()))
                    for rows in (rows.take(pa.array(at[chosen])).flatten() for rows, at in sides)
                )
                found = _near(a, b, kind, [n[chosen] for n in sizes], same[chosen].astype(bool), w)
                x, y, first, shared = (v[(found[3] >= 0) == (columns is not None)] for v in found)
                if not len(x):
                    continue
                parts = {}
                if columns is not None:
                    parts = _parts(a, b, kind, w, x, y, first, shared) | {"shared_usernames": shared}
                    near = parts["dist"] < w.limit
                    x, y, first = x[near], y[near], first[near]
                    parts = {c: parts[c][near] for c in columns}
                ids = pa.concat_arrays([a["id"], b["id"]])
                y = y + len(a["id"])
                ends = [ids.take(pa.array(np.where(first, p, q))) for p, q in ((x, y), (y, x))]
                yield pa.RecordBatch.from_arrays([*ends, *map(pa.array, parts.values())], ["i", "j", *parts])

    return run
