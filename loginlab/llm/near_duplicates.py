"""N-gram Jaccard join by chosen paths.

A document is the set of its shingles: runs of five words (one shingle, if it has fewer). In each run
every set chooses each of its shingles with probability 1 / (threshold * size), by a hash that is the
same for all sets; sets that chose the same shingle share a bucket. Large buckets are split again
and again on coordinates of a MinHash sketch, which are sampled shingles too; in small ones all pairs are
compared by their sketches. Two sets above the threshold share at least one expected choice per
run, so each run finds them with probability 1 - 1/e or more, and the runs are repeated until the target
recall. What is found joins sets into groups; inside a group all pairs are compared on their
whole sets, block by block, and only counts and a spanning forest leave a block.

Equal sets are one class and are compared once. The result has a row per document: its class (documents
connected by links), the smallest id with the same shingles, how many documents have these, and
the number of other sets it is linked to. Null and empty texts, and texts without a word, have no
shingles and link to nothing; each is its own class. Repeated rows are copies of each other. A null
id is only a representative if no copy has an id. ``class_id`` is the smallest id of a class, so
classes without an id, or with clashing ids, share it; ``class_key`` of ``links`` tells them apart.
Other columns are ignored, or kept by ``one_of_each``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlab.llm.common import kept, per_process, small_batches, table, trimmed
from loginlab.llm.graph import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
SKETCH = 32
ALIKE = 14  # equal sketch entries from which two sets are compared: 6 in a million pairs at 0.8 have fewer
SMALL = 64  # sets in a bucket that are compared without another split
LARGE = 2048  # sets in a bucket beyond which Spark splits it
DEPTH = 5  # splits, after which the rest of a bucket counts as one group
BLOCK = 400_000  # shingles of a group that one task compares with as many others
SLOTS = 2**20  # bound of the broadcast that filters documents without a partner
MOST_WORDS, LONGEST = 100_000, 64  # words that are remembered, and characters of one

U64 = np.uint64
_WORD = re.compile(r"\w+")
_rng = np.random.default_rng(2024)
_MULTIPLY = _rng.integers(1, 2**63, SKETCH, dtype=U64) * U64(2) + U64(1)
_ADD = _rng.integers(0, 2**63, SKETCH, dtype=U64)


def runs_for(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 / math.e))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Words(dict):
    def __missing__(self, word):
        n = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(word) <= LONGEST:
            if len(self) > MOST_WORDS:
                self.clear()
            self[word] = n
        return n


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    memory = per_process("shingle words", _Words)
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(memory.__getitem__, words), U64, len(words))
    n = min(WORDS, len(words))
    if not n:
        return h
    total = np.zeros(len(h) - n + 1, U64)
    for k in range(n):
        total = total * U64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(total))


def chosen(tokens: np.ndarray, runs: int, threshold: float) -> np.ndarray:
    """The buckets that a set chooses."""
    share = min(1.0, 1 / (threshold * max(1, len(tokens))))
    limit = U64(min(2**64 - 1, int(share * 2**64)))
    out = []
    for run in range(runs):
        mixed = _mix(tokens + U64((run + 1) * 0xD6E8FEB86659FD93 % 2**64))
        picked = tokens[mixed <= limit]
        out.append(_mix(picked ^ U64(run * 0xA0761D6478BD642F % 2**64)))
    return np.concatenate(out).astype(np.int64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    low = np.full(SKETCH, 2**64 - 1, U64)
    for first in range(0, len(tokens), 4096):
        part = tokens[first : first + 4096]
        low = np.minimum(low, (part[None] * _MULTIPLY[:, None] + _ADD[:, None]).min(1))
    return (low >> U64(32)).astype(np.uint32).view(np.int32)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by ``keys``, cut anew where the keys change."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.num_rows - 1
        last = [batch[k][at].as_py() for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last):
            same &= batch[k].to_numpy(zero_copy_only=False) == v
        begin = int(np.argmax(same))
        if begin:
            yield pa.Table.from_batches([*rest, batch.slice(0, begin)])
            rest = []
        elif rest and [rest[-1][k][0].as_py() for k in keys] != last:
            yield pa.Table.from_batches(rest)
            rest = []
        rest.append(batch.slice(begin))
    if rest:
        yield pa.Table.from_batches(rest)


def _bounds(columns: list[np.ndarray]) -> np.ndarray:
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.nonzero(change)[0], len(columns[0]))


def _forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the smallest row connected with it."""
    root = np.arange(len(near))
    while True:
        new = np.minimum(root, np.where(near, root[None], len(near)).min(1, initial=len(near)))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _alike(sketches: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    near = (sketches[:, None] == sketches[None]).sum(2) >= ALIKE
    near &= sizes[:, None] >= threshold * sizes[None] - 1e-9
    return near & near.T


def _search(ids, sizes, sketches, threshold: float, out: list, depth=0, seed=0) -> None:
    """Appends ⟨set, set⟩ pairs that span what a bucket's pairs connect."""
    if len(ids) < 2:
        return
    if len(ids) <= SMALL:
        root = _forest(_alike(sketches, sizes, threshold))
        at = np.nonzero(root != np.arange(len(root)))[0]
        out.append((ids[at], ids[root[at]]))
        return
    if depth == DEPTH or (sketches == sketches[0]).sum(1).min() >= ALIKE:
        out.append((ids[1:], np.full(len(ids) - 1, ids[0])))  # one group, compared as a whole later
        return
    rng = np.random.default_rng(seed)
    for k in rng.choice(SKETCH, 2, replace=False):
        order = np.argsort(sketches[:, k], kind="stable")
        cut = _bounds([sketches[order, k]])
        for a, b in zip(cut[:-1], cut[1:]):
            part = order[a:b]
            _search(ids[part], sizes[part], sketches[part], threshold, out, depth + 1, int(rng.integers(2**60)))


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs as connect what the given ones connect."""
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = where[: len(a)], where[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            at = np.nonzero(root != np.arange(len(ids)))[0]
            return ids[at], ids[root[at]]
        root = new


def _candidate_edges(sets: DataFrame, runs: int, threshold: float) -> DataFrame:
    """⟨a, b⟩ pairs of sets that span the groups of sets that may be alike."""
    chosen_ = kept(sets.select("rec", F.explode("buckets").alias("bucket")))
    counts = chosen_.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    rows = chosen_.join(counts, "bucket").join(sets.select("rec", "n", "sketch"), "rec")
    rows = kept(rows.select("bucket", "c", "rec", "n", "sketch"))
    leaves, large = rows.where(F.col("c") <= LARGE), rows.where(F.col("c") > LARGE)
    for depth in range(DEPTH):
        if large.isEmpty():
            break
        one = F.pmod(F.xxhash64("bucket", F.lit(depth)), F.lit(SKETCH)).cast("int")
        two = F.pmod(one + 1 + F.pmod(F.xxhash64("bucket", F.lit(-1 - depth)), F.lit(SKETCH - 1)), F.lit(SKETCH)).cast("int")
        split = large.select("bucket", "rec", "n", "sketch", F.explode(F.array(one, two)).alias("k"))
        split = split.withColumn("bucket", F.xxhash64("bucket", "k", F.get("sketch", F.col("k")))).drop("k")
        counts = split.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
        rows = kept(split.join(counts, "bucket").select("bucket", "c", "rec", "n", "sketch"))
        leaves, large = leaves.unionByName(rows.where(F.col("c") <= LARGE)), rows.where(F.col("c") > LARGE)
    # what no split has made small is one group
    least = large.groupBy("bucket").agg(F.min("rec").alias("b"))
    rest = large.select("bucket", F.col("rec").alias("a")).join(least, "bucket").select("a", "b")

    @trimmed
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, ["bucket"]):
            bucket, ids, sizes = (rows[c].to_numpy() for c in ("bucket", "rec", "n"))
            sketches = rows["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, SKETCH)
            out: list = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            cut = _bounds([bucket])
            pair = cut[:-1][np.diff(cut) == 2]  # most buckets: compared all at once
            near = (sketches[pair] == sketches[pair + 1]).sum(1) >= ALIKE
            near &= np.minimum(sizes[pair], sizes[pair + 1]) >= threshold * np.maximum(sizes[pair], sizes[pair + 1]) - 1e-9
            out.append((ids[pair[near] + 1], ids[pair[near]]))
            for a, b in zip(cut[:-1], cut[1:]):
                if b - a > 2:
                    found: list = []
                    _search(ids[a:b], sizes[a:b], sketches[a:b], threshold, found, 0, int(bucket[a]) & (2**60 - 1))
                    if found:
                        out.append(_spanning(*(np.concatenate([x[k] for x in found]) for k in range(2))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x[k] for x in out])) for k in range(2)], ["a", "b"]
            )

    dealt = leaves.select("bucket", "rec", "n", "sketch").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(search, "a long, b long").unionByName(rest)


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets on the left with sets on the right."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    sets = [*left, *right]
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    often = np.bincount(where, minlength=len(values))[where] > 1
    where, owner = where[often], owner[often]
    where = np.unique(where, return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(where.max(initial=-1)) + 1, 2048):
        a, b = np.searchsorted(where, [first, first + 2048])
        has = np.zeros((len(sets), 2048), np.float32)
        has[owner[a:b], where[a:b] - first] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def links(docs: DataFrame, threshold=THRESHOLD, recall=RECALL, id_col="doc_id", text_col="text") -> DataFrame:
    """⟨id, class_id, set_id, n_copies, n_links⟩ per row of ``docs``, ``set_key``, the digest of
    its shingles, and ``class_key``, a number that no other class has."""
    small_batches(docs.sparkSession)
    runs = runs_for(recall)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    @trimmed
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                sets = [shingles(t) for t in part["text"].to_pylist()]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"],
                        pa.array(keys, pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([sketch(s) if len(s) else None for s in sets], pa.list_(pa.int32())),
                        pa.array([chosen(s, runs, threshold) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["id", "set_key", "n", "sketch", "buckets"],
                )

    fields = f"id {kind}, set_key binary, n long, sketch array<int>, buckets array<long>"
    read_ = kept(docs.mapInArrow(read, fields))
    sets = read_.where("n > 0").groupBy("set_key").agg(
        F.min("id").alias("set_id"),
        F.count("*").alias("n_copies"),
        F.first("n").alias("n"),
        F.first("sketch").alias("sketch"),
        F.first("buckets").alias("buckets"),
    )
    sets = kept(sets.withColumn("rec", F.monotonically_increasing_id()))

    groups = kept(components(_candidate_edges(sets, runs, threshold)))
    members = groups.select(F.col("node").alias("rec"), F.col("component").alias("grp")).join(
        sets.select("rec", "set_key", "set_id", "n"), "rec"
    )
    blocks = members.groupBy("grp").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("blocks"))
    members = kept(members.join(blocks, "grp"))

    # the sets of the members, read again: a bounded broadcast leaves out most other documents
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    slots = members.select(F.pmod(F.xxhash64("set_id"), F.lit(SLOTS)).alias("slot")).distinct()
    again = docs.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi")

    @trimmed
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                data = [shingles(t).tobytes() for t in batch.slice(first, 500)["text"].to_pylist()]
                keys = [hashlib.blake2b(s, digest_size=16).digest() for s in data]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["set_key", "tokens"]
                )

    tokens = again.select("text").mapInArrow(whole, "set_key binary, tokens binary")
    tokens = tokens.join(members.select("set_key"), "set_key", "left_semi").dropDuplicates(["set_key"])
    part = F.pmod(F.xxhash64("rec"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = (
        members.join(tokens, "set_key")
        .withColumn("part", part)
        .withColumn("other", F.explode(every))
        .select(
            "grp",
            F.least("part", "other").alias("i"),
            F.greatest("part", "other").alias("j"),
            "part",
            "rec",
            "tokens",
            "blocks",
        )
        .repartition("grp", "i", "j")
        .sortWithinPartitions("grp", "i", "j", "rec")
    )

    @trimmed
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, ["grp", "i", "j"]):
            grp, i, j, part, rec, blocks = (rows[c].to_numpy() for c in ("grp", "i", "j", "part", "rec", "blocks"))
            data = rows["tokens"].to_pylist()
            cut = _bounds([grp, i, j])
            out = [[], [], [], []]
            for a, b in zip(cut[:-1], cut[1:]):
                sets = [np.frombuffer(x, U64) for x in data[a:b]]
                for at, n, root in _linked(sets, part[a:b], i[a], j[a], threshold):
                    out[0].append(rec[a + at])
                    out[1].append(n)
                    out[2].append(rec[a + root])
                    out[3].append(blocks[a] > 1)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, kinds)], ["rec", "n_links", "root", "open"]
            )

    compared = kept(dealt.mapInArrow(compare, "rec long, n_links long, root long, open boolean"))
    joined = components(compared.where("open").select(F.col("rec").alias("a"), F.col("root").alias("b")))
    linked = compared.groupBy("rec").agg(F.sum("n_links").alias("n_links"), F.min("root").alias("root"))
    linked = linked.join(joined.withColumnRenamed("node", "rec"), "rec", "left").select(
        "rec", "n_links", F.coalesce("component", "root").alias("class")
    )
    known = sets.select("rec", "set_key", "set_id", "n_copies").join(linked, "rec", "left")
    known = kept(known.withColumn("class", F.coalesce("class", "rec")).withColumn("n_links", F.coalesce("n_links", F.lit(0))))
    names = known.groupBy("class").agg(F.min("set_id").alias("class_id"))
    known = known.join(names, "class").select(
        "set_key", "class_id", "set_id", "n_copies", "n_links", F.col("class").alias("class_key")
    )
    with_words = read_.where("n > 0").select("id", "set_key").join(known, "set_key")
    without = read_.where("n = 0").select(
        "set_key", "id", F.col("id").alias("class_id"), F.col("id").alias("set_id"),
        F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"),
        (-1 - F.monotonically_increasing_id()).alias("class_key"),
    )
    return with_words.unionByName(without).withColumnRenamed("id", id_col)


def _linked(sets, part, i, j, threshold):
    """⟨row, links, root⟩ of one task: all pairs of a block, or of two blocks with each other."""
    left = np.nonzero(part == i)[0]
    right = left if i == j else np.nonzero(part == j)[0]
    if not len(left) or not len(right):
        return
    size = np.array([len(s) for s in sets])
    both = _intersections([sets[k] for k in left], [sets[k] for k in right])
    near = both >= threshold * (size[left][:, None] + size[right][None] - both) - 1e-6
    if i == j:
        np.fill_diagonal(near, False)
        root = _forest(near)
        yield from zip(left, near.sum(1), left[root])
    else:
        full = np.zeros((len(sets), len(sets)), bool)
        full[np.ix_(left, right)] = near
        full |= full.T
        yield from zip(range(len(sets)), full.sum(1), _forest(full))


def one_of_each(docs: DataFrame, threshold=THRESHOLD, recall=RECALL, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` without all but one document of each class: the one with the smallest id stays,
    and of several rows with that id the one with the smallest text. A row without an id stays if its
    class has none; rows of different classes never compete, whatever their ids. Rows without a word are
    classes of their own, but of those with one id and one text one stays."""
    found = kept(links(docs, threshold, recall, id_col, text_col))
    several = found.groupBy(F.col(id_col).alias("_id")).agg(
        F.count("*").alias("_rows"), F.max(F.col(id_col).eqNullSafe(F.col("class_id"))).alias("_stays")
    )
    several = several.where("_stays AND _id IS NOT NULL")
    kept_rows = docs.join(several, docs[id_col] == F.col("_id"))
    alone = kept_rows.where("_rows = 1").select(docs.columns)
    # several rows with one id, or without one: told apart by their shingles
    tied = kept_rows.where("_rows > 1").select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))

    @trimmed
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch[text_col].to_pylist()]
            data = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "_key"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tied.schema)
    tied = kept(tied.mapInArrow(keys, f"{fields}, _key binary"))
    which = found.where("class_key >= 0").select(
        F.col("set_key").alias("_key"), F.col("class_id").alias("_first"), F.col("class_key").alias("_class")
    )
    text = F.coalesce(text_col, F.lit(""))
    row = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), text).alias("_row")
    with_words = tied.where("_key IS NOT NULL").join(which.distinct(), "_key")
    with_words = with_words.where(F.col(id_col).eqNullSafe(F.col("_first"))).groupBy("_class").agg(row)
    without = tied.where("_key IS NULL").groupBy(F.col(id_col).alias("_id"), text.alias("_text")).agg(row)
    tied = with_words.select("_row").unionByName(without.select("_row")).select("_row.*")
    return alone.unionByName(tied)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents")).drop("set_key", "class_key")
