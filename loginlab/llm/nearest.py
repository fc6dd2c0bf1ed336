"""Approximate nearest neighbours with an adaptive dimension scan.

Vectors are dealt into lists by their nearest centroid. A query probes its nearest lists, each in
blocks: a block of vectors and a block of queries meet in one group of bounded size. Inside, vectors
are rotated at random and compared one block of columns after the other. From the partial
distance over ``d`` of ``D`` columns a hypothesis test decides whether the whole distance can still be among
the best: partial * D / d > bound * (1 + ERROR / sqrt(d))^2 abandons the candidate. Bounds come from the
query's nearest list and sink during the scan. Survivors are scored exactly, in double precision.

The largest inner product is searched as the smallest distance: every vector is divided by the greatest
norm and gets one more component that makes its norm one.

Null vectors, vectors with null or non-finite components, zero vectors, null ids and vectors of another
than the most frequent length (ties: the greater) take no part. Equal vectors are searched as one and
listed each; ties go to the smaller id. Repeated rows count once. Rows with the query's id are never its
neighbours. Other columns are ignored. An empty table gives an empty result.

Centroids are fitted on at most ``TRAINED_ON`` vectors and the number of probed lists on at most
``TUNED_ON`` queries against all vectors; every vector is indexed. A query probes further lists until they hold as
many vectors as it wants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loginlab.llm.common import kept, table

TRAINED_ON = 20_000
TUNED_ON = 64
LIST_SIZE = 1000
MOST_LISTS = 4096  # centroids go to every task: 4096 * 8 bytes * columns
RECALL = 0.98  # share of the tuned queries' neighbours that lie in the probed lists
VECTORS, QUERIES = 4096, 512  # rows of a block
COLUMNS = 16  # columns compared at a time
CHUNK = 512  # vectors after which bounds are tightened
ERROR = 2.1


def _same(values: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return np.array(values.flatten(), dtype=np.float64).reshape(len(values), -1)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    x = F.col("vector")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull()).where(~bad & F.exists(x, lambda v: v != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1)
    size = [r[0] for r in sizes.collect()]
    return rows.where(F.size("vector") == (size[0] if size else 0))


class Space:
    """Turns vectors into rotated points whose distance orders as the inner product."""

    def __init__(self, columns: int, greatest: float):
        self.greatest = greatest
        self.rotation = np.linalg.qr(np.random.default_rng(7).standard_normal((columns + 1, columns + 1)))[0]

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.greatest
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))
        return np.column_stack([x, rest]) @ self.rotation

    def queries(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.column_stack([x, np.zeros(len(x))]) @ self.rotation


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)


def _closest(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point, some thousand distances at a time."""
    step = max(1, 2_000_000 // len(centre))
    parts = [_squares(points[a : a + step], centre).argmin(1) for a in range(0, len(points), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def centroids(points: np.ndarray, n: int, rounds=12) -> np.ndarray:
    rng = np.random.default_rng(11)
    centre = points[rng.choice(len(points), min(n, len(points)), replace=False)]
    for _ in range(rounds):
        near = _closest(points, centre)
        total = np.zeros_like(centre)
        np.add.at(total, near, points)
        count = np.bincount(near, minlength=len(centre))[:, None]
        centre = np.where(count > 0, total / np.maximum(count, 1), centre)
    return centre


def adaptive_scan(points, queries, bounds, wanted: int):
    """Pairs ⟨query, point⟩ that may be among the ``wanted`` nearest of each query. ``bounds``
    holds a distance for each query that ``wanted`` points are known to be within, or infinity."""
    columns = points.shape[1]
    bounds = bounds.copy()
    best = [np.full((len(queries), wanted), np.inf)]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for first in range(0, len(points), CHUNK):
        part = points[first : first + CHUNK]
        known = np.zeros((len(queries), len(part)))
        known[:] = _squares(queries[:, :COLUMNS], part[:, :COLUMNS])
        q, p = np.nonzero(known <= _limit(bounds, min(COLUMNS, columns), columns)[:, None])
        so_far = known[q, p]
        for begin in range(COLUMNS, columns, COLUMNS):
            end = min(begin + COLUMNS, columns)
            gap = part[p, begin:end] - queries[q, begin:end]
            so_far = so_far + np.einsum("ij,ij->i", gap, gap)
            alive = so_far <= _limit(bounds, end, columns)[q]
            q, p, so_far = q[alive], p[alive], so_far[alive]
        pairs.append((q, p + first))
        if len(q):
            seen = np.full((len(queries), len(part)), np.inf)
            seen[q, p] = so_far
            near = np.concatenate([best[0], seen], axis=1)
            best[0] = np.partition(near, wanted - 1, axis=1)[:, :wanted]
            bounds = np.minimum(bounds, best[0][:, wanted - 1])
    return np.concatenate([q for q, _ in pairs]), np.concatenate([p for _, p in pairs]), bounds


def _limit(bounds, read: int, columns: int):
    if read == columns:
        return bounds * (1 + 1e-9) + 1e-12
    return bounds * read / columns * (1 + ERROR / np.sqrt(read)) ** 2 + 1e-12


def _blocks(column: Column, counts: dict[int, int], size: int) -> Column:
    """Number of blocks of a list, as a lookup among at most MOST_LISTS entries."""
    n = F.create_map(*[F.lit(v) for k, c in counts.items() for v in (k, -(-c // size))])
    return F.coalesce(n[column], F.lit(1))


def _meet(queries: DataFrame, index: DataFrame, space: Space, wanted: int) -> DataFrame:
    """⟨q, cid, score, bound⟩: each query's best in each group of its lists' blocks. ``queries``
    has q, vector, list and bound; ``index`` cid, least (its smallest id), vector and list."""
    asked = {r[0]: r[1] for r in queries.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    there = {r[0]: r[1] for r in index.groupBy("list").count().collect()}
    q_blocks, v_blocks = _blocks(F.col("list"), asked, QUERIES), _blocks(F.col("list"), there, VECTORS)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("q"), q_blocks)).withColumn("vb", every(v_blocks))
    right = index.withColumn("vb", F.pmod(F.xxhash64("cid"), v_blocks)).withColumn("qb", every(q_blocks))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "cid": [], "score": [], "bound": []})
        raw_q, raw_v = np.stack(a["vector"].to_numpy()), np.stack(b["vector"].to_numpy())
        q, p, bounds = adaptive_scan(
            space.points(raw_v), space.queries(raw_q), a["bound"].fillna(np.inf).to_numpy(), wanted
        )
        score = np.einsum("ij,ij->i", raw_q[q], raw_v[p])
        cid = b["cid"].to_numpy()[p]
        order = np.lexsort((b["least"].to_numpy()[p], -score, q))
        q, cid, score = q[order], cid[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, cid, score = q[place < wanted], cid[place < wanted], score[place < wanted]
        return pd.DataFrame({"q": a["q"].to_numpy()[q], "cid": cid, "score": score, "bound": bounds[q]})

    keys = ["list", "vb", "qb"]
    return (
        left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "q long, cid long, score double, bound double")
    )


def neighbours(
    rows: DataFrame, is_query: Column, k: int, id_col="id", vector_col="vector", list_size=LIST_SIZE, recall=RECALL
) -> DataFrame:
    """⟨query_id, rank, id, score⟩: for every row with ``is_query`` (a condition on ``id``) its ``k``
    rows with the largest inner products, as far as found."""
    spark = rows.sparkSession
    wanted = k + 1  # the query's own row is among its neighbours
    rows = usable(rows, id_col, vector_col).distinct()
    first = Window.partitionBy("vector").orderBy("id")
    smallest = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= wanted)
    classes = smallest.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = kept(classes.withColumn("cid", F.monotonically_increasing_id()))
    asked = rows.where(is_query).join(classes.select("vector", "cid"), "vector").select("id", F.col("cid").alias("q"))
    asked = kept(asked)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
    total, greatest, columns = classes.agg(F.count("*"), F.max(norm), F.max(F.size("vector"))).first()
    if not total:
        return asked.select(
            F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score")
        ).where("false")

    space = Space(columns, greatest)
    sample = classes.orderBy(F.xxhash64("vector")).limit(TRAINED_ON).select("vector").collect()
    lists = min(MOST_LISTS, max(1, -(-total // list_size)))
    centre = centroids(space.points(np.array([r[0] for r in sample])), lists)
    del sample

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _closest(space.points(_same(batch["vector"])), centre).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c] for c in ("cid", "least", "vector")), pa.array(near)], ["cid", "least", "vector", "list"]
                )

    numbered = classes.select("cid", F.col("ids")[0].alias("least"), "vector")
    index = kept(numbered.mapInArrow(assign, "cid long, least long, vector array<double>, list int"))
    sizes = np.zeros(len(centre), np.int64)
    for n, size in index.groupBy("list").count().collect():  # at most MOST_LISTS rows
        sizes[n] = size
    queries = classes.join(asked.select(F.col("q").alias("cid")).distinct(), "cid", "left_semi")
    queries = kept(queries.select(F.col("cid").alias("q"), "vector"))
    probes = _probes(index, queries, space, centre, wanted, recall)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, 2_000_000 // len(centre))
            for batch in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
                far = _squares(space.queries(_same(batch["vector"])), centre)
                near = np.argsort(far, axis=1, kind="stable").astype(np.int32)
                # more lists where the nearest ones are too small
                enough = (np.cumsum(sizes[near], axis=1) < wanted).sum(1) + 1
                lists = [row[: max(probes, n)] for row, n in zip(near, enough)]
                yield pa.RecordBatch.from_arrays(
                    [batch["q"], batch["vector"], pa.array(lists, pa.list_(pa.int32()))], ["q", "vector", "lists"]
                )

    probed = kept(queries.mapInArrow(probe, "q long, vector array<double>, lists array<int>"))
    home = probed.select("q", "vector", F.col("lists")[0].alias("list"), F.lit(None).cast("double").alias("bound"))
    near = kept(_meet(home, index, space, wanted))
    bounds = near.groupBy("q").agg(F.min("bound").alias("bound"))
    away = probed.select("q", "vector", F.explode(F.slice("lists", 2, len(centre))).alias("list")).join(bounds, "q", "left")
    more = probes > 1 or not away.isEmpty()
    found = near.unionByName(_meet(away, index, space, wanted)) if more else near

    best = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    listed = found.join(classes.select("cid", "ids", F.col("ids")[0].alias("least")), "cid")
    listed = listed.withColumn("n", F.row_number().over(best)).where(F.col("n") <= wanted)
    entry = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id")))
    listed = listed.groupBy("q").agg(F.flatten(F.collect_list(entry)).alias("near"))
    listed = listed.withColumn("near", F.slice(F.array_sort("near"), 1, wanted))
    answers = asked.select(F.col("id").alias("query_id"), "q").join(listed, "q")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("place", "x")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.far")).alias("score")
    )


def _probes(index, queries, space, centre, wanted, recall) -> int:
    """How many lists hold enough of the true neighbours of some queries, found among all rows."""
    some = queries.orderBy(F.xxhash64("vector")).limit(TUNED_ON).collect()
    if not some:
        return 1
    raw = np.array([r["vector"] for r in some])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = raw @ _same(batch["vector"]).T
                n = min(wanted, batch.num_rows)
                at = np.argpartition(-score, n - 1, axis=1)[:, :n]
                which = np.repeat(np.arange(len(raw)), n)
                lists = batch["list"].to_numpy()[at.ravel()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which), pa.array(score[which, at.ravel()]), pa.array(lists)], ["s", "score", "list"]
                )

    top = Window.partitionBy("s").orderBy(F.desc("score"))
    true = index.mapInArrow(nearest, "s long, score double, list int")
    true = true.withColumn("n", F.row_number().over(top)).where(F.col("n") <= wanted).select("s", "list").collect()
    order = np.argsort(_squares(space.queries(raw), centre), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.sort([place[r["s"], r["list"]] + 1 for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20, "vec_id", "embedding")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
