"""Vector code compression: a codebook for each part of the vectors, assigned by a walk over a trie.

Components become integers, vectors are cut into parts, and the parts of all vectors are sorted: by position,
then component by component. A stretch of sorted parts is a lexicographic trie. A depth-first walk carries the
squared distances to all entries of a codebook down the trie, so parts that begin alike share what their
common components add; subtrees of bounded size are walked level by level at once. At a leaf, a
distinct part, the nearest entry is taken, and the part counts with the number of its vectors in the sums that
move the entries. Only sums and codebooks meet in the driver, whatever the number of vectors.

Vectors that are null, empty or hold null or non-finite components are dropped, and those of another than
the most frequent length (ties: the greater). A length that is no multiple of the number of parts is filled up with zeros.
Codebooks begin with the parts of the smallest ids (repeated rows count each, ordered by their components; null ids
never); with fewer ids there are fewer entries, with none, or an empty table, the result is empty. Repeated rows
are coded each. Distances and sums are exact whole numbers; components beyond 2^63, and errors beyond it, are set to
that bound. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlab.llm.common import join_groups, kept, remove, scratch_folder, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK = 2**16  # sorted parts that make a trie
SUBTREE = 2**13  # leaves of a subtree that is walked level by level
LARGEST = 2**63 - 1


def whole(vector: Column, scale: int) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))


def usable(rows: DataFrame, vector_col: str) -> DataFrame:
    x = F.col(vector_col)
    bad = F.exists(x.cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(x.isNotNull() & (F.size(x) > 0)).where(~bad)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Whole numbers as bytes that sort as the numbers do: one value of bytes per row."""
    signed = values.astype(f"i{width}")
    shifted = signed.view(f"u{width}") ^ np.array(1 << (8 * width - 1), f"u{width}")
    return np.ascontiguousarray(shifted.astype(f">u{width}")).view(np.uint8).reshape(len(values), -1)


def unpack(data: np.ndarray, width: int) -> np.ndarray:
    shifted = np.ascontiguousarray(data).view(f">u{width}").astype(f"u{width}")
    return (shifted ^ np.array(1 << (8 * width - 1), f"u{width}")).view(f"i{width}").astype(np.int64)


def _binary(data: np.ndarray) -> pa.Array:
    """Rows of a matrix of bytes as a column of binary values."""
    ends = np.arange(len(data) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


def _bytes(column: pa.Array, size: int) -> np.ndarray:
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[begin : begin + size * len(column)].reshape(-1, size)


class Trie:
    """Sorted parts of one position as a trie: ``leaf`` is the leaf of each row, ``part`` its components."""

    def __init__(self, parts: np.ndarray, kind):
        differs = parts[1:] != parts[:-1]
        new = np.append(True, differs.any(1))
        self.leaf = np.cumsum(new) - 1
        self.part = parts[new].astype(kind)
        #: the component at which a leaf leaves the path of the leaf before it
        self.turn = np.append(0, differs[new[1:]].argmax(1)) if len(self.part) > 1 else np.zeros(1, np.int64)

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each leaf the nearest entry (ties: the first), and its squared distance."""
        self.code = np.empty(len(self.part), np.int64)
        self.error = np.empty(len(self.part), self.part.dtype)
        self._walk(0, len(self.part), 0, np.zeros(len(book), self.part.dtype), book)
        return self.code, self.error

    def _walk(self, low: int, high: int, depth: int, so_far: np.ndarray, book: np.ndarray) -> None:
        """Leaves ``low`` to ``high``, which share ``depth`` components; ``so_far`` is what these add."""
        if high - low <= SUBTREE or depth == self.part.shape[1]:
            self._levels(low, high, depth, so_far, book)
            return
        child = low + np.nonzero(self.turn[low:high] <= depth)[0]
        child = np.append(child if child[0] == low else np.append(low, child), high)
        at = 0
        while at + 1 < len(child):
            # neighbours as long as they are small together, or one large child
            to = max(at + 1, int(np.searchsorted(child, child[at] + SUBTREE, "right")) - 1)
            if child[to] - child[at] <= SUBTREE:
                self._levels(child[at], child[to], depth, so_far, book)
            else:
                step = self.part[child[at], depth] - book[:, depth]
                self._walk(child[at], child[to], depth + 1, so_far + step * step, book)
            at = to

    def _levels(self, low: int, high: int, depth: int, so_far: np.ndarray, book: np.ndarray) -> None:
        turn = self.turn[low:high]
        total = so_far[None]
        above = np.zeros(high - low, np.int64)
        for d in range(depth, self.part.shape[1]):
            new = turn <= d
            new[0] = True
            first = np.nonzero(new)[0]
            step = self.part[low + first, d][:, None] - book[:, d][None]
            total = total[above[first]] + step * step
            above = np.cumsum(new) - 1
        code = total.argmin(1)
        self.code[low:high] = code[above]
        self.error[low:high] = total[np.arange(len(code)), code][above]


class Codes:
    """The layout of sorted parts, and the passes over them."""

    def __init__(self, parts: int, size: int, width: int, largest: int):
        self.parts, self.size, self.width = parts, size, width
        # whole numbers of any size where 64 bits might not hold a distance or a sum
        self.kind = np.int64 if (2 * largest) ** 2 * parts * size < 2**62 else object

    def tries(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int, Trie]]:
        """⟨rec of each row, position, trie⟩ of stretches of rows."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield from self._cut(held)
                held = []
        yield from self._cut(held)

    def _cut(self, held):
        held = [b for b in held if b.num_rows]
        if not held:
            return
        pos, rec = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("pos", "rec"))
        data = np.concatenate([_bytes(b["part"], self.size * self.width) for b in held])
        cut = np.append(np.append(0, np.nonzero(np.diff(pos))[0] + 1), len(pos))
        for a, b in zip(cut[:-1], cut[1:]):
            yield rec[a:b], int(pos[a]), Trie(unpack(data[a:b], self.width), self.kind)

    def split(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _bytes(batch["packed"], self.parts * self.size * self.width)
            rec = batch["rec"].to_numpy()
            for pos in range(self.parts):
                part = data[:, pos * self.size * self.width : (pos + 1) * self.size * self.width]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rec), pos, np.int32)), _binary(np.ascontiguousarray(part)), pa.array(rec)],
                    ["pos", "part", "rec"],
                )

    def sums(self, sorted_: DataFrame, books: np.ndarray) -> np.ndarray:
        """Per position and entry the sums of its parts' components, and their number."""
        shape = (self.parts, books.shape[1], self.size + 1)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, self.kind)
            for _, pos, trie in self.tries(batches):
                code, _ = trie.nearest(books[pos].astype(self.kind))
                weight = np.bincount(trie.leaf).astype(self.kind)[:, None]
                np.add.at(total[pos], code, np.concatenate([trie.part * weight, weight], axis=1))
            flat = total.ravel().tolist()
            slot = [k for k, x in enumerate(flat) if x]
            values = pa.array([Decimal(flat[k]) for k in slot], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), values], ["slot", "total"])

        rows = sorted_.mapInArrow(add, "slot int, total decimal(38,0)").groupBy("slot").agg(F.sum("total").alias("total"))
        out = np.zeros(int(np.prod(shape)), object)
        for slot, total in rows.collect():  # one row per number of the codebooks at most
            out[slot] = int(total)
        return out.reshape(shape)

    def assign(self, sorted_: DataFrame, books: np.ndarray) -> DataFrame:
        """⟨rec, pos, code, error⟩."""

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rec, pos, trie in self.tries(batches):
                near, error = trie.nearest(books[pos].astype(self.kind))
                error = np.minimum(error, LARGEST).astype(np.int64)
                columns = [rec, np.full(len(rec), pos, np.int32), near[trie.leaf].astype(np.int32), error[trie.leaf]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rec", "pos", "code", "error"])

        return sorted_.mapInArrow(code, "rec long, pos int, code int, error long")


def compress(
    rows: DataFrame, parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE, id_col="vec_id", vector_col="embedding", label_col="label"
) -> tuple[DataFrame, np.ndarray]:
    """⟨vec_id, label, code, error⟩, ``code`` a list of the entries of a vector's parts, and the codebooks
    (part, entry, component)."""
    spark = rows.sparkSession
    label = rows.schema[label_col].dataType.simpleString()
    good = usable(rows, vector_col).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), whole(F.col(vector_col), scale).alias("v")
    )
    largest = F.array_max(F.transform("v", lambda x: F.greatest(F.abs(F.greatest(x, F.lit(-LARGEST))), F.lit(0))))
    sizes = good.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(largest).alias("largest"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    out_fields = f"vec_id long, label {label}, code array<int>, error long"
    if most is None:
        return spark.createDataFrame([], out_fields), np.zeros((parts, 0, 0), object)
    size = -(-most["size"] // parts)
    width = next(w for w in (2, 4, 8) if most["largest"] < 2 ** (8 * w - 1))
    codes = Codes(parts, size, width, most["largest"])
    length = parts * size

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.zeros((batch.num_rows, length), np.int64)
            values[:, : most["size"]] = batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], _binary(pack(values, width))], ["id", "label", "packed"])

    fields = f"id long, label {label}, packed binary"
    good = good.where(F.size("v") == most["size"]).mapInArrow(packed, fields)
    landed = kept(good.withColumn("rec", F.monotonically_increasing_id()))
    first = landed.where("id IS NOT NULL").orderBy("id", "packed").limit(entries).select("packed").collect()
    if not first:
        return spark.createDataFrame([], out_fields), np.zeros((parts, 0, 0), object)
    begin = unpack(np.frombuffer(b"".join(bytes(r[0]) for r in first), np.uint8).reshape(len(first), -1), width)
    books = begin.reshape(len(first), parts, size).transpose(1, 0, 2).astype(object)

    # the parts in order; equal parts may lie in several tasks, so none is too large
    folder = scratch_folder(spark, "parts")
    split = landed.select("rec", "packed").mapInArrow(codes.split, "pos int, part binary, rec long")
    split.repartitionByRange("pos", "part", "rec").sortWithinPartitions("pos", "part").write.parquet(folder)
    sorted_ = spark.read.schema("pos int, part binary, rec long").parquet(folder)
    for _ in range(rounds):
        total = codes.sums(sorted_, books)
        used = total[..., -1] > 0
        books[used] = total[used][:, :-1] // total[used][:, -1:]
    found = codes.assign(sorted_, books).groupBy("rec")
    found = found.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("code"),
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("long").alias("error"),
    )
    found = kept(landed.select("rec", F.col("id").alias("vec_id"), "label").join(found, "rec").drop("rec"))
    remove(spark, folder)
    return found, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(table(spark, sf_dir, "embeddings"))
    found = found.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(0))})
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("long")
    labels = found.groupBy("_none", "_label").agg(total.alias("label_error"), F.count("*").alias("_n"))
    digits = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return join_groups(found, labels, ["_none", "_label"], "_n", "vec_id").select(
        "vec_id", F.concat_ws("", digits).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def _sql(rounds: int) -> str:
    near = """SELECT p.vec_id, p.p, p.part, min({{'d': list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.part, b.part)]),
    'e': b.e}}) AS best FROM parts p JOIN book{k} b ON p.p = b.p GROUP BY ALL"""
    out = [
        """vectors AS (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND NOT list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding]))""",
        """parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS part
  FROM vectors, (SELECT unnest(range(8)) AS p))""",
        """book0 AS MATERIALIZED (SELECT p, e, part FROM (
    SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 16)""",
    ]
    for k in range(rounds):
        out.append(f"near{k} AS MATERIALIZED ({near.format(k=k)})")
        out.append(
            f"""moved{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS part FROM (
    SELECT p, best.e AS e, i, sum(part[i]) AS s, count(*) AS n FROM near{k}, (SELECT unnest(range(1, 1025)) AS i)
    WHERE i <= len(part) GROUP BY ALL) GROUP BY ALL)"""
        )
        out.append(
            f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.part, b.part) AS part
  FROM book{k} b LEFT JOIN moved{k} m ON b.p = m.p AND b.e = m.e)"""
        )
    out.append(f"near{rounds} AS MATERIALIZED ({near.format(k=rounds)})")
    out.append(
        f"""codes AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id)"""
    )
    return f"""WITH {', '.join(out)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM codes JOIN vectors USING (vec_id)"""


ORACLE_SQL = _sql(ROUNDS)
