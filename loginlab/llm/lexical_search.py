"""Ranked lexical search in reverse.

The items are the index: their terms, each with the items that hold it, go to every task, in slices of a
bounded number of postings. The documents stream through a slice: a document's counts of the indexed
terms are turned into scores of all items at once, and each item keeps its best documents of the task in a
bounded heap. The heaps of all tasks are merged in two steps. A pass before that counts the documents that
hold each indexed term. Items with too many terms for a slice meet the documents' terms in a shuffle instead.

Null and empty texts have no term. Items without a term, or whose terms are in no document, have no
result. Repeated rows of items are answered each, repeated documents rank each. Equal scores are
ordered by the smaller id, a null id comes last; equal rows in any order. Texts are read piece by piece,
whatever their length. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loginlab.llm.common import kept, table

BEST = 20
SLICE = 500_000  # postings ⟨term, item⟩ that a task holds at a time
CELLS = 2_000_000  # scores, and products, that are worked out at a time
PIECE = 2**20  # bytes of a text that are split at a time
MERGED = 64  # parts that the heaps of an item are merged in first
#: A-Z to a-z; what is in no term becomes a space; bytes beyond ASCII belong to terms
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in pieces."""
    plain, at = text.translate(_PLAIN), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _rows(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in fields], [n for n, _ in fields])


def _counted(batches: Iterator[pa.RecordBatch], fields: str) -> Iterator[pa.RecordBatch]:
    """⟨row, id, text⟩ to ⟨row, id, n, term, times⟩."""
    for batch in batches:
        for row, id_, text in zip(batch["row"].to_pylist(), batch["id"].to_pylist(), _texts(batch["text"])):
            found: Counter = Counter()
            for piece in terms(text):
                found.update(piece)
            n, size = found.total(), len(found)
            yield _rows(fields, row=[row] * size, id=[id_] * size, n=[n] * size, term=list(found), times=list(found.values()))


def term_rows(rows: DataFrame) -> DataFrame:
    fields = "row long, id long, n long, term binary, times long"
    return rows.mapInArrow(lambda b: _counted(b, fields), fields)


class Index:
    """Terms of a slice of items, each with its items and how often it stands in them."""

    def __init__(self, postings: pa.Table):
        term = postings["term"].to_pylist()
        self.terms: dict[bytes, int] = {}
        number = np.fromiter((self.terms.setdefault(t, len(self.terms)) for t in term), np.int64, len(term))
        self.items, item = np.unique(postings["row"].to_numpy(), return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.item, self.times = item[order], postings["times"].to_numpy()[order]
        self.begin = np.searchsorted(number[order], np.arange(len(self.terms) + 1))

    def document(self, text: bytes) -> tuple[int, list[int], list[int]]:
        """Number of terms; indexed terms and their counts."""
        n, found = 0, Counter()
        for piece in terms(text):
            n += len(piece)
            found.update(filter(self.terms.__contains__, piece))
        return n, [self.terms[t] for t in found], list(found.values())


def statistics(docs: DataFrame, index) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and the documents that hold each indexed term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = np.zeros(len(index.value.terms) + 2, np.int64)
        for batch in batches:
            for text in _texts(batch["text"]):
                n, found, _ = index.value.document(text)
                holds[found] += 1
                holds[-2:] += (n > 0, n)
        at = np.nonzero(holds)[0]
        yield _rows("at long, n long", at=at, n=holds[at])

    sums = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    total = np.zeros(len(index.value.terms) + 2, np.int64)
    for at, n in sums.collect():  # at most SLICE + 2 rows
        total[at] = n
    return int(total[-2]), int(total[-1]), total[:-2]


class Heaps:
    """The best documents of every item of an index; the worst of them lies on top."""

    def __init__(self, items: int, best: int):
        self.best = best
        self.least = np.ones(items, np.int64)
        self.rows: list[list] = [[] for _ in range(items)]

    def update(self, scores: np.ndarray, ids: list) -> None:
        """``scores`` has a row per document and a column per item."""
        for doc, item in zip(*(x.tolist() for x in np.nonzero(scores >= self.least))):
            rows, id_ = self.rows[item], ids[doc]
            entry = (int(scores[doc, item]), id_ is not None, -(id_ or 0))
            if len(rows) < self.best:
                heapq.heappush(rows, entry)
            elif entry > rows[0]:
                heapq.heapreplace(rows, entry)
            if len(rows) == self.best:
                self.least[item] = rows[0][0]


def _scan(docs: DataFrame, index, documents: int, words: int, weights: np.ndarray, best: int) -> DataFrame:
    """⟨item, id, score⟩: the heaps of all tasks."""

    def scores(batch: list, items: int) -> np.ndarray:
        doc = np.repeat(np.arange(len(batch)), [len(found) for _, found, _ in batch])
        length = np.array([n for n, _, _ in batch], np.int64)
        term = np.array([t for _, found, _ in batch for t in found], np.int64)
        tf = np.array([c for _, _, times in batch for c in times], np.int64)
        m = 100 - 25 + (25 * length * documents) // max(1, words)
        part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        ix = index.value
        many = ix.begin[term + 1] - ix.begin[term]
        at = np.repeat(ix.begin[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
        out = np.zeros(len(batch) * items, np.int64)
        np.add.at(out, np.repeat(doc, many) * items + ix.item[at], np.repeat(part, many) * ix.times[at])
        return out.reshape(len(batch), items)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        heaps = Heaps(len(ix.items), best)
        ids: list = []
        held: list = []
        work = 0
        for batch in batches:
            for id_, text in zip(batch["id"].to_pylist(), _texts(batch["text"])):
                n, found, times = ix.document(text)
                if not found:
                    continue
                ids.append(id_)
                held.append((n, found, times))
                work += int((ix.begin[np.array(found) + 1] - ix.begin[found]).sum()) + len(ix.items)
                if work > CELLS:
                    heaps.update(scores(held, len(ix.items)), ids)
                    ids, held, work = [], [], 0
        if held:
            heaps.update(scores(held, len(ix.items)), ids)
        for item, rows in zip(ix.items.tolist(), heaps.rows):
            if rows:
                ids = [-i if known else None for _, known, i in rows]
                yield _rows("item long, id long, score long", item=[item] * len(rows), id=ids, score=[s for s, _, _ in rows])

    return docs.select("id", "text").mapInArrow(stream, "item long, id long, score long")


def _weight(documents: int, holds) -> Iterator[int]:
    return (math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holds)


def _by_terms(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """⟨item, id, score⟩ of items whose terms do not fit into a slice, by a join on the term."""
    found = kept(term_rows(docs.withColumn("row", F.monotonically_increasing_id())))
    each = found.select("row", "n").distinct()
    n_docs, n_words = each.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holds = found.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    m = f"(100 - 25 + (25 * n * {n_docs}L) div {max(1, n_words)}L)"
    asked = postings.select(F.col("row").alias("item"), "term", F.col("times").alias("often"))
    asked = asked.join(holds, "term").select("item", "term", (weight * F.col("often")).alias("w"))
    part = F.expr(f"w * ((1000000000L * times) div (1000L * times + 12L * {m}))")
    return found.join(asked, "term").groupBy("item", "row", "id").agg(F.sum(part).alias("score")).where("score > 0").drop("row")


def _best(rows: DataFrame, best: int, *by: str) -> DataFrame:
    order = Window.partitionBy("item", *by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(
    items: DataFrame, docs: DataFrame, best=BEST, item_id="item_id", item_text="text", doc_id="doc_id", doc_text="text",
    slice_size=SLICE,
) -> DataFrame:
    """⟨item_id, rank, doc_id, score⟩: the ``best`` documents of each item."""
    spark = items.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).cast("string").alias("text"))
    asked = items.select(F.col(item_id).alias("_item"), F.col(item_text).cast("string").alias("text"))
    asked = kept(asked.withColumn("item", F.monotonically_increasing_id()))
    postings = kept(term_rows(asked.select(F.col("item").alias("row"), F.lit(None).cast("long").alias("id"), "text")))
    sizes = kept(postings.groupBy("row").agg(F.count("*").alias("size")))
    fits = sizes.where(F.col("size") <= max(1, slice_size // 8))
    total = fits.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slices = -(-2 * total // slice_size)  # half full on average
    slice_of = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    while slices and fits.groupBy(slice_of(slices)).agg(F.sum("size").alias("n")).where(F.col("n") > slice_size).count():
        slices += 1
    heaps = []
    for k in range(slices):
        part = postings.join(fits, "row", "left_semi").where(slice_of(slices) == k).select("row", "term", "times").toArrow()
        if part.num_rows:
            index = spark.sparkContext.broadcast(Index(part))
            n_docs, n_words, holds = statistics(docs, index)
            weights = np.fromiter(_weight(n_docs, holds), np.int64, len(holds))
            found = _scan(docs, index, n_docs, n_words, weights, best)
            heaps.append(kept(found) if slices > 1 else found)
    large = sizes.where(F.col("size") > max(1, slice_size // 8))
    if not large.isEmpty():
        heaps.append(_by_terms(postings.join(large, "row", "left_semi"), docs))
    if not heaps:
        heaps = [spark.createDataFrame([], "item long, id long, score long")]
    rows = heaps[0]
    for other in heaps[1:]:
        rows = rows.unionByName(other)
    rows = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    merged = _best(_best(rows, best, "part").drop("part", "rank"), best)
    return merged.join(asked.select("item", "_item"), "item").select(
        F.col("_item").alias(item_id), "rank", F.col("id").alias(doc_id), "score"
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE_SQL = r"""
WITH plain AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM plain GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
holds AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
wanted AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS often FROM wanted GROUP BY ALL),
weights AS (
  SELECT item_id, term, often * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM asked JOIN holds USING (term), corpus),
scores AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // words)))))::BIGINT AS score
  FROM weights JOIN counts USING (term) JOIN lengths USING (doc_id), corpus GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scores WHERE score > 0) WHERE rank <= 20
"""
