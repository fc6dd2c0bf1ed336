"""Best-fit packing from a histogram of lengths.

The plan is made over the counts of each length, of which there are no more than the capacity:
longest first, all pieces of a length at once go to the sequences with the least room that still
fits them. The plan is a list of runs ⟨length, ranks, sequences, offset⟩. Pieces get their rank
within their length and take the slot of the run that holds it. No piece is cut but those longer
than the capacity.

Null text counts as empty and has one piece, the end token alone. Repeated rows are packed each. Equal
lengths are ranked by the hash and value of the order columns. Other columns of the pieces are kept; a
table without rows gives none.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loginlab.llm.common import TOKENIZER_FOLDER, kept, per_process, small_batches, table, trimmed

CAPACITY = 2048
END_ID = 0
MOST_WORDS, LONGEST = 200_000, 64  # encoded words in a generation that a process keeps; characters of one
SEPARATORS = re.compile("[\\x1c-\\x1f]")  # Python takes them for white space, Unicode does not
RANKED_TOGETHER = 50_000  # rows of one length that one task puts in order


class Memory(dict):
    """What was found last, in two generations: a full one becomes the older one, whose entries come back
    when they are asked for again. So frequent words are not encoded anew, and rare ones go."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= MOST_WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class WordEncoder:
    """Ids of a tokenizer file whose pre-tokens are words. Where a text has only characters
    below U+0180 and no special token, normalisation is lower-casing and white space only
    separates, so words are encoded one by one and remembered, without the marks beside them, which would make
    many of each; other texts go to the library whole. Both give the library's ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: 256 + n for n, b in enumerate(hidden)}  # how files write such bytes
        kind = lambda k: "".join(
            re.escape(c) for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == k
        )
        letters, numbers = kind("L"), kind("N")
        self.split = re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{letters}{numbers}\\s]+")
        self.beyond = re.compile("[^\\x00-\\u017f]")
        self.words = Memory(self.word)

    def word(self, word: str) -> bytes:
        found = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def plain(self, text: str) -> bool:
        if "<|" in text and re.search(r"<\|(?:startoftext|endoftext)\|>", text):
            return False
        if SEPARATORS.search(text):
            return False
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return not self.beyond.search(text)

    def __call__(self, text: str) -> bytes:
        if not self.plain(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, self.split.findall(text.lower())))


def token_pieces(
    docs: DataFrame, path: str, capacity=CAPACITY, end_id=END_ID, id_col="doc_id", text_col="text"
) -> DataFrame:
    """⟨id, piece, start, length, ids⟩: every document's ids and the end token, in pieces of
    ``capacity``; ids are little-endian unsigned 32-bit integers in a binary column."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("words", path), lambda: WordEncoder(path))
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                at, piece, ids = [], [], []
                for n, text in enumerate(part["text"].to_pylist()):
                    data = encoder(text) + end
                    for k, start in enumerate(range(0, len(data), capacity * 4)):
                        at.append(n)
                        piece.append(k)
                        ids.append(data[start : start + capacity * 4])
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"].take(pa.array(at, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array([k * capacity for k in piece], pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["id", "piece", "start", "length", "ids"],
                )

    pieces = rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary")
    return pieces.withColumnRenamed("id", id_col)


def best_fit(counts: dict[int, int], capacity: int):
    """Runs ⟨length, first rank, pieces, pieces per sequence, first sequence, offset⟩."""
    runs, rooms, groups, sequences = [], [], {}, 0

    def put(room, first, n):
        if n and room:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                room = rooms[k]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            each = room // length
            for bins, per in ((min(n, left // each), each), (1, left % each)):
                bins = min(bins, n)
                if bins and per and left:
                    runs.append((length, rank, bins * per, per, first, capacity - room))
                    put(room - per * length, first, bins)
                    rank, left, first, n = rank + bins * per, left - bins * per, first + bins, n - bins
                    if left >= each:  # the next group takes the rest
                        break
            put(room, first, n)
    return runs


def pack(pieces: DataFrame, capacity=CAPACITY, order=("doc_id", "piece"), length_col="length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Lengths are from 1 to ``capacity``, so the
    histogram that the driver sees has at most ``capacity`` rows."""
    spark = pieces.sparkSession
    pieces = kept(pieces)
    counts = {int(n): int(c) for n, c in pieces.groupBy(length_col).count().collect()}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("a length is not from 1 to the capacity")
    plan = spark.createDataFrame(
        best_fit(counts, capacity),
        "_length long, _first long, _pieces long, _each long, _sequence long, _offset long",
    )
    parts = spark.createDataFrame(
        [(n, -(-c // RANKED_TOGETHER)) for n, c in counts.items()], "_length long, _parts long"
    )
    rows = pieces.join(F.broadcast(parts), F.col(length_col) == F.col("_length")).withColumn(
        "_part", F.pmod(F.xxhash64(*order), F.col("_parts"))
    )
    before = rows.groupBy("_length", "_part").agg(F.count("*").alias("_n"))
    up_to = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_length", "_part", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_length", "_part").orderBy(*order)
    ranked = rows.withColumn("_place", F.row_number().over(here) - 1).join(before, ["_length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_place")).withColumnRenamed("_length", "_own")
    slot = (F.col("_own") == F.col("_length")) & F.col("_rank").between(
        F.col("_first"), F.col("_first") + F.col("_pieces") - 1
    )
    nth = F.col("_rank") - F.col("_first")
    placed = ranked.join(F.broadcast(plan), slot).select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("_own")).cast("long").alias("offset"),
    )
    return placed


def pack_documents(docs: DataFrame) -> DataFrame:
    path = f"{TOKENIZER_FOLDER}/word_bpe_49k.json"
    pieces = token_pieces(docs, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, order=("doc_id", "piece", "ids_crc32")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
