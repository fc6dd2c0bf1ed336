"""Long texts as rows of chunks, dealt out to all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(rows: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """⟨id, text⟩ to ⟨id, row_key, copies, pos, n_bytes, chunk⟩: chunk ``pos`` has ``size``
    characters from ``pos * size`` on, and up to ``overlap`` more.

    Rows are recognised by id and a digest of the text, so a repeated task deals the same rows;
    equal rows become one with their number in ``copies``. ``n_bytes`` leaves the overlap out."""
    kind = rows.schema["id"].dataType.simpleString()
    keyed = rows.withColumn("row_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    counted = keyed.groupBy("id", "row_key").agg(F.count("*").alias("copies"), F.max("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch["text"][i].as_py()
                one = batch.slice(i, 1)
                for first in range(0, len(text), size * 64):
                    starts = range(first, min(len(text), first + size * 64), size)
                    n = len(starts)
                    same = [one[c].take(pa.array([0] * n)) for c in ("id", "row_key", "copies")]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *same,
                            pa.array([s // size for s in starts], pa.int32()),
                            pa.array([len(text[s : s + size].encode()) for s in starts], pa.int64()),
                            pa.array([text[s : s + size + overlap] for s in starts], pa.string()),
                        ],
                        ["id", "row_key", "copies", "pos", "n_bytes", "chunk"],
                    )

    fields = f"id {kind}, row_key binary, copies long, pos int, n_bytes long, chunk string"
    return counted.mapInArrow(cut, fields).repartition("row_key", "pos")
