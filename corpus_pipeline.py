"""From raw documents to packed training sequences.

Language ID drops texts without a language, exact deduplication keeps one of equal texts, the n-gram
Jaccard join keeps one document of each class of near copies, and best-fit packing lays out what is
left. All stages but the last return the columns of ``documents``."""

import uuid

from loginlab.llm.common import shared_folder
from loginlab.llm.exact_dedup import drop_copies
from loginlab.llm.languages import keep_identified
from loginlab.llm.near_duplicates import one_of_each
from loginlab.llm.packing import pack_documents

ORACLE_SQL = None  # the model of the first stage cannot be trained in SQL
STAGES = [
    ("language ID", lambda spark, docs, sf_dir: keep_identified(docs)),
    ("exact dedup", lambda spark, docs, sf_dir: drop_copies(docs)),
    ("n-gram Jaccard join", lambda spark, docs, sf_dir: one_of_each(docs)),
    ("best-fit packing", lambda spark, docs, sf_dir: pack_documents(docs)),
]


def run(spark, sf_dir):
    """The stages one after the other on ``documents``; each result but the last is written as Parquet
    to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
