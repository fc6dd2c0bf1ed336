"""Exact deduplication with streaming state on disk.

Documents are landed as fingerprints ⟨digest, id, row, locator⟩. A streaming aggregation keyed by
digest remembers, without expiry and in RocksDB, the row that stays (the largest id; among equal
ids the last row), where its content lies and how many rows had the digest. New files can be landed
and streamed later: the state goes on. Rows are combined before they are shuffled, so a digest that
holds a third of all rows costs one row per task. Digests seen more than once are hits: the full
bytes of their texts are compared, and texts that only share a digest are told apart.

Null text counts as empty. Equal rows, also those with equal ids, form a group of which one row stays;
a null id is smaller than any other. Extra columns are ignored, or kept by ``drop_copies``. An empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loginlab.llm.common import kept, shared_folder, table

FILES_PER_BATCH = 256
# fixed values: Spark's own state store on disk, without space set aside in each of many small ones
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _store(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", digest=sha256) -> DataFrame:
    """⟨digest, id, row, locator⟩; ``row`` numbers the rows once they are landed."""
    return docs.select(
        digest(F.coalesce(text_col, F.lit(""))).alias("digest"),
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.input_file_name().alias("locator"),
    )


def remember(prints: DataFrame, checkpoint: str) -> None:
    """Runs a stream of fingerprints through the state kept under ``checkpoint``, as far as
    there are files."""
    state = prints.groupBy("digest").agg(
        F.max(F.struct("id", "row", "locator")).alias("stays"), F.count("*").alias("n")
    )
    with _store(prints.sparkSession):
        query = (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """⟨digest, stays, n⟩ as the state holds them."""
    with _store(spark):
        rows = spark.read.format("statestore").load(checkpoint)
        stays, n = rows.schema["value"].dataType.names
        return kept(rows.select("key.digest", F.col(f"value.{stays}").alias("stays"), F.col(f"value.{n}").alias("n")))


def _texts(docs, id_col, text_col, digest) -> DataFrame:
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(digest(text).alias("digest"), F.col(id_col).alias("id"), text.alias("text"))


def copies(docs: DataFrame, id_col="doc_id", text_col="text", digest=sha256) -> DataFrame:
    """⟨id, digest, keep_id, group_size, kept, texts⟩ per row of ``docs``; ``texts`` is the number
    of different texts that the row's digest has."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/copies-{uuid.uuid4().hex}"
    prints = fingerprints(docs, id_col, text_col, digest)
    prints.write.parquet(f"{folder}/landed")
    landed = spark.read.schema(prints.schema).parquet(f"{folder}/landed")
    if landed.isEmpty():
        extra = {"keep_id": F.col("id"), "group_size": F.lit(0).cast("long"), "kept": F.lit(True), "texts": F.lit(1)}
        return landed.withColumns(extra).drop("row", "locator").withColumnRenamed("id", id_col)
    stream = spark.readStream.schema(prints.schema).option("maxFilesPerTrigger", FILES_PER_BATCH)
    remember(stream.parquet(f"{folder}/landed"), f"{folder}/state")
    state = remembered(spark, f"{folder}/state")

    # full bytes of the hits: each task passes on one row per digest and text
    hits = state.where("n > 1").select("digest")
    texts = _texts(docs, id_col, text_col, digest).join(hits, "digest", "left_semi")
    texts = texts.groupBy("digest", "text").agg(F.lit(1).alias("one"))
    mixed = kept(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1"))

    stays = state.select("digest", "stays", F.col("n").alias("group_size"))
    found = landed.join(stays, "digest").select(
        "id",
        "digest",
        F.col("stays.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"),
        F.lit(1).alias("texts"),
    )
    if not mixed.isEmpty():  # different texts share a digest: these are grouped by their bytes
        rows = _texts(docs, id_col, text_col, digest).join(mixed, "digest")
        rows = kept(rows.withColumn("row", F.monotonically_increasing_id()))
        groups = rows.groupBy("digest", "text").agg(
            F.max(F.struct("id", "row")).alias("stays"), F.count("*").alias("group_size")
        )
        apart = rows.join(groups, ["digest", "text"]).select(
            "id",
            "digest",
            F.col("stays.id").alias("keep_id"),
            "group_size",
            (F.col("row") == F.col("stays.row")).alias("kept"),
            F.col("texts").cast("int").alias("texts"),
        )
        found = found.join(mixed, "digest", "left_anti").unionByName(apart)
    return found.withColumnRenamed("id", id_col)


def drop_copies(docs: DataFrame, id_col="doc_id", text_col="text", digest=sha256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = kept(copies(docs, id_col, text_col, digest))
    # of an id and digest: how many rows, how many stay
    rows = found.groupBy(F.col("digest").alias("_digest"), F.col(id_col).alias("_id")).agg(
        F.count("*").alias("_rows"),
        F.count_if("kept").alias("_stay"),
        F.max("texts").alias("_texts"),
    )
    digest_of = digest(F.coalesce(text_col, F.lit("")))
    same = (F.col("_own") == F.col("_digest")) & F.col(id_col).eqNullSafe(F.col("_id"))
    marked = docs.withColumn("_own", digest_of).join(rows.where("_stay > 0"), same)
    plain = marked.where("_texts = 1")
    out = plain.where("_rows = 1").select(docs.columns)
    tied = plain.where("_rows > 1").dropDuplicates(["_own", id_col]).select(docs.columns)
    out = out.unionByName(tied)
    mixed = rows.where("_texts > 1").select(F.col("_digest").alias("_own")).distinct()
    if mixed.isEmpty():
        return out
    largest = Window.partitionBy("_own", F.coalesce(text_col, F.lit(""))).orderBy(F.col(id_col).desc_nulls_last())
    apart = docs.withColumn("_own", digest_of).join(mixed, "_own", "left_semi")
    apart = apart.withColumn("_n", F.row_number().over(largest)).where("_n = 1")
    return out.unionByName(apart.select(docs.columns))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.col("digest").alias("text_sha256"),
    )


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
