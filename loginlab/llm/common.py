"""Helpers shared by the operators."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from functools import wraps

import pyarrow as pa

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlab.functions import skew

try:
    import public_tokenizers

    TOKENIZER_FOLDER = os.path.dirname(public_tokenizers.path("x"))
except ImportError:
    TOKENIZER_FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")

# fixed value: Unicode's white space, as a character class
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space after something else always begins a pre-token, so a text's tokens are those of
#: its segments: white space and what follows up to the next white space.
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

_kept: dict = {}


def per_process(key, make):
    """One object of a kind in each Python process, made when first asked for. Spark gives a process to another
    operator's steps later; the object of the one before goes then."""
    if key not in _kept:
        _kept.clear()
        _trim()
        _kept[key] = make()
    return _kept[key]


def _trim() -> None:
    """Gives unused memory of the process back."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


BATCH_BYTES = 4 * 2**20


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of at most about BATCH_BYTES (or fewer, if it has
    a smaller bound): 10,000 long texts at once would take several buffers of that size in both processes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).removesuffix("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def trimmed(run):
    """A step of ``mapInArrow`` that gives back the memory of its task at the end, before the
    process waits for another step of another operator."""

    @wraps(run)
    def tidy(batches):
        yield from run(batches)
        _trim()

    return tidy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local master takes a
    folder of its own; a cluster must have the setting."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared folder. Later steps start from the files,
    whatever happens to executors; Spark removes them when nothing refers to them any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A name for a new folder among the shared ones."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ⟨file, row in the file⟩ that tells its rows apart and stays the same however
    often and in whatever splits they are read. Rows that do not come from Parquet files are written first."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return df.select("*", at.alias(name))
    except AnalysisException:
        path = scratch_folder(df.sparkSession, "rows")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path).select("*", at.alias(name))


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, spread: str) -> DataFrame:
    """Left join of ``rows`` with ``groups``, whose hot keys are spread."""
    return skew.join_groups(rows, kept(groups), on, size, spread)
