"""Columns added to a stored log later, day by day, in a way that can be stopped and taken up again.

The columns of a day are written to a folder of the run first. Only when they are complete, an entry
of the manifest names that folder as the one in force, together with a fingerprint of the day's files in the
log. A day whose fingerprint is in the manifest is done: a repeated run passes over it, a stopped run goes on
with the days that are left, and a day whose files have changed is computed again. Readers see the folders in
force and nothing else. A log partitioned by ``month`` instead of ``d`` is taken month by month in the same way.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAYS_AT_ONCE = 31
# what a log may be partitioned by, from its days
PARTS = {"d": lambda: F.col("d").cast("string"), "month": lambda: F.date_format("d", "yyyy-MM")}


class Folder:
    """The few file operations that are needed, on whatever file system a path is in."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[tuple[str, int, int]]:
        """⟨name, bytes, time of the last change⟩ of what is in a folder."""
        if not self.fs.exists(self._path(name)):
            return []
        found = self.fs.listStatus(self._path(name))
        return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)

    def write(self, name: str, text: str) -> None:
        """A file that is there as a whole or not at all."""
        draft = f"_draft-{uuid.uuid4().hex}"
        out = self.fs.create(self._path(draft))
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self._path(name).getParent())
        if not self.fs.rename(self._path(draft), self._path(name)):
            raise FileExistsError(name)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def manifest(spark: SparkSession, path: str) -> dict[str, dict]:
    """Day -> ``folder, source, entry``: the entry with the greatest number of each day."""
    folder, out = Folder(spark, path), {}
    for name, _, _ in folder.names("_manifest"):
        day, number, _ = name.split(".")
        if day not in out or int(number) > out[day]["entry"]:
            out[day] = json.loads(folder.read(f"_manifest/{name}")) | {"entry": int(number)}
    return out


def _fingerprints(spark: SparkSession, log_path: str) -> tuple[str, dict[str, str]]:
    """The column that the log is partitioned by, and a fingerprint for each of its values."""
    log = Folder(spark, log_path)
    folders = [n for n, _, _ in log.names() if n.split("=")[0] in PARTS]
    part = folders[0].split("=")[0] if folders else "d"
    return part, {
        n.removeprefix(f"{part}="): hashlib.sha256(json.dumps(log.names(n)).encode()).hexdigest() for n in folders
    }


def backfill(
    log_path: str,
    path: str,
    compute: Callable[[DataFrame], DataFrame],
    spark: SparkSession,
    days_at_once: int = DAYS_AT_ONCE,
) -> list[str]:
    """Stores ``compute(rows)`` for every day of a log partitioned by ``d``; the days that were computed. ``compute``
    is given whole days and returns rows with ``d``, each from rows of its own day only. Of a log partitioned by
    month, days stands for months here."""
    part, source = _fingerprints(spark, log_path)
    done, out = manifest(spark, path), Folder(spark, path)
    in_force = {e["folder"].split("/")[0] for e in done.values()}
    for name, _, _ in out.names("data"):
        if name not in in_force:  # left by a run that was stopped
            out.remove(f"data/{name}")
    todo = sorted(d for d, f in source.items() if done.get(d, {}).get("source") != f)
    for first in range(0, len(todo), days_at_once):
        days = todo[first : first + days_at_once]
        run = uuid.uuid4().hex
        # only these folders are listed, not the whole log for every step
        rows = spark.read.option("basePath", log_path).parquet(*[f"{log_path}/{part}={d}" for d in days])
        result = compute(rows if part == "d" else rows.drop(part)).withColumn("day", PARTS[part]())
        # small days share a task and have a file each, large ones are split
        result.hint("rebalance", "day").write.partitionBy("day").parquet(f"{path}/data/{run}")
        for d in days:
            number = done.get(d, {}).get("entry", 0) + 1
            entry = {"folder": f"{run}/day={d}", "source": source[d]}
            out.write(f"_manifest/{d}.{number}.json", json.dumps(entry))
    return todo


def read_backfill(spark: SparkSession, path: str) -> DataFrame:
    """The rows in force."""
    entries = manifest(spark, path).values()
    return spark.read.parquet(*[f"{path}/data/{e['folder']}" for e in entries])
