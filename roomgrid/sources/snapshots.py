"""Versioned snapshots of a table: every commit writes a whole new version, readers pin one.

A version is one folder ``<path>/v<number>-<batch>``, written by one Spark job.  Spark's output
committer puts ``_SUCCESS`` there after all tasks have committed, so that marker is the
commit: a folder without it (a write that failed, or lost its driver) is never read, and its
number is not used again.  A batch whose id is already committed is not written a second time,
so a job that is run again after a failure leaves the table as one run would.

One writer at a time per table.  A commit rewrites the table once; the driver lists one entry
per version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Version:
    number: int
    batch: str
    path: str
    committed: bool


def _listed(spark: SparkSession, path: str) -> list[Version]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    out = []
    for s in fs.listStatus(folder):
        number, dash, batch = s.getPath().getName().partition("-")
        if s.isDirectory() and dash and number[:1] == "v" and number[1:].isdigit():
            done = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
            out.append(Version(int(number[1:]), unquote(batch), s.getPath().toString(), done))
    return sorted(out, key=lambda v: v.number)


def versions(spark: SparkSession, path: str) -> list[Version]:
    """The committed versions, oldest first."""
    return [v for v in _listed(spark, path) if v.committed]


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """One committed version, the latest unless told; a later commit never changes its rows."""
    known = versions(spark, path)
    chosen = [v for v in known if number is None or v.number == number]
    if not chosen:
        raise LookupError(f"{path}: no committed version{'' if number is None else f' {number}'}")
    return spark.read.parquet(chosen[-1].path)


def commit(spark: SparkSession, path: str, batch: str,
           merge: Callable[[DataFrame | None], DataFrame]) -> Version:
    """Write ``merge(latest version, None if there is none)`` as the next version and return it.
    A batch that is already committed is left alone: its version is returned."""
    if not batch:
        raise ValueError("a batch needs an id")
    known = _listed(spark, path)
    done = [v for v in known if v.committed]
    for v in done:
        if v.batch == batch:
            return v
    number = known[-1].number + 1 if known else 1
    target = f"{path.rstrip('/')}/v{number:08d}-{quote(batch, safe='')}"
    merge(spark.read.parquet(done[-1].path) if done else None).write.parquet(target)
    made = _listed(spark, path)[-1]
    if made.number != number or not made.committed:
        raise RuntimeError(f"{target}: written without Spark's success marker or beside another writer")
    return made
