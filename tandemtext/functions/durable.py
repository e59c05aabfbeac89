"""Results that outlive an executor: written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset and all runs on one machine, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tandemtext-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir("file://" + own)
    return "file://" + own


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/tandemtext/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """`df`, computed once and read back from Parquet in the shared folder: lineage ends here, and a lost executor loses nothing."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str = "step") -> tuple[DataFrame, str]:
    """As `written`, with the path, so that the table can be dropped when nothing reads it any more."""
    spark = df.sparkSession
    path = _path(spark, name)
    scopes = getattr(_open, "scopes", None)
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def consumed(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A scope whose written tables are deleted when it ends, also if it fails, but for those written by the function it gives.

    That function computes a result from the tables of the scope and writes it; the result belongs to the scope around, if there is one.
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    own: list[str] = []
    scopes.append(own)

    def keep(df: DataFrame, name: str = "result") -> DataFrame:
        scopes.pop()
        try:
            return written(df, name)
        finally:
            scopes.append(own)

    try:
        yield keep
    finally:
        scopes.pop()
        for path in own:
            drop_written(spark, path)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def drop_written(spark: SparkSession, path: str) -> None:
    """Deletes a table that `written_at` has made."""
    fs, at = _at(spark, path)
    fs.delete(at, True)
