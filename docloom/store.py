"""Tables that several steps read: written to the folder that the cluster shares, and read back."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_OPEN = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="docloom-"))
    return _OWN[0]


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Owns what is written within it, in this thread: all intermediate tables go at its end, so results that rest on them are to be written or collected before.
    Tables written outside of any workspace stay until the folder is cleared."""
    root = f"{shared_folder(spark)}/docloom/work-{uuid.uuid4().hex}"
    _OPEN.roots = [*getattr(_OPEN, "roots", []), root]
    try:
        yield root
    finally:
        _OPEN.roots = [r for r in _OPEN.roots if r != root]
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, tag: str) -> str:
    roots = getattr(_OPEN, "roots", [])
    return f"{roots[-1] if roots else shared_folder(spark) + '/docloom'}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written and read back: computed once, however often it is read, and safe from lost executors."""
    path = new_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over the session's cores where its files make fewer splits than there are cores; large inputs stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
