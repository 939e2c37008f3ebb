"""What the operators of this subpackage share: table reading, written intermediate tables, splits."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.store import new_folder

#: A word, as all operators here take it: no ASCII white space inside.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of 1,000 rows, where the session still has Spark's 10,000: long texts add up."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    tidy(spark)
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Share of its heap limit that the driver may hold before it collects its garbage.
HELD = 0.55


def tidy(spark: SparkSession) -> bool:
    """Has the driver collect its garbage where its heap has grown past HELD. Hundreds of short jobs leave plans, broadcasts and shuffle files behind, which
    Spark drops, and gives the memory of, only then."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() <= HELD * heap.maxMemory():
        return False
    gc.collect()
    spark._jvm.System.gc()
    return True


def give_back() -> None:
    """Returns free memory to the system. A Python worker lives on from stage to stage, and its allocators keep what an earlier stage took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def split_no(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


#: Rows of numbers up to which a table is broadcast; larger ones are joined by a shuffle.
FEW = 500_000


def sized(rows: DataFrame) -> DataFrame:
    """rows of a written table, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= FEW else rows
