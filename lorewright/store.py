"""Written tables that cut lineage and outlive lost executors."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs in one process, a new local one.

    On a cluster executors write to disks of their own, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lorewright_")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Seconds between two releases, so that loops of short jobs don't pay for one each.
RELEASE_S = 3.0
_released = 0.0
_written: list[str] = []


def _release(spark: SparkSession) -> None:
    """Lets Spark delete what finished jobs shuffled, which it does when their handles are collected."""
    global _released
    if time.monotonic() - _released >= RELEASE_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


def stored(df: DataFrame, name: str) -> DataFrame:
    """*df* written once as Parquet under the shared folder and read again.

    Later readers, and tasks run again after a lost executor, start from these files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    _release(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, first: int = 0, keep: DataFrame | None = None) -> int:
    """Deletes the tables that stored() wrote in this process from the *first* one on, but *keep*, and returns their number.

    For callers that have written their results: what was returned before can't be read any more.
    """
    kept = {p for f in (keep.inputFiles() if keep is not None else []) for p in _written[first:] if f"/{p.rsplit('/', 1)[1]}/" in f}
    gone = [p for p in _written[first:] if p not in kept]
    _written[first:] = kept
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in gone:
        path = hadoop(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def n_stored() -> int:
    """How many tables stored() has written and not deleted."""
    return len(_written)


def small_batches(spark: SparkSession, rows: int = 100_000, size: str = "4m") -> None:
    """Bounds what a Python worker holds at once: batches of about *size* of data, or *rows* narrow rows.

    Texts differ much in length, so a bound by bytes keeps memory level. Results don't depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
